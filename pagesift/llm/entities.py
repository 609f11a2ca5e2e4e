"""Personal data in one text: where it is, its normal form, and stand-ins for it.

A mention has a kind (which carries gender and script for names) and a normal
form; mentions with equal kind and normal form are the same entity. A stand-in
is drawn from a keyed hash of both and an attempt number, in the shape of its
kind, and then written in the format of the mention.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

# Titles and given names that tell a person's gender.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Señora", "Señorita", "Doña", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Hans", "Klaus", "Jürgen",
          "Pierre", "Jacques", "Michel", "Carlos", "José", "Miguel", "Иван", "Сергей", "Дмитрий", "Γιώργος"],
    "f": ["Mary", "Patricia", "Jennifer", "Elizabeth", "Susan", "Sarah", "Emma", "Anna", "Julia", "Ursula", "Monika", "Sabine",
          "Claire", "Sophie", "Hélène", "Carmen", "Lucía", "Isabel", "Анна", "Мария", "Ольга", "Ελένη"],
}
SOUNDS = {
    "latin": ("b c d f g h l m n p r s t v".split(), "a e i o u".split()),
    "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split()),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο".split()),
}
ENDINGS = {
    "latin": {"m": "rd", "f": "na", "n": "lin", "family": "ston"},
    "cyrillic": {"m": "слав", "f": "на", "n": "ль", "family": "енко"},
    "greek": {"m": "ος", "f": "νη", "n": "ις", "family": "ίδης"},
}
GENDER_OF = {w.casefold(): g for g, words in GIVEN.items() for w in words}
TITLE_OF = {w: g for g, words in TITLES.items() for w in words}


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    normal: str


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn_rest(number: str) -> int:
    """0 for a valid number."""
    total = sum(map(int, number[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])) % 10


def iban_rest(value: str) -> int:
    """1 for a valid account number."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def script_of(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


# Letters, also joined by single hyphens and apostrophes, as in O'Brien; 's is no part of a name.
WORD = r"[^\W\d_]+(?:['’-](?!s(?!\w))[^\W\d_]+)*"
NAMED = "|".join(sorted((re.escape(w) for g in GIVEN.values() for w in g), key=len, reverse=True))
TITLED = "|".join(sorted((re.escape(w) for w in TITLE_OF), key=len, reverse=True))
# Every pattern starts where a run of its characters starts, so a scan is linear.
NAME = re.compile(rf"(?<!\w)(?:({TITLED})\.?[ \t]+({WORD})(?:[ \t]+({WORD}))?|({NAMED})[ \t]+({WORD}))(?!\w)")
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.ASCII)
SECRET = re.compile(
    r"(?<!\w)(?:(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?!\w)"
    r"|(?i:password|passwd|token|secret|api[_-]?key)[ \t]*[=:][ \t]*[\"']?([^\s\"',;]{6,}))"
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")
IP4 = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
IP6 = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(
    r"(?<![\w.+])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}"
    r"|0\d{2,4}[ /-]\d{6,8})(?!\w)"
)


def national(number: str) -> str:
    return number[1:] if len(number) == 11 and number[0] == "1" else number


TOKEN = re.compile(rf"(?<!\w){WORD}(?!\w)")


def all_names(text: str) -> list[Mention]:
    """Names that a title or a given name shows, and where else their words stand as they do there.

    So a person named once with a title is also replaced where only the family
    name is said, as the same person.
    """
    shown = list(found_names(text))
    kinds: dict[str, Mention] = {}
    for m in shown:
        kinds.setdefault(text[m.start : m.end], m)
    if not kinds:
        return shown
    taken = {m.start for m in shown}
    for m in TOKEN.finditer(text):
        known = kinds.get(m.group())
        if known and m.start() not in taken:
            shown.append(Mention(*m.span(), known.kind, known.normal))
    return shown


def found_names(text: str) -> Iterator[Mention]:
    for m in NAME.finditer(text):
        title, first, second, given, family = m.groups()
        if title:
            gender = TITLE_OF[title]
            parts = [2] if second is None or not second[0].isupper() else [2, 3]
        else:
            gender, parts = GENDER_OF[given.casefold()], [4, 5]
        if not all(m.group(i)[0].isupper() for i in parts):
            continue
        if len(parts) == 2 and gender == "n":
            gender = GENDER_OF.get(m.group(parts[0]).casefold(), "n")
        for i in parts:
            word = m.group(i)
            role = "family" if i == parts[-1] else gender
            yield Mention(m.start(i), m.end(i), f"name/{script_of(word)}/{role}", word.casefold())


def found_numbers(text: str) -> Iterator[Mention]:
    for m in IBAN.finditer(text):
        value = m.group().replace(" ", "")
        if iban_rest(value) == 1:
            yield Mention(*m.span(), "iban", value)
    for m in CARD.finditer(text):
        value = digits(m.group())
        if not luhn_rest(value):
            yield Mention(*m.span(), "card", value)
    for m in IP4.finditer(text):
        parts = m.group().split(".")
        if all(int(p) < 256 for p in parts):
            yield Mention(*m.span(), "ip", ".".join(str(int(p)) for p in parts))
    for m in IP6.finditer(text):
        yield Mention(*m.span(), "ip6", ":".join(f"{int(p, 16):x}" for p in m.group().split(":")))
    for m in SSN.finditer(text):
        yield Mention(*m.span(), "ssn", digits(m.group()))
    for m in PHONE.finditer(text):
        value = digits(m.group())
        if 8 <= len(value) <= 15:
            yield Mention(*m.span(), "phone", national(value))


def mentions(text: str) -> list[Mention]:
    """All mentions in order; of overlapping ones the first kind found stays.

    The order of kinds: secrets, e-mail, account, card, address, security and
    phone numbers, names.
    """
    found: list[Mention] = []
    if any(c in text for c in ("=", ":", "AKIA", "gh")):
        for m in SECRET.finditer(text):
            i = 1 if m.group(1) else 2
            found.append(Mention(*m.span(i), "secret", m.group(i)))
    if "@" in text:
        found += [Mention(*m.span(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    if re.search("[0-9]", text):
        found += found_numbers(text)
    found += all_names(text)
    if len(found) < 2:
        return found
    rank = sorted(range(len(found)), key=lambda i: (found[i].start, i))
    kept: list[int] = []
    for i in rank:
        if kept and found[i].start < found[kept[-1]].end:
            kept[-1] = min(kept[-1], i)
            continue
        kept.append(i)
    out = sorted(found[i] for i in kept)
    return [m for i, m in enumerate(out) if not i or m.start >= out[i - 1].end]


class Draw:
    """Numbers from a keyed hash; the same for the same words."""

    def __init__(self, key: bytes, *words: str) -> None:
        self.seed = hashlib.blake2b("\0".join(words).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest()
        self.left, self.block = 0, 0

    def below(self, n: int) -> int:
        if self.left < n << 32:
            more = hashlib.blake2b(self.block.to_bytes(8, "big"), key=self.seed).digest()
            self.left, self.block = int.from_bytes(more, "big"), self.block + 1
        self.left, out = divmod(self.left, n)
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def shaped(self, like: str, hexadecimal: bool = False) -> str:
        """Lower, upper and digit stay such; other characters stay."""
        def one(c: str) -> str:
            if hexadecimal and c in "0123456789abcdef":
                return "0123456789abcdef"[self.below(16)]
            if c in "0123456789":
                return str(self.below(10))
            if c.isalpha():
                letter = chr(97 + self.below(26))
                return letter.upper() if c.isupper() else letter
            return c

        return "".join(map(one, like))


def wider(attempt: int) -> int:
    """Characters added to a shape whose stand-ins collided eight times and more."""
    return max(0, attempt - 7)


def email(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    local, _, domain = normal.partition("@")
    head, _, top = domain.rpartition(".")
    return f"{draw.shaped(local + 'x' * wider(attempt))}@{Draw(key, 'domain', head).shaped(head)}.{top}"


def phone(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    if len(normal) == 10:
        middle = "555" if attempt < 3 else f"{2 + draw.below(8)}{draw.digits(2)}"
        return f"{2 + draw.below(8)}{draw.digits(2)}{middle}{draw.digits(4)}" + draw.digits(wider(attempt))
    return normal[:2] + draw.digits(len(normal) - 2 + wider(attempt))


def card(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    body = normal[0] + draw.digits(len(normal) - 2 + wider(attempt))
    return next(body + str(c) for c in range(10) if not luhn_rest(body + str(c)))


def iban(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    body = draw.shaped(normal[4:] + "0" * wider(attempt))
    return f"{normal[:2]}{98 - iban_rest(normal[:2] + '00' + body):02d}{body}"


def ip(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    a, b, *_ = map(int, normal.split("."))
    if a in (10, 127):
        head = [str(a), str(draw.below(256))]
    elif (a, b) == (192, 168) or (a, b) == (169, 254):
        head = [str(a), str(b)]
    elif a == 172 and 16 <= b < 32:
        head = ["172", str(16 + draw.below(16))]
    else:
        plain = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]
        head = [str(plain[draw.below(len(plain))]), str(draw.below(256))]
    # A private range that is full goes on in the public ones.
    if wider(attempt) and len(head) and a in (10, 127, 169, 172, 192):
        head = [str(11 + draw.below(100)), str(draw.below(256))]
    return ".".join([*head, str(draw.below(256)), str(draw.below(256))])


def ip6(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    return ":".join(["2001", "db8", *(f"{draw.below(65536):x}" for _ in range(6))])


def ssn(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    return f"{100 + draw.below(566):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + draw.digits(wider(attempt))


def secret(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
    head = next((p for p in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_") if normal.startswith(p)), "")
    rest = normal[len(head) :] + "0" * wider(attempt)
    return head + draw.shaped(rest, bool(re.fullmatch("[0-9a-f]+", rest)))


def name(kind: str) -> Callable[[str, Draw, int, bytes], str]:
    _, script, role = kind.split("/")

    def of(normal: str, draw: Draw, attempt: int, key: bytes) -> str:
        hard, soft = SOUNDS[script]
        count = 2 + (attempt > 1) + wider(attempt)
        syllables = "".join(hard[draw.below(len(hard))] + soft[draw.below(len(soft))] for _ in range(count))
        return syllables + ENDINGS[script][role]

    return of


MAKERS = {
    "email": email, "phone": phone, "card": card, "iban": iban, "ip": ip, "ip6": ip6, "ssn": ssn, "secret": secret,
}


def surrogate(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """The stand-in's normal form."""
    maker = name(kind) if kind.startswith("name/") else MAKERS[kind]
    return maker(normal, Draw(key, kind, normal, str(attempt)), attempt, key)


def space(kind: str) -> str:
    """Kinds whose stand-ins must differ from each other."""
    return "name" if kind.startswith("name/") else kind


def written(mention: str, kind: str, value: str) -> str:
    """The stand-in in the mention's format: separators, prefix, case."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = [c for c in mention if c.isalnum()]
        extra = max(0, len(signs) - len(value))
        new = iter(mention_prefix(mention, extra) + value)
        out = "".join(next(new, "") if c.isalnum() else c for c in mention)
        return out + "".join(new)
    if kind.startswith("name/"):
        return value.upper() if mention.isupper() and len(mention) > 1 else value[0].upper() + value[1:]
    if kind in ("email", "ip6"):
        return value.upper() if mention.isupper() else value
    return value


def mention_prefix(mention: str, n: int) -> str:
    return "".join([c for c in mention if c.isalnum()][:n])
