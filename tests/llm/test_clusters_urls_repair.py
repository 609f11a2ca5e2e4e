"""Centroid clustering, path templates and conversation repair against plain versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagesift.llm import centroids, repair, url_templates


def clashing(df, names):
    """Extra columns whose names clash with those that the operators use."""
    own = df.columns
    for i, _ in enumerate(names):
        df = df.withColumn(f"x{i}", F.lit(i))
    return df.toDF(*own, *names)


# --- centroids -------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centres)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    small = lambda n: n if n < 2**63 else None
    total = sum(d for _, _, d in found)
    return sorted(
        ((i, c, small(d), small(sum(e for _, b, e in found if b == c)), small(total),
          hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("size", [1.0, 1e4, 1e30])
def test_clusters_equal_plain_ones_at_any_magnitude(spark, size):
    draw = random.Random(size)
    rows = [(i, [size * draw.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [(1000 + i, [0.25 * size, -size, size, 0.0]) for i in range(60)]  # a third are equal
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [size] * 4), (None, [size] * 4)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0]), (2003, [1.0, float("nan"), 1.0, 1.0]),
             (2004, [1.0, float("inf"), 1.0, 1.0]), (2005, [1.0] * 3), (2006, [1.0] * 5)]
    df = clashing(vectors(spark, rows), ["cluster", "distance", "VEC_ID", "vector", "a.b"]).repartition(7)
    found = centroids.clustered(df, dimensions=4, rounds=6)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_clusters(rows, 8, 6, 4)


def test_clusters_of_few_or_no_vectors(spark):
    few = [(1, [0.5, 0.5]), (2, [-3.0, 2.0])]
    found = centroids.clustered(vectors(spark, few), dimensions=2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_clusters(few, 8, 10, 2)
    none = centroids.clustered(vectors(spark, [(1, None)]), dimensions=2)
    assert none.count() == 0 and none.columns == found.columns
    assert centroids.clustered(vectors(spark, [])).count() == 0


def test_cluster_sums_are_whole_beyond_64_bits():
    for value in (0, 5, -5, 10**24, -(10**24) - 1, 3 * 10**60):
        assert sum(d * centroids.BASE**p for p, d in centroids.digits(value)) == value


# --- urls ------------------------------------------------------------------------


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for kind, rule in rules:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append((len(rule), len(own), kind == "block", kind, rule))
    return host, path, max(fits)[3:] if fits else None


def plain_tree(urls, rules):
    """The tree of all urls, node by node: template and purity of each url."""
    t = url_templates
    out = [None] * len(urls)
    hosts = defaultdict(list)
    for i, url in enumerate(urls):
        host, path, rule = plain_rule(url, rules)
        parts = [s for s in path.split("/") if s]
        if len(parts) > t.DEPTH:
            parts = parts[: t.DEPTH - 1] + ["/".join(parts[t.DEPTH - 1:])]
        hosts[host].append((i, parts, rule))

    def kind(parts, k):
        s = parts[k] if k < len(parts) else None
        if s is None:
            return "end"
        if s.isascii() and s.isdigit():
            return "digits"
        if s.isascii() and s.isalpha():
            return "letters"
        tail = s.rpartition(".")[2]
        return "file" if "." in s and tail.isascii() and tail.isalpha() and 2 <= len(tail) <= 5 else "other"

    def measured(rows):
        labelled = [r for r in rows if r[2]]
        return sum(r[2][0] == "block" for r in labelled), len(labelled)

    def grow(rows, level, template, purity):
        for i, parts, _ in rows:
            out[i] = (template, purity)
        rows = [r for r in rows if len(r[1]) > level]
        children = defaultdict(list)
        for r in rows:
            children[r[1][level]].append(r)
        named = {s: c for s, c in children.items() if len(c) >= t.FEWEST and len(c) * t.SHARE >= len(rows)}

        def like(x, y):
            a, b = named[x], named[y]
            apart = 0.5 * sum(abs(sum(kind(r[1], level + 1) == s for r in a) / len(a) - sum(kind(r[1], level + 1) == s for r in b) / len(b))
                              for s in t.SHAPES)
            (ba, la), (bb, lb) = measured(a), measured(b)
            if apart > 0.25 + 1e-12 or (la == 0) != (lb == 0):
                return False
            if not la:
                return True
            p = (ba + bb) / (la + lb)
            return abs(ba / la - bb / lb) <= 2 * math.sqrt(p * (1 - p) * (1 / la + 1 / lb)) + 1e-12

        left = set(named)
        groups = []
        while left:
            group, open_ = set(), {left.pop()}
            while open_:
                s = open_.pop()
                group.add(s)
                near = {o for o in left if like(s, o)}
                left -= near
                open_ |= near
            groups.append(group)
        for group in [*groups, None]:
            segments = group if group is not None else set(children) - set(named)
            below = [r for s in segments for r in children[s]]
            if below:
                label = "*" if group is None else "|".join(sorted(group)) if len(group) == 1 else f"({'|'.join(sorted(group))})"
                b, n = measured(below)
                grow(below, level + 1, f"{template}/{label}", (b + t.PRIOR * purity) / (n + t.PRIOR))

    for rows in hosts.values():
        b, n = measured(rows)
        grow(rows, 0, "", (b + t.PRIOR * t.EVEN) / (n + t.PRIOR))
    return out


ODD_URLS = [
    None, "", "no url", "://", "http://", "HTTP://ORG", "http://org/", "http://a.ORG/x", "http://xorg/", "http://org:80/", "http://Ä.org/É/",
    "http://example.org/en/1", "http://m.example.org/en/19?x#y", "http://example.org/en#/1", "http://a.com/fr", "http://a.com/fr/",
    "http://a.com/de/x/y", "x://b.com?/fr/", "http://b.com//de/", "http://q.net/" + "/".join("abcdefghijkl"), "http://q.net/" + "z" * 50_000,
    "http://q.net/(a|b)/*\\", "a://b://c.com/de/1", "http://r.net/a\nb/1",
]


def test_rules_and_templates_equal_plain_ones(spark):
    draw = random.Random(3)
    urls = list(ODD_URLS)
    for _ in range(1500):
        host = draw.choice(["big.com", "big.com", "www.one.com", "two.example.org", "k.net", f"h{draw.randrange(9)}.com"])
        area = draw.choice(["fr", "de", "en", "es", "shop/item", "shop/list", "t/a", f"u{draw.randrange(500)}"])
        last = draw.choice([str(draw.randrange(900)), f"{draw.randrange(90)}.html", "about", f"p-{draw.randrange(900)}", ""])
        urls.append(f"http://{host}/{area}/{last}{draw.choice(['', '/', '?q=1', '#t'])}")
    # The block of one area teaches the templates of pages that no rule fits.
    rules = (*url_templates.RULES, ("block", "big.com/shop/item/p-1"), ("block", "big.com/shop/item/p-2"), ("block", "one.com/t/"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    df = clashing(df, ["host", "path", "RULE", "template", "URL", "n"]).repartition(5)
    found = {r["page_id"]: r for r in url_templates.judged(df, rules).collect()}
    assert len(found) == len(urls)
    for i, ((template, purity), url) in enumerate(zip(plain_tree(urls, rules), urls)):
        row, (host, path, rule) = found[i], plain_rule(url, rules)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule and rule[1])
        if "(a|b)" not in (url or ""):
            assert row["template"] == template and row["purity"] == pytest.approx(purity, abs=1e-12), url
        assert row["verdict"] == (rule[0] if rule else "block" if row["purity"] >= url_templates.BLOCKED else "allow")
    assert any(r["rule"] is None and r["verdict"] == "block" for r in found.values())


def test_templates_by_shuffle_with_hot_keys_equal_those_sent_out(spark, monkeypatch):
    urls = [f"http://hot.com/{'de' if i % 3 else 'fr'}/{i}" for i in range(300)] + [f"http://h{i}.net/a/{i}" for i in range(100)]
    df = spark.createDataFrame([(i % 350, u) for i, u in enumerate(urls)], "page_id long, url string")
    sent = sorted(map(tuple, url_templates.judged(df).collect()), key=repr)
    real = url_templates.salted_left_join
    monkeypatch.setattr(url_templates, "is_small", lambda facts: False)
    monkeypatch.setattr(url_templates, "salted_left_join", lambda *a: real(*a, rows_per_salt=40))
    assert sorted(map(tuple, url_templates.judged(df).collect()), key=repr) == sent


def test_templates_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, "http://a.com/de/1"), (1, "http://a.com/de/1")], "page_id long, url string")
    rows = sorted(((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_templates.judged(df).collect()), key=repr)
    assert rows == [(1, "a.com", "com/de/", "block")] * 2 + [(None, "", None, "allow")] * 2
    assert url_templates.judged(df.limit(0)).count() == 0
    unlabelled = url_templates.judged(df, rules=())
    assert {r["verdict"] for r in unlabelled.collect()} == {"allow"}


# --- repair ----------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Faults and the least cheapest edits of one conversation's rows, by a search over all edits."""
    key = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r)))
    seen, faults = set(), []
    for _, _, role, text in rows:
        visible = "".join(c for c in text if c not in " \t\n\v\f\r")
        again = (role, text) in seen
        seen.add((role, text))
        faults.append("blank" if not visible else "duplicate" if again else "truncated" if visible[-1] not in ".!?" else "")
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {(0, "s"): 1, **{(s, "u"): 2 for s in (0, 1, 3)}, (2, "a"): 3}
    best = {0: (0, "", ())}

    def offer(table, state, value):
        if state is not None and (state not in table or value[:2] < table[state][:2]):
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for s, (c, a, t) in list(table.items()):
                for role in ("user", "assistant"):
                    offer(table, step.get((s, role[0])), (c + 3, a + "I", (*t, f"{role}:")))
        return table

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for s, (c, a, t) in inserted(best).items():
            offer(after, s, (c + 4, a + "D", t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                offer(after, step.get((s, role[:1])), (c + more, a + "K", (*t, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    offer(after, step.get((s, new[0])), (c + more + 3, a + "R", (*t, f"{new}:{text}")))
        best = after
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in (0, 3))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(faults.count(n) for n in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def check_repair(spark, rows, damage, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = clashing(df, ["kind", "conv", "TEXT", "part", "copy", "a.b"]).repartition(6)
    found = {r[0]: tuple(r)[1:] for r in repair.repaired(df, damage=damage, **options).collect()}
    left = defaultdict(list)
    for r in plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        left[r[0]].append(r)
    assert set(found) == {r[0] for r in rows}
    for conv, row in found.items():
        assert row == plain_repair(left[conv]), conv


def talk(seed, conv, n):
    draw = random.Random(seed)
    for turn in range(n):
        text = draw.choice(["Yes.", "No", f"Text {draw.randrange(40)}.", f"Open {draw.randrange(99)}", " ", "", None, f"Ça va {turn}!\u00a0", "x? \n"])
        yield conv, draw.choice([turn, turn, turn + draw.randrange(3), None]), draw.choice(["user", "assistant", "system", "unicorn", "tool", "", None]), text


@pytest.mark.parametrize("chunk_rows", [3, 512])
def test_repair_equals_the_plain_search(spark, chunk_rows):
    rows = [r for conv in range(60) for r in talk(conv, conv, conv % 14)]
    rows += list(talk(99, 1000, 700)) + list(talk(98, None, 30))  # one conversation has half of all rows
    rows += [(2000, 5, "user", "Same.")] * 40 + [(2001, None, None, None)] * 3
    for damage in (False, True):
        check_repair(spark, rows, damage, chunk_rows=chunk_rows)


def test_repair_cuts_chunks_at_long_texts(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "long " * 30_000 + ".") for i in range(20)] + list(talk(5, 2, 9))
    check_repair(spark, rows, False, chunk_bytes=200_000)


def test_repair_of_empty_tables_and_conversations_that_lose_all_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(empty, damage=True).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = spark.createDataFrame([(lost, 1, "user", "Hi.")], empty.schema)
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(repair.repaired(rows, damage=True).first()) == (lost, 0, 0, 0, 0, 0, 0, "", nothing)
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert repair.repaired(spark.createDataFrame(far, empty.schema)).first()["gaps"] is None


def test_ranks_choose_among_arcs_of_one_letter():
    """Where a letter leads to two nodes, the rank of what follows decides."""
    import numpy as np

    target = np.zeros((6, 4), np.int64)
    optimal = np.zeros((6, 4), bool)
    # 0 -K-> 1 or -R-> 2; 1 -K-> 3 -D-> 5; 2 -K-> 4 -I-> 5
    for node, letter, to in ((0, 2, 1), (0, 3, 2), (1, 2, 3), (2, 2, 4), (3, 0, 5), (4, 1, 5)):
        target[node, letter], optimal[node, letter] = to, True
    pointer, letter = repair.chosen(target, optimal)
    pointers, lengths = repair.doubled(pointer, letter)
    edits, ends = repair.walked(np.array([0, 2, 5]), letter, pointers, lengths)
    assert edits == [b"KKD", b"KI", b""] and ends.tolist() == [5, 5, 5]
