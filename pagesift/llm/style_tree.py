"""Main text of pages by a site style tree.

The pages of a host are merged by the paths of their containers. A container's
importance comes from two entropies over the pages that have it: how varied the
rows of its children are (presentation), and how far its own pieces of text and
links are spread (content). Containers that look and read the same everywhere
are menus, footers and notices; a page loses each branch that consists of such
containers. What markup itself names as no part of the article goes too.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.urls import url_host
from pagesift.llm.common import materialize, pick, slices

# A container on fewer pages of a host is not judged.
MIN_PAGES = 10
# Branches of containers below this importance go; it lies between 0 and 1.
IMPORTANCE = 0.2
DAMPING = 0.9

CONTAINERS = set(
    "html body div section article main nav header footer aside form ul ol dl table figure details fieldset menu dialog".split()
)
BLOCKS = CONTAINERS | set(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre blockquote address figcaption summary hr center".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Their content is text to the end tag, and no part of the page's text.
RAW = set("script style title textarea noscript template iframe object svg canvas xmp select button video audio".split())
DROPPED = set("nav footer aside form dialog menu head".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription sidebar sidebars widget"
    " widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply"
    " replies share sharing social related recommended recommendations login signup toolbar pagination pager paywall".split()
)
# Of these words, those that go however much text they hold.
ALWAYS = set("comment comments disqus respond reply replies cookie cookies consent gdpr nav navbar navigation menu menus".split())
# Words that say nothing by themselves; inside an article a name goes only if it has no others.
NEUTRAL = set(
    "box list item items wrapper container area block section left right top bottom inner outer button buttons bar link"
    " links icon icons form page site main article articles post posts story stories user reader news more text content"
    " header title group panel primary secondary".split()
)
HEADERS = {"header"}
KEPT, BY_NAME, BY_MARKUP = range(3)
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th"}
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAG = re.compile(r"[A-Za-z][^\s/>]*")


class Element:
    __slots__ = ("tag", "node", "skipped", "region", "branch")

    def __init__(self, tag: str, node: int, skipped: bool, region: int, branch: int) -> None:
        self.tag, self.node, self.skipped, self.region, self.branch = tag, node, skipped, region, branch


class Page:
    """One pass over the markup: containers by path, and the blocks of text in them."""

    def __init__(self, source: str) -> None:
        # Of containers: parent, and signature (tag and classes).
        self.parents: list[int] = [-1]
        self.signatures: list[str] = [""]
        self.children: dict[int, list[str]] = defaultdict(list)
        self.links: list[tuple[int, str]] = []
        # Node, text, skipped by markup, region (article or main element, 0 for none).
        self.blocks: list[tuple[int, str, bool, int]] = []
        # Branches whose name is unwanted: the one around each, and that of each block.
        self.around: list[int] = [0]
        self.branches: list[int] = []
        self.stack = [Element("", 0, False, 0, 0)]
        self.open: Counter = Counter()
        self.pieces: list[str] = []
        self.regions = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(html_lib.unescape("".join(self.pieces)).split())
            if text:
                top = self.stack[-1]
                self.blocks.append((top.node, text, top.skipped, top.region))
                self.branches.append(top.branch)
            self.pieces = []

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        quotes = {'"': True, "'": True}
        while at < n:
            begin = s.find("<", at)
            if begin < 0:
                self.pieces.append(s[at:])
                return
            if begin > at:
                self.pieces.append(s[at:begin])
            after = s[begin + 1 : begin + 2]
            if s.startswith("<!--", begin):
                end = s.find("-->", begin + 4)
                at = n if end < 0 else end + 3
                continue
            if after in ("!", "?"):
                end = s.find(">", begin)
                at = n if end < 0 else end + 1
                continue
            closing = after == "/"
            name = TAG.match(s, begin + 1 + closing)
            if not name:
                self.pieces.append("<")
                at = begin + 1
                continue
            end = s.find(">", name.end())
            if end < 0:
                # A tag cut off at the end of the page.
                return
            end = self._tag_end(s, name.end(), end, quotes)
            tag = name.group().lower()
            at = end + 1
            if closing:
                self._close(tag)
            elif tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(s, at) if s[end - 1] != "/" else None
                if stop:
                    close = s.find(">", stop.end())
                    at = n if close < 0 else close + 1
                elif s[end - 1] != "/":
                    at = n
                self.pieces.append(" ")
            else:
                self._start(tag, s[name.end() : end])

    @staticmethod
    def _tag_end(s: str, begin: int, end: int, quotes: dict[str, bool]) -> int:
        """The ``>`` that is in no quoted value; a quote that never closes is none."""
        at = begin
        while True:
            first = min((p for p in (s.find('"', at, end), s.find("'", at, end)) if p >= 0), default=-1)
            if first < 0:
                return end
            mark = s[first]
            close = s.find(mark, first + 1) if quotes[mark] else -1
            if close < 0:
                quotes[mark] = False
                at = first + 1
                continue
            at = close + 1
            if close > end:
                more = s.find(">", at)
                if more < 0:
                    return end
                end = more

    def _pop(self) -> None:
        self._flush()
        self.open[self.stack.pop().tag] -= 1

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.pieces.append(" ")
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def _start(self, tag: str, rest: str) -> None:
        attributes = {}
        if "=" in rest or "hidden" in rest:
            for m in ATTRIBUTE.finditer(rest):
                attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if tag == "a" and attributes.get("href"):
            self.links.append((self.stack[-1].node, attributes["href"]))
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self.pieces.append(" ")
            return
        named = " ".join((attributes.get("class", ""), attributes.get("id", "")))
        kind = self._unwanted(tag, named, attributes)
        if tag not in BLOCKS and kind == KEPT:
            return
        self._flush()
        if tag in BLOCKS:
            while self.stack[-1].tag in ("p", tag) and self.stack[-1].tag in SELF_CLOSING:
                self._pop()
        top = self.stack[-1]
        node, region = top.node, top.region
        if tag in CONTAINERS:
            signature = re.sub(r"\d+", "0", ".".join([tag, *sorted(set(attributes.get("class", "").lower().split()))]))
            self.children[node].append(signature)
            node = len(self.parents)
            self.parents.append(top.node)
            self.signatures.append(signature)
            if region == 0 and (tag in ("article", "main") or attributes.get("role", "").lower() == "main"):
                self.regions += 1
                region = self.regions
        branch = top.branch
        if kind == BY_NAME:
            self.around.append(branch)
            branch = len(self.around) - 1
        self.stack.append(Element(tag, node, top.skipped or kind == BY_MARKUP, region, branch))
        self.open[tag] += 1

    def _unwanted(self, tag: str, named: str, attributes: dict[str, str]) -> int:
        """Whether an element goes, and if by its name, which is a weaker reason than its markup."""
        if tag in DROPPED or attributes.get("role", "").lower() in ROLES:
            return BY_MARKUP
        inside = self.stack[-1].region > 0
        if tag in HEADERS:
            return KEPT if inside else BY_MARKUP
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return BY_MARKUP
        if "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return BY_MARKUP
        if tag in ("html", "body", "main") or not named.strip():
            return KEPT
        names = [{w.lower() for w in WORDS.findall(name)} for name in named.split()]
        if inside or tag == "article":
            unwanted = any(words & NAMES and words <= NAMES | NEUTRAL for words in names)
        else:
            unwanted = any(words & NAMES or "header" in words for words in names)
        if not unwanted:
            return KEPT
        return BY_MARKUP if any(words & ALWAYS for words in names) else BY_NAME

    def named_away(self) -> list[bool]:
        """Which blocks go by a name around them.

        If nearly nothing were left (a tenth of the text at most), the names mean
        something else, and a branch with over half of the text stays.
        """
        sizes = [0] * len(self.around)
        for (_, text, skipped, _), branch in zip(self.blocks, self.branches):
            while branch and not skipped:
                sizes[branch] += len(text)
                branch = self.around[branch]
        whole = sum(len(text) for _, text, skipped, _ in self.blocks if not skipped)
        named = sum(len(t) for (_, t, skipped, _), branch in zip(self.blocks, self.branches) if branch and not skipped)
        if 10 * (whole - named) > whole:
            return [branch > 0 for branch in self.branches]
        # Inside a branch that goes, all goes.
        away = [False]
        for branch in range(1, len(self.around)):
            away.append(away[self.around[branch]] or 2 * sizes[branch] <= whole)
        return [away[branch] for branch in self.branches]

    def paths(self, host: str) -> list[int]:
        """A hash of the host and the signatures down to each container."""
        texts = [host]
        for parent, signature in zip(self.parents[1:], self.signatures[1:]):
            texts.append(f"{texts[parent]}/{signature}" if len(texts[parent]) < 400 else f"{hashed(texts[parent])}/{signature}")
        return [hashed(t) for t in texts]

    def text(self, host: str, low: set[int]) -> str:
        """Blocks that stay, in page order.

        A container goes if it and all its containers are of low importance. If
        nothing were left, the article is all that the host's pages share, and
        stays. Where there are articles or main elements, all of their text is the
        page's.
        """
        kept = [b for b, away in zip(self.blocks, self.named_away()) if not (b[2] or away)]
        if low:
            paths = self.paths(host)
            gone = [p in low for p in paths]
            for i in range(len(paths) - 1, 0, -1):
                if not gone[i]:
                    gone[self.parents[i]] = False
            for i in range(1, len(paths)):
                gone[i] = gone[i] or gone[self.parents[i]]
            kept = [b for b in kept if not gone[b[0]]] or kept
        if any(b[3] for b in kept):
            kept = [b for b in kept if b[3]]
        return "\n\n".join(b[1] for b in kept)


def hashed(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


ROWS, PIECES, PAGES, PLACES = range(4)


def observations(pages: DataFrame) -> DataFrame:
    """``node, kind, feature, total, spread``: what each container shows on its pages.

    Kinds: rows of children, pieces of content, presence on a page (each with
    its sum, and the sum of x ln x over pages), and the page itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            sums: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
            columns = (batch.column(c).to_pylist() for c in ("page", "host", "html"))
            for page, host, source in zip(*columns):
                parsed = Page(source)
                paths = parsed.paths(host)
                seen: Counter = Counter()
                for i, path in enumerate(paths):
                    seen[path, ROWS, hashed(" ".join(parsed.children.get(i, ())))] += 1
                for node, text, _, _ in parsed.blocks:
                    seen[paths[node], PIECES, hashed(text)] += 1
                for node, link in parsed.links:
                    seen[paths[node], PIECES, hashed("href " + link)] += 1
                for path in set(paths):
                    seen[path, PAGES, 0] += 1
                    seen[path, PLACES, page] += 1
                for key, n in seen.items():
                    held = sums[key]
                    held[0] += n
                    held[1] += n * math.log(n)
            keys = list(zip(*sums)) or [[], [], []]
            values = list(zip(*sums.values())) or [[], []]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            arrays = [pa.array(v, t) for v, t in zip([*keys, *values], kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "kind", "feature", "total", "spread"])

    return pages.mapInArrow(run, "node long, kind int, feature long, total double, spread double")


def importances(seen: DataFrame) -> DataFrame:
    """``node, pages, importance``.

    With m pages and entropies to base m: presentation is the entropy of the
    rows of children, content one minus the mean entropy of its pieces over the
    pages. ``1 - DAMPING ** kinds of rows`` is the weight of presentation.
    """
    each = seen.filter(F.col("kind") < PLACES).groupBy("node", "kind", "feature")
    each = each.agg(F.sum("total").alias("total"), F.sum("spread").alias("spread"))
    part = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    t, one = F.col("total"), F.lit(1)
    node = each.groupBy("node").agg(
        part(PAGES, t).alias("pages"), part(ROWS, t).alias("n"), part(ROWS, t * F.log(t)).alias("nlogn"),
        part(ROWS, one).alias("rows"), part(PIECES, F.log(t) - F.col("spread") / t).alias("entropy"),
        part(PIECES, one).alias("pieces"),
    )
    base = F.log("pages")
    rows = F.when(F.col("pages") > 1, (F.log("n") - F.col("nlogn") / F.col("n")) / base).otherwise(F.lit(1.0))
    pieces = F.when(F.col("pages") > 1, 1 - F.col("entropy") / F.col("pieces") / base).otherwise(F.lit(1.0))
    weight = F.pow(F.lit(DAMPING), F.col("rows"))
    value = (1 - weight) * F.greatest(rows, F.lit(0.0)) + weight * F.coalesce(F.greatest(pieces, F.lit(0.0)), F.lit(0.0))
    return node.select("node", "pages", value.alias("importance"))


def main_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, importance: float = IMPORTANCE,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row.

    Blocks of the main text are trimmed, have single blanks, and are joined by
    an empty line. A null or empty page has an empty text. Pages with a null or
    unreadable URL are those of one host without a name. Repeated rows and null
    ids stay; containers of a host on fewer than ``min_pages`` pages are not
    judged. Pages are read twice in linear time; a page's own low containers
    are joined to it by a hash of host and source. An empty table gives no rows.
    """
    rows = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    rows = rows.withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("host", F.lower(F.coalesce(url_host("url"), F.lit(""))))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    seen = materialize(observations(rows.select("page", "host", "html")), "observations")
    low = importances(seen).filter((F.col("pages") >= min_pages) & (F.col("importance") < importance))
    low = materialize(low.select("node"), "low")
    places = seen.filter(F.col("kind") == PLACES).select("node", F.col("feature").alias("page"))
    low = places.join(low, "node").groupBy("page").agg(F.collect_set("node").alias("low"))
    joined = rows.join(materialize(low, "low-places"), "page", "left").select("page_id", "url", "host", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            columns = (batch.column(c).to_pylist() for c in ("host", "html", "low"))
            texts = [Page(source).text(host, set(low or ())) for host, source, low in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return joined.mapInArrow(run, schema)
