"""Pages to element trees: the one stage that needs Python.

A page becomes one ``tree`` struct beside its other columns:

* ``nodes``: its elements in document order. ``node_id`` is the index in that
  array and ``end_id`` the last descendant, so the inside of an element is a
  slice.
* ``texts``: its stripped, non-empty text pieces in document order. Each node
  knows its range ``text_from``..``text_to`` of them.
* ``html_from``, ``html_to``: where the element stands in the page source, in
  UTF-8 bytes, so cutting it out does not count through the page.

Everything a selector needs of a page lies in the page's own row, so selection
and field extraction are projections: no shuffle, no join of nodes with nodes,
and a page never has to be put together again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML: elements without content, elements whose content is
# not markup, and which open element a start tag ends.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style textarea title xmp noembed noframes iframe".split())
DECODED_RAW_TEXT = frozenset(["textarea", "title"])
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search "
    "section table ul".split()
)
ENDS_SIBLING = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
# Page text that is in Python as elements at one time; a longer page is alone.
SLICE_BYTES = 1 << 20
PARAGRAPH = frozenset(["p"])
NONE: frozenset = frozenset()
# An end of paragraph does not reach out of these.
HOLDS_PARAGRAPH = frozenset("td th table caption button object".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)"
    r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/=>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("end_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text_from", T.IntegerType()),
        T.StructField("text_to", T.IntegerType()),
        T.StructField("html_from", T.IntegerType()),
        T.StructField("html_to", T.IntegerType()),
    ]
)
NODES = T.ArrayType(NODE)
# Ids of the elements with a tag ("p"), a class (".lead") or an id ("#top"), rising.
POSTINGS = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))
TREE = T.StructType(
    [
        T.StructField("nodes", NODES),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("postings", POSTINGS),
    ]
)

END_ID, TAG, CLASSES, ATTRS, TEXT_TO, HTML_TO = (
    NODE.fieldNames().index(name)
    for name in ("end_id", "tag", "classes", "attrs", "text_to", "html_to")
)

_ARROW_NODE = pa.struct(
    [
        *[(name, pa.int32()) for name in ("node_id", "end_id", "parent_id", "depth")],
        ("tag", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        *[(name, pa.int32()) for name in ("text_from", "text_to", "html_from", "html_to")],
    ]
)
_ARROW_POSTINGS = pa.map_(pa.string(), pa.list_(pa.int32()))
_ARROW_TREE = pa.struct(
    [("nodes", pa.list_(_ARROW_NODE)), ("texts", pa.list_(pa.string())), ("postings", _ARROW_POSTINGS)]
)


def _attributes(source: str) -> dict[str, str | None]:
    found: dict[str, str | None] = {}
    for match in _ATTRIBUTE.finditer(source):
        name, *values = match.groups()
        value = next((v for v in values if v is not None), None)
        found.setdefault(name.lower(), value if value is None else unescape(value))
    return found


def page_elements(html: str, nodes: list[list], texts: list[str]) -> None:
    """Append the elements of one page as rows of ``NODE``, and its text pieces."""
    first_node, first_text = len(nodes), len(texts)
    opened: list[list] = []
    open_tags: Counter[str] = Counter()
    ascii_only = html.isascii()
    counted = [0, 0]

    def bytes_to(at: int) -> int:
        """Byte position of a character; asked for in rising order."""
        if ascii_only:
            return at
        counted[1] += len(html[counted[0] : at].encode("utf-8", "surrogatepass"))
        counted[0] = at
        return counted[1]

    def add_text(piece: str, decode: bool = True) -> None:
        piece = (unescape(piece) if decode else piece).strip()
        if piece:
            texts.append(piece)

    def close(depth: int, at: int) -> list:
        """Close the open elements from ``depth`` on; gives the outermost of them."""
        outermost = opened[depth]
        for node in opened[depth:]:
            node[END_ID] = len(nodes) - first_node - 1
            node[TEXT_TO] = len(texts) - first_text
            node[HTML_TO] = at
            open_tags[node[TAG]] -= 1
        del opened[depth:]
        return outermost

    def innermost(tags: Iterable[str], fence: frozenset = NONE) -> int | None:
        if not any(open_tags[tag] for tag in tags):
            return None
        for depth in range(len(opened) - 1, -1, -1):
            if opened[depth][TAG] in tags:
                return depth
            if opened[depth][TAG] in fence:
                return None
        return None

    at = 0
    # Behind the last ">" no tag can end, so none is looked for: a page cut off in
    # the middle of its markup is read once, not once for each "<".
    last = html.rfind(">") + 1
    while token := _TOKEN.search(html, at, last):
        if token.start() > at:
            add_text(html[at : token.start()])
        at = token.end()
        if at == last and token.group().startswith("<!--") and not token.group().endswith("-->"):
            at = len(html)
        slash, name, rest = token.groups()
        if name is None:
            continue
        name = name.lower()
        start, end = bytes_to(token.start()), bytes_to(at)
        if slash:
            depth = innermost((name,))
            if depth is not None:
                close(depth, start)[HTML_TO] = end
            continue
        if name in ENDS_PARAGRAPH:
            depth = innermost(PARAGRAPH, HOLDS_PARAGRAPH)
            if depth is not None:
                close(depth, start)
        if name in ENDS_SIBLING:
            depth = innermost(*ENDS_SIBLING[name])
            if depth is not None:
                close(depth, start)
        attrs = _attributes(rest) if rest else {}
        number, piece = len(nodes) - first_node, len(texts) - first_text
        parent = opened[-1][0] if opened else -1
        classes = (attrs.get("class") or "").split()
        node = [
            number, number, parent, len(opened), name, classes, list(attrs.items()),
            piece, piece, start, end,
        ]
        nodes.append(node)
        if name not in VOID:
            opened.append(node)
            open_tags[name] += 1
        if name in RAW_TEXT:
            ending = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = ending.start() if ending else len(html)
            add_text(html[at:stop], decode=name in DECODED_RAW_TEXT)
            at = stop
    add_text(html[at:].partition("<!--")[0])
    if opened:
        close(0, bytes_to(len(html)))


def page_postings(nodes: Iterable[list]) -> dict[str, list[int]]:
    """Where each tag, class and id of a page stands."""
    found: dict[str, list[int]] = {}
    for number, node in enumerate(nodes):
        found.setdefault(node[TAG], []).append(number)
        for name in dict.fromkeys(node[CLASSES]):
            found.setdefault(f".{name}", []).append(number)
        for name, value in node[ATTRS]:
            if name == "id" and value:
                found.setdefault(f"#{value}", []).append(number)
    return found


def _batch_trees(pages: pa.Array) -> pa.Array:
    nodes: list[list] = []
    texts: list[str] = []
    postings: list[list[tuple[str, list[int]]]] = []
    node_ends, text_ends = [0], [0]
    for html in pages:
        page_elements(html.as_py() or "", nodes, texts)
        postings.append(list(page_postings(nodes[node_ends[-1] :]).items()))
        node_ends.append(len(nodes))
        text_ends.append(len(texts))
    fields = list(_ARROW_NODE)
    columns = zip(*nodes) if nodes else [[] for _ in fields]
    structs = pa.StructArray.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, fields)], fields=fields
    )
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(node_ends, pa.int32()), structs),
            pa.ListArray.from_arrays(
                pa.array(text_ends, pa.int32()), pa.array(texts, pa.string())
            ),
            pa.array(postings, _ARROW_POSTINGS),
        ],
        fields=list(_ARROW_TREE),
    )


def _slices(pages: pa.Array) -> Iterator[pa.Array]:
    """Parts of about ``SLICE_BYTES`` of page text, in order."""
    start = held = 0
    for i, size in enumerate(pa.compute.binary_length(pages).to_pylist()):
        if held and held + (size or 0) > SLICE_BYTES:
            yield pages.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(pages):
        yield pages.slice(start)


# Trees leave slice by slice: a worker's memory depends on the size of a slice or
# of its longest page, not on how many pages Spark puts into a batch.
@F.arrow_udf(TREE)
def html_tree(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        for part in _slices(batch):
            yield _batch_trees(part)


@F.arrow_udf(TREE)
def escaped_html_tree(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Tree of markup that arrives entity-escaped, as in JSON descriptions."""
    for batch in pages:
        for part in _slices(batch):
            yield _batch_trees(
                pa.array([unescape(p.as_py() or "") for p in part], pa.string())
            )


# Not pushed around by the optimizer: a filter it derives, say from an explode,
# would build every tree a second time.
html_tree = html_tree.asNondeterministic()
escaped_html_tree = escaped_html_tree.asNondeterministic()


@F.arrow_udf(T.StringType())
def html_unescape(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t.as_py() is None else unescape(t.as_py()) for t in texts], pa.string()
    )


def page_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add the ``tree`` of each page. Filter and select pages before this."""
    return pages.withColumn("tree", html_tree(F.col(html_col)))


def node_rows(trees: DataFrame, *keys: str, with_text: bool = False) -> DataFrame:
    """One row per element, for queries that want elements as a table.

    Text is cut out before the elements are exploded: no row carries the page.
    """
    if not with_text:
        return trees.select(*keys, F.explode("tree.nodes").alias("_node")).select(*keys, "_node.*")
    places = "filter(sequence(n.text_from, n.text_to), at -> at < n.text_to)"
    text = f"array_join(transform({places}, at -> get(tree.texts, at)), ' ')"
    node = f"transform(tree.nodes, n -> named_struct('node', n, 'text', {text}))"
    return trees.select(*keys, F.explode(F.expr(node)).alias("_n")).select(
        *keys, "_n.node.*", "_n.text"
    )


def all_text(tree: Column, separator: str = " ") -> Column:
    return F.array_join(tree["texts"], separator)
