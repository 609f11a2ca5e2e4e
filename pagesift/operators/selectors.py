"""Selectors as data, evaluated inside the page row.

A selector text is split into steps once - on the rules table, or at plan time
for a fixed selector - and the steps are then worked off by expressions, so one
plan serves every source. Forms: tag, ``*``, ``.class``, ``#id``, ``[a]``,
``[a=v]``, ``[a^=v]``, ``[a$=v]``, ``[a*=v]``, descendant and ``>``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.columns import as_col, bind_sql, text_sql
from pagesift.functions.text import u_strip
from pagesift.operators.nodes import NODES

_BRACKET = re.compile(
    r"""\[\s*([\w:-]+)\s*(?:([\^$*]?=)\s*("[^"]*"|'[^']*'|[^\]\s"']*)\s*)?\]"""
)
_COMPOUND = rf"(?:\*|[a-zA-Z][\w-]*)?(?:[.#][\w-]+|{re.sub(r'[(](?![?])', '(?:', _BRACKET.pattern)})*"
_STEP = re.compile(rf"\s*(>?)\s*({_COMPOUND})")

STEPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("child", T.BooleanType()),
            T.StructField("tag", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("classes", T.ArrayType(T.StringType())),
            T.StructField(
                "attrs",
                T.ArrayType(
                    T.StructType(
                        [T.StructField(n, T.StringType()) for n in ("name", "op", "value")]
                    )
                ),
            ),
        ]
    )
)


def parse_selector(css: str | None) -> list[tuple] | None:
    """Steps of a selector as rows of ``STEPS``; None if blank or not understood."""
    steps, at, css = [], 0, (css or "").strip()
    while at < len(css):
        match = _STEP.match(css, at)
        mark, compound = match.groups()
        if not compound:
            return None
        at = match.end()
        attrs = [
            (name.lower(), op, value.strip("\"'"))
            for name, op, value in _BRACKET.findall(compound)
        ]
        plain = _BRACKET.sub("", compound)
        tag = re.match(r"[a-zA-Z][\w-]*", plain)
        ids = re.findall(r"#([\w-]+)", plain)
        steps.append(
            (
                mark == ">",
                tag.group().lower() if tag else "",
                ids[0] if ids else "",
                re.findall(r"\.([\w-]+)", plain),
                attrs,
            )
        )
    return steps or None


def steps_sql(css: str) -> str:
    """Steps of a selector known at plan time, as a literal."""
    steps = parse_selector(css)
    if steps is None:
        raise ValueError(f"selector not supported: {css!r}")

    def array(items: list[str], kind: str) -> str:
        return f"cast(array({', '.join(items)}) as array<{kind}>)"

    def step(child: bool, tag: str, id_: str, classes: list[str], attrs: list[tuple]) -> str:
        tests = [
            f"named_struct('name', {text_sql(n)}, 'op', '{o}', 'value', {text_sql(v)})"
            for n, o, v in attrs
        ]
        return (
            f"named_struct('child', {str(child).lower()}, 'tag', {text_sql(tag)}, "
            f"'id', {text_sql(id_)}, "
            f"'classes', {array([text_sql(c) for c in classes], 'string')}, "
            f"'attrs', {array(tests, 'struct<name:string,op:string,value:string>')})"
        )

    return f"array({', '.join(step(*s) for s in steps)})"


# For rules tables only: settings rows, parsed before they are joined to pages.
selector_steps = F.udf(lambda css: parse_selector(css), STEPS)


def split_mode(selector: Column | str) -> Column:
    """Struct (css, mode) of ``css::mode``; the mode is ``text`` by default."""
    parts = F.split(as_col(selector), "::", 2)
    return F.struct(
        u_strip(F.get(parts, F.lit(0))).alias("css"),
        F.coalesce(F.lower(u_strip(F.get(parts, F.lit(1)))), F.lit("text")).alias("mode"),
    )


_ATTRIBUTE_FITS = """coalesce(case want.op
  when '' then map_contains_key(node.attrs, want.name)
  when '=' then element_at(node.attrs, want.name) = want.value
  when '^=' then want.value <> '' and startswith(element_at(node.attrs, want.name), want.value)
  when '$=' then want.value <> '' and endswith(element_at(node.attrs, want.name), want.value)
  when '*=' then want.value <> '' and contains(element_at(node.attrs, want.name), want.value)
  end, false)"""

_FITS = f"""(step.tag = '' or node.tag = step.tag)
  and (step.id = '' or coalesce(element_at(node.attrs, 'id') = step.id, false))
  and forall(step.classes, class -> array_contains(node.classes, class))
  and forall(step.attrs, want -> {_ATTRIBUTE_FITS})"""

# Largest end so far, for each kept element: a prefix maximum by doubling steps.
_REACH = """aggregate(sequence(0, cast(ceil(log2(size(kept) + 1)) as int)),
  transform(kept, k -> k.end_id),
  (ends, t) -> transform(ends, (e, i) ->
    if(i >= shiftleft(1, t), greatest(e, get(ends, i - shiftleft(1, t))), e)))"""

# Kept elements that stand in no other kept element.
_OUTERMOST = bind_sql(
    "reach", _REACH, "filter(kept, (k, i) -> i = 0 or get(reach, i - 1) < k.node_id)"
)


# Under what the elements of a step are posted; null if a step names nothing.
_POSTED_AS = """case when step.id <> '' then concat('#', step.id)
  when size(step.classes) > 0 then concat('.', step.classes[0]) when step.tag <> '' then step.tag end"""


def select_sql(nodes: str, steps: str, postings: str | None = None) -> str:
    """All elements of ``nodes`` that fit, in document order.

    ``nodes`` is a page's array or the scope of an item: its index is the node
    id less that of its first node. Each step looks only inside what the step
    before kept; for descendants inside the outermost of these, so only once.

    ``postings`` (of a whole page) gives a step the elements that have its id,
    class or tag. They are tested instead of all elements, where looking up what
    holds them takes no more than going through it. So no page takes longer.
    """

    def at_id(at: str) -> str:
        return f"get({nodes}, {at} - {nodes}[0].node_id)"

    def within(ups: str, fits: str, give: str = "node") -> str:
        below = f"transform(sequence(up.node_id + 1, up.end_id), at -> {at_id('at')})"
        found = f"filter({below}, node -> {fits})"
        picked = found if give == "node" else f"transform({found}, node -> {give})"
        holding = f"filter({ups}, k -> k.end_id > k.node_id)"
        return f"flatten(transform({holding}, up -> {picked}))"

    descendants = within("outer", _FITS)
    child_ids = within("kept", f"node.parent_id = up.node_id and {_FITS}", "node.node_id")
    children = f"transform(array_sort({child_ids}), at -> {at_id('at')})"
    first = f"filter({nodes}, node -> {_FITS})"
    if postings is not None:
        span = "aggregate({ups}, 0L, (n, up) -> n + up.end_id - up.node_id)"

        def posted(plain: str, ups: str | None, held: str = "true") -> str:
            """``plain``, or the posted elements that ``held`` finds inside ``ups``."""
            some = f"filter(transform(posted, at -> get({nodes}, at)), node -> {held} and {_FITS})"
            fewer = "posted is not null"
            if ups is not None:
                fewer += f" and 1L * size(posted) * size({ups}) <= {span.format(ups=ups)}"
            return f"if({fewer}, {some}, {plain})"

        inside = "exists(outer, up -> node.node_id > up.node_id and node.node_id <= up.end_id)"
        descendants = posted(descendants, "outer", inside)
        children = posted(children, "kept", "exists(kept, up -> node.parent_id = up.node_id)")
        first = posted(first, None)
    descendants = bind_sql("outer", _OUTERMOST, descendants)
    step = (
        f"case when kept is null then {first} "
        f"when step.child then {children} else {descendants} end"
    )
    if postings is not None:
        none = "cast(array() as array<int>)"
        ids = f"if(label is null, null, coalesce(element_at({postings}, label), {none}))"
        step = bind_sql("label", _POSTED_AS, bind_sql("posted", ids, step))
    return f"aggregate({steps}, cast(null as {NODES.simpleString()}), (kept, step) -> {step})"


def select_nodes(nodes: str, selector: str, postings: str | None = None) -> Column:
    return F.expr(select_sql(nodes, steps_sql(selector), postings))


def inside_sql(nodes: str, item: str) -> str:
    """The item itself and everything in it: the scope of relative selectors.

    Element by element: ``slice`` would go through the whole array each time.
    """
    return f"transform(sequence({item}.node_id, {item}.end_id), at -> get({nodes}, at))"


def first_match_sql(nodes: str, steps: str, postings: str | None = None) -> str:
    """The first element that fits. With ``postings``, nothing behind it is tested
    where a selector has one step."""
    every = f"get({select_sql(nodes, steps, postings)}, 0)"
    if postings is None:
        return every
    node = f"get({nodes}, at)"
    fits = bind_sql("node", node, f"if({_FITS}, node, null)")
    some = f"coalesce(element_at({postings}, label), cast(array() as array<int>))"
    one = f"aggregate({some}, cast(null as {NODES.elementType.simpleString()}), (hit, at) -> coalesce(hit, {fits}))"
    step = bind_sql("step", f"{steps}[0]", bind_sql("label", _POSTED_AS, f"if(label is null, {every}, {one})"))
    return f"if(size({steps}) = 1, {step}, {every})"


def first_match(nodes: str, selector: str, postings: str | None = None) -> Column:
    return F.expr(first_match_sql(nodes, steps_sql(selector), postings))


def node_text_sql(texts: str, node: str, separator: str = " ") -> str:
    places = f"filter(sequence({node}.text_from, {node}.text_to), at -> at < {node}.text_to)"
    return f"array_join(transform({places}, at -> get({texts}, at)), {text_sql(separator)})"


def node_html_sql(html: str, node: str) -> str:
    """Outer HTML as it stands in the captured page.

    ``html`` is the page text, or its bytes bound once where many are cut out.
    """
    return (
        f"cast(substring(cast({html} as binary), {node}.html_from + 1, "
        f"{node}.html_to - {node}.html_from) as string)"
    )


def node_attr_sql(node: str, name: str) -> str:
    return f"element_at({node}.attrs, {name})"


def node_text(texts: str, node: str, separator: str = " ") -> Column:
    return F.expr(node_text_sql(texts, node, separator))


def node_html(html: str, node: str) -> Column:
    return F.expr(node_html_sql(html, node))


def node_attr(node: str, name: str) -> Column:
    return F.expr(node_attr_sql(node, text_sql(name)))


def node_value_sql(html: str, texts: str, node: str, mode: str) -> str:
    """Value of an element by mode: html, attr:<name>, anything else is text."""
    return (
        f"case when {node} is null then null when {mode} = 'html' then {node_html_sql(html, node)} "
        f"when startswith({mode}, 'attr:') then {node_attr_sql(node, f'substring({mode}, 6)')} "
        f"else {node_text_sql(texts, node)} end"
    )


def selected_rows(trees: DataFrame, selector: str, *keys: str) -> DataFrame:
    """One row per selected element of each page: keys, pos, node."""
    return trees.select(
        *keys,
        F.posexplode(select_nodes("tree.nodes", selector, "tree.postings")).alias("pos", "node"),
    )
