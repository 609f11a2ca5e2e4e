"""Pages to links and records. All of it works inside the page row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import urls
from pagesift.functions.columns import bind_sql, let, text_sql
from pagesift.functions.embedded import read_embedded_json
from pagesift.functions.text import blank_to_null_sql, time_and_rest, title_cut, u_strip_sql
from pagesift.functions.times import epoch_ms_iso
from pagesift.operators import nodes as tree_ops
from pagesift.operators import selectors as sel
from pagesift.schemas import JSON_DETAIL, JSON_LIST
from pagesift.session import checked_broadcast, is_small

# Where title and content are looked for when the rules give nothing.
META_FALLBACKS = {
    "title": [
        'meta[property="og:title"]::attr:content',
        'meta[name="title"]::attr:content',
        "title",
    ],
    "content": [
        'meta[property="og:description"]::attr:content',
        'meta[name="description"]::attr:content',
    ],
}
FALLBACK_RANK = 1000


# --- rules -------------------------------------------------------------------


def with_fallbacks(rules: DataFrame) -> DataFrame:
    """Append the meta fallbacks to every source that has the field."""
    fallbacks = [
        (field, FALLBACK_RANK + i, selector)
        for field, selectors in META_FALLBACKS.items()
        for i, selector in enumerate(selectors)
    ]
    table = rules.sparkSession.createDataFrame(fallbacks, "field string, rank int, selector string")
    wanted = rules.select("source_name", "field", "field_pos").distinct()
    added = wanted.join(F.broadcast(table), "field").select(rules.columns)
    return rules.unionByName(added)


def rule_sets(rules: DataFrame, fallbacks: bool, one_task: bool = False) -> DataFrame:
    """One row per source: fields in order, each with its selectors by rank.

    A settings table in, a settings table out; selectors are parsed here, once.
    """
    if "field_pos" not in rules.columns:
        rules = rules.withColumn("field_pos", F.lit(0))
    if fallbacks:
        rules = with_fallbacks(rules)
    if one_task:
        rules = rules.coalesce(1)
    split = rules.withColumn("_mode", sel.split_mode("selector")).select(
        "source_name",
        "field",
        "field_pos",
        "rank",
        sel.selector_steps(F.col("_mode.css")).alias("steps"),
        F.col("_mode.mode").alias("mode"),
    )
    by_field = split.groupBy("source_name", "field").agg(
        F.min("field_pos").alias("field_pos"),
        F.array_sort(
            F.collect_list(F.when(F.col("steps").isNotNull(), F.struct("rank", "steps", "mode")))
        ).alias("tries"),
    )
    return by_field.groupBy("source_name").agg(
        F.array_sort(F.collect_list(F.struct("field_pos", "field", "tries"))).alias("rule_set")
    )


def field_values_sql(
    html: str, texts: str, nodes: str, rule_set: str, postings: str | None = None
) -> str:
    """Map field -> value: per field the first selector that gives something.

    A selector contributes its first element only. Later selectors are not
    evaluated once there is a value.
    """
    value = blank_to_null_sql("val")
    tried = bind_sql(
        "hit",
        sel.first_match_sql(nodes, "t.steps", postings),
        bind_sql("val", sel.node_value_sql(html, texts, "hit", "t.mode"), value),
    )
    found = f"aggregate(rule.tries, cast(null as string), (found, t) -> coalesce(found, {tried}))"
    return (
        f"map_from_entries(transform({rule_set}, "
        f"rule -> named_struct('key', rule.field, 'value', {found})))"
    )


# --- links -------------------------------------------------------------------


def usable_links_sql(base: str, hrefs: str) -> str:
    """Resolved links of an href array; the first occurrence of each is kept."""
    usable = f"filter({hrefs}, href -> {urls.usable_link_sql('href')})"
    resolved = urls.resolve_sql("base", u_strip_sql("href"))
    return bind_sql(
        "base", urls.url_parts_sql(base), f"array_distinct(transform({usable}, href -> {resolved}))"
    )


def entry_links(trees: DataFrame, steps: str, *keys: str, url: str = "url") -> DataFrame:
    """Links of the elements an entry pattern selects: keys, pos, link.

    ``steps`` is a column of parsed steps or ``steps_sql`` of a fixed selector.
    """
    picked = sel.select_sql("tree.nodes", steps, "tree.postings")
    hrefs = f"transform({picked}, n -> {sel.node_attr_sql('n', text_sql('href'))})"
    return trees.select(
        *keys, F.posexplode(F.expr(usable_links_sql(url, hrefs))).alias("pos", "link")
    )


def links_or_target(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source's links; a source without any has its own target URL."""
    found = links.select("source_name").distinct()
    missing = sources.join(found, "source_name", "left_anti").select(
        "source_name", F.lit(0).alias("pos"), F.col("target_url").alias("link")
    )
    return links.select("source_name", "pos", "link").unionByName(missing)


# --- records -----------------------------------------------------------------


def attach_rules(pages: DataFrame, rules: DataFrame, fallbacks: bool) -> DataFrame:
    """Join each page with the rules of its source.

    A rules table of settings size, once counted, is worked off in one small
    task and sent out; a larger one is grouped and joined by shuffle.
    """
    if is_small(rules):
        sets = F.broadcast(rule_sets(rules, fallbacks, one_task=True))
    else:
        sets = rule_sets(rules, fallbacks)
    return pages.join(sets, "source_name", "left")


def detail_fields(pages: DataFrame, rules: DataFrame, html: str = "html") -> DataFrame:
    """Add ``fields`` to detail pages with a ``source_name``; and their ``tree``, if they have none.

    Pages meet their rules before they are parsed, so no join moves a tree.
    """
    with_rules = attach_rules(pages, rules, fallbacks=True)
    if "tree" not in pages.columns:
        with_rules = tree_ops.page_nodes(with_rules, html)
    values = field_values_sql(html, "tree.texts", "tree.nodes", "rule_set", "tree.postings")
    return with_rules.withColumn("fields", F.expr(values)).drop("rule_set")


def keep_last_per_url_sql(items: str) -> str:
    """Items with one URL: the last one's position, and the first one's as ``pos``.

    ``items`` is an array of structs with ``url`` and ``pos``. Sorting by
    (url, pos) puts equal URLs in runs; a run's ends are what is wanted.
    """
    slim = f"array_sort(transform({items}, x -> named_struct('url', x.url, 'pos', x.pos)))"
    firsts = "filter(runs, (x, i) -> i = 0 or get(runs, i - 1).url <> x.url)"
    lasts = "filter(runs, (x, i) -> i = size(runs) - 1 or get(runs, i + 1).url <> x.url)"
    ends = (
        f"zip_with({firsts}, {lasts}, (f, l) -> "
        "named_struct('pos', f.pos, 'last_pos', l.pos, 'url', l.url))"
    )
    return bind_sql("runs", slim, f"array_sort({ends})")


def _unique_records(pages: DataFrame, items: str, *keys: str) -> DataFrame:
    """Explode an array of (url, pos, ...) record structs, one row per URL.

    The array is reduced before it is exploded, so no row carries the whole.
    """
    kept = keep_last_per_url_sql("filter(items, x -> x.url is not null)")
    reduced = bind_sql(
        "items",
        items,
        f"transform({kept}, k -> named_struct('pos', k.pos, 'r', get(items, k.last_pos)))",
    )
    return pages.select(*keys, F.explode(F.expr(reduced)).alias("_kept")).select(
        *keys, "_kept.pos", "_kept.r.url", "_kept.r.fields", "_kept.r.raw_html"
    )


def _per_page_sql(url: str, html: str, items: str) -> str:
    """Bind ``base`` (parts of the page's URL) and ``source`` (its bytes) for ``items``."""
    return bind_sql(
        "base", urls.url_parts_sql(url), bind_sql("source", f"cast({html} as binary)", items)
    )


def item_url_sql(base: str, scope: str, item: str) -> str:
    """Key of a list item: its first usable link, else its data-id, else data-time."""
    anchor = sel.first_match_sql(scope, sel.steps_sql("a[href]"))
    href = bind_sql("anchor", anchor, sel.node_attr_sql("anchor", text_sql("href")))

    def marked(name: str) -> str:
        value = sel.node_attr_sql(item, text_sql(f"data-{name}"))
        return f"concat('#{name}-', nullif({value}, ''))"

    ref = bind_sql(
        "href",
        href,
        f"coalesce(if({urls.usable_link_sql('href')}, {u_strip_sql('href')}, null), "
        f"{marked('id')}, {marked('time')})",
    )
    return bind_sql("ref", ref, f"if(ref is null, null, {urls.resolve_sql(base, 'ref')})")


def list_records(
    trees: DataFrame, steps: str, *keys: str, url: str = "url", html: str = "html"
) -> DataFrame:
    """Records of a list page: one per element the entry pattern selects.

    ``trees`` carries ``rule_set`` (see ``attach_rules``, without fallbacks).
    Gives keys, pos, url, fields, raw_html.
    """
    record = bind_sql(
        "scope",
        sel.inside_sql("tree.nodes", "item"),
        f"named_struct('url', {item_url_sql('base', 'scope', 'item')}, 'pos', pos, "
        f"'fields', {field_values_sql('source', 'tree.texts', 'scope', 'rule_set')}, "
        f"'raw_html', {sel.node_html_sql('source', 'item')})",
    )
    items = sel.select_sql("tree.nodes", steps, "tree.postings")
    picked = f"transform({items}, (item, pos) -> {record})"
    return _unique_records(trees, _per_page_sql(url, html, picked), *keys)


def timeline_cards(
    trees: DataFrame, *keys: str, url: str = "url", html: str = "html"
) -> DataFrame:
    """Cards of a news timeline page: keys, pos, url, fields, raw_html."""

    def pick(*selectors: str) -> str:
        tries = [sel.first_match_sql("scope", sel.steps_sql(s)) for s in selectors]
        return f"coalesce({', '.join(tries)})"

    def text(part: str, separator: str) -> str:
        return sel.node_text_sql("tree.texts", f"card.{part}", separator)

    def every(selector: str) -> str:
        return sel.select_sql("tree.nodes", sel.steps_sql(selector), "tree.postings")

    cards = bind_sql(
        "wide", every("div.el-timeline-item__wrapper"), f"if(size(wide) > 0, wide, {every('div.list_body')})"
    )
    parts = (
        f"named_struct('title', {pick('a.news_body_title')}, "
        f"'content', {pick('div.news_body_content span', 'div.detail-body')}, "
        f"'time', {pick('div.el-timeline-item__timestamp', 'span.topic-time')}, "
        f"'topic', {pick('div.topic')})"
    )
    title = f"coalesce(nullif({text('title', '')}, ''), {text('topic', '')}, '')"
    fields = (
        f"map_filter(map('title', {title}, 'content', {text('content', ' ')}, "
        f"'published_at', {text('time', '')}), (k, v) -> k <> 'published_at' or card.time is not null)"
    )
    href = f"coalesce({sel.node_attr_sql('card.title', text_sql('href'))}, '')"
    link = (
        f"if(card.title is not null and card.content is not null, "
        f"nullif({urls.resolve_sql('base', href)}, ''), null)"
    )
    record = bind_sql(
        "scope",
        sel.inside_sql("tree.nodes", "item"),
        bind_sql(
            "card",
            parts,
            f"named_struct('url', {link}, 'pos', pos, 'fields', {fields}, "
            f"'raw_html', {sel.node_html_sql('source', 'item')})",
        ),
    )
    picked = f"transform({cards}, (item, pos) -> {record})"
    return _unique_records(trees, _per_page_sql(url, html, picked), *keys)


def last_by_id(items: Column) -> Column:
    """Structs ``at, item`` of a list: the last item of each id, at the place of the first.

    Items without an id are one another's repeats. Missing items are left out.
    """
    placed = F.transform(items, lambda x, i: F.struct(i.alias("at"), x.alias("item")))
    there = F.filter(placed, lambda x: x["item"].isNotNull())
    key = lambda x: F.coalesce(x["item"]["id"], F.lit("None"))

    def chosen(found: Column) -> Column:
        ids = F.array_distinct(F.transform(found, key))

        def of(i: Column) -> Column:
            same = F.filter(found, lambda x: key(x) == i)
            return F.struct(same[0]["at"].alias("at"), F.element_at(same, -1)["item"].alias("item"))

        return F.transform(ids, of)

    repeats = F.size(F.array_distinct(F.transform(there, key))) < F.size(there)
    return F.when(repeats, F.transform(F.array(there), chosen)[0]).otherwise(there)


def json_list_records(
    pages: DataFrame, *keys: str, url: str = "url", html: str = "html"
) -> DataFrame:
    """Records of a page that embeds its list as JSON; no tree of the page needed.

    Of items with one id the last counts, at the place of the first.
    """
    payload = read_embedded_json(html, 'initData":', JSON_LIST)
    rows = pages.select(
        *keys,
        F.expr(url).alias("_base"),
        F.inline(last_by_id(payload["pageResult"]["list"])).alias("_at", "_item"),
    )
    described = rows.withColumn("_text", F.coalesce("_item.description", F.lit("")))
    parsed = described.withColumn("_tree", tree_ops.escaped_html_tree("_text")).withColumn(
        "raw_html", tree_ops.html_unescape("_text")
    )
    fields = F.create_map(
        F.lit("title"), F.coalesce("_item.title", F.lit("")),
        F.lit("content"), tree_ops.all_text(F.col("_tree")),
        F.lit("published_at"), epoch_ms_iso("_item.publishTimestamp"),
    )
    path = "concat('/zh-CN/newsflash/', coalesce(_item.id, 'None'))"
    return parsed.select(
        *keys,
        F.col("_at").alias("pos"),
        urls.url_join("_base", path).alias("url"),
        fields.alias("fields"),
        "raw_html",
    )


def json_detail(raw_html: Column | str) -> Column:
    """Map of the fields a detail page embeds as JSON; empty ones are left out."""
    detail = read_embedded_json(raw_html, '"initData"', JSON_DETAIL, where="around")["initData"]["detail"]

    def entries(d: Column) -> Column:
        found = F.create_map(
            F.lit("title"), d["title"],
            F.lit("content"), d["description"],
            F.lit("original_url"), d["newsUrl"],
            F.lit("published_at"), epoch_ms_iso(d["publishTimestamp"]),
        )
        return F.when(
            d.isNotNull(), F.map_filter(found, lambda _, v: F.coalesce(v != "", F.lit(False)))
        )

    return let(detail, entries)


# Labels of the timeline's navigation that are not news.
TIMELINE_LABELS = ["热门", "7x24", "视频", "基金", "资讯", "达人", "私募", "ETF"]
_CLOCK_LINE = r"^\d{2}:\d{2}$"
_DATE_LINE = r"^\d+[十月年]"
MIN_ITEM_CHARS = 10


def timeline_items_sql(text: str) -> str:
    """Items of timeline text: a clock line opens one, the lines after it belong to it.

    Marking each clock line with a line end and joining everything by blanks
    lets one split give the items: linear, and inside the row.
    """
    lines = f"transform(split({text}, '\\n'), raw -> {u_strip_sql('raw')})"
    labels = ", ".join(text_sql(label) for label in TIMELINE_LABELS)
    wanted = (
        f"filter({lines}, line -> line <> '' and line not in ({labels}) "
        f"and not rlike(line, {text_sql(_DATE_LINE)}))"
    )
    marked = f"transform({wanted}, line -> if(rlike(line, {text_sql(_CLOCK_LINE)}), concat('\\n', line), line))"
    items = f"transform(split(array_join({marked}, ' '), '\\n'), raw -> {u_strip_sql('raw')})"
    # What stands before the first clock line belongs to no item.
    return f"filter({items}, (item, i) -> i > 0 and length(item) > {MIN_ITEM_CHARS})"


def timeline_text_records(
    pages: DataFrame, text: str, *keys: str, url: str = "url"
) -> DataFrame:
    """Records of timeline text: keys, pos, url, fields, raw_html."""
    items = pages.select(
        *keys,
        F.expr(url).alias("_base"),
        F.posexplode(F.expr(timeline_items_sql(text))).alias("pos", "raw_html"),
    ).withColumn("_split", time_and_rest("raw_html"))
    fields = F.create_map(
        F.lit("title"), title_cut("_split.rest"),
        F.lit("content"), F.col("_split.rest"),
        F.lit("published_at"), F.col("_split.time"),
    )
    return items.select(
        *keys,
        "pos",
        F.concat(F.col("_base"), F.lit("#item_"), F.col("pos").cast("string")).alias("url"),
        fields.alias("fields"),
        "raw_html",
    )


def timeline_text(selector: str = ".style_home__timeline_1Tz") -> Column:
    """Text lines of the timeline element of a page that carries a ``tree``."""
    first = sel.first_match_sql("tree.nodes", sel.steps_sql(selector), "tree.postings")
    return F.expr(bind_sql("node", first, sel.node_text_sql("tree.texts", "node", "\n")))


# --- families of pages ---------------------------------------------------------

# Host parts that have an extractor of their own.
HOST_FAMILIES = {
    "foresightnews.pro": "cards",
    "odaily.news": "json_list",
    "xueqiu.com": "timeline_text",
}


def host_family(url: str, families: dict[str, str] | None = None) -> Column:
    """Which extractor a page needs, by its host; ``generic`` if none is named."""
    cases = [
        f"when contains(host, {text_sql(part)}) then {text_sql(family)}"
        for part, family in (families or HOST_FAMILIES).items()
    ]
    return F.expr(
        bind_sql("host", urls.url_host_sql(url), f"case {' '.join(cases)} else 'generic' end")
    )


Extractor = Callable[..., DataFrame]


def family_records(
    trees: DataFrame, *keys: str, extra: dict[str, Extractor] | None = None
) -> DataFrame:
    """Records of all pages, each by the extractor of its ``family``.

    ``trees`` carries ``family``, ``rule_set`` and ``entry_steps``. ``extra``
    adds or replaces extractors: ``function(trees, *keys) -> DataFrame``.
    """
    extractors: dict[str, Extractor] = {
        "generic": lambda df, *k: list_records(df, "entry_steps", *k),
        "cards": timeline_cards,
        "json_list": json_list_records,
        "timeline_text": lambda df, *k: timeline_text_records(
            df.withColumn("_lines", timeline_text()), "_lines", *k
        ),
        **(extra or {}),
    }
    branches = [
        extract(trees.filter(F.col("family") == family), *keys)
        for family, extract in extractors.items()
    ]
    records = branches[0]
    for branch in branches[1:]:
        records = records.unionByName(branch, allowMissingColumns=True)
    return records


def prefer_records(records: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the sources that have no list records.

    The side asked for is one row per source at most, so it is size-checked
    and sent out: a source with a third of all links needs no shuffle.
    """
    having = records.select("source_name").distinct()
    return links.join(checked_broadcast(having), "source_name", "left_anti")
