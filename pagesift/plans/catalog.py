"""Every operator as a query over the test tables, with the same thing in SQL.

Mapping of the tables: a document is a parsed record (content = text, source =
source, store = lang), an event a timed record or a fetch attempt, a page a
captured page, a conversation a timeline. "Now" is the newest event, never the
clock.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import text as tx
from pagesift.functions import times as tm
from pagesift.functions import urls
from pagesift.functions.embedded import read_embedded_json
from pagesift.operators import dedup, extract, filters, keywords, records, report, running
from pagesift.operators import nodes as tree_ops
from pagesift.operators import selectors as sel
from pagesift.plans import run
from pagesift.schemas import HISTORY, SOURCES
from pagesift.session import materialize, work_folder
from pagesift.sinks import files
from pagesift.sources import history, history_merge
from pagesift.sources import pages as page_source
from pagesift.sources.logs import log_files, newest_lines, recent_log
from pagesift.sources.page_store import PageStore
from pagesift.sources.rules import read_rules, rules_table
from pagesift.streaming import ingest, late, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PARSED = """
  SELECT doc_id, source AS source_name, lang AS store_key, 'https://' || source || '/' || doc_id AS url,
         sha256(text) AS content_hash FROM documents"""

LATEST = datetime(2024, 1, 30, 23, 59, 59, tzinfo=timezone.utc)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pages -------------------------------------------------------------------


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_source.spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.withColumn("source_name", F.lit("web"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_ops.page_nodes(captured(spark, sf_dir))


def field(spark: SparkSession, sf_dir: str, name: str, selectors: list[str]) -> DataFrame:
    rules = rules_table(spark, {"web": {name: selectors}})
    filled = extract.detail_fields(captured(spark, sf_dir), rules)
    return filled.select("page_id", F.col("fields")[name].alias(name))


def unescaped(sql: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return f"regexp_replace({sql}, '&amp;?', '&', 'g')"


BASE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1)"
HREFS = f"regexp_extract_all({NAV}, 'href=\"([^\"]*)\"', 1)"
LINKS = f"""
  SELECT page_id, {BASE} || href AS link, i - 1 AS spot FROM (
    SELECT page_id, url, unnest({HREFS}) AS href, generate_subscripts({HREFS}, 1) AS i
    FROM pages)"""


@query(
    f"""
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(spot)) - 1 AS INTEGER) AS pos, link
    FROM ({LINKS}) GROUP BY page_id, link"""
)
def entry_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.entry_links(
        trees(spark, sf_dir), sel.steps_sql("nav ul li a"), "page_id"
    )


@query(
    f"""
    SELECT path, page_id, pos FROM (
      SELECT regexp_replace(link, '^[a-z]+://[^/]*', '') AS path, page_id, CAST(spot AS INTEGER) AS pos,
             row_number() OVER (PARTITION BY regexp_replace(link, '^[a-z]+://[^/]*', '')
                                ORDER BY page_id, spot) AS r
      FROM ({LINKS})) WHERE r = 1"""
)
def entry_links_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = sel.selected_rows(trees(spark, sf_dir), "nav ul li a", "page_id").select(
        "page_id", "pos", sel.node_attr("node", "href").alias("path")
    )
    return dedup.first_per_key(
        hrefs.filter(urls.usable_link("path")), ["path"], ["page_id", "pos"]
    )


@query(
    f"""
    SELECT regexp_extract(url, '//([^/?#:]*)', 1) AS source_name, count(*) AS total
    FROM ({LINKS}) l JOIN pages USING (page_id) GROUP BY 1"""
)
def link_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = trees(spark, sf_dir).withColumn("source_name", urls.url_host("url"))
    links = sel.selected_rows(pages, "nav ul li a[href]", "source_name")
    return report.totals(links, "source_name")


@query(
    f"""
    WITH s AS (
      SELECT regexp_extract(url, '//([^/?#:]*)', 1) AS source_name, min(url) AS target_url FROM pages GROUP BY 1),
    l AS (
      SELECT source_name, link, count(*) AS n FROM ({LINKS}) JOIN pages USING (page_id)
      JOIN s ON source_name = regexp_extract(url, '//([^/?#:]*)', 1)
      WHERE regexp_matches(link, '^[a-z]+://[^/]*/th') GROUP BY ALL)
    SELECT * FROM l UNION ALL
    SELECT source_name, target_url, 1 FROM s WHERE source_name NOT IN (SELECT source_name FROM l)"""
)
def links_or_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = captured(spark, sf_dir).withColumn("source_name", urls.url_host("url"))
    sources = pages.groupBy("source_name").agg(F.min("url").alias("target_url"))
    links = extract.entry_links(
        tree_ops.page_nodes(pages), sel.steps_sql('nav > ul a[href^="/th"]'), "source_name"
    )
    both = extract.links_or_target(links, sources)
    return both.groupBy("source_name", "link").agg(F.count(F.lit(1)).alias("n"))


def trimmed(sql: str) -> str:
    return f"trim({sql}, ' ' || chr(10))"


TITLE = trimmed(unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))


@query(f"SELECT page_id, nullif({TITLE}, '') AS title FROM pages")
def detail_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "title", ["h1.headline", "h1"])


HEAD_TITLE = trimmed(unescaped("regexp_extract(html, '<title>(.*?)</title>', 1)"))


@query(f"SELECT page_id, {HEAD_TITLE} AS title FROM pages")
def detail_title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "title", ["h1.headline", "div.title::html"])


def pieces_sql(inner: str) -> str:
    parts = f"regexp_split_to_array({inner}, '<[^>]*>')"
    trimmed = f"list_transform({parts}, lambda x: trim({unescaped('x')}, ' ' || chr(10)))"
    return f"array_to_string(list_filter({trimmed}, lambda x: x <> ''), ' ')"


CONTENT = pieces_sql("regexp_extract(html, '<article>(.*?)</article>', 1, 's')")


@query(f"SELECT page_id, nullif({CONTENT}, '') AS content FROM pages")
def detail_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "content", [".article-content", "article"])


@query(
    f"""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Notes on page ' || page_id WHEN page_id % 3 = 1 THEN 'About page ' || page_id
      ELSE nullif({CONTENT}, '') END AS content FROM pages"""
)
def content_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pages has a description, a third one for sharing, and only the rest an article."""
    kind = F.element_at(F.array(F.lit('name="description"'), F.lit('property="og:description"')), (F.col("page_id") % 3 + 1).cast("int"))
    words = F.element_at(F.array(F.lit("Notes on page "), F.lit("About page ")), (F.col("page_id") % 3 + 1).cast("int"))
    meta = F.concat(F.lit("<head><meta "), kind, F.lit(' content="'), words, "page_id", F.lit('">'))
    bare = F.replace(F.replace("html", F.lit("<head>"), meta), F.lit("article>"), F.lit("main>"))
    pages = captured(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 3 < 2, bare).otherwise(F.col("html")))
    filled = extract.detail_fields(pages, rules_table(spark, {"web": {"content": [".none", "article"]}}))
    return filled.select("page_id", F.col("fields")["content"].alias("content"))


@query("SELECT page_id, regexp_extract(html, '<article>.*?</article>', 0, 's') AS content_html FROM pages")
def detail_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "content_html", ["article::html"])


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def detail_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "lang", ["html::attr:missing", "html::ATTR:lang"])


@query(
    """
    WITH p AS (SELECT page_id, regexp_replace(html, '<script>.*?</script>', '<script></script>', 'g') AS h FROM pages)
    SELECT page_id,
      len(regexp_extract_all(h, '<[a-z]')) AS n_nodes,
      len(regexp_extract_all(h, '<p[ >]')) AS n_p,
      len(regexp_extract_all(h, '<li[ >]')) AS n_li FROM p"""
)
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree_ops.node_rows(trees(spark, sf_dir), "page_id")
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("tag") == "p").alias("n_p"),
        F.count_if(F.col("tag") == "li").alias("n_li"),
    )


LIST_ITEMS = f"""
  SELECT page_id, {BASE} || regexp_extract(li, 'href="([^"]*)"', 1) AS url,
         {unescaped("regexp_extract(li, '<a[^>]*>(.*?)</a>', 1)")} AS title, li AS raw_html, i - 1 AS spot
  FROM (SELECT page_id, url, unnest(regexp_extract_all({NAV}, '<li>.*?</li>')) AS li,
               generate_subscripts(regexp_extract_all({NAV}, '<li>.*?</li>'), 1) AS i FROM pages)"""


@query(
    f"""
    SELECT page_id, CAST(min(spot) AS INTEGER) AS pos, url, max_by(title, spot) AS title, max_by(raw_html, spot) AS raw_html
    FROM ({LIST_ITEMS}) GROUP BY page_id, url"""
)
def list_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rules_table(spark, {"web": {"title": ["b", "a"]}})
    pages = tree_ops.page_nodes(extract.attach_rules(captured(spark, sf_dir), rules, fallbacks=False))
    found = extract.list_records(pages, sel.steps_sql("nav ul li"), "page_id")
    return found.select("page_id", "pos", "url", F.col("fields")["title"].alias("title"), "raw_html")


@query(
    f"""
    SELECT url, max_by(page_id, page_id * 1000 + spot) AS page_id,
           CAST(max_by(spot, page_id * 1000 + spot) AS INTEGER) AS pos
    FROM ({LIST_ITEMS}) GROUP BY url"""
)
def list_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sel.selected_rows(trees(spark, sf_dir), "nav ul li > a", "page_id", "url")
    keyed = rows.select(
        "page_id",
        "pos",
        urls.url_join("url", "node.attrs['href']").alias("url"),
        (F.col("page_id") * 1000 + F.col("pos")).alias("place"),
    )
    return dedup.last_per_key(keyed, ["url"], "place").drop("place")


@query(
    """
    SELECT page_id, host, CASE WHEN contains(host, 'example.com') THEN 'com'
      WHEN contains(host, 'example.net') THEN 'net' ELSE 'generic' END AS family
    FROM (SELECT page_id, lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host FROM pages)"""
)
def host_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"example.com": "com", "example.net": "net"}
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.url_host("url").alias("host"),
        extract.host_family("url", families).alias("family"),
    )


@query(
    f"""
    SELECT page_id, CAST(min(spot) AS INTEGER) AS pos, key AS url, max_by(title, spot) AS title FROM (
      SELECT l.*, CASE page_id % 3 WHEN 2 THEN l.url
        ELSE regexp_replace(p.url, '#.*', '') || CASE page_id % 3 WHEN 0 THEN '#id-' ELSE '#time-' END
          || regexp_extract(raw_html, 'href="([^"]*)"', 1) END AS key
      FROM ({LIST_ITEMS}) l JOIN pages p USING (page_id)) GROUP BY page_id, key"""
)
def list_item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a link are known by their id, or else by their time."""
    name = F.element_at(F.array(F.lit("id"), F.lit("time")), (F.col("page_id") % 3 + 1).cast("int"))
    marked = F.regexp_replace("html", F.lit('<li><a href="([^"]*)">'), F.concat(F.lit("<li data-"), name, F.lit('="$1"><a>')))
    pages = captured(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 3 < 2, marked).otherwise(F.col("html")))
    rules = rules_table(spark, {"web": {"title": ["b", "a"]}})
    ready = tree_ops.page_nodes(extract.attach_rules(pages, rules, fallbacks=False))
    found = extract.list_records(ready, sel.steps_sql("nav ul li"), "page_id")
    return found.select("page_id", "pos", "url", F.col("fields")["title"].alias("title"))


@query("SELECT url, html, CASE page_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS source_name FROM pages")
def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures stored in two formats; of each the rows of one source are read, together all."""
    home = work_folder(spark, "pages")
    source = F.when(F.col("page_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    pages = table(spark, sf_dir, "pages").select("url", F.lit(200).alias("status"), "html", source.alias("source_name"))
    pages.write.parquet(f"{home}/parquet")
    pages.write.json(f"{home}/json")
    even = page_source.read_pages(spark, f"{home}/parquet", "even")
    odd = page_source.read_pages(spark, f"{home}/json", "odd", fmt="json")
    names = ["url", "html", "source_name"]
    return even.select(*names).unionByName(odd.select(*names))


@query(
    f"""
    WITH h AS (SELECT page_id, url, html, contains(lower(regexp_extract(url, '//([^/?#:]*)', 1)), 'example.net') AS net FROM pages)
    SELECT page_id, CAST(min(spot) AS INTEGER) AS pos, l.url, max_by(title, spot) AS title, max_by(raw_html, spot) AS raw_html
    FROM ({LIST_ITEMS}) l WHERE page_id IN (SELECT page_id FROM h WHERE NOT net) GROUP BY page_id, l.url
    UNION ALL SELECT page_id, 0, url, url, html FROM h WHERE net"""
)
def family_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page by the extractor of its host's family, and the records of all families together."""
    def whole_page(pages: DataFrame, *keys: str) -> DataFrame:
        fields = F.create_map(F.lit("title"), F.col("url"))
        return pages.select(*keys, F.lit(0).alias("pos"), "url", fields.alias("fields"), F.col("html").alias("raw_html"))

    pages = trees(spark, sf_dir).withColumn("family", extract.host_family("url", {"example.net": "net"}))
    pages = extract.attach_rules(pages, rules_table(spark, {"web": {"title": ["b", "a"]}}), fallbacks=False)
    pages = pages.withColumn("entry_steps", sel.selector_steps(F.lit("nav ul li")))
    found = extract.family_records(pages, "page_id", extra={"net": whole_page})
    return found.select("page_id", "pos", "url", F.col("fields")["title"].alias("title"), "raw_html")


@query(
    f"""
    WITH i AS (SELECT page_id, url, lower(regexp_extract(p.url, '//([^/?#:]*)', 1)) AS host FROM pages p),
    listed AS (
      SELECT 'list' AS origin, host AS source_name, l.url AS url FROM ({LIST_ITEMS}) l JOIN i USING (page_id)
      WHERE contains(host, 'example.com')),
    linked AS (
      SELECT 'link' AS origin, host AS source_name, link AS url FROM ({LINKS}) JOIN i USING (page_id)
      WHERE host NOT IN (SELECT source_name FROM listed))
    SELECT origin, source_name, url, count(*) AS n FROM (
      SELECT DISTINCT origin, source_name, u.url AS url, page_id FROM (
        SELECT 'list' AS origin, host AS source_name, l.url AS url, page_id FROM ({LIST_ITEMS}) l JOIN i USING (page_id)
        WHERE contains(host, 'example.com')
        UNION ALL
        SELECT 'link', host, link, page_id FROM ({LINKS}) JOIN i USING (page_id)
        WHERE host NOT IN (SELECT source_name FROM listed)) u)
    GROUP BY ALL"""
)
def records_replace_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rules_table(spark, {"web": {"title": "a"}})
    pages = extract.attach_rules(trees(spark, sf_dir), rules, fallbacks=False).withColumn(
        "source_name", urls.url_host("url")
    )
    listed = extract.list_records(
        pages.filter(F.contains("source_name", F.lit("example.com"))),
        sel.steps_sql("nav ul li"),
        "source_name",
    )
    links = extract.entry_links(pages, sel.steps_sql("nav ul li a"), "source_name")
    kept = extract.prefer_records(listed, links)
    work = listed.select(F.lit("list").alias("origin"), "source_name", "url").unionByName(
        kept.select(F.lit("link").alias("origin"), "source_name", F.col("link").alias("url"))
    )
    return work.groupBy("origin", "source_name", "url").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
    SELECT page_id, {BASE} || '/a/' || page_id AS up, {BASE} || '/c?q=' || page_id AS sibling,
           split_part(url, '#', 1) || '#part' AS anchor,
           'https://other.example/x' AS elsewhere FROM pages"""
)
def url_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = table(spark, sf_dir, "pages").withColumn("base", urls.url_join("url", "'/a/b/d'"))
    return moved.select(
        "page_id",
        urls.url_join("base", "concat('.././', page_id)").alias("up"),
        urls.url_join("base", "concat('../../c?q=', page_id)").alias("sibling"),
        urls.url_join("url", "'#part'").alias("anchor"),
        urls.url_join("url", "'https://other.example/x'").alias("elsewhere"),
    )


# --- pages with embedded data, made from documents -----------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For work that is bound by computing, not by reading."""
    return page_source.spread(documents(spark, sf_dir), "doc_id")


CLEAN = f"trim({unescaped('text')}, ' ' || chr(10))"


@query(
    f"""
    SELECT doc_id, 0 AS pos, 'https://odaily.news/zh-CN/newsflash/' || doc_id AS url, left(text, 60) AS title,
           {CLEAN} AS content, strftime(make_timestamp((1704067200000 + doc_id) * 1000), '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN doc_id % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '000' END
             || '+00:00' AS published_at
    FROM documents"""
)
def json_list_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("description"),
        (F.lit(1704067200000) + F.col("doc_id")).alias("publishTimestamp"),
    )
    inner = F.to_json(F.struct(F.struct(F.array(item).alias("list")).alias("pageResult")))
    pages = spread_documents(spark, sf_dir).select(
        "doc_id",
        F.lit("https://odaily.news/zh-CN").alias("url"),
        F.concat(F.lit('<html><script>var x={"initData":'), inner, F.lit("};</script></html>")).alias("html"),
    )
    found = extract.json_list_records(pages, "doc_id")
    return found.select(
        "doc_id", "pos", "url", *[F.col("fields")[n].alias(n) for n in ("title", "content", "published_at")]
    )


@query(
    """
    SELECT doc_id, pos, 'https://odaily.news/zh-CN/newsflash/' || id AS url, title FROM (
      SELECT doc_id, 0 AS pos, CAST(doc_id AS VARCHAR) AS id, lang AS title FROM documents
      UNION ALL SELECT doc_id, 1, 'b' || doc_id, source FROM documents)"""
)
def json_list_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that name an item twice: the last one counts, at the place of the first."""
    def item(key: Column, title: str) -> Column:
        return F.struct(
            key.alias("id"), F.col(title).alias("title"), F.col("text").alias("description"),
            F.lit(1704067200000).alias("publishTimestamp"),
        )

    first = F.col("doc_id").cast("string")
    items = F.array(item(first, "source"), item(F.concat(F.lit("b"), "doc_id"), "source"), item(first, "lang"))
    inner = F.to_json(F.struct(F.struct(items.alias("list")).alias("pageResult")))
    pages = spread_documents(spark, sf_dir).select(
        "doc_id",
        F.lit("https://odaily.news/zh-CN").alias("url"),
        F.concat(F.lit('<html><script>var x={"initData":'), inner, F.lit("};</script></html>")).alias("html"),
    )
    found = extract.json_list_records(pages, "doc_id")
    return found.select("doc_id", "pos", "url", F.col("fields")["title"].alias("title"))


@query(
    """
    SELECT doc_id, text AS content, left(text, 40) AS title, 'https://n.example/' || doc_id AS original_url,
           strftime(make_timestamp((1704067200 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_at
    FROM documents"""
)
def json_detail_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.struct(
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string")).alias("newsUrl"),
        ((F.lit(1704067200) + F.col("doc_id")) * 1000).alias("publishTimestamp"),
    )
    payload = F.to_json(F.struct(F.struct(detail.alias("detail")).alias("initData")))
    pages = spread_documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("<html><body>{}"), payload, F.lit("</body></html>")).alias("raw_html")
    )
    got = pages.select("doc_id", extract.json_detail("raw_html").alias("d"))
    return got.select(
        "doc_id", *[F.col("d")[n].alias(n) for n in ("title", "content", "original_url", "published_at")]
    )


@query(
    f"""
    SELECT doc_id, 0 AS pos, 'https://foresightnews.pro/news/' || doc_id AS url, 'Topic ' || doc_id AS title,
           {CLEAN} AS content, CASE WHEN lang = 'en' THEN '2024-05-20 10:00' END AS published_at
    FROM documents"""
)
def timeline_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    time = F.when(
        F.col("lang") == "en", F.lit('<span class="topic-time">2024-05-20 10:00</span>')
    ).otherwise(F.lit(""))
    card = F.concat(
        F.lit('<html><body><div class="list_body"><div class="topic">Topic '), number,
        F.lit('</div><a class="news_body_title" href="/news/'), number,
        F.lit('"></a><div class="detail-body">'), F.col("text"), F.lit("</div>"), time,
        F.lit('</div><div class="list_body"><a class="news_body_title" href="/none">no content</a></div>'),
        F.lit("</body></html>"),
    )
    pages = spread_documents(spark, sf_dir).select(
        "doc_id", "lang", F.lit("https://foresightnews.pro").alias("url"), card.alias("html")
    )
    cards = extract.timeline_cards(tree_ops.page_nodes(pages), "doc_id")
    return cards.select(
        "doc_id", "pos", "url", *[F.col("fields")[n].alias(n) for n in ("title", "content", "published_at")]
    )


TIMELINE_ITEMS = """
  SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
      lambda x, i: lpad(CAST((i - 1) % 24 AS VARCHAR), 2, '0') || ':30 ' || trim(x)), lambda x: length(x) > 10) AS items
    FROM documents)"""


@query(
    f"""
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, 'https://xueqiu.com#item_' || pos AS url,
      CASE WHEN length(item) > 106 THEN substr(item, 7, 100) || '...' ELSE substr(item, 7) END AS title,
      substr(item, 7) AS content, left(item, 5) AS published_at
    FROM ({TIMELINE_ITEMS})"""
)
def timeline_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":30\n热门\n17十月\n"), line
        ),
    )
    pages = spread_documents(spark, sf_dir).select(
        "doc_id",
        F.lit("https://xueqiu.com").alias("url"),
        F.concat(F.lit("before any item\n"), F.array_join(lines, "\n")).alias("lines"),
    )
    found = extract.timeline_text_records(pages, "lines", "doc_id")
    return found.select(
        "doc_id", "pos", "url", *[F.col("fields")[n].alias(n) for n in ("title", "content", "published_at")]
    )


@query(
    """
    SELECT conv_id, CAST(island - 1 AS BIGINT) AS item, min(turn) AS first_pos, count(*) AS n_lines,
           string_agg(text, ' ' ORDER BY turn) AS text
    FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
            OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations)
    WHERE island > 0 GROUP BY conv_id, island"""
)
def timeline_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations")
    return running.island_texts(lines, ["conv_id"], "turn", "text", F.col("role") == "user")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<script>{} window.data = "), F.col("props"), F.lit(";</script>"))
    return table(spark, sf_dir, "events").select(
        "event_id", read_embedded_json(text, '"k"', "k BIGINT", where="around")["k"].alias("k")
    )


@query(
    """
    SELECT source AS page, key, doc_id AS round FROM (
      SELECT source, sha256(text) AS key, doc_id,
             row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents)
    WHERE r = 1"""
)
def merge_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = documents(spark, sf_dir).select(
        F.col("source").alias("page"), tx.content_hash("text").alias("key"), F.col("doc_id").alias("round")
    )
    return page_source.merge_snapshots(captures, ["page", "key"], ["round"])


# --- whole runs over pages -------------------------------------------------------


PAGE_RULES = {
    "title": ["h1", "title"],
    "content": ["article"],
    "lang": ["html::attr:lang"],
}
RUN_TS = datetime(2024, 2, 1, tzinfo=timezone.utc)


def page_sources(spark: SparkSession) -> DataFrame:
    """One source for everything on the web; its store is its own."""
    return spark.createDataFrame(
        [("web", "news", "https://web.example/", "nav ul li a", [], True, False, True, True, "web", "json")],
        SOURCES,
    )


def page_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(spark, sf_dir).select("source_name", "url", "html", F.lit(200).alias("status"))


def page_run(spark: SparkSession, sf_dir: str) -> run.RunResult:
    return run.run_batch(
        page_batch(spark, sf_dir),
        page_sources(spark),
        rules_table(spark, {"web": PAGE_RULES}),
        spark.createDataFrame([], HISTORY),
        run.RunOptions(run_ts=RUN_TS, follow_links=False),
    )


PAGE_OUTCOMES = f"""
  SELECT url, title, content, summary, reason, CASE WHEN reason IS NULL AND r > 1 THEN 'duplicate' ELSE reason END AS why
  FROM (SELECT *, row_number() OVER (PARTITION BY content, reason ORDER BY url) AS r FROM (
    SELECT url, title, content, CASE WHEN title = '' THEN 'missing_title'
      WHEN length(content) < 40 THEN 'content_too_short' END AS reason,
      CASE WHEN length(content) <= 240 THEN content
        ELSE rtrim(regexp_extract(content, '^(.{{0,239}}) ', 1)) || '…' END AS summary
    FROM (SELECT url, {TITLE} AS title, {CONTENT} AS content FROM pages)))"""


@query(
    f"""
    SELECT url, title, content, summary FROM ({PAGE_OUTCOMES}) WHERE why IS NULL"""
)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.core_columns(page_run(spark, sf_dir).records).select(
        "url", "title", "content", "summary"
    )


@query(
    f"""
    SELECT source_name, count(*) FILTER (why IS NULL) AS success,
      count(*) FILTER (why IN ('missing_title', 'content_too_short')) AS failed,
      count(*) FILTER (why = 'duplicate') AS skipped, 0 AS window_filtered,
      count(*) FILTER (why IN ('missing_title', 'content_too_short')) > 0 AS any_failed, false AS no_result
    FROM ({PAGE_OUTCOMES}), (VALUES ('web'), (NULL)) s(source_name) GROUP BY source_name"""
)
def page_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_run(spark, sf_dir).summary


@query(f"SELECT url, title, content FROM ({PAGE_OUTCOMES}) WHERE why IS NULL")
def page_recaptures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages captured three times, kept in a page store: the first capture of each counts, once."""
    pages = captured(spark, sf_dir).select("source_name", "url", "html", F.lit(200).alias("status"))
    at = lambda day: F.to_timestamp(F.lit(f"2024-01-{day:02d} 00:00:00"))
    later = pages.withColumn("html", F.concat("html", F.lit("<p>later</p>")))
    both = pages.withColumn("fetched_at", at(1)).unionByName(later.withColumn("fetched_at", at(2)))
    both = both.unionByName(pages.withColumn("fetched_at", at(1)))
    store = PageStore(spark, work_folder(spark, "captures"), buckets=8)
    store.append(both, "b1")
    result = run.run_batch(
        store.read(),
        page_sources(spark),
        rules_table(spark, {"web": PAGE_RULES}),
        spark.createDataFrame([], HISTORY),
        run.RunOptions(run_ts=RUN_TS, follow_links=False),
    )
    return records.core_columns(result.records).select("url", "title", "content")


@query(
    """
    SELECT CASE page_id % 3 WHEN 0 THEN 'b1' ELSE 'b2' END AS batch, 'web' AS source_name, url, html, count(*) AS captures
    FROM pages GROUP BY ALL"""
)
def pages_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page store filled in two batches, each written twice, and opened anew."""
    path = work_folder(spark, "pages")
    pages = captured(spark, sf_dir).withColumn("status", F.lit(200))
    first = F.col("page_id") % 3 == 0
    for _ in range(2):
        PageStore(spark, path, buckets=8).append(pages.filter(first), "b1")
        PageStore(spark, path, buckets=16).append(pages.filter(~first), "b2")
    stored = PageStore(spark, path).read(source="web")
    return stored.groupBy("batch", "source_name", "url", "html").agg(F.count(F.lit(1)).alias("captures"))


ENTRY_LINKS = f"""
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(spot)) - 1 AS pos, link FROM ({LINKS}) GROUP BY page_id, link"""


@query(
    f"""
    WITH e AS (SELECT lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host, min(page_id) AS page_id FROM pages GROUP BY 1),
    l AS (SELECT host, host NOT LIKE '%.org' AS incremental, page_id + 1 + pos AS page_id, pos, link
      FROM e JOIN ({ENTRY_LINKS}) USING (page_id)),
    f AS (SELECT l.*, html, {TITLE} AS title, {CONTENT} AS content FROM l LEFT JOIN pages USING (page_id)),
    j AS (SELECT *, CASE WHEN incremental AND pos = 0 THEN 'known_url' WHEN html IS NULL OR page_id % 7 = 0 THEN 'not_fetched'
        WHEN NOT contains(lower(link || ' ' || host || ' ' || html), 'thth') THEN 'keyword'
        WHEN title = '' THEN 'missing_title' WHEN length(content) < 40 THEN 'content_too_short'
        WHEN page_id % 3 = 0 THEN 'window_filtered' END AS bad FROM f),
    d AS (SELECT *, CASE WHEN bad IS NULL AND incremental AND row_number() OVER (
        PARTITION BY incremental, bad, content ORDER BY host, pos, link) > 1 THEN 'duplicate' ELSE bad END AS reason FROM j)
    SELECT host AS source_name, link AS url, reason, CASE WHEN reason IS NULL THEN 'success'
      WHEN reason IN ('keyword', 'window_filtered', 'duplicate', 'known_url') THEN 'skipped' ELSE 'failed' END AS status FROM d"""
)
def linked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of a source per host: entry page, links, history, captures, keywords, window, dedup.

    A host's first page is its entry page; its links are captured with the sources
    of the pages that follow it, some without success (503; a 404 page
    counts). The first link is known, which matters to incremental sources only.
    """
    pages = captured(spark, sf_dir).withColumn("source_name", urls.url_host("url"))
    first = pages.groupBy("source_name").agg(F.min_by("url", "page_id").alias("target_url"), F.min("page_id").alias("page_id"))
    first = materialize(first, "first-pages")
    incremental = ~F.col("source_name").endswith(".org")
    sources = first.select(
        "source_name", F.lit("news").alias("site_type"), "target_url", F.lit("nav ul li a").alias("entry_pattern"),
        F.array(F.lit("thth")).alias("keywords"), incremental.alias("incremental"), F.lit(False).alias("use_entry_content"),
        F.lit(True).alias("by_url"), F.lit(True).alias("by_content"),
        F.when(incremental, F.lit("shared")).otherwise(F.lit("own")).alias("store_key"), F.lit("json").alias("output_format"),
    )
    fields = [(f, i, r, c) for i, (f, cs) in enumerate(PAGE_RULES.items()) for r, c in enumerate(cs)]
    names = ["field", "field_pos", "rank", "selector"]
    each = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, f)]) for f in fields]
    rules = first.select("source_name", F.inline(F.array(*each)))
    entry = tree_ops.page_nodes(pages.join(first.select("page_id"), "page_id", "left_semi"))
    links = materialize(extract.entry_links(entry, sel.steps_sql("nav ul li a"), "source_name", "page_id"), "links")
    at = F.when(F.col("page_id") % 3 == 0, F.lit("2023-06-01 12:00:00")).otherwise(F.lit("2024-01-15 12:00:00"))
    linked = links.select("source_name", F.col("link").alias("url"), (F.col("page_id") + 1 + F.col("pos")).alias("page_id"))
    status = F.when(F.col("page_id") % 7 == 0, 503).when(F.col("page_id") % 7 == 1, 404).otherwise(200).alias("status")
    details = linked.join(pages.select("page_id", "html"), "page_id").select("*", status)
    both = pages.select("source_name", "url", "page_id", "html", F.lit(200).alias("status")).unionByName(details)
    captures = both.select("source_name", "url", "html", "status", F.to_timestamp(at).alias("fetched_at"))
    store = PageStore(spark, work_folder(spark, "captures"), buckets=8)
    store.append(captures, "b1")
    known = links.filter("pos = 0").select(
        F.lit("shared").alias("store_key"), F.col("link").alias("url"), tx.content_hash("link").alias("content_hash"),
        F.lit(LATEST).alias("ts"), "source_name",
    )
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    result = run.run_batch(store.read(), sources, rules, known, run.RunOptions(run_ts=RUN_TS, window=(start, RUN_TS)))
    return result.outcomes.select("source_name", "url", "reason", "status")


@query(
    """
    WITH i AS (SELECT doc_id // 20 AS page_id, string_agg('<li>' || text || '</li>', chr(10) ORDER BY doc_id) AS items
      FROM documents GROUP BY 1)
    SELECT page_id, sha256(html || coalesce(chr(10) || items, '')) AS html_hash FROM pages LEFT JOIN i USING (page_id)"""
)
def pages_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the items that were loaded later behind their own HTML, in the order of the items."""
    items = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 20").alias("page_id"), "doc_id", F.concat(F.lit("<li>"), "text", F.lit("</li>")).alias("html")
    )
    whole = page_source.append_items(captured(spark, sf_dir), items, "page_id", ["doc_id"])
    return whole.select("page_id", F.sha2("html", 256).alias("html_hash"))


# --- streams ---------------------------------------------------------------------


@query(f"SELECT url, title, content, summary FROM ({PAGE_OUTCOMES}) WHERE why IS NULL")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run as ``page_records``, fed by a stream of page files."""
    home = work_folder(spark, "ingest")
    stream = ingest.page_stream(
        spark, sf_dir, "page_id BIGINT, url STRING, html STRING", table="pages"
    ).select(F.lit("web").alias("source_name"), "url", "html", F.lit(200).alias("status"))
    ingest.run_stream(
        stream,
        page_sources(spark),
        rules_table(spark, {"web": PAGE_RULES}),
        home,
        run.RunOptions(run_ts=RUN_TS, follow_links=False),
    )
    stored = spark.read.parquet(f"{home}/records")
    return records.core_columns(stored).select("url", "title", "content", "summary")


@query(
    """
    SELECT lang AS store_key, sha256(text) AS content_hash, count(*) - 1 AS copies
    FROM documents GROUP BY 1, 2"""
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup of records against a history that grows from batch to batch."""
    home = work_folder(spark, "dedup")
    stream = ingest.page_stream(
        spark, sf_dir, "doc_id BIGINT, text STRING, lang STRING, source STRING", table="documents"
    ).select(
        F.col("source").alias("source_name"),
        F.col("lang").alias("store_key"),
        F.concat_ws("/", F.lit("https:/"), "source", F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("source_ord"),
        F.col("doc_id").alias("pos"),
        tx.content_hash("text").alias("content_hash"),
    )
    ingest.dedup_stream(stream, home, RUN_TS)
    seen = parsed(spark, sf_dir).groupBy("store_key", "content_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = spark.read.parquet(f"{home}/records")
    return kept.join(seen, ["store_key", "content_hash"]).select(
        "store_key", "content_hash", (F.col("n") - 1).alias("copies")
    )


EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ingest.page_stream(spark, sf_dir, EVENT_SCHEMA, table="events")
    return stream.withColumn("ts", tm.ntz_instant("ts"))


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY ALL")
def stream_bounded_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sight of a URL per store, with state kept for a bounded time only."""
    stream = event_stream(spark, sf_dir).select(
        "ts", F.col("event_type").alias("store_key"), F.col("user_id").cast("string").alias("url")
    )
    rows = ingest.collect_stream(ingest.bounded_dedup(stream, "60 days"), "append", "bounded")
    return rows.groupBy(
        F.col("store_key").alias("event_type"), F.col("url").cast("bigint").alias("user_id")
    ).agg(F.count(F.lit(1)).alias("n"))


STREAM_STATUS = (
    "CASE WHEN value < 2 THEN 'failed' WHEN value < 5 OR ts < TIMESTAMP '2024-01-05' THEN 'skipped' ELSE 'success' END"
)


@query(
    f"""
    SELECT event_type AS source_name, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS slot,
      count(*) FILTER (s = 'success') AS success, count(*) FILTER (s = 'failed') AS failed,
      count(*) FILTER (s = 'skipped') AS skipped,
      count(*) FILTER (s = 'skipped' AND value >= 5) AS window_filtered
    FROM (SELECT *, {STREAM_STATUS} AS s FROM events) GROUP BY 1, 2"""
)
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per source and time slot while a stream runs; late data is counted."""
    late = F.col("ts") < F.lit(datetime(2024, 1, 5, tzinfo=timezone.utc))
    outcomes_stream = event_stream(spark, sf_dir).select(
        "ts",
        F.col("event_type").alias("source_name"),
        F.when(F.col("value") < 2, "failed")
        .when((F.col("value") < 5) | late, "skipped")
        .otherwise("success")
        .alias("status"),
        F.when((F.col("value") >= 5) & late, "window_filtered").alias("reason"),
    )
    counted = ingest.live_counters(outcomes_stream, "60 days", "6 hours")
    latest = ingest.collect_stream(counted, "update", "counters")
    return latest.select(
        "source_name", F.unix_micros("slot_start").alias("slot"), *report.COUNTERS
    )


@query(
    f"""
    SELECT doc_id, store_key, content_hash FROM (SELECT *, row_number() OVER (
      PARTITION BY store_key, content_hash ORDER BY doc_id % 3, doc_id) AS n FROM ({PARSED})) WHERE n = 1"""
)
def stream_state_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup by kept state: three runs of one stream, each started anew from its checkpoint."""
    home = work_folder(spark, "state-dedup")
    rows = parsed(spark, sf_dir)
    for p in range(3):
        rows.filter(F.col("doc_id") % 3 == p).write.parquet(f"{home}/in/part-{p}")
        stream = ingest.page_stream(spark, f"{home}/in/*", ingest.schema_text(rows))
        ingest.to_files(state.keyed_dedup(stream), f"{home}/out", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/out").select("doc_id", "store_key", "content_hash")


ARRIVED = "ts + CASE WHEN event_id % 10 = 0 THEN INTERVAL 12 DAY ELSE INTERVAL 0 DAY END"


@query(
    f"""
    WITH a AS (SELECT *, CASE WHEN {ARRIVED} < TIMESTAMP '2024-01-11' THEN 0 WHEN {ARRIVED} < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS p FROM events),
    m AS (SELECT x.p, y.event_type, max(y.ts) - INTERVAL 1 DAY AS mark FROM (VALUES (1), (2)) x(p) JOIN a y ON y.p < x.p GROUP BY ALL),
    j AS (SELECT a.*, CASE WHEN ts < mark THEN 'late' WHEN ts < TIMESTAMP '2024-01-05' THEN 'window_filtered' END AS reason
      FROM a LEFT JOIN m USING (p, event_type))
    SELECT event_type AS source_name, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS slot,
      count(*) FILTER (reason IS NULL) AS success, 0 AS failed, count(*) FILTER (reason IS NOT NULL) AS skipped,
      count(*) FILTER (reason = 'window_filtered') AS window_filtered, count(*) FILTER (reason = 'late') AS late,
      count(*) FILTER (reason = 'late') AS in_table FROM j GROUP BY 1, 2"""
)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts of three micro-batches in which a tenth of the rows come twelve days late."""
    home = work_folder(spark, "late")
    events = event_times(spark, sf_dir).withColumnRenamed("event_type", "source_name")
    arrived = F.col("ts") + F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 12 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    at = lambda day: F.lit(datetime(2024, 1, day, tzinfo=timezone.utc))
    part = F.when(arrived < at(11), 0).when(arrived < at(21), 1).otherwise(2)
    rows = events.select("event_id", "source_name", "ts", part.alias("p"))
    for p in range(3):
        rows.filter(F.col("p") == p).drop("p").write.parquet(f"{home}/in/part-{p}")
        stream = ingest.page_stream(spark, f"{home}/in/*", ingest.schema_text(rows.drop("p")))
        late.route_stream(stream, home, "1 DAY", (datetime(2024, 1, 5, tzinfo=timezone.utc), RUN_TS), "6 hours")
    slot = F.unix_micros("slot_start").alias("slot")
    behind = spark.read.parquet(f"{home}/late").groupBy("source_name", F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("in_table"))
    behind = behind.select("source_name", F.col("w.start").alias("slot_start"), "in_table")
    counts = late.live_counts(spark, home).join(behind, ["source_name", "slot_start"], "left")
    return counts.select("source_name", slot, *report.COUNTERS, "late", F.coalesce("in_table", F.lit(0)).alias("in_table"))


# --- filters -------------------------------------------------------------------


@query(
    """
    SELECT doc_id FROM documents
    WHERE contains(lower(source || ' ' || text), 'zuver') OR contains(lower(source || ' ' || text), 'src7 ')
       OR contains(lower(source || ' ' || text), 'reentre')"""
)
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = filters.keyword_match(filters.haystack("source", "text"), ["Zuver", "SRC7 ", "reentre"])
    return documents(spark, sf_dir).filter(hit).select("doc_id")


@query(
    """
    WITH k AS (SELECT DISTINCT source, lower(substr(text, 5, 12)) AS keyword FROM documents JOIN labels USING (doc_id)
      WHERE length(text) >= 16 AND doc_id % 2 = 0)
    SELECT doc_id, source NOT IN (SELECT source FROM k)
      OR EXISTS (SELECT 1 FROM k WHERE k.source = d.source AND contains(lower(concat_ws(' ', d.source, d.text)), k.keyword)) AS hit
    FROM documents d"""
)
def keyword_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a table of keywords: passages of those that somebody labelled, for their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    words = known.filter((F.length("text") >= 16) & (F.col("doc_id") % 2 == 0)).select(
        F.col("source").alias("source_name"), F.substring("text", 5, 12).alias("keyword")
    )
    match = keywords.keyword_matcher(words)
    return docs.select("doc_id", match(filters.haystack("source", "text"), F.col("source")).alias("hit"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", tm.ntz_instant("ts"))


@query(
    """
    SELECT event_id FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"""
)
def within_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = tm.window_bounds(since="2024-01-10T06:00", duration="2d6h")
    # Plain bounds on the stored column, so the scan can skip row groups.
    events = table(spark, sf_dir, "events")
    inside = filters.within_window("ts", tm.ntz_literal(start), tm.ntz_literal(end))
    return events.filter(inside).select("event_id")


@query(
    """
    SELECT event_id FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-30 00:30:00' AND TIMESTAMP '2024-01-30 20:30:00'"""
)
def daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = tm.daily_window("08:30", "20h", now=LATEST, tz="Asia/Shanghai")
    events = table(spark, sf_dir, "events")
    inside = filters.within_window("ts", tm.ntz_literal(start), tm.ntz_literal(end))
    return events.filter(inside).select("event_id")


@query(
    "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'"
)
def date_range_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = tm.date_bounds(relative="last_7_days", reference=date(2024, 1, 30))
    events = table(spark, sf_dir, "events")
    return events.filter(filters.date_range("ts", start, end)).select("event_id")


@query(
    """
    SELECT doc_id, CASE WHEN trim(coalesce(i.text, '')) = '' THEN 'missing_title'
      WHEN lang = 'en' AND length(trim(d.text, ' ' || chr(10))) < 40
      THEN 'content_too_short' END AS reason FROM documents d LEFT JOIN benchmark i ON item_id = doc_id"""
)
def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; the title is that of the benchmark item with the same number, if there is one."""
    titles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("title"))
    return documents(spark, sf_dir).join(titles, "doc_id", "left").select(
        "doc_id", filters.validity("title", "text", strict=F.col("lang") == "en").alias("reason")
    )


STATUS = "CAST(200 + floor(value * 10) % 400 AS INTEGER)"


def fetch_status() -> Column:
    return (F.lit(200) + F.floor(F.col("value") * 10) % 400).cast("int")


@query(
    f"""
    SELECT {STATUS} AS status, count(*) AS n, bool_or({STATUS} >= 500 OR {STATUS} IN (401, 403, 429)) AS failed
    FROM events GROUP BY 1"""
)
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "events").select(fetch_status().alias("status"))
    return answers.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(filters.fetch_failed("status")).alias("failed")
    )


ATTEMPTS = f"""
    WITH a AS (SELECT user_id, event_id, {STATUS} AS status,
                 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events),
    t AS (SELECT *, NOT (status >= 500 OR status IN (401, 403, 429)) AS good FROM a WHERE attempt <= 3)
    SELECT user_id, coalesce(min(attempt) FILTER (good), max(attempt)) AS attempts,
           min(attempt) FILTER (good) IS NULL AS failed,
           min_by(event_id, attempt) FILTER (good) AS event_id, min_by(status, attempt) FILTER (good) AS status
    FROM t GROUP BY user_id"""


@query(ATTEMPTS)
def resolve_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", fetch_status().alias("status"))
    attempts = running.numbered(log, ["user_id"], "event_id", "attempt")
    return filters.resolve_attempts(attempts, retries=2, request="user_id")


@query(ATTEMPTS)
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in which attempts come in any order, over three runs and a late sign of life."""
    home = work_folder(spark, "attempts")
    log = event_times(spark, sf_dir).select("user_id", "event_id", fetch_status().alias("status"), "ts")
    attempts = running.numbered(log, ["user_id"], "event_id", "attempt")
    parts = [attempts.filter(F.col("event_id") * 7 % 3 == p) for p in range(3)]
    # Long after the last attempt; it is no attempt that counts, but moves the time on.
    end = F.timestamp_seconds(F.lit(1718409600))
    parts.append(attempts.limit(1).withColumns({"user_id": F.lit(-1).cast("bigint"), "attempt": F.lit(99).cast("bigint"), "ts": end}))
    for p, part in enumerate(parts):
        part.write.parquet(f"{home}/in/part-{p}")
        stream = ingest.page_stream(spark, f"{home}/in/*", ingest.schema_text(attempts))
        found = state.resolve_stream(stream, 2, "60 days", request="user_id")
        ingest.to_files(found, f"{home}/out", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/out")


# --- times and texts -------------------------------------------------------------


@query(
    """
    SELECT event_id, epoch_us(CASE event_type
      WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 8 HOUR
      WHEN 'view' THEN date_trunc('minute', ts) - INTERVAL 8 HOUR
      WHEN 'error' THEN ts
      WHEN 'purchase' THEN date_trunc('minute', ts) - INTERVAL 8 HOUR
      ELSE date_trunc('day', ts) - INTERVAL 8 HOUR END) AS at_time FROM events"""
)
def coerce_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    def written(pattern: str) -> Column:
        return F.date_format("ts", pattern)

    text = (
        F.when(F.col("event_type") == "click", written("yyyy/M/d H:m:s"))
        .when(F.col("event_type") == "view", written("M-d HH:mm"))
        .when(F.col("event_type") == "error", written("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(F.col("event_type") == "purchase", written("yyyy-MM-dd'T'HH:mm'+08:00'"))
        .otherwise(written("yyyyMMdd"))
    )
    events = table(spark, sf_dir, "events").select("event_id", text.alias("published_at"))
    at = tm.record_ts(events, tz="Asia/Shanghai", fallback_year=2024)
    return events.select("event_id", F.unix_micros(at).alias("at_time"))


@query(
    """
    SELECT event_id, epoch_us(ts) // 1000 * 1000 AS at_time,
           CASE WHEN user_id > 0 THEN CAST(user_id * 3600 + event_id % 60 * 60 AS BIGINT) ELSE 0 END AS seconds,
           epoch_us(ts) // 1000000 * 1000000 AS at_second FROM events"""
)
def epochs_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_times(spark, sf_dir)
    minutes = F.col("event_id") % 60
    spec = F.concat(
        F.col("user_id").cast("string"),
        F.when(minutes > 0, F.concat(F.lit("h"), minutes.cast("string"), F.lit("m"))).otherwise(F.lit("")),
    )
    return events.select(
        "event_id",
        F.unix_micros(tm.epoch_ts(F.unix_millis("ts"))).alias("at_time"),
        F.coalesce(tm.duration_spec(spec), F.lit(0).cast("long")).alias("seconds"),
        F.unix_micros(tm.epoch_ts(F.unix_seconds("ts"))).alias("at_second"),
    )


COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    f"""
    SELECT doc_id, CASE WHEN length({COLLAPSED}) <= 240 THEN {COLLAPSED}
      ELSE rtrim(regexp_extract({COLLAPSED}, '^(.{{0,239}}) ', 1)) || '…' END AS summary,
      source AS source_name, 'news' AS site_type, 1706659199000000 AS fetched_at
    FROM documents"""
)
def enrich_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = spread_documents(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("source_name"),
        F.lit("news").alias("site_type"),
        F.create_map(F.lit("title"), F.substring("text", 1, 60), F.lit("content"), F.col("text")).alias("fields"),
        F.lit("").alias("raw_html"),
    )
    full = records.enrich(plain, F.lit(LATEST))
    return full.select(
        "doc_id",
        F.col("fields")["summary"].alias("summary"),
        "source_name",
        "site_type",
        F.unix_micros("fetched_at").alias("fetched_at"),
    )


@query(
    """
    SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS title,
      regexp_replace(trim(text, ' ' || chr(10)), '[^0-9A-Za-z_-]+', '_', 'g') AS file_slug,
      trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '-', 'g'), '-') AS key_slug
    FROM documents"""
)
def titles_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id",
        tx.title_cut("text").alias("title"),
        tx.slug_file("text").alias("file_slug"),
        tx.slug_key("text").alias("key_slug"),
    )


# --- dedup and history -------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.content_hash("text").alias("content_hash"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of one batch; the store is their language."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("source_name"),
        F.col("lang").alias("store_key"),
        url.alias("url"),
        F.lit(0).alias("source_ord"),
        F.col("doc_id").alias("pos"),
        tx.content_hash(tx.hash_seed("text", F.lit(""))).alias("content_hash"),
    )


def stored_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History: the documents somebody labelled, stored on the first of January."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return (
        parsed(spark, sf_dir)
        .join(labels, "doc_id", "left_semi")
        .select(
            "store_key", "url", "content_hash",
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"), "source_name",
        )
    )


SEEN = f"(SELECT * FROM ({PARSED}) WHERE doc_id IN (SELECT doc_id FROM labels))"


@query(
    f"""
    SELECT min(doc_id) AS doc_id, store_key, content_hash FROM ({PARSED}) GROUP BY store_key, content_hash"""
)
def dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = parsed(spark, sf_dir)
    return dedup.dedup(batch, spark.createDataFrame([], HISTORY), unique_urls=True).select("doc_id", "store_key", "content_hash")


FRESH = f"""
    SELECT min(doc_id) AS doc_id, store_key, content_hash FROM ({PARSED}) p
    WHERE NOT EXISTS (SELECT 1 FROM {SEEN} h WHERE h.store_key = p.store_key AND h.url = p.url)
      AND NOT EXISTS (SELECT 1 FROM {SEEN} h WHERE h.store_key = p.store_key AND h.content_hash = p.content_hash)
    GROUP BY store_key, content_hash"""


@query(FRESH)
def dedup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(parsed(spark, sf_dir), stored_before(spark, sf_dir)).select(
        "doc_id", "store_key", "content_hash"
    )


@query(
    """
    SELECT doc_id, lang AS store_key FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
    WHERE n % 2 = 1"""
)
def dedup_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's documents as one chain of conflicts: each has its URL or its content from the one before."""
    rows = running.numbered_in_order(parsed(spark, sf_dir).select("doc_id", "store_key"), ["store_key"], ["doc_id"], "n")
    linked = rows.select(
        "doc_id", "store_key", F.expr("concat('u', n div 2)").alias("url"), F.expr("concat('h', (n + 1) div 2)").alias("content_hash"),
        F.lit(0).alias("source_ord"), F.col("n").alias("pos"),
    )
    return dedup.dedup(linked, spark.createDataFrame([], HISTORY)).select("doc_id", "store_key")


@query(FRESH)
def dedup_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against a stored history, whose bitmap settles what is certainly new."""
    home = work_folder(spark, "history")
    seen = materialize(stored_before(spark, sf_dir), "seen")
    early = F.unix_seconds("ts") % 3 == 0
    history.append_bits(seen.filter(early), home, "b1")
    history.append_history(seen.filter(early), home, "b1")
    history.append_history(seen.filter(~early), home, "b2")  # its bits are made up for
    bits = history.read_membership(spark, home)
    kept = dedup.dedup(parsed(spark, sf_dir), history.read_history(spark, home), bits=bits)
    return kept.select("doc_id", "store_key", "content_hash")


@query(
    f"""
    WITH p AS ({PARSED}), h AS (SELECT DISTINCT store_key, url, content_hash FROM {SEEN}),
    u AS (SELECT p.*, EXISTS (SELECT 1 FROM h WHERE h.store_key = p.store_key AND h.url = p.url) AS url_duplicate,
                 EXISTS (SELECT 1 FROM h WHERE h.store_key = p.store_key AND h.content_hash = p.content_hash) AS seen
          FROM p),
    f AS (SELECT store_key, content_hash, min(doc_id) AS first FROM u WHERE NOT url_duplicate AND NOT seen GROUP BY ALL)
    SELECT doc_id, url_duplicate, seen OR coalesce(doc_id > first, false) AS content_duplicate,
           url_duplicate OR seen OR coalesce(doc_id > first, false) AS is_duplicate
    FROM u LEFT JOIN f USING (store_key, content_hash)"""
)
def dedup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = dedup.duplicate_flags(parsed(spark, sf_dir), stored_before(spark, sf_dir), unique_urls=True)
    return flags.select(F.col("pos").alias("doc_id"), "url_duplicate", "content_duplicate", "is_duplicate")


@query(
    f"""
    SELECT p.doc_id, CASE WHEN lang <> 'de' AND EXISTS (
      SELECT 1 FROM {SEEN} h WHERE h.store_key = p.lang AND h.url = 'https://' || p.source || '/' || p.doc_id)
      THEN 'known' ELSE 'visit' END AS verdict
    FROM documents p"""
)
def prefilter_known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = parsed(spark, sf_dir).select(
        "*", F.lit(True).alias("by_url"), (F.col("store_key") != "de").alias("incremental")
    )
    history = stored_before(spark, sf_dir)
    known = dedup.known_urls(work, history).select("doc_id", F.lit("known").alias("verdict"))
    fresh = dedup.unknown_urls(work, history).select("doc_id", F.lit("visit").alias("verdict"))
    return known.unionByName(fresh)


@query(
    f"""
    WITH o AS (SELECT store_key, url, content_hash, 1704067200 + doc_id AS at_time FROM {SEEN}),
    n AS (SELECT store_key, url, sha256(url) AS content_hash, 1706659199 AS at_time FROM ({PARSED})
          WHERE source_name IN ('src1', 'src2'))
    SELECT store_key, url, max_by(content_hash, at_time) AS content_hash, max(at_time) AS at_time
    FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY store_key, url"""
)
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = (
        parsed(spark, sf_dir)
        .filter(F.col("source_name").isin("src1", "src2"))
        .withColumn("content_hash", tx.content_hash("url"))
    )
    new = dedup.history_rows(changed, F.lit(LATEST))
    merged = dedup.history_upsert(stored_before(spark, sf_dir), new)
    return merged.select("store_key", "url", "content_hash", F.unix_seconds("ts").alias("at_time"))


@query(f"SELECT store_key, count(*) AS n FROM {SEEN} WHERE store_key <> 'de' GROUP BY 1")
def history_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup.history_without(stored_before(spark, sf_dir), "de")
    return left.groupBy("store_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
    SELECT store_key, url, content_hash, 1704067200 + doc_id AS at_time, source_name FROM {SEEN}
    WHERE store_key <> 'de' OR doc_id % 2 = 1"""
)
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History written in two batches, one store deleted between them, the second batch written twice."""
    home = work_folder(spark, "history")
    rows = stored_before(spark, sf_dir)
    odd = F.unix_seconds("ts") % 2 == 1
    history.append_history(rows.filter(~odd), home, "b1")
    history.history_reset(spark, home, "de")
    for _ in range(2):
        history.append_history(rows.filter(odd), home, "b2")
    kept = history.read_history(spark, home)
    return kept.select("store_key", "url", "content_hash", F.unix_seconds("ts").alias("at_time"), "source_name")


@query(
    f"""
    SELECT store_key, url, CASE WHEN doc_id % 4 = 3 THEN sha256(url) ELSE content_hash END AS content_hash,
      1704067200 + doc_id + CASE WHEN doc_id % 4 = 3 THEN 86400 ELSE 0 END AS at_time
    FROM {SEEN} WHERE store_key <> 'de'"""
)
def history_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches and one that replaces rows, stores merged as they fill, then a lookup by key in most stores."""
    home = work_folder(spark, "history")
    rows = stored_before(spark, sf_dir)
    at = F.unix_seconds("ts") % 4
    for i in range(4):
        history.append_history(rows.filter(at == i), home, f"b{i}")
    again = rows.filter(at == 3).withColumns(
        {"content_hash": tx.content_hash("url"), "ts": F.col("ts") + F.expr("interval 1 day")}
    )
    history.append_history(again, home, "b4")
    history_merge.merge_batches(spark, home, most_batches=2)
    found = history_merge.latest_for(spark, home, rows.filter("store_key <> 'de'"))
    return found.select("store_key", "url", "content_hash", F.unix_seconds("ts").alias("at_time"))


@query(f"SELECT store_key, url FROM {SEEN} WHERE doc_id % 2 = 1")
def history_after_full_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stores deleted, then what came afterwards."""
    home = work_folder(spark, "history")
    rows = stored_before(spark, sf_dir)
    odd = F.unix_seconds("ts") % 2 == 1
    history.append_history(rows.filter(~odd), home, "b1")
    history.history_reset(spark, home)
    history.append_history(rows.filter(odd), home, "b2")
    return history.read_history(spark, home).select("store_key", "url")


@query(
    f"""
    SELECT * FROM (SELECT source_name, url, 1704067200 + doc_id AS at_time,
      CAST(row_number() OVER (PARTITION BY source_name ORDER BY doc_id DESC) AS INTEGER) AS rank FROM {SEEN})
    WHERE rank <= 5"""
)
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = dedup.recent_history_all(stored_before(spark, sf_dir), 5)
    return newest.select("source_name", "url", F.unix_seconds("ts").alias("at_time"), "rank")


# --- reports -----------------------------------------------------------------------


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged: too short fails, old is outside the window, copies are skipped."""
    batch = parsed(spark, sf_dir).join(
        documents(spark, sf_dir).select("doc_id", "n_chars"), "doc_id"
    )
    valid = batch.filter("n_chars >= 300 AND n_chars < 5000")
    stored = dedup.stored_rows(valid, spark.createDataFrame([], HISTORY), unique_urls=True)
    new = stored.select(F.col("pos").alias("doc_id"), F.lit(True).alias("_new"))
    reason = (
        F.when(F.col("n_chars") < 300, F.lit("content_too_short"))
        .when(F.col("n_chars") >= 5000, F.lit("window_filtered"))
        .when(F.col("_new").isNull(), F.lit("duplicate"))
    )
    status = (
        F.when(F.col("n_chars") < 300, F.lit("failed"))
        .when((F.col("n_chars") >= 5000) | F.col("_new").isNull(), F.lit("skipped"))
        .otherwise(F.lit("success"))
    )
    return batch.join(new, "doc_id", "left").select(
        "source_name", "url", status.alias("status"), reason.alias("reason")
    )


OUTCOMES = f"""
  SELECT p.source_name, CASE WHEN n_chars < 300 THEN 'failed'
      WHEN n_chars >= 5000 OR p.doc_id <> first THEN 'skipped' ELSE 'success' END AS status,
    n_chars >= 5000 AS late
  FROM ({PARSED}) p JOIN documents USING (doc_id) LEFT JOIN (
    SELECT store_key, content_hash, min(doc_id) AS first FROM ({PARSED}) JOIN documents USING (doc_id)
    WHERE n_chars >= 300 AND n_chars < 5000 GROUP BY ALL) f
  ON f.store_key = p.store_key AND f.content_hash = p.content_hash"""
SUMMARY = f"""
  SELECT source_name, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (late AND status = 'skipped') AS window_filtered
  FROM ({OUTCOMES}) GROUP BY source_name"""


@query(SUMMARY)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_summary(outcomes(spark, sf_dir))


@query(
    f"""
    WITH s AS (SELECT c.source_name, coalesce(success, 0) AS success, coalesce(failed, 0) AS failed,
        coalesce(skipped, 0) AS skipped, coalesce(window_filtered, 0) AS window_filtered, success IS NULL AS none
      FROM (SELECT DISTINCT source AS source_name FROM documents UNION ALL SELECT 'silent') c
      LEFT JOIN ({SUMMARY}) USING (source_name))
    SELECT source_name, CAST(sum(success) AS BIGINT) AS success, CAST(sum(failed) AS BIGINT) AS failed,
      CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(window_filtered) AS BIGINT) AS window_filtered,
      bool_or(failed > 0) AS any_failed, bool_or(none) AS no_result
    FROM s GROUP BY ROLLUP (source_name)"""
)
def run_summary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = documents(spark, sf_dir).select(F.col("source").alias("source_name")).distinct()
    sources = named.unionByName(spark.createDataFrame([("silent",)], "source_name string"))
    return report.run_summary_total(report.run_summary(outcomes(spark, sf_dir)), sources)


@query(
    f"""
    SELECT source_name, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (late AND status = 'skipped') AS window_filtered
    FROM (SELECT * FROM ({OUTCOMES}) UNION ALL SELECT p.source_name, 'skipped', false FROM ({PARSED}) p
      WHERE EXISTS (SELECT 1 FROM {SEEN} h WHERE h.url = p.url AND h.store_key = p.store_key)) GROUP BY 1"""
)
def prefilter_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = parsed(spark, sf_dir).select("*", F.lit(True).alias("by_url"), F.lit(True).alias("incremental"))
    known = dedup.known_urls(work, stored_before(spark, sf_dir))
    return report.run_summary(report.with_prefilter_skips(outcomes(spark, sf_dir), known))


@query(
    """
    SELECT epoch_us(date_trunc('hour', ts)) AS slot, count(*) AS urls, count(*) / 3600 AS per_second,
      format('{:.1f} url/s', count(*) / 3600) AS rate FROM events GROUP BY date_trunc('hour', ts)"""
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = report.throughput(event_times(spark, sf_dir), every="1 hour", seconds=3600)
    return rates.select(F.unix_micros("slot_start").alias("slot"), "urls", "per_second", "rate")


@query(
    "SELECT event_id, event_type, epoch_us(ts) AS at_time FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 100"
)
def recent_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    newest = recent_log(logs, "error", 100, ts="ts", source_col="event_type")
    return newest.select("event_id", "event_type", F.unix_micros(tm.ntz_instant("ts")).alias("at_time"))


@query(
    """
    SELECT CAST(event_id AS VARCHAR) AS event, event_type AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp
    FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 100"""
)
def recent_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest lines of daily log files, of which only the newest are read."""
    home = work_folder(spark, "logs")
    lines = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("info").alias("level"),
        F.col("event_id").cast("string").alias("event"), F.col("event_type").alias("source"), F.to_date("ts").alias("day"),
    )
    lines.write.partitionBy("day").json(home)
    # A file was last changed when its day ended.
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(home).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, _ in log_files(spark, f"{home}/day=*/*"):
        day = datetime.strptime(name.split("day=")[1][:10], "%Y-%m-%d").replace(tzinfo=timezone.utc)
        system.setTimes(place(name), int(day.timestamp() + 86400) * 1000, -1)
    return newest_lines(spark, f"{home}/day=*/*", 100, "error").select("event", "source", "timestamp")


# --- outputs -----------------------------------------------------------------------


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).drop("content_hash").join(
        documents(spark, sf_dir).select("doc_id", "text"), "doc_id"
    ).select(
        "url", "source_name", "pos",
        F.lit("news").alias("site_type"),
        F.lit("").alias("raw_html"),
        F.lit(LATEST).alias("fetched_at"),
        F.create_map(
            F.lit("title"), F.when(F.col("store_key") != "es", F.substring("text", 1, 60)),
            F.lit("content"), F.col("text"),
        ).alias("fields"),
    )


@query(
    """
    SELECT source AS source_name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_no,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) || '. '
        || CASE WHEN lang = 'es' THEN '(未提供标题)' ELSE left(text, 60) END || '｜' || source || chr(10)
        || '抓取时间：2024-01-30T23:59:59Z' || chr(10) || trim(text, ' ' || chr(10)) || chr(10)
        || '链接：https://' || source || '/' || doc_id || chr(10) || chr(10) AS block
    FROM documents"""
)
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.text_digest(exported(spark, sf_dir))


@query(
    """
    SELECT source AS source_name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id,
      CAST(json_object('url', 'https://' || source || '/' || doc_id, 'source_name', source, 'site_type', 'news',
        'raw_html', '', 'fetched_at', '2024-01-30T23:59:59Z',
        'title', CASE WHEN lang <> 'es' THEN left(text, 60) END, 'content', text) AS VARCHAR) AS payload
    FROM documents"""
)
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.payload_rows(exported(spark, sf_dir))


@query(
    """
    SELECT text AS content, '2024-01-30T23:59:59Z' AS fetched_at, '' AS raw_html, 'news' AS site_type,
      source AS source_name, CASE WHEN lang <> 'es' THEN left(text, 60) END AS title,
      'https://' || source || '/' || doc_id AS url FROM documents"""
)
def csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.flat_records(exported(spark, sf_dir), ["title", "content"])


@query(
    """
    SELECT source AS collection, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS content_chars
    FROM documents GROUP BY 1"""
)
def document_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.document_rows(exported(spark, sf_dir))
    content = F.from_json("document", "content STRING")["content"]
    return rows.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(content)).alias("content_chars")
    )


FORMAT_OF = "CASE lang WHEN 'de' THEN 'csv' WHEN 'es' THEN 'txt' WHEN 'fr' THEN 'sqlite' WHEN 'en' THEN 'json' ELSE 'mongodb' END"


@query(
    f"""
    SELECT {FORMAT_OF} AS format, source, '20240130-235959' AS run, 'https://' || source || '/' || doc_id AS url,
      CASE WHEN lang <> 'es' THEN left(text, 60) END AS title, CASE WHEN lang <> 'es' THEN text END AS content FROM documents"""
)
def sinks_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written in the format of their language and read again: whole rows, of digests the links."""
    home = work_folder(spark, "sinks")
    lang = parsed(spark, sf_dir).select("url", F.col("store_key").alias("lang"))
    rows = exported(spark, sf_dir).join(lang, "url").withColumn("output_format", F.expr(FORMAT_OF))
    files.write_records(rows, home, "20240130-235959", ["title", "content"])

    target = "source STRING, run STRING"
    digest = spark.read.schema(f"value STRING, {target}").text(f"{home}/txt")
    found = digest.filter(F.startswith("value", F.lit("链接：https://"))).select(
        F.lit("txt").alias("format"), "source", "run", F.substring("value", 4, 1000000).alias("url"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"),
    )
    own = "url STRING, title STRING, content STRING"
    names = [c.split()[0] for c in own.split(", ")]
    table_of = "content STRING, fetched_at STRING, raw_html STRING, site_type STRING, source_name STRING, title STRING, url STRING"
    csv = spark.read.schema(f"{table_of}, {target}").csv(f"{home}/csv", header=True, multiLine=True, quote='"', escape='"')
    parts = [csv.select(F.lit("csv").alias("format"), *files.TARGET, *names)]
    for fmt, kind, column, more in (
        ("json", "text", "value", ""), ("sqlite", "parquet", "payload", "id BIGINT, "), ("mongodb", "parquet", "document", "collection STRING, ")
    ):
        stored = spark.read.schema(f"{more}{column} STRING, {target}").format(kind).load(f"{home}/{fmt}")
        parsed_rows = stored.withColumn("r", F.from_json(column, own))
        parts.append(parsed_rows.select(F.lit(fmt).alias("format"), *files.TARGET, "r.*"))
    for part in parts:
        found = found.unionByName(part)
    return found


@query(
    """
    SELECT source AS source_name, 'https://' || source || '/' AS target_url, CASE WHEN n % 2 = 0 THEN 'csv' ELSE 'json' END AS output_format,
      n % 2 = 1 AS by_url, true AS incremental, field, field_pos, rank, selector
    FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1),
      (VALUES ('title', 0, 0, 'h1.headline'), ('title', 0, 1, 'h1'), ('content', 1, 0, 'article')) r(field, field_pos, rank, selector)"""
)
def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file per source, written and read: defaults filled in, fallbacks ranked."""
    home = work_folder(spark, "settings")
    counted = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    even = F.col("n") % 2 == 0
    pattern = F.struct(F.array(F.lit("h1.headline"), F.lit("h1")).alias("title"), F.lit("article").alias("content"))
    settings = counted.select(
        F.col("source").alias("file"), F.col("source").alias("source_name"),
        F.concat(F.lit("https://"), "source", F.lit("/")).alias("target_url"), pattern.alias("detail_pattern"),
        F.when(even, F.lit("csv")).alias("output_format"),
        F.when(even, F.struct(F.lit(False).alias("by_url"))).alias("deduplication"),
    )
    settings.repartition("file").write.partitionBy("file").json(home)
    sources, rules = read_rules(spark, home)
    return sources.select("source_name", "target_url", "output_format", "by_url", "incremental").join(rules, "source_name")
