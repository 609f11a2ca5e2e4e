"""Trees, selectors and records on small pages with known results."""

import html as html_lib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagesift.operators import extract
from pagesift.operators import nodes as tree_ops
from pagesift.operators import selectors as sel
from pagesift.operators.filters import haystack, keyword_match
from pagesift.sources.rules import rules_table

MESSY = (
    '<h1>Title</h1><!-- <p>no</p> --><div class="a b" id=x>Body <p>one<p>two <a href="/q?a&amp;b" data-x>link</a></div>'
    '<ul class="items all"><li>1<li>2 <b>bold</ul><script>var t="</p>";</script>'
    "<p title=it's>z &amp; y<i>é漢</i><table><tr><td>c1<td>c2<tr><td>c3</table><textarea><b>raw</b></textarea>"
)


def tree_of(spark, html):
    pages = spark.createDataFrame([(1, "https://example.com/x/", html, "s")], "page_id long, url string, html string, source_name string")
    return tree_ops.page_nodes(pages)


@pytest.mark.parametrize(
    "selector, texts",
    [
        ("h1", ["Title"]),
        ("div.a.b > p a[href]", ["link"]),
        ("#x p", ["one", "two link"]),
        ("ul.items.all li", ["1", "2 bold"]),
        ("ul > li b", ["bold"]),
        ('a[href^="/q"]', ["link"]),
        ("a[href$='b']", ["link"]),
        ("[data-x]", ["link"]),
        ("p[title=\"it's\"]", ["z & y é漢"]),
        ("div > b", []),
        ("tr td", ["c1", "c2", "c3"]),
        ("textarea", ["<b>raw</b>"]),
        ("* > a", ["link"]),
        ("script", ['var t="</p>";']),
    ],
)
def test_selectors(spark, selector, texts):
    rows = sel.selected_rows(tree_of(spark, MESSY), selector, "tree")
    assert [r[0] for r in rows.select(sel.node_text("tree.texts", "node")).collect()] == texts


def test_unknown_selector_forms_are_refused():
    for css in ("a, b", "a:hover", "p + a", "a[b"):
        assert sel.parse_selector(css) is None
        with pytest.raises(ValueError):
            sel.steps_sql(css)


def test_tree_is_consistent(spark):
    """Ranges nest, and source offsets hold the element's own markup."""
    rows = tree_ops.node_rows(tree_of(spark, MESSY), "html").collect()
    by_id = {r.node_id: r for r in rows}
    for r in rows:
        assert r.html.encode()[r.html_from : r.html_to].decode().lower().startswith(f"<{r.tag}")
        assert r.node_id <= r.end_id
        if r.parent_id >= 0:
            parent = by_id[r.parent_id]
            assert parent.node_id < r.node_id and r.end_id <= parent.end_id
            assert parent.html_from <= r.html_from and r.html_to <= parent.html_to
            assert parent.depth == r.depth - 1


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "just text"), (4, "<p"), (5, '<a href="x>y'), (6, "<DIV CLASS=X>ü</DIV>")], "id int, html string")
    got = tree_ops.page_nodes(pages).select("id", F.size("tree.nodes").alias("n"), tree_ops.all_text(F.col("tree")).alias("t")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0, ""), (2, 0, ""), (3, 0, "just text"), (4, 0, "<p"), (5, 1, "y"), (6, 1, "ü")]


def test_entry_links_first_wins(spark):
    html = (
        '<ol class="toc"><li><a href="#top">up</a></li><li><a href="/harbour?p=2">Harbour</a></li><li><a>no target</a></li>'
        '<li><a href="//tide.example/low">Tide</a></li><li><a href="javascript:open()">Open</a></li>'
        '<li><a href="/harbour?p=2">Harbour, once more</a></li></ol>'
    )
    links = extract.entry_links(tree_of(spark, html), sel.steps_sql("ol.toc li a"))
    assert [tuple(r) for r in links.orderBy("pos").collect()] == [(0, "https://example.com/harbour?p=2"), (1, "https://tide.example/low")]


def fields_of(spark, html, patterns):
    filled = extract.detail_fields(tree_of(spark, html), rules_table(spark, {"s": patterns}))
    return filled.first().fields


def test_detail_fields(spark):
    got = fields_of(
        spark,
        "<h3>Harbour reopens</h3><section id=s1 class='story wide'>Ships <b>sail</b> again.</section>",
        {"title": "h3", "content": "section.story", "content_html": "section.story::html", "c": "section::ATTR:id", "odd": "h3::attr(href)", "none": "", "gone": "h6"},
    )
    assert got == {
        "title": "Harbour reopens", "content": "Ships sail again.", "c": "s1", "odd": "Harbour reopens", "none": None, "gone": None,
        "content_html": "<section id=s1 class='story wide'>Ships <b>sail</b> again.</section>",
    }


def test_fields_keep_the_order_of_the_rules(spark):
    rules = rules_table(spark, {"s": {"z": "h1", "a": "p", "title": "b"}})
    filled = extract.detail_fields(tree_of(spark, MESSY), rules)
    assert filled.select(F.map_keys("fields")).first()[0] == ["z", "a", "title"]


def test_meta_fallbacks(spark):
    html = (
        '<meta property="og:description" content="Rain all week"><meta name="title" content="Weather at the pier">'
        '<p>No heading here.</p><section class="report"> </section>'
    )
    got = fields_of(spark, html, {"content": ["section.report::text"], "title": ["h2::text", 'meta[name="title"]::attr:content']})
    assert got == {"title": "Weather at the pier", "content": "Rain all week"}
    # Only the first node of a selector counts, blank or not.
    got = fields_of(spark, "<title>T</title><h1> </h1><h1>second</h1>", {"title": ["h1"]})
    assert got == {"title": "T"}


def test_list_records(spark):
    html = (
        '<div class="w"><h2>One</h2><a href="n1">x</a></div>'
        '<div class="w" data-id="7"><h2>Two</h2><a href="#">x</a></div>'
        '<div class="w" data-time="09:00"><h2>Three</h2></div>'
        '<div class="w"><h2>dropped</h2></div>'
        '<div class="w"><h2>One again</h2><a href="n1">x</a></div>'
        '<a class="w" href="/self"><h2>Self</h2></a>'
    )
    pages = extract.attach_rules(tree_of(spark, html), rules_table(spark, {"s": {"title": ".w h2", "content": "h6"}}), fallbacks=False)
    rows = extract.list_records(pages, sel.steps_sql(".w")).orderBy("pos").collect()
    assert [(r.pos, r.url, r.fields["title"]) for r in rows] == [
        (0, "https://example.com/x/n1", "One again"),
        (1, "https://example.com/x/#id-7", "Two"),
        (2, "https://example.com/x/#time-09:00", "Three"),
        (5, "https://example.com/self", "Self"),
    ]
    assert rows[0].raw_html == '<div class="w"><h2>One again</h2><a href="n1">x</a></div>'
    assert rows[0].fields["content"] is None


CARDS = """
<div class="list_body"><div class="topic">Ferry resumes</div><a class="news_body_title" href="/n/ferry"></a>
<div class="detail-body">Boats cross again after the storm.</div><span class="topic-time">2023-11-02 18:45</span></div>
<div class="list_body"><div class="topic">Lighthouse repainted</div><a class="news_body_title" href="/n/light"></a>
<div class="detail-body">White and red, as before.</div></div>
<div class="list_body"><a class="news_body_title" href="/n/empty">no content</a></div>
"""


def test_timeline_cards(spark):
    rows = extract.timeline_cards(tree_of(spark, CARDS)).orderBy("pos").collect()
    assert [(r.url, r.fields) for r in rows] == [
        ("https://example.com/n/ferry", {"title": "Ferry resumes", "content": "Boats cross again after the storm.", "published_at": "2023-11-02 18:45"}),
        ("https://example.com/n/light", {"title": "Lighthouse repainted", "content": "White and red, as before."}),
    ]
    wide = '<div class="el-timeline-item__wrapper"><a class="news_body_title" href="/w">W</a><div class="news_body_content"><span>in</span></div></div>'
    rows = extract.timeline_cards(tree_of(spark, CARDS + wide)).collect()
    assert [(r.url, r.fields["title"], r.fields["content"]) for r in rows] == [("https://example.com/w", "W", "in")]


def test_json_list_records(spark):
    items = [
        {"id": 5, "title": "A", "description": html_lib.escape("<p>x <b>y</b> &amp; z</p>"), "publishTimestamp": 1716206400000},
        {"id": "s6", "description": None, "publishTimestamp": "soon"},
        None,
    ]
    page = f'<script>self.x={{"initData":{json.dumps({"pageResult": {"list": items}})}}}</script>'
    df = spark.createDataFrame([("https://example.com/n", page), ("https://example.com/n", '{"initData":{oops')], "url string, html string")
    rows = extract.json_list_records(df).orderBy("pos").collect()
    assert [(r.url, r.fields["title"], r.fields["content"], r.fields["published_at"]) for r in rows] == [
        ("https://example.com/zh-CN/newsflash/5", "A", "x y & z", "2024-05-20T12:00:00+00:00"),
        ("https://example.com/zh-CN/newsflash/s6", "", "", None),
    ]
    assert rows[0].raw_html == "<p>x <b>y</b> &amp; z</p>"


def test_json_detail(spark):
    detail = {"initData": {"detail": {"title": "Bridge closed", "description": "Repairs until spring", "newsUrl": "https://paper.example/bridge", "publishTimestamp": 1700000000000}}}
    df = spark.createDataFrame([(f"<html><body>{json.dumps(detail)}</body></html>",), ("nothing",)], "h string")
    got = [r[0] for r in df.select(extract.json_detail("h")).collect()]
    assert got == [
        {"title": "Bridge closed", "content": "Repairs until spring", "original_url": "https://paper.example/bridge", "published_at": "2023-11-14T22:13:20+00:00"},
        None,
    ]


def test_timeline_text(spark):
    lines = ["before", "热门", "17十月", "09:30", "first item text", "09:31", "x", "09:32", " second item ", "", "more"]
    df = spark.createDataFrame([("https://u", "\n".join(lines))], "url string, t string")
    rows = extract.timeline_text_records(df, "t").collect()
    assert [(r.url, r.fields["content"], r.fields["published_at"], r.raw_html) for r in rows] == [
        ("https://u#item_0", "first item text", "09:30", "09:30 first item text"),
        ("https://u#item_1", "second item more", "09:32", "09:32 second item more"),
    ]
    page = tree_of(spark, '<div class="style_home__timeline_1Tz"><p>09:30<p>some item text<p>more</div>')
    rows = extract.timeline_text_records(page.withColumn("t", extract.timeline_text()), "t").collect()
    assert [r.fields["content"] for r in rows] == ["some item text more"]


def test_host_family_and_own_extractor(spark):
    df = spark.createDataFrame([("https://WWW.odaily.news/x",), ("https://xueqiu.com",), ("https://foresightnews.pro/",), ("https://other.org",)], "url string")
    assert [r[0] for r in df.select(extract.host_family("url")).collect()] == ["json_list", "timeline_text", "cards", "generic"]
    pages = extract.attach_rules(tree_of(spark, CARDS), rules_table(spark, {"s": {"title": "a"}}), fallbacks=False)
    pages = pages.withColumn("family", F.lit("mine")).withColumn("entry_steps", F.expr(sel.steps_sql("div")))
    mine = extract.family_records(
        pages, "page_id",
        extra={"mine": lambda df, *k: df.select(*k, F.lit(0).alias("pos"), "url", F.create_map(F.lit("title"), F.lit("own")).alias("fields"), F.lit("").alias("raw_html"))},
    )
    assert [(r.url, r.fields["title"]) for r in mine.collect()] == [("https://example.com/x/", "own")]


def test_keywords(spark):
    df = spark.createDataFrame([("<h1>Otters return</h1>", None), ("İx", "b")], "a string, b string")
    h = haystack("a", "b")
    assert [r[0] for r in df.select(keyword_match(h, ["OTTER"])).collect()] == [True, False]
    assert [r[0] for r in df.select(keyword_match(h, ["heron"])).collect()] == [False, False]
    assert [r[0] for r in df.select(keyword_match(h, [])).collect()] == [True, True]
    assert [r[0] for r in df.select(keyword_match(h, F.array("b"))).collect()][1] is True


def test_one_python_stage_and_no_shuffle(spark):
    """Selection and fields are projections over one tree per page."""
    filled = extract.detail_fields(tree_of(spark, MESSY), rules_table(spark, {"s": {"title": "h1", "content": "p"}}))
    links = extract.entry_links(tree_of(spark, MESSY), sel.steps_sql("a"), "page_id")
    rows = tree_ops.node_rows(tree_of(spark, MESSY), "page_id").select("tag")
    for df in (filled.filter(F.col("fields")["title"].isNotNull()), links, rows):
        plan = df._jdf.queryExecution().executedPlan().toString()
        main = plan.split("BroadcastExchange")[0]
        assert main.count("html_tree") <= 2 and main.count("ArrowEvalPython [html_tree") == 1
        assert "Exchange hashpartitioning" not in main




def naive_select(elements, css):
    """Right to left, one element at a time."""
    steps = sel.parse_selector(css)
    by_id = {e[0]: e for e in elements}

    def fits(e, step):
        _, tag, id_, classes, attrs = step
        have = dict(e[6])
        return (
            tag in ("", e[4]) and id_ in ("", have.get("id")) and all(c in e[5] for c in classes)
            and all(n in have and (op == "" or have[n] == v) for n, op, v in attrs)
        )

    def holds(e, at):
        if not fits(e, steps[at]):
            return False
        if at == 0:
            return True
        up = by_id.get(e[2])
        while up is not None:
            if holds(up, at - 1):
                return True
            if steps[at][0]:
                return False
            up = by_id.get(up[2])
        return False

    return [e[0] for e in elements if holds(e, len(steps) - 1)]


def test_selectors_equal_naive_matching_on_random_trees(spark):
    rng = random.Random(7)

    def grow(depth):
        tag = rng.choice(["div", "section", "b"])
        marks = rng.choice(["", ' class="x"', ' class="x y"', ' id="i"', ' k="é"'])
        inner = "".join(grow(depth + 1) for _ in range(rng.choice([0, 1, 2, 3]) if depth < 6 else 0))
        return f"<{tag}{marks}>é{inner}</{tag}>"

    pages = [(i, "".join(grow(0) for _ in range(4))) for i in range(12)]
    df = tree_ops.page_nodes(spark.createDataFrame(pages, "i int, html string")).cache()
    for css in ("div", "div div", "div > div", "div div > b", "div > div b", ".x .y > *", "section [k=é] b", "#i div.x", "* > * > *"):
        got = df.select("i", F.transform(sel.select_nodes("tree.nodes", css), lambda n: n["node_id"])).collect()
        for i, ids in got:
            elements = []
            tree_ops.page_elements(dict(pages)[i], elements, [])
            assert ids == naive_select(elements, css), css
    df.unpersist()


def test_json_list_last_item_of_an_id_wins(spark):
    import json

    from pagesift.operators import extract

    items = [{"id": "7", "title": "old"}, None, {"id": "8", "title": "eight"}, {"id": "7", "title": "new"}]
    items = [x and {**x, "description": f"<p>{x['title']}</p>", "publishTimestamp": 0} for x in items]
    source = '<script>window.x = {"initData":' + json.dumps({"pageResult": {"list": items}}) + "}</script>"
    df = spark.createDataFrame([("https://o.example/n", source)], "url string, html string")
    rows = extract.json_list_records(df).orderBy("pos").collect()
    assert [(r.pos, r.fields["title"]) for r in rows] == [(0, "new"), (2, "eight")]


def test_cut_off_markup_is_read_once():
    import time

    for piece in ("<a ", "<!x ", '<a h="', "</b ", "<!-- "):
        for head in ("", "<p>start</p> 1 > 0 "):
            nodes, texts = [], []
            begin = time.perf_counter()
            tree_ops.page_elements(head + piece * (1_000_000 // len(piece)), nodes, texts)
            assert time.perf_counter() - begin < 1
            assert len(nodes) == (1 if head else 0)
    nodes, texts = [], []
    tree_ops.page_elements("a<!-- b > c", nodes, texts)
    assert texts == ["a"]


def test_postings_give_what_a_full_search_gives(spark):
    """Random nested pages: every selector with and without postings, whole and first."""
    rng = random.Random(11)

    def page(depth: int) -> str:
        if depth == 0 or rng.random() < 0.1:
            return rng.choice(["x", "<br>", '<img id="i">'])
        tag, name = rng.choice(["div", "p", "span", "li"]), rng.choice(["", ' class="a"', ' class="b a a"', ' id="t"', ' id=""'])
        return f"<{tag}{name}>" + "".join(page(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    pages = [page(5) for _ in range(30)] + ["", None, "<div>" * 300, "<p>" * 50]
    df = tree_ops.page_nodes(spark.createDataFrame(list(enumerate(pages)), "i int, html string"))
    selectors = [
        "div", ".a", "#t", "*", ".a.b", "div.b", "[id]", "div .a", "div > .a", "* > span", ".a div .b", "div div > div",
        "div * span", ".missing", ".missing p", "#t [class]", "div > * > p#t", '[class="a"] li', "#i", "p img",
    ]
    node_id = lambda nodes: F.transform(nodes, lambda n: n["node_id"])
    for css in selectors:
        both = df.select(
            node_id(sel.select_nodes("tree.nodes", css)).alias("plain"),
            node_id(sel.select_nodes("tree.nodes", css, "tree.postings")).alias("posted"),
            sel.first_match("tree.nodes", css, "tree.postings")["node_id"].alias("first"),
        ).collect()
        for row in both:
            assert row.posted == row.plain, css
            assert row.first == (row.plain[0] if row.plain else None), css
    assert len(both) == len(pages)


def test_trees_leave_python_in_slices(spark):
    """A batch of many pages is not held as elements all at once; rows keep their order."""
    pages = [None if i % 50 == 7 else f"<p id=n{i}>{i}</p>" + "<b>x</b>" * (i % 400) for i in range(1500)]
    pages[700] = "<p id=n700>700</p>" + "<i>long</i>" * 200_000
    parts = list(tree_ops.html_tree.func(iter([pa.array(pages), pa.array([], pa.string())])))
    assert len(parts) > 3 and sum(map(len, parts)) == len(pages)
    whole = [tree["texts"][0] if tree["texts"] else None for part in parts for tree in part.to_pylist()]
    assert whole == [None if page is None else str(i) for i, page in enumerate(pages)]
    for part in parts:
        assert len(part) == 1 or sum(len(t["nodes"]) for t in part.to_pylist()) < 150_000
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").coalesce(1)
    for make in (tree_ops.html_tree, tree_ops.escaped_html_tree):
        got = rows.select("i", make("html").alias("tree")).selectExpr("i", "get(tree.texts, 0) AS t", "size(tree.nodes) AS n")
        want = {i: (None, 0) if p is None else (str(i), p.count("<p") + p.count("<b>") + p.count("<i>")) for i, p in enumerate(pages)}
        assert {r.i: (r.t, r.n) for r in got.collect()} == want
