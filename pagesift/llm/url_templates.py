"""URL filters: rules for hosts and paths, and a tree of path templates for the rest.

The urls that a rule fits are the labelled ones. For every host a tree of path
templates grows from the root, one segment a round. Under a node a segment that
few of its pages share is variable and becomes ``*``; the others are named, and
named ones that are statistically similar become one branch, such as
``(en|es)`` (a mark that a segment itself holds follows a backslash). A template's purity is the share of blocked pages among its
labelled ones, smoothed towards that of its parent; urls without a rule are
blocked where it reaches ``BLOCKED``.

Counts are pre-aggregated by (host, template, segment). Only nodes go to the
pages, and a node has at most ``1 / SHARE`` named children whatever its pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import materialize, pick
from pagesift.operators.skew import salted_left_join
from pagesift.session import is_small

# (verdict, host and path): a rule fits its host, all subdomains, and paths that start with its own.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# A segment is named if it has this share of its node's pages, and as many pages.
SHARE, FEWEST = 16, 4
# Deeper segments are taken together as one.
DEPTH = 8
# Weight of the parent's purity, in pages; the root's parent has an even one.
PRIOR, EVEN = 4.0, 0.5
BLOCKED = 0.8
SHAPES = ("end", "digits", "letters", "file", "other")
NODE = "host string, template string, purity double, star string, star_purity double, named map<string,struct<template:string,purity:double>>"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones that of the longer host, then block."""
    def order(rule: tuple[str, str]) -> tuple:
        return len(rule[1]), len(rule[1].partition("/")[0]), rule[0] == "block"

    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=order):
        own, slash, rest = rule.partition("/")
        own = own.lower()
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    tail = F.array_join(F.slice(parts, depth, 1 << 30), "/")
    return F.when(F.size(parts) <= depth, parts).otherwise(F.concat(F.slice(parts, 1, depth - 1), F.array(tail)))


def shape(segment: Column) -> Column:
    """Kind of the segment that follows a branch."""
    return (
        F.when(segment.isNull(), "end")
        .when(segment.rlike("^[0-9]+\\z"), "digits")
        .when(segment.rlike("^[A-Za-z]+\\z"), "letters")
        .when(segment.rlike("\\.[A-Za-z]{2,5}\\z"), "file")
        .otherwise("other")
    )


def similar(a: dict, b: dict) -> bool:
    """Whether two branches may be one: what follows them, and how they are labelled.

    Total variation of the next segments' kinds up to a quarter; shares of
    blocked pages within two standard errors. A labelled branch is never like
    an unlabelled one. All in integers.
    """
    apart = sum(abs(a[s] * b["n"] - b[s] * a["n"]) for s in SHAPES)
    if 2 * apart > a["n"] * b["n"]:
        return False
    la, lb = a["labelled"], b["labelled"]
    if not la or not lb:
        return la == lb
    labelled, blocked = la + lb, a["blocked"] + b["blocked"]
    return (a["blocked"] * lb - b["blocked"] * la) ** 2 * labelled <= 4 * blocked * (labelled - blocked) * la * lb


def merged(children: Iterable[dict]) -> list[list[dict]]:
    """Children in groups of which each is connected by similar pairs; at most ``SHARE`` children."""
    groups: list[list[dict]] = []
    for child in children:
        near = [g for g in groups if any(similar(child, other) for other in g)]
        groups = [g for g in groups if not any(g is other for other in near)]
        groups.append(sum(near, []) + [child])
    return groups


def smoothed(blocked: int, labelled: int, parent: float) -> float:
    return (blocked + PRIOR * parent) / (labelled + PRIOR)


def grown(row: dict) -> tuple:
    """A node with its named children, from its counts."""
    named, rest = {}, {"blocked": row["blocked"], "labelled": row["labelled"]}
    for group in merged(c.asDict() if hasattr(c, "asDict") else c for c in row["children"]):
        names = sorted(c["segment"] for c in group)
        marked = [re.sub(r"([\\*()|])", r"\\\1", name) for name in names]
        label = marked[0] if len(marked) == 1 else f"({'|'.join(marked)})"
        blocked, labelled = sum(c["blocked"] for c in group), sum(c["labelled"] for c in group)
        rest["blocked"] -= blocked
        rest["labelled"] -= labelled
        child = {"template": f"{row['template']}/{label}", "purity": smoothed(blocked, labelled, row["purity"])}
        named.update({name: child for name in names})
    star = smoothed(rest["blocked"], rest["labelled"], row["purity"])
    return row["host"], row["template"], row["purity"], f"{row['template']}/*", star, named


def nodes(pages: DataFrame, level: int) -> DataFrame:
    """The nodes of a level with children: a row for each host and template."""
    there = pages.filter(F.size("segments") > level).withColumns(
        {"segment": F.col("segments")[level], "next": shape(F.get("segments", F.lit(level + 1)))}
    )
    counts = [
        F.count(F.lit(1)).alias("n"),
        F.sum("labelled").alias("labelled"),
        F.sum("blocked").alias("blocked"),
        *[F.count_if(F.col("next") == s).alias(s) for s in SHAPES],
    ]
    children = there.groupBy("host", "template", "segment").agg(F.max("purity").alias("purity"), *counts)
    children = materialize(children, "children")
    node = children.groupBy("host", "template").agg(
        F.max("purity").alias("purity"), *[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    )
    # Only segments with enough pages meet their node, at most SHARE for each of them.
    some = children.filter(F.col("n") >= FEWEST).select(
        "host", "template", F.struct("segment", "n", "labelled", "blocked", *SHAPES).alias("child")
    )
    named = some.join(node.select("host", "template", F.col("n").alias("all")), ["host", "template"])
    named = named.filter(F.col("child.n") * SHARE >= F.col("all")).groupBy("host", "template")
    named = named.agg(F.array_sort(F.collect_list("child")).alias("children"))
    rows = node.join(named, ["host", "template"], "left").withColumn("children", F.coalesce("children", F.array()))

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        names = [c.split()[0] for c in NODE.split(", ")]
        for batch in batches:
            yield pd.DataFrame([grown(row) for row in batch.to_dict("records")], columns=names)

    return materialize(rows.mapInPandas(run, NODE), "nodes")


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of each row.

    The longest fitting rule decides; its text is in ``rule``. Elsewhere ``rule``
    is null and the template's smoothed share of blocked pages decides. A null
    url, or one without ``://``, has an empty host and path; such rows make up a
    host of their own. Nothing labelled means nothing blocked. Repeated rows
    count and are returned each time; ids may be null. An empty table gives no
    rows; other columns may have any name.
    """
    rows = pick(pages, id_col, url_col).toDF("page_id", "url")
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    rows = materialize(
        rows.withColumns(
            {
                "segments": segments(F.col("path")),
                "labelled": F.col("ruled").isNotNull().cast("int"),
                "blocked": F.coalesce(F.col("ruled") == "block", F.lit(False)).cast("int"),
                "template": F.lit(""),
            }
        ),
        "urls",
    )
    roots = rows.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    root = (F.col("b") + F.lit(PRIOR * EVEN)) / (F.col("l") + F.lit(PRIOR))
    rows = joined(rows, materialize(roots.select("host", root.alias("purity")), "roots"), ["host"])
    for level in range(rows.agg(F.max(F.size("segments"))).first()[0] or 0):
        found = nodes(rows, level).drop("purity")
        child = F.element_at("named", F.get("segments", F.lit(level)))
        deeper = F.size("segments") > level
        rows = materialize(
            joined(rows, found, ["host", "template"]).withColumns(
                {
                    "template": F.when(deeper, F.coalesce(child["template"], "star")).otherwise(F.col("template")),
                    "purity": F.when(deeper, F.coalesce(child["purity"], "star_purity")).otherwise(F.col("purity")),
                }
            ).drop("star", "star_purity", "named"),
            "level",
        )
    method = F.when(F.col("purity") >= BLOCKED, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )


def joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts to rows by key: sent out if measured small, else by a shuffle with hot keys salted."""
    if is_small(facts):
        return rows.join(F.broadcast(facts), keys, "left")
    return salted_left_join(rows, facts, keys, ["page_id", "path"])
