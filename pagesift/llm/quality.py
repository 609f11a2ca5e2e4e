"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histograms of character classes and of common words are compared
with those of its language by the Jensen-Shannon distance. The references are
the sums over all documents of a language that pass the base rules. Short
documents are not judged by the distances.

Everything of one text is computed in its own row; the references are a
pre-aggregated sum per language of the word lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import bind, materialize, pick

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "mark", "symbol", "other")
MIN_WORDS, REPEAT_PERCENT, SPAN = 10, 20, 5
# Guard: with fewer words the histograms are too small to judge.
JUDGED_WORDS = 50
# On a scale from 0 to 1: characters alone reject beyond the first limit; beyond
# the second one only if the common words are far off too.
CLASS_DISTANCE, BOTH_CLASS, BOTH_COMMON = 0.3, 0.15, 0.27

# Frequent function words of each language.
COMMON = {
    "de": "der die und das in den von zu mit sich auf für ist im dem nicht ein eine als auch".split(),
    "en": "the of and to in a is that for it as was with be by on are this from at".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}


def length_without(text: Column, pattern: str) -> tuple[Column, Column]:
    return text, F.regexp_replace(text, pattern, "")


def class_counts(text: Column) -> Column:
    """Characters of each class; every step looks only at what the last one left."""
    patterns = [f"[{SPACE}]+", "[a-z]+", "[A-Z]+", "[0-9]+", "[.,;:?'\"()-]+", "[!-/:-@\\[-`{-~]+"]

    def step(rest: Column, found: list[Column], left: list[str]) -> Column:
        if not left:
            return F.array(*found[1:], F.length(rest).cast("long"))
        cut = F.regexp_replace(rest, left[0], "")
        return bind(cut, lambda less: step(less, [*found, (F.length(rest) - F.length(less)).cast("long")], left[1:]))

    return step(text, [], patterns)


def common_counts(words: Column, common: list[str]) -> Column:
    """How often each common word occurs, and all other words together."""
    listed = F.array(*[F.lit(w) for w in common])
    hits = F.filter(words, lambda w: F.array_contains(listed, F.lower(w)))

    def counted(found: Column) -> Column:
        each = F.transform(listed, lambda c: F.size(F.filter(found, lambda w: F.lower(w) == c)).cast("long"))
        return F.concat(each, F.array((F.size(words) - F.size(found)).cast("long")))

    return bind(hits, counted)


def repeat_words(words: Column) -> Column:
    """Words in windows of ``SPAN`` words that occur twice or more in the text.

    Windows are told apart by a 64-bit hash. Only texts with a repeat go on to
    sort the windows and to add up the stretches they cover.
    """
    spans = F.size(words) - (SPAN - 1)

    def hashes(keys: Column) -> Column:
        window = F.sequence(F.lit(0), spans - 1)
        return F.transform(window, lambda i: F.xxhash64(*[F.get(keys, i + F.lit(k)) for k in range(SPAN)]))

    def covered(places: Column) -> Column:
        reach = F.zip_with(
            places, F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(2147483647))),
            lambda here, after: F.least(after - here, F.lit(SPAN)),
        )
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, n: total + n)

    def repeated(found: Column) -> Column:
        numbered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(order: Column) -> Column:
            same = lambda i, j: F.get(order, i).getField("h") == F.get(order, j).getField("h")
            twice = F.filter(order, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x.getField("i")))

        return bind(bind(numbered, places), covered)

    def judged(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) < F.size(found), repeated(found)).otherwise(F.lit(0).cast("long"))

    keys = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(spans > 1, bind(bind(keys, hashes), judged)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, lang: Column) -> Column:
    """A struct of all counts of one text."""
    none = F.array().cast("array<string>")

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
        common = F.lit(None).cast("array<long>")
        for name, listed in COMMON.items():
            common = F.when(lang == name, common_counts(words, listed)).otherwise(common)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            class_counts(text).alias("classes"),
            common.alias("common"),
        )

    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    return bind(F.coalesce(found, none), of)


def measured(docs: DataFrame, *keep: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The columns ``keep``, the language and the counts of each text; no shuffle."""
    rows = pick(docs, *keep, lang_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.select(*keep, F.col(lang_col).alias("_lang"), measures(text, F.col(lang_col)).alias("_m"))
    m = F.col("_m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    return rows.withColumn("_failed", failed)


def references(rows: DataFrame) -> DataFrame:
    """One row per language of the word lists: summed histograms of sound documents.

    Summed twice: junk is part of the first sums, and what lies far from these
    is left out of the second ones. ``rows`` are the written counts, not texts.
    """
    first = materialize(summed(rows), "references")
    return materialize(summed(judged(rows, first).filter("kept").select(*rows.columns)), "references")


def summed(rows: DataFrame) -> DataFrame:
    sums = [F.sum(F.col("_m.classes")[i]).alias(f"a{i}") for i in range(len(CLASSES))]
    width = max(map(len, COMMON.values())) + 1
    sums += [F.sum(F.get(F.col("_m.common"), F.lit(i))).alias(f"b{i}") for i in range(width)]
    sound = rows.filter(~F.col("_failed") & F.col("_lang").isin(*COMMON))
    total = sound.groupBy("_lang").agg(*sums)
    classes = F.array(*[F.col(f"a{i}") for i in range(len(CLASSES))])
    common = F.filter(F.array(*[F.col(f"b{i}") for i in range(width)]), lambda x: x.isNotNull())
    return total.select(F.col("_lang").alias("_of"), classes.alias("ref_classes"), common.alias("ref_common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence to base 2) of two count arrays."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, n: a + n)

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return (half(a, m) + half(b, m)) / 2

    def of(sums: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: term(x / sums[0], y / sums[1]))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))

    return bind(F.array(total(p), total(q)), of)


def judged(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``class_distance``, ``common_distance`` and ``kept``.

    The references are sent to all tasks: a row for each language of ``COMMON``
    at most.
    """
    m = F.col("_m")
    joined = rows.join(F.broadcast(refs), F.col("_lang") == F.col("_of"), "left")
    long_enough = m["n_words"] >= JUDGED_WORDS
    classes = F.when(long_enough, distance(m["classes"], F.col("ref_classes")))
    common = F.when(long_enough, distance(m["common"], F.col("ref_common")))
    joined = joined.withColumns({"class_distance": classes, "common_distance": common})
    both = (F.col("class_distance") > BOTH_CLASS) & (F.col("common_distance") > BOTH_COMMON)
    far = (F.col("class_distance") > CLASS_DISTANCE) | both
    # A sum, so that a filter on it stays whole: half of it moved below the join
    # would measure each text once more.
    against = F.when(F.col("_failed"), F.lit(1)).otherwise(F.lit(0)) + F.when(far, F.lit(1)).otherwise(F.lit(0))
    return joined.withColumn("kept", against == 0)


def quality(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and verdict of each row, in one pass over the texts.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, common_distance``, a row
    for each row. A null text has no words and fails the base rules. A null or
    unlisted language, a language none of whose documents passes the base rules,
    and texts under ``JUDGED_WORDS`` words have null distances,
    which reject nothing. A distance equal to a limit is kept. Null ids stay;
    an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(measured(docs, id_col), "measures")
    out = judged(rows, references(rows))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(
        F.col(id_col).alias("doc_id"), *[F.col("_m")[c].alias(c) for c in counts],
        F.col("_failed").alias("base_failed"), "kept", "class_distance", "common_distance",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, unchanged.

    The texts are measured for the references and again for the verdict, so no
    text is shuffled or written.
    """
    refs = references(materialize(measured(docs), "measures"))
    names = docs.columns
    at = lambda name: F.col(f"_{names.index(name)}")
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = F.coalesce(at("text"), F.lit(""))
    rows = plain.withColumns({"_lang": at("lang"), "_m": measures(text, at("lang"))})
    m = F.col("_m")
    rows = rows.withColumn(
        "_failed", (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    )
    kept = judged(rows, refs).filter("kept")
    return kept.select(*[F.col(f"_{i}") for i in range(len(names))]).toDF(*names)
