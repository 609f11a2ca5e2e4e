"""Text clean-up, summaries, slugs and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.columns import as_col, let, text_sql

# Every character that counts as white space in Unicode text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_RUN_OF_SPACE = r"(?U)[\s\x1c-\x1f]+"

SUMMARY_WIDTH = 240
TITLE_WIDTH = 100

# Where a line may end: after a word before a blank, after a hyphen inside a
# word, around a dash. Only the cut position matters, so look-around is enough.
_SUMMARY_BREAK = (
    r"(?U)^(.{0,%d})(?:(?<=[^ ])(?= )"
    r"|(?<=[^\d\W]{2}-|[^\d\W]-[^\d\W]-)(?=[^\d\W]-?[^\d\W])"
    r"""|(?<=[\w!"'&.,?])(?=-{2,}\w)|(?<=[\w!"'&.,?]-{2,%d})(?=\w))"""
)


def u_strip_sql(text: str) -> str:
    return f"btrim({text}, {text_sql(WHITESPACE)})"


def u_strip(col: Column | str) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(as_col(col), F.lit(WHITESPACE))


def blank_to_null_sql(text: str) -> str:
    return f"if({u_strip_sql(text)} <> '', {text}, null)"


def blank_to_null(col: Column | str) -> Column:
    """Null if nothing is left after stripping; the value itself otherwise."""
    col = as_col(col)
    return F.when(u_strip(col) != "", col)


def collapse_space(col: Column | str) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.btrim(F.regexp_replace(as_col(col), _RUN_OF_SPACE, " "), F.lit(" "))


def summary(col: Column | str, width: int = SUMMARY_WIDTH, cut: str = "words") -> Column:
    """One-line summary of at most ``width`` characters, ending in an ellipsis.

    ``cut='words'`` keeps whole words, so a long text without blanks becomes
    just the ellipsis; ``cut='chars'`` cuts anywhere.
    """
    if cut not in ("words", "chars"):
        raise ValueError(f"unknown cut: {cut}")

    def shorten(text: Column) -> Column:
        if cut == "chars":
            head = F.substring(text, 1, width - 1)
        else:
            head = F.regexp_extract(text, _SUMMARY_BREAK % (width - 1, width), 1)
        return F.when(F.length(text) <= width, text).otherwise(
            F.concat(F.rtrim(head), F.lit("…"))
        )

    return let(collapse_space(col), shorten)


def title_cut(col: Column | str, width: int = TITLE_WIDTH) -> Column:
    col = as_col(col)
    return F.when(
        F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))
    ).otherwise(col)


def slug_file(col: Column | str) -> Column:
    """Name of an output folder: other characters than [0-9A-Za-z_-] become _."""
    slug = F.regexp_replace(u_strip(col), r"[^0-9A-Za-z_-]+", "_")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("source"))


def slug_key(col: Column | str) -> Column:
    """Key of a source: lower case, everything but letters and digits is '-'."""
    return F.btrim(F.regexp_replace(F.lower(as_col(col)), r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def content_hash(col: Column | str) -> Column:
    return F.sha2(as_col(col), 256)


def hash_seed(content: Column | str, raw_html: Column | str) -> Column:
    """What the fingerprint is taken of: content, else the page, else ''."""
    return F.coalesce(
        F.nullif(as_col(content), F.lit("")),
        F.nullif(as_col(raw_html), F.lit("")),
        F.lit(""),
    )


def time_and_rest(col: Column | str) -> Column:
    """Struct (time, rest): split at the first blank; no blank, no time."""
    col = as_col(col)
    at = F.instr(col, " ")
    return F.struct(
        F.when(at > 0, F.substring_index(col, " ", 1)).otherwise(F.lit("")).alias("time"),
        F.when(at > 0, F.substring(col, at + 1, F.length(col))).otherwise(col).alias("rest"),
    )
