"""URL resolution and link tests, as JVM-side expressions.

Arguments are SQL expressions, such as a column name or ``'/path'``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.columns import bind_sql, text_sql
from pagesift.functions.text import u_strip_sql

# Schemes whose references are resolved against a base.
RELATIVE_SCHEMES = ["", "ftp", "http", "https", "file", "sftp", "ws", "wss"]

# Parts of a URI reference (RFC 3986, appendix B).
_URI = r"^(?s)(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_DOTS = r"(?:^|/)\.{1,2}(?:/|$)"


def url_parts_sql(url: str) -> str:
    """Struct (url, scheme, authority, path, query, fragment); absent is ''."""
    # Tabs and line ends never belong to a URL, nor do blanks around it.
    clean = f"trim(regexp_replace({url}, {text_sql('[\t\r\n]')}, ''))"

    def part(group: int) -> str:
        return f"regexp_extract(u, {text_sql(_URI)}, {group})"

    return bind_sql(
        "u",
        clean,
        f"named_struct('url', u, 'scheme', lower({part(1)}), 'authority', {part(2)}, "
        f"'path', {part(3)}, 'query', {part(4)}, 'fragment', {part(5)})",
    )


# Text of a (scheme, authority, path, query, fragment) struct ``p``.
_UNSPLIT = """concat(
  if(p.scheme <> '', concat(p.scheme, ':'), ''),
  if(p.authority <> '' or (p.scheme = 'file' and startswith(p.path, '/')), concat('//', p.authority), ''),
  if(p.authority <> '' and p.path <> '' and not startswith(p.path, '/'), '/', ''),
  p.path,
  if(p.query <> '', concat('?', p.query), ''),
  if(p.fragment <> '', concat('#', p.fragment), ''))"""

# Path of a segment list ``segs`` with '.' and '..' worked off.
_DROP_DOTS = """array_join(concat(
  aggregate(segs, cast(array() as array<string>), (kept, seg) -> case
    when seg = '.' then kept
    when seg = '..' then slice(kept, 1, greatest(size(kept) - 1, 0))
    else concat(kept, array(seg)) end),
  if(element_at(segs, -1) in ('.', '..'), array(''), cast(array() as array<string>))), '/')"""

# Segments of a path relative to the folder of the base; inner empty ones go.
_RELATIVE_SEGMENTS = bind_sql(
    "parts",
    f"split(concat(regexp_replace(b.path, {text_sql('[^/]+$')}, ''), r.path), '/')",
    "filter(parts, (seg, i) -> i = 0 or i = size(parts) - 1 or seg <> '')",
)

_MERGED_PATH = f"""case
  when startswith(r.path, '/') and not rlike(r.path, {text_sql(_DOTS)}) then r.path
  else coalesce(nullif({bind_sql(
      "segs",
      f"if(startswith(r.path, '/'), split(r.path, '/'), {_RELATIVE_SEGMENTS})",
      _DROP_DOTS,
  )}, ''), '/') end"""

_TARGET = f"""named_struct(
  'scheme', b.scheme,
  'authority', if(r.authority <> '', r.authority, b.authority),
  'path', case when r.authority <> '' then r.path when r.path = '' then b.path else {_MERGED_PATH} end,
  'query', if(r.authority = '' and r.path = '' and r.query = '', b.query, r.query),
  'fragment', r.fragment)"""

_RESOLVED = f"""case
  when r.url = '' then b.url
  when b.url = '' then r.url
  when (r.scheme <> '' and r.scheme <> b.scheme)
    or b.scheme not in ({", ".join(text_sql(s) for s in RELATIVE_SCHEMES)}) then r.url
  else {bind_sql("p", _TARGET, _UNSPLIT)} end"""


def resolve_sql(base: str, href: str) -> str:
    """Resolve ``href`` against a ``url_parts_sql`` struct (bind it once per page)."""
    return bind_sql("b", base, bind_sql("r", url_parts_sql(href), _RESOLVED))


def url_join(base: str, href: str) -> Column:
    return F.expr(resolve_sql(url_parts_sql(base), href))


def url_host_sql(url: str) -> str:
    return f"coalesce(lower(try_parse_url({url}, 'HOST')), '')"


def url_host(url: str) -> Column:
    """Lower-cased host, '' if there is none or the URL is malformed."""
    return F.expr(url_host_sql(url))


def usable_link_sql(href: str) -> str:
    link = "link <> '' and not startswith(link, 'javascript:') and not startswith(link, '#')"
    return f"coalesce({bind_sql('link', u_strip_sql(href), link)}, false)"


def usable_link(href: str) -> Column:
    """Not blank, no script, no anchor. Never null."""
    return F.expr(usable_link_sql(href))
