"""SQL that says the same as a query, for the queries that SQL can express."""

from __future__ import annotations

from pagesift.llm import centroids, chat, quality, repair, url_templates

WORD = "[^\\x20\\x09-\\x0D]+"


def without(pattern: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"


def distances(name: str, refs: str) -> str:
    """Distance of each document's histograms to those of its language."""
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((p + q) / 2)) ELSE 0 END"
    return f"""
    {name} AS (SELECT doc_id, kind, sqrt(greatest(sum(({half('p')} + {half('q')}) / 2), 0)) AS d FROM (
      SELECT h.doc_id, h.kind, h.n / sum(h.n) OVER (PARTITION BY h.doc_id, h.kind) AS p,
             r.n / sum(r.n) OVER (PARTITION BY h.doc_id, h.kind) AS q
      FROM h JOIN {refs} r USING (lang, kind, j) JOIN base b ON b.doc_id = h.doc_id
      WHERE b.n_words >= {quality.JUDGED_WORDS}) GROUP BY ALL),
    {name}_far AS (SELECT doc_id FROM {name} GROUP BY doc_id
      HAVING max(CASE kind WHEN 'a' THEN d END) > {quality.CLASS_DISTANCE}
        OR (max(CASE kind WHEN 'a' THEN d END) > {quality.BOTH_CLASS}
            AND max(CASE kind WHEN 'b' THEN d END) > {quality.BOTH_COMMON}))"""


def sums(name: str, also: str = "") -> str:
    return f"""
    {name} AS (SELECT lang, kind, j, sum(n) AS n FROM h
      WHERE doc_id IN (SELECT doc_id FROM base WHERE NOT base_failed) {also} GROUP BY ALL)"""


COMMON = ", ".join(
    f"('{lang}', {j}, '{word}')" for lang, words in quality.COMMON.items() for j, word in enumerate(words)
)
QUALITY = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM w, unnest(range(1, len(ws) - 3)) u(i)),
dup AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN dup USING (doc_id, g), unnest(range(5)) v(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
counts AS (SELECT doc_id, lang, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    {without('[#*$%&|<>]+')} AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed
  FROM counts),
chars AS (SELECT doc_id, lang, {without('[a-z]+')} AS lower, {without('[A-Z]+')} AS upper, {without('[0-9]+')} AS digit,
    {without("[.,;:?''\"()-]+")} AS mark, {without('[!-/:-@\\[-`{-~]+')} AS punct,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS visible FROM w),
common(lang, j, word) AS (VALUES {COMMON}),
hits AS (SELECT doc_id, j, count(*) AS n FROM (SELECT doc_id, lang, lower(unnest(ws)) AS word FROM w)
  JOIN common USING (lang, word) GROUP BY ALL),
h AS (
  SELECT doc_id, lang, 'a' AS kind, unnest(range(6)) AS j, unnest([lower, upper, digit, mark, punct - mark,
    visible - lower - upper - digit - punct]) AS n FROM chars WHERE lang IN (SELECT lang FROM common)
  UNION ALL
  SELECT w.doc_id, lang, 'b', j, coalesce(hits.n, 0) FROM w JOIN common USING (lang) LEFT JOIN hits USING (doc_id, j)
  UNION ALL
  SELECT w.doc_id, lang, 'b', -1, any_value(len(ws)) - coalesce(sum(hits.n), 0) FROM w LEFT JOIN hits USING (doc_id)
  WHERE lang IN (SELECT lang FROM common) GROUP BY ALL),
{sums('r1')}, {distances('d1', 'r1')},
{sums('r2', 'AND doc_id NOT IN (SELECT doc_id FROM d1_far)')}, {distances('d2', 'r2')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM d2_far) AS kept FROM base"""

ROTATION = f"""
WITH r AS (SELECT conv_id, turn, regexp_replace(coalesce(nullif(regexp_replace(trim(coalesce(role, '')), '\\s+', '_', 'g'), ''),
    '{chat.UNNAMED}'), '<(\\\\*)\\|im_', '<\\\\\\1|im_', 'g') AS role,
    regexp_replace(coalesce(text, ''), '<(\\\\*)\\|im_', '<\\\\\\1|im_', 'g') AS text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS n FROM r),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t),
v AS (SELECT conv_id, speaker, n // {chat.PART_TURNS} AS part, n, role,
    CASE WHEN role = speaker THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body FROM t JOIN s ON c IS NOT DISTINCT FROM conv_id),
p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY n
    ROWS UNBOUNDED PRECEDING) - length(body) AS spot FROM v)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS text,
  coalesce(string_agg(CASE WHEN role = speaker THEN CAST(spot AS BIGINT) || '-' || CAST(spot + length(body) - 1 AS BIGINT) END, ' '
    ORDER BY n), '') AS masks
FROM p GROUP BY ALL"""


def clustering() -> str:
    """Ten unrolled rounds; sums are of 128 bits, floors exact."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
          list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
        c0 AS MATERIALIZED (SELECT n - 1 AS c, x FROM (SELECT x, row_number() OVER (
          ORDER BY sha256('{centroids.SALT}' || vec_id), x) AS n FROM kept) WHERE n <= {centroids.CENTROIDS})"""
    ]
    for k in range(centroids.ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT v.r, arg_min(c.c, [{apart}, c.c]) AS c, min({apart}) AS d
            FROM kept v CROSS JOIN c{k} c GROUP BY 1)"""
        )
        if k < centroids.ROUNDS:
            steps.append(
                f"""m{k} AS (SELECT c, list(f ORDER BY i) AS x FROM (
                SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
                  SELECT a.c, i, sum(v.x[i]) AS s, count(*) AS n FROM a{k} a JOIN kept v USING (r), unnest(range(1, 65)) u(i)
                  GROUP BY ALL)) GROUP BY c),
                c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{k} o LEFT JOIN m{k} m USING (c))"""
            )
    last = centroids.ROUNDS
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
      CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(o.x, ',')) AS centroid_sha256
    FROM a{last} a JOIN kept USING (r) JOIN c{last} o ON o.c = a.c"""


def path_templates() -> str:
    """The tree by levels: counts, named children, similar pairs and what they connect."""
    t = url_templates
    rules = ", ".join(f"('{kind}', '{rule}')" for kind, rule in t.RULES)
    shape = """CASE WHEN {s} IS NULL THEN 'end' WHEN regexp_matches({s}, '^[0-9]+\\z') THEN 'digits'
      WHEN regexp_matches({s}, '^[A-Za-z]+\\z') THEN 'letters'
      WHEN regexp_matches({s}, '\\.[A-Za-z]{{2,5}}\\z') THEN 'file' ELSE 'other' END"""
    smooth = lambda b, l, p: f"(({b}) + {t.PRIOR} * {p}) / (({l}) + {t.PRIOR})"
    steps = [
        f"""rules(kind, rule) AS (VALUES {rules}),
        cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
          THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        fit AS (SELECT r, arg_max(rule, [length(rule), strpos(rule, '/'), CAST(kind = 'block' AS INT)]) AS rule,
          arg_max(kind, [length(rule), strpos(rule, '/'), CAST(kind = 'block' AS INT)]) AS kind FROM split, rules
          WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
            AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY r),
        seg AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM split LEFT JOIN fit USING (r)),
        flat AS (SELECT r, page_id, host, path, rule, kind, CASE WHEN len(parts) <= {t.DEPTH} THEN parts ELSE
          list_append(parts[:{t.DEPTH - 1}], array_to_string(parts[{t.DEPTH}:], '/')) END AS segs,
          CAST(kind IS NOT NULL AS INT) AS l, CAST(coalesce(kind = 'block', false) AS INT) AS b, '' AS tpl FROM seg),
        u0 AS MATERIALIZED (SELECT flat.*, {smooth('sum(b) OVER (PARTITION BY host)', 'sum(l) OVER (PARTITION BY host)', t.EVEN)}
          AS pur FROM flat)"""
    ]
    sums = ", ".join(f"count(*) FILTER (nxt = '{s}') AS {s}_" for s in t.SHAPES)
    apart = " + ".join(f"abs(x.{s}_ * y.n - y.{s}_ * x.n)" for s in t.SHAPES)
    mark = "regexp_replace(seg, '([\\\\*()|])', '\\\\\\1', 'g')"
    for k in range(t.DEPTH):
        steps.append(
            f"""ch{k} AS MATERIALIZED (SELECT host, tpl, seg, max(pur) AS pur, count(*) AS n, sum(l) AS l, sum(b) AS b, {sums} FROM (
              SELECT *, segs[{k + 1}] AS seg, {shape.format(s=f'segs[{k + 2}]')} AS nxt FROM u{k} WHERE len(segs) > {k}) GROUP BY ALL),
            nd{k} AS (SELECT host, tpl, max(pur) AS pur, sum(n) AS a, sum(l) AS l, sum(b) AS b FROM ch{k} GROUP BY ALL),
            nm{k} AS MATERIALIZED (SELECT c.* FROM ch{k} c JOIN nd{k} d USING (host, tpl)
              WHERE c.n >= {t.FEWEST} AND c.n * {t.SHARE} >= d.a),
            pr{k} AS MATERIALIZED (SELECT x.host, x.tpl, x.seg AS s1, y.seg AS s2 FROM nm{k} x JOIN nm{k} y USING (host, tpl)
              WHERE 2 * ({apart}) <= x.n * y.n AND CASE WHEN x.l = 0 OR y.l = 0 THEN x.l = y.l ELSE
                pow(CAST(x.b AS DOUBLE) * y.l - y.b * x.l, 2) * (x.l + y.l)
                  <= 4 * (CAST(x.b AS DOUBLE) + y.b) * (x.l + y.l - x.b - y.b) * x.l * y.l END),
            cl{k}(host, tpl, s1, s2) AS (SELECT * FROM pr{k} UNION SELECT c.host, c.tpl, c.s1, p.s2 FROM cl{k} c
              JOIN pr{k} p ON p.host = c.host AND p.tpl = c.tpl AND p.s1 = c.s2),
            gp{k} AS (SELECT host, tpl, s1 AS seg, min(s2) AS g FROM cl{k} GROUP BY ALL),
            gs{k} AS (SELECT host, tpl, g, CASE WHEN count(*) = 1 THEN any_value({mark})
              ELSE '(' || string_agg({mark}, '|' ORDER BY seg) || ')' END AS label, sum(l) AS l, sum(b) AS b
              FROM gp{k} JOIN nm{k} USING (host, tpl, seg) GROUP BY ALL),
            st{k} AS (SELECT d.host, d.tpl, any_value(d.pur) AS pur, any_value(d.l) - coalesce(sum(m.l), 0) AS l,
              any_value(d.b) - coalesce(sum(m.b), 0) AS b FROM nd{k} d LEFT JOIN nm{k} m USING (host, tpl) GROUP BY ALL),
            u{k + 1} AS MATERIALIZED (SELECT u.* REPLACE (
              CASE WHEN len(segs) <= {k} THEN u.tpl ELSE u.tpl || '/' || coalesce(gs.label, '*') END AS tpl,
              CASE WHEN len(segs) <= {k} THEN u.pur WHEN gs.label IS NULL THEN {smooth('st.b', 'st.l', 'u.pur')}
                ELSE {smooth('gs.b', 'gs.l', 'u.pur')} END AS pur)
              FROM u{k} u LEFT JOIN st{k} st USING (host, tpl)
              LEFT JOIN gp{k} gp ON gp.host = u.host AND gp.tpl = u.tpl AND gp.seg = u.segs[{k + 1}]
              LEFT JOIN gs{k} gs ON gs.host = gp.host AND gs.tpl = gp.tpl AND gs.g = gp.g)"""
        )
    return f"""WITH RECURSIVE {", ".join(steps)}
    SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN pur >= {t.BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict,
      tpl AS template, pur AS purity FROM u{t.DEPTH}"""


def repairs() -> str:
    """Forward DP over places that carries the least (cost, audit) and text of every state."""
    r = repair

    def edit(state: str, cost: str, letter: str, line: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line} || chr(10)}}"

    def dropped(state: str) -> str:
        return f"{{'c': {state}.c + {r.DELETE}, 'a': {state}.a || 'D', 't': {state}.t}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def closed(source: str) -> str:
        user, assistant = "'user:'", "'assistant:'"
        two = least("s2", *[edit(s, str(r.INSERT), "I", user) for s in ("s0", "s1", "s3")])
        return f"""(SELECT * REPLACE ({least("s3", edit("s2", str(r.INSERT), "I", assistant))} AS s3)
          FROM (SELECT * REPLACE ({two} AS s2) FROM {source}))"""

    own, stays = "role || ':' || text", "pay"
    to_user = [edit(s, f"{stays} + CASE WHEN left(role, 1) = 'u' THEN 0 ELSE {r.REROLE} END", "{}", "{}") for s in ("s0", "s1", "s3")]
    user = [f"CASE WHEN left(role, 1) = 'u' THEN {o.replace('{}', 'K', 1).replace('{}', own)} ELSE "
            f"{o.replace('{}', 'R', 1).replace('{}', chr(39) + 'user:' + chr(39) + ' || text')} END" for o in to_user]  # fmt: skip
    agent = (f"CASE WHEN left(role, 1) = 'a' THEN {edit('s2', stays, 'K', own)} ELSE "
             f"{edit('s2', f'{stays} + {r.REROLE}', 'R', chr(39) + 'assistant:' + chr(39) + ' || text')} END")  # fmt: skip
    system = edit("s0", f"{stays} + CASE WHEN left(role, 1) = 's' THEN 0 ELSE {r.FAR} END", "K", own)
    nothing = lambda cost: f"{{'c': CAST({cost} AS BIGINT), 'a': '', 't': ''}}"
    return f"""WITH RECURSIVE bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda x: CAST(ascii(x) AS BIGINT)) AS k FROM conversations),
    kinds AS (SELECT * EXCLUDE (k, t), xor(list_reduce(list_prepend(4294967295, k), lambda c, b:
        xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, bits),
    hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN ''
        WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(j)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
        sha256(strlen(role) || ':' || role || text)) AS i FROM hurt),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
        regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS vis,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM placed),
    f AS MATERIALIZED (SELECT *, CASE WHEN vis = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN right(vis, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        CASE WHEN vis = '' OR nth > 1 THEN {r.FAR} WHEN right(vis, 1) NOT IN ('.', '!', '?') THEN {r.TRUNCATED} ELSE 0 END AS pay FROM seen),
    facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND prev || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
    dp(conv_id, i, s0, s1, s2, s3) AS (
      SELECT conv_id, CAST(0 AS BIGINT), {nothing(0)}, {nothing(r.FAR)}, {nothing(r.FAR)}, {nothing(r.FAR)} FROM facts
      UNION ALL
      SELECT p.conv_id, f.i, {dropped("s0")}, {least(dropped("s1"), system)}, {least(dropped("s2"), *user)}, {least(dropped("s3"), agent)}
      FROM {closed("dp")} p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1),
    done AS (SELECT conv_id, {least("s0", "s3")} AS best FROM {closed("dp")} p JOIN facts n USING (conv_id) WHERE p.i = n.n
      UNION ALL SELECT p.conv_id, {least("s0", "s3")} FROM {closed("dp")} p, facts n
      WHERE p.conv_id IS NULL AND n.conv_id IS NULL AND p.i = n.n)
    SELECT o.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
      coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
      sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES = {
    "op6_distribution_divergence": QUALITY,
    "op10_perspective_rotation": ROTATION,
    "op11_scalar_tables": clustering(),
    "op12_path_templates": path_templates(),
    "op13_prefix_doubling": repairs(),
}
