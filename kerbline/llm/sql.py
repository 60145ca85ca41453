"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import csv

from kerbline.llm import licences, mixing, quality_rules, url_filters
from kerbline.llm.common import GAP

WORD = r"[^\x20\x09-\x0D]+"
#: Trim the contract's white space.
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def url_filter() -> str:
    rules = ", ".join(f"({_quoted(v)}, {_quoted(r)}, {_quoted(r.split('/')[0])}, {_quoted(r[r.index('/'):])})" for v, r in url_filters.RULES)
    host = lambda u: f"translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: f"regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"
    key = lambda u: f"{host(u)} || {path(u)} || regexp_extract({u}, '://[^?#]*(\\?[^#]*)', 1)"
    u = url_filters
    value = lambda name: _TRIM.format("concat(" + ", ".join(f"regexp_extract(tag, {_quoted(u._VALUE.format(name))}, {k})" for k in (1, 2, 3)) + ")")
    tag = r"""(?is)<(?:link|meta)\b(?:[^<>"']+|"[^"<]*"|'[^'<]*'|["'])*>"""
    names = " ".join(f"WHEN starts_with(p, {_quoted(n)}) THEN {_quoted(c)} || substr(p, {len(n) + 1})" for n, c in u.NAMED)
    code = "CASE WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{1,6};') THEN ('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1))::BIGINT WHEN regexp_matches(p, '^#[0-9]{1,7};') THEN regexp_extract(p, '^#([0-9]+);', 1)::BIGINT END"
    char = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(({code})::INT) || regexp_replace(p, '^[^;]*;', '') {names} ELSE '&' || p END"
    unescape = lambda x: f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {char}), ''))"
    dots = lambda x: f"CASE WHEN contains({x}, '/.') THEN list_reduce(list_prepend('', string_split({x}, '/')[2:]), lambda done, s: CASE s WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || s END) || CASE WHEN regexp_matches({x}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {x} END"
    return f"""
WITH RECURSIVE rules(verdict, rule, rule_host, rule_path) AS (VALUES {rules}),
tags AS (
  SELECT url AS a, unnest(regexp_extract_all(regexp_replace(html, {_quoted(u._NOISE)}, ' ', 'g'), {_quoted(tag)})) AS tag FROM pages WHERE url IS NOT NULL
), raw AS (
  SELECT a, CASE WHEN regexp_matches(tag, {_quoted(u._CANONICAL)}) THEN {value('href')} WHEN regexp_matches(tag, {_quoted(u._REFRESH)}) THEN {value('content')} END AS r,
    regexp_matches(tag, {_quoted(u._CANONICAL)}) AS canonical FROM tags
), plain AS (SELECT a, canonical, {unescape('r')} AS t FROM raw WHERE r IS NOT NULL),
seen AS (SELECT a, CASE WHEN canonical THEN t ELSE {_TRIM.format(f"regexp_extract(t, {_quoted(u._URL)}, 1)")} END AS t FROM plain),
split AS (SELECT a, t, regexp_extract(a, '^(.*?)://', 1) AS scheme, regexp_extract(a, '://([^/?#]*)', 1) AS authority, {path('a')} AS base,
  regexp_extract(t, '(?s)^([^?#]*)', 1) AS own, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS rest FROM seen),
joined AS (SELECT *, CASE WHEN own = '' THEN base WHEN starts_with(own, '/') THEN own ELSE CASE WHEN regexp_replace(base, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(base, '[^/]*$', '') END || own END AS there FROM split),
links AS (
  SELECT a, CASE WHEN regexp_matches(t, {_quoted(u._SCHEME + "//")}) THEN t WHEN t = '' OR starts_with(t, '#') OR regexp_matches(t, {_quoted(u._SCHEME)}) OR NOT contains(a, '://') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t ELSE scheme || '://' || authority || CASE WHEN own = '' THEN there ELSE {dots('there')} END || rest END AS b FROM joined
), ends AS (SELECT * FROM links WHERE b IS NOT NULL AND {host('a')} <> '' AND {host('b')} <> ''),
edges AS (SELECT {key('a')} AS x, {key('b')} AS y FROM ends UNION SELECT {key('b')}, {key('a')} FROM ends),
near(x, y) AS (SELECT x, x FROM edges UNION SELECT near.x, edges.y FROM near JOIN edges ON near.y = edges.x),
places AS (
  SELECT DISTINCT {host('u')} AS host, {path('u')} AS path, {key('u')} AS address
  FROM (SELECT coalesce(url, '') AS u FROM pages UNION ALL SELECT a FROM ends UNION ALL SELECT b FROM ends)
), ruled AS (
  SELECT p.address, p.host, p.path, arg_max(struct_pack(rule := rule, verdict := verdict), struct_pack(n := length(rule), ok := verdict = 'allow')) AS best
  FROM places p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY ALL
), blocked AS (SELECT DISTINCT near.x FROM near JOIN ruled ON ruled.address = near.y WHERE best.verdict = 'block')
SELECT page_id, p.host, p.path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN blocked.x IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT page_id, {host("coalesce(url, '')")} AS host, {path("coalesce(url, '')")} AS path, {key("coalesce(url, '')")} AS address FROM pages) p
LEFT JOIN ruled ON ruled.address = p.address LEFT JOIN blocked ON blocked.x = p.address
"""


def licence_scan() -> str:
    # a mark after "copyright" keeps the words of licence texts from being read as a holder; the mark goes with the punctuation
    gap = r"[ \t\x0b\f\r]"
    marked = rf"(?m)^({gap}*(?i:copyright))({gap}+(?i:{licences._WORDS})\b)"
    sign = rf"(?i:copyright)[:,]?{gap}*(?:(?i:\(c\)|by\b)|©|[\[<{{]?(?:\d{{4}}\b|(?i:yyyy|year)\b))"
    holder = rf"(?i:copyright){gap}+\p{{Lu}}|(?i:\(c\)){gap}*(?:\d{{4}}\b|(?i:copyright)\b)|©"
    notice = rf"(?m)^{gap}*(?:(?:{sign}|{holder})[^\n]*?({licences._PHRASE}|$)|(?i:all rights reserved)\b[.!]?)"

    def words(t: str) -> str:
        names = "[" + ", ".join(_quoted(v) for v, _ in licences.SPELLINGS if " " not in v) + "]"
        values = "[" + ", ".join(_quoted(c) for v, c in licences.SPELLINGS if " " not in v) + "]"
        rest = f"regexp_replace(regexp_replace(coalesce({t}, ''), {_quoted(marked)}, '\\1' || chr(1) || '\\2', 'g'), {_quoted(notice)}, ' \\1', 'g')"
        plain = f"trim(regexp_replace(lower({rest}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        out = f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce(map({names}, {values})[w], w)), ' ')"
        for v, c in licences.SPELLINGS:
            if " " in v:
                out = f"regexp_replace({out}, '\\b{v}\\b', '{c}', 'g')"
        return out

    known = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licences.KNOWN + licences.HEADERS)
    with licences.FULL_TEXTS.open(newline="") as f:
        full = ", ".join(f"({_quoted(r['digest'])}, {_quoted(r['licence'])})" for r in csv.DictReader(f))
    return f"""
WITH digests AS (SELECT sha256({words('t')}) AS digest, n FROM (VALUES {known}) v(n, t) UNION ALL SELECT * FROM (VALUES {full}) f(digest, n)),
known AS (SELECT digest, min(n) AS licence FROM digests GROUP BY 1 HAVING digest <> sha256('')),
lines AS (SELECT text, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (SELECT text, list_sort(list_distinct(list(licence))) AS notices FROM lines JOIN known ON digest = sha256({words('line')}) WHERE {_TRIM.format('line')} <> '' GROUP BY text)
SELECT doc_id, sha256({words('d.text')}) AS text_sha256, licence, coalesce(notices, []::VARCHAR[]) AS notices
FROM documents d LEFT JOIN known ON digest = sha256({words('d.text')}) LEFT JOIN found ON found.text = coalesce(d.text, '')
"""


def quality() -> str:
    q = quality_rules
    norm = "lower(" + _TRIM.format(f"regexp_replace(line, {_quoted(GAP)}, ' ', 'g')") + ")"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: {_TRIM.format('l')} <> '') AS lines FROM documents),
windows AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) s(k) GROUP BY rid),
base AS (SELECT doc_id, source, d.text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)),
lines AS (SELECT source, text, {norm} AS line, len(regexp_extract_all(line, '{WORD}')) AS n FROM (SELECT source, text, unnest(lines) AS line FROM d)),
often AS (SELECT source, line FROM lines GROUP BY ALL HAVING count(DISTINCT text) > {q.LINE_DOCS}),
bad AS (SELECT l.source, l.text FROM lines l LEFT JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.line = l.line GROUP BY ALL
  HAVING sum(CASE WHEN o.line IS NULL THEN n ELSE 0 END) < sum(n) * {q.LEAST_LEFT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AND bad.text IS NULL AS kept
FROM base LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM base.source AND bad.text = base.text
"""


def mix() -> str:
    w = mixing.WEIGHTS
    weight = f"[{', '.join(f'{x}::DOUBLE' for x in w)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(w)} + 1]"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
c AS (SELECT *, {weight} AS weight, source_size * {float(mixing.MOST)}::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT level FROM r WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM f)), cap) AS target FROM r),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (SELECT doc_id, d.size, source_size, target, whole, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS up_to FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN up_to - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""


#: Unsigned CRC-32 of a text of ASCII letters, digits and marks or of Latin letters: table of 256 remainders, then byte by byte.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) FROM range(256) r(i))"


def crc32(text: str, table: str) -> str:
    hexed = f"hex(encode({text}))"
    data = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr({hexed}, 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1])), 4294967295)"


def prefix_trie() -> str:
    return f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY place) AS l FROM turns GROUP BY conv_id),
crc AS (SELECT {_CRC_TABLE} AS t),
cut AS (SELECT conv_id, l, {crc32("conv_id::VARCHAR", "crc.t")} % 9 AS h FROM own, crc),
seq AS (SELECT c.conv_id AS c, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS s FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
member AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends, s FROM seq, LATERAL unnest(range(0, len(s) + 1)) u(d)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].text) END AS saved FROM member GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT u.p, u.d, sum(v.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves FROM node u JOIN node v ON v.d >= u.d AND v.p[1:u.d] = u.p
  LEFT JOIN child c ON c.p = v.p AND c.d = v.d GROUP BY u.p, u.d)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children, below.leaves AS n_leaves,
  below.saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below ON below.p = node.p AND below.d = node.d LEFT JOIN child ON child.p = node.p AND child.d = node.d LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[1:node.d - 1] AND node.d > 0
"""


def spelling() -> str:
    return f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00c0-\u00ff]+')) AS r FROM documents),
low AS (SELECT DISTINCT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) OVER (PARTITION BY d, w) AS n FROM runs WHERE length(r) >= 7),
hashed AS (SELECT w, n, {crc32("(d || ':' || w)", "crc.t")} AS h FROM low, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, LATERAL unnest(range(0, length(word))) u(i)),
one AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.rest UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(near := near, n := near_n), struct_pack(less := -near_n, near := near)) AS b FROM one GROUP BY word),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN b.near END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, root, steps) AS (SELECT word, word, 0 FROM form UNION ALL SELECT walk.word, form.form, steps + 1 FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL)
SELECT form.word, form.form, last.root, form.n, form.n_near, form.form_n FROM form JOIN (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word) last ON last.word = form.word
"""


def all_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter(), "op8_licence_scan": licence_scan(), "op9_quality_rules": quality(), "op10_mixing": mix(), "op11_spelling_variants": spelling(), "op12_prefix_trie": prefix_trie()}
