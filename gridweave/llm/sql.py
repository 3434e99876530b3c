"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import divergence, secrets, url_filter

_LISTED = " CROSS JOIN ".join(f"(SELECT unnest([{', '.join(repr(x) for x in xs)}]) AS {c})" for c, xs in (("a", url_filter.FIRST), ("b", url_filter.LAST), ("n", ("", *"123456789")), ("t", url_filter.SUFFIXES)))
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP5 = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
p AS (
  SELECT page_id, row_number() OVER () AS r,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), {_AZ}) ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
fit AS (
  SELECT p.r, arg_max(k.host || k.path, length(k.host || k.path)) AS rule, arg_max(k.verdict, length(k.host || k.path)) AS verdict
  FROM p JOIN rules k ON (p.host = k.host OR ends_with(p.host, '.' || k.host)) AND starts_with(p.path, k.path)
  GROUP BY p.r),
hit AS (
  SELECT DISTINCT r FROM (SELECT r, array_to_string(list_slice(x, i, len(x)), '.') AS key FROM (SELECT r, string_split(host, '.') AS x, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> ''))
  WHERE key IN (SELECT a || '-' || b || n || '.' || t FROM {_LISTED}))
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN hit.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)
"""

OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS responder, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
  CASE WHEN n > 1 AND page_id < responder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id < responder THEN responder END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""

_LEAK_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LEAK_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_LEAK_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT r, dw.k, p, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
words AS (SELECT r, count(DISTINCT p + o) AS n FROM (SELECT DISTINCT r, k, p, unnest(range(0, k)) AS o FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strings(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


# written anew, so that a slip in the operator shows
_ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ACCESS, _HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
_ALPHABET = "".join(chr(c) for a, z in ("AZ", "az", "09") for c in range(ord(a), ord(z) + 1)) + "+/_=-"
_KINDS = ("assign", "access", "hex", "markov")
_K = 67
_SHA = "sha256(concat_ws(':', {k}, id))"
_PICK = f"parts[('0x' || substr({_SHA}, 1, 8))::BIGINT % {len(secrets.PARTS)} + 1]"
_CAPITAL = "upper(left({p}, 1)) || substr({p}, 2)"
_B64 = f"replace(to_base64(from_hex({_SHA.format(k=2)})), '=', '')"


def _pick(k: int) -> str:
    return _PICK.format(k=10 + k)


def _spans(pattern: str, group: int = 0, least: int = 0) -> str:
    """(s, e) structs, from the pieces between matches and the matches."""
    p = _text(pattern)
    at = "list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0)"
    keep = f"length(groups[k]) >= {least}" if group else "true"
    return f"""(SELECT coalesce(list_transform(list_filter(range(1, len(found) + 1), lambda k: {keep}), lambda k: {{'s': ({at})::BIGINT, 'e': ({at} + length(found[k]))::BIGINT}}), [])
      FROM (SELECT regexp_extract_all(t, {p}) AS found, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, {group}) AS groups))"""


_NAMES = "list_transform({k}, lambda x: {{'s': x.s, 'r': {r}, 'n': '{k}:' || x.s || ':' || x.e}})"
_JOINED = "array_to_string(list_transform(list_sort({lists}), lambda x: x.n), ',')"


def _joined(kinds) -> str:
    return _JOINED.format(lists=" || ".join(_NAMES.format(k=k, r=r) for r, k in enumerate(kinds)))


OP6 = f"""
WITH src AS (SELECT {_strings(secrets.PARTS)} AS parts),
strings AS (
  SELECT CASE WHEN id % 4 = 0 THEN substr({_SHA.format(k=1)}, 1, 40) WHEN id % 4 = 1 THEN upper(regexp_replace({_B64}, '[+/]', 'X', 'g')) ELSE {_B64} END AS text, 1 AS label FROM range(4000) t(id)),
names AS (
  SELECT CASE WHEN id % 3 = 0 THEN concat_ws('_', {', '.join(_pick(k) for k in range(4))})
    WHEN id % 3 = 1 THEN {' || '.join(_CAPITAL.format(p=_pick(k)) for k in range(5))} ELSE {' || '.join(_pick(k) for k in range(6))} END AS text, 0 AS label
  FROM range(4000) t(id), src),
pairs AS (
  SELECT label, strpos({_text(_ALPHABET)}, substr(text, i, 1)) - 1 AS a, strpos({_text(_ALPHABET)}, substr(text, i + 1, 1)) - 1 AS b
  FROM (SELECT label, text, unnest(range(1, length(text))) AS i FROM (SELECT * FROM strings UNION ALL SELECT * FROM names))),
seen AS (SELECT label, a, b, count(*) AS n FROM pairs WHERE a >= 0 AND b >= 0 GROUP BY ALL),
cells AS (
  SELECT l.label, x.a, y.b, coalesce(n, 0) + 1.0::DOUBLE AS n FROM range(2) l(label) CROSS JOIN range({_K}) x(a) CROSS JOIN range({_K}) y(b) LEFT JOIN seen s ON s.label = l.label AND s.a = x.a AND s.b = y.b),
logs AS (SELECT label, a, b, ln(n / sum(n) OVER (PARTITION BY label, a)) AS l FROM cells),
model AS (SELECT list(q ORDER BY a, b) AS q FROM (SELECT a, b, round(1000 * (max(l) FILTER (label = 1) - max(l) FILTER (label = 0)))::BIGINT AS q FROM logs GROUP BY a, b)),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, t, {_spans(_ASSIGN, 2, 6)} AS assign, {_spans(_ACCESS)} AS access, {_spans(_HEX)} AS hex, {_spans('[A-Za-z0-9+/_=-]{20,}')} AS runs FROM d),
free AS (SELECT *, list_filter(runs, lambda x: len(list_filter(assign || access || hex, lambda y: y.s < x.e AND x.s < y.e)) = 0) AS left_ FROM base),
codes AS (SELECT *, list_transform(left_, lambda x: {{'s': x.s, 'e': x.e, 'c': list_transform(range(x.s + 1, x.e + 1), lambda i: strpos({_text(_ALPHABET)}, substr(t, i, 1)) - 1)}}) AS coded FROM free),
found AS (
  SELECT *, list_transform(list_filter(coded, lambda x: floor(list_sum(list_transform(range(1, len(x.c)), lambda i: q[x.c[i] * {_K} + x.c[i + 1] + 1])) / (len(x.c) - 1)) >= 500), lambda x: {{'s': x.s, 'e': x.e}}) AS markov
  FROM codes, model)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex, sha256({_joined(_KINDS[:3])}) AS base_sha256, {_joined(_KINDS)} AS spans FROM found
"""

_BLANK = r"[^\x20\x09-\x0D]"
_SETS = {"upper": "[^A-Z]", "lower": "[^a-z]", "digit": "[^0-9]", "space": _BLANK, "stop": r"[^.,;:!?'\"()\-]", "symbol": "[^#*$%&|<>]", "wide": r"[\x00-\x7F]"}
_NINE = [c for c in divergence.CLASSES if c != "other"]
_TERM = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"


def _distance(p: str, q: str) -> str:
    return f"sqrt(greatest(0, sum({_TERM.format(a=p, b=q)} + {_TERM.format(a=q, b=p)}) / 2))"


OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '{_BLANK}+') AS w FROM d),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_BLANK}')),
dup AS (SELECT r, count(*) AS n FROM lines WHERE k > 1 GROUP BY r),
win AS (SELECT r, p, list_slice(w, p, p + 4) AS v FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
again AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, v) > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, p + unnest(range(5)) AS q FROM again) GROUP BY r),
classes AS (SELECT r, lang, length(t) AS all_, {', '.join(f"length(regexp_replace(t, {_text(p)}, '', 'g')) AS {c}" for c, p in _SETS.items())} FROM d),
class AS (SELECT r, lang, {', '.join(_NINE)}, all_ - {' - '.join(_NINE)} AS other FROM classes),
cl AS (UNPIVOT class ON {', '.join(divergence.CLASSES)} INTO NAME c VALUE n),
common AS (SELECT lang AS g, unnest(ws) AS word FROM (VALUES {', '.join(f"('{g}', {_strings(ws)})" for g, ws in divergence.COMMON.items())}) v(lang, ws)),
tok AS (SELECT r, regexp_replace(x, '^[.,;:!?''\"()]+|[.,;:!?''\"()]+$', '', 'g') AS word, count(*) AS n FROM (SELECT r, unnest(list_transform(w, lambda x: translate(x, {_AZ}))) AS x FROM w) GROUP BY ALL),
own AS (SELECT r, g, word, sum(n) AS n FROM tok JOIN common USING (word) GROUP BY ALL),
ref_n AS (SELECT lang AS g, sum(len(w))::DOUBLE AS n FROM w WHERE lang IN (SELECT DISTINCT g FROM common) GROUP BY lang HAVING sum(len(w)) > 0),
ref_w AS (SELECT c.g, c.word, coalesce(sum(o.n), 0) / any_value(ref_n.n) AS q FROM common c JOIN ref_n USING (g) LEFT JOIN (SELECT o.* FROM own o JOIN d ON o.r = d.r AND d.lang = o.g) o ON o.g = c.g AND o.word = c.word GROUP BY ALL),
ref_all AS (SELECT * FROM ref_w UNION ALL SELECT g, NULL, 1 - sum(q) FROM ref_w GROUP BY g),
ref_c AS (SELECT lang AS g, c, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cl WHERE lang IN (SELECT g FROM ref_n) GROUP BY lang, c),
ask AS (SELECT r, g, len(w)::DOUBLE AS n FROM w JOIN ref_n ON lang = g OR coalesce(lang, '') NOT IN (SELECT g FROM ref_n)),
rest AS (SELECT a.r, a.g, a.n - coalesce(sum(o.n), 0) AS n FROM ask a LEFT JOIN own o ON o.r = a.r AND o.g = a.g GROUP BY a.r, a.g, a.n),
hist AS (SELECT a.r, a.g, coalesce(CASE WHEN k.word IS NULL THEN rest.n ELSE o.n END, 0) / a.n AS p, k.q FROM ask a JOIN ref_all k ON k.g = a.g JOIN rest ON rest.r = a.r AND rest.g = a.g LEFT JOIN own o ON o.r = a.r AND o.g = a.g AND o.word = k.word WHERE a.n > 0),
far_w AS (SELECT r, min(x) AS far FROM (SELECT r, g, {_distance('p', 'q')} AS x FROM hist GROUP BY r, g) GROUP BY r),
far_c AS (SELECT r, min(x) AS far FROM (SELECT cl.r, k.g, {_distance('(cl.n / z.all_::DOUBLE)', 'k.q')} AS x FROM cl JOIN classes z ON z.r = cl.r AND z.all_ > 0 JOIN ask a ON a.r = cl.r JOIN ref_c k ON k.g = a.g AND k.c = cl.c GROUP BY cl.r, k.g) GROUP BY r),
out_ AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, class.symbol::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(t) AS chars, far_w.far AS fw, far_c.far AS fc
  FROM w JOIN class USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN far_w USING (r) LEFT JOIN far_c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR coalesce(chars >= 200 AND fc > 0.25 + 1.0 / sqrt(chars), false) OR coalesce(n_words >= 50 AND fw > 0.22 + 1.0 / sqrt(n_words), false)) AS kept
FROM out_
"""


#: op1's parameters, which its SQL shares.
DOMAINS = 4
DOMAIN_WEIGHTS = {"group0": 4.0, "group1": 3.0, "group2": 2.0, "group3": 1.0}
ENGLISH_WEIGHT = 3.0


def _fill(name: str, nodes: str, parent: str) -> str:
    """Share each parent's budget ``b`` over its children (w, cap): all get
    min(cap, level x w); levels rise up to the first child that is not full."""
    by = f"PARTITION BY {parent} ORDER BY cap / w"
    return f"""{name}_ratio AS (SELECT *, least(b, sum(cap) OVER (PARTITION BY {parent})) AS have, row_number() OVER ({by}) AS k FROM {nodes}),
{name}_level AS (
  SELECT *, (have - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY {parent} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_ratio),
{name} AS (SELECT * EXCLUDE (b), least(cap, w * max(level) OVER (PARTITION BY {parent})) AS b FROM {name}_level)"""


_WEIGHT = "CASE domain " + " ".join(f"WHEN '{d}' THEN {w}::DOUBLE" for d, w in DOMAIN_WEIGHTS.items()) + " END"

OP1 = f"""
WITH d AS (
  SELECT doc_id, lang, source, 'group' || (('0x' || substr(md5(coalesce(source, '')), 1, 4))::BIGINT % {DOMAINS}) AS domain, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, md5(text) AS t
  FROM documents),
doc AS (SELECT * FROM d WHERE n > 0),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS size, 4.0::DOUBLE * sum(n) AS cap, 1.0::DOUBLE AS w FROM doc GROUP BY ALL),
l1 AS (SELECT domain, sum(cap) AS cap, {_WEIGHT} AS w, (SELECT 0.5::DOUBLE * sum(n) FROM doc) AS b, 0 AS top FROM leaf GROUP BY domain),
{_fill('f1', 'l1', 'top')},
l2 AS (SELECT leaf.domain, lang, sum(leaf.cap) AS cap, CASE WHEN lang = 'en' THEN {ENGLISH_WEIGHT}::DOUBLE ELSE 1.0::DOUBLE END AS w, any_value(f1.b) AS b FROM leaf JOIN f1 USING (domain) GROUP BY leaf.domain, lang),
{_fill('f2', 'l2', 'domain')},
l3 AS (SELECT leaf.*, f2.b FROM leaf JOIN f2 ON f2.domain = leaf.domain AND f2.lang IS NOT DISTINCT FROM leaf.lang),
{_fill('f3', 'l3', 'domain, lang')},
plan AS (SELECT domain, lang, source, size, least(floor(b + 1e-6)::BIGINT, 4 * size) AS budget FROM f3),
turns AS (SELECT domain, lang, source, unnest(range(0, 4)) AS epoch, size, budget FROM plan),
rows_ AS (
  SELECT doc_id, t.lang, t.source, t.domain, epoch, n, budget - epoch * size AS room, ('0x' || substr(md5(concat_ws(':', '17', epoch, coalesce(doc_id::VARCHAR, ''), t_)), 1, 15))::BIGINT AS h
  FROM turns t JOIN (SELECT doc_id, lang, source, domain, n, t AS t_ FROM doc) x ON x.domain = t.domain AND x.lang IS NOT DISTINCT FROM t.lang AND x.source IS NOT DISTINCT FROM t.source WHERE budget > epoch * size),
run AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM rows_)
SELECT doc_id, lang, source, domain, epoch::INTEGER AS epoch, n::BIGINT AS tokens, least(n, room - before)::BIGINT AS taken FROM run WHERE before < room
"""

ORACLE_SQL = {"op1_mix_sources": OP1, "op5_url_filter": OP5, "op6_secret_scan": OP6, "op7_warc_salvage": OP7, "op9_decontaminate": OP9, "op10_divergence": OP10}
