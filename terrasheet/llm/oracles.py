"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .quality import LEAST_GROUP, MEASURES, WIDTH
from .urlfilter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _group(k: int) -> str:
    """Four base-32 digits of the five hex digits from place k."""
    digit = " + ".join(f"(instr('0123456789abcdef', substr(hx, {k + i}, 1)) - 1) * {16 ** (4 - i)}" for i in range(5))
    return " || ".join(f"substr('{_BASE32}', CAST((({digit}) // {32 ** (3 - j)}) % 32 AS INTEGER) + 1, 1)" for j in range(4))


OP5 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS hx, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {" || ".join(_group(1 + 5 * k) for k in range(8))} AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

OP6 = f"""WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in RULES)}) AS t(v, rh, rp)),
m AS (SELECT h.page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rh) + length(rp) DESC NULLS LAST, length(rh) DESC, v DESC) AS n FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1"""

OP7 = rf"""WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
u AS (SELECT item, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM s),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM u),
ns AS (SELECT DISTINCT n FROM win),
e AS (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, ns WHERE len(w) >= n),
hit AS (SELECT doc_id, e.n AS n, i, item FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM e) e JOIN win ON e.n = win.n AND e.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _fences(keys: str, where: str = "") -> str:
    q = ", ".join(f"quantile_disc({m}, 0.75) + {WIDTH} * greatest(quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25), {s}) AS f_{m}" for m, s in MEASURES.items())
    return f"SELECT {keys + ', ' if keys else ''}count(*) AS n, {q} FROM ok {where}{f' GROUP BY {keys}' if keys else ''}"


OP9 = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
u AS (SELECT doc_id, words, unnest(range(1, CAST(len(words) - 1 AS BIGINT))) AS i FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS c FROM u),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS n_upper, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
r AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio, word_chars / greatest(n_words, 1) AS word_length, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
ok AS (SELECT * FROM r WHERE NOT base_failed),
fs AS ({_fences("lang, source")}), fl AS ({_fences("lang")}), fa AS ({_fences("")}),
f AS (SELECT fs.lang, fs.source, {", ".join(f"CASE WHEN fs.n >= {LEAST_GROUP} THEN fs.f_{m} WHEN fl.n >= {LEAST_GROUP} THEN fl.f_{m} ELSE fa.f_{m} END AS f_{m}" for m in MEASURES)} FROM fs JOIN fl ON fs.lang = fl.lang, fa)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
NOT base_failed AND coalesce({" AND ".join(f"{m} <= f_{m}" for m in MEASURES)}, true) AS kept
FROM r LEFT JOIN f ON f.lang = r.lang AND f.source = r.source"""

_LETTERS = "ABCDE"
_FAILS = " ".join(f"WHEN '{x}' THEN {x}" for x in _LETTERS)

OP12 = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B, 100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 3 * length(text) AS C,
regexp_matches(text, '[#$%&*|]') AS D, coalesce(w.doc_id > first, false) AS E FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT f.*, filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM f, o),
r AS (SELECT *, substr(filter_order, step, 1) AS filter, least({", ".join(f"CASE WHEN {x} THEN instr(filter_order, '{x}') ELSE 6 END" for x in _LETTERS)}) AS first_step, ({" + ".join(f"{x}::INT" for x in _LETTERS)}) AS n_fails FROM s),
q AS (SELECT *, CASE filter {_FAILS} END AS fails FROM r),
n AS (SELECT part, filter_order, step, filter, count(*) FILTER (first_step > step) AS kept, count(*) FILTER (first_step = step) AS removed, count(*) FILTER (fails AND first_step < step) AS redundant, count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
count(*) FILTER (first_step = step AND good = 1) AS good_lost, count(*) FILTER (first_step = step AND toxic = 1) AS toxic_lost FROM q GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley, filter FROM n"""


def _mark(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_mark, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _climb(name: str, start: str) -> str:
    """All nodes of the trees over `start` (g, i, n, h), level by level."""
    return f"{name} AS (SELECT 0 AS lvl, g, i, n, h FROM {start} UNION ALL SELECT lvl + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lvl, g, i // 3, n)"


def _siblings(nodes: str, leaves: str) -> str:
    """For each leaf and level the siblings left and right of its node, joined."""
    return f"""SELECT a.g, a.i, b.lvl, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i // CAST(3 ** b.lvl AS BIGINT)), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i // CAST(3 ** b.lvl AS BIGINT)), '') AS r
FROM {leaves} a JOIN {nodes} b ON b.g = a.g AND b.n > 1 AND b.i // 3 = a.i // CAST(3 ** (b.lvl + 1) AS BIGINT) GROUP BY a.g, a.i, b.lvl"""


#: One bit of the reflected CRC-32, for which DuckDB has no function.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP13 = f"""WITH RECURSIVE d AS (SELECT *, coalesce('1' || source, '0') AS g, {_leaf("text")} AS h, CAST(doc_id AS VARCHAR) AS s FROM documents),
crc AS (SELECT DISTINCT s, 1 AS p, 0 AS k, xor(4294967295::BIGINT, ascii(s[1])::BIGINT) AS c FROM d WHERE s IS NOT NULL
UNION ALL SELECT s, CASE WHEN k = 7 THEN p + 1 ELSE p END, (k + 1) % 8, CASE WHEN k = 7 AND p < length(s) THEN xor({_STEP}, ascii(s[p + 1])::BIGINT) ELSE {_STEP} END FROM crc WHERE p <= length(s)),
even AS (SELECT s FROM crc WHERE p > length(s) AND xor(c, 4294967295::BIGINT) % 2 = 0),
e AS (SELECT d.*, CASE WHEN even.s IS NOT NULL THEN {_leaf("replace(text, chr(10), '')")} ELSE h END AS shown FROM d LEFT JOIN even ON even.s = d.s),
lv AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM e),
{_climb("node", "lv")},
sub AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, h, g AS src FROM node WHERE n = 1),
{_climb("high", "sub")},
own AS ({_siblings("node", "lv")}),
top AS ({_siblings("high", "sub")}),
path AS (SELECT g, i, lvl, l, r FROM own UNION ALL SELECT lv.g, lv.i, 1000 + top.lvl, top.l, top.r FROM lv JOIN sub ON sub.src = lv.g JOIN top ON top.i = sub.i),
steps AS (SELECT g, i, row_number() OVER (PARTITION BY g, i ORDER BY lvl) AS k, l, r FROM path),
proof AS (SELECT g, i, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM steps GROUP BY g, i),
fold AS (SELECT g, i, shown AS h, 1 AS k FROM lv UNION ALL SELECT fold.g, fold.i, sha256(l || h || r), fold.k + 1 FROM fold JOIN steps ON steps.g = fold.g AND steps.i = fold.i AND steps.k = fold.k),
last AS (SELECT g, i, arg_max(h, k) AS folded_root FROM fold GROUP BY g, i),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT lv.doc_id, lv.h AS leaf, sub.h AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM lv JOIN sub ON sub.src = lv.g JOIN last ON last.g = lv.g AND last.i = lv.i LEFT JOIN proof ON proof.g = lv.g AND proof.i = lv.i, root"""

ORACLES = {"op5_warc": OP5, "op6_url_filter": OP6, "op7_decontamination": OP7, "op9_quality_rules": OP9, "op12_filter_audit": OP12, "op13_merkle_manifest": OP13}
