"""Comparison SQL (DuckDB) of the op queries."""

from __future__ import annotations

from pagefacts.llm.licenses import TEMPLATES, THRESHOLD, bigrams
from pagefacts.llm.quality_rules import ERROR, MAX_REPEAT_PERCENT, MIN_WORDS, RISK, RULES, chain_levels, chains

ORACLES: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    ways = chains(RULES)
    passed = ", ".join(
        f"CASE WHEN {r.whole} > 0 AND {r.scale} * {r.part} >= {min(r.cutoffs)} * {r.whole} THEN "
        f"len(list_filter({list(r.cutoffs)}, lambda c: {r.scale} * {r.part} < c * {r.whole})) END AS q{i}"
        for i, r in enumerate(RULES)
    )
    steps = ", ".join(
        f"{{'c': {c}, 'step': least({', '.join(f'q{r} * {len(way)} + {place + 1}' for place, r in enumerate(way))})}}"
        for c, way in enumerate(ways)
    )
    facts = ", ".join(
        f"({c}, {level!r}::DOUBLE, {len(way) * max(len(RULES[r].cutoffs) for r in way)})"
        for c, (way, level) in enumerate(zip(ways, chain_levels(RULES, ERROR)))
    )
    columns = ", ".join(
        "CASE c " + " ".join(
            f"WHEN {c} THEN {sorted(rule.cutoffs, reverse=True)}[least((step - {way.index(i)} + {len(way) - 1}) // {len(way)}, {len(rule.cutoffs)})]"
            for c, way in enumerate(ways) if i in way
        ) + f" END AS cut_{rule.name}"
        for i, rule in enumerate(RULES)
    )
    verdict = " AND ".join(
        f"NOT coalesce({r.whole} > 0 AND {r.scale} * {r.part} >= cut_{r.name} * {r.whole}, false)" for r in RULES
    )
    names = ", ".join(f"cut_{r.name}" for r in RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, stratum, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS times FROM g),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM h WHERE times > 1) GROUP BY k),
m AS (SELECT w.k, doc_id, stratum, md5(t) AS key, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN c ON c.k = w.k),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
held AS (SELECT DISTINCT stratum, key, {passed} FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
hist AS (SELECT stratum, c, step, count(*) AS m FROM (SELECT stratum, unnest([{steps}], recursive := true) FROM held) GROUP BY ALL),
total AS (SELECT stratum, c, sum(m)::BIGINT AS n FROM hist GROUP BY ALL),
tests AS (SELECT stratum, c, step, n, sum(m) OVER (PARTITION BY stratum, c ORDER BY step)::BIGINT AS k
  FROM (SELECT * FROM hist WHERE step IS NOT NULL UNION ALL SELECT stratum, c, 0, 0 FROM total) JOIN total USING (stratum, c)),
p AS (SELECT stratum, c, step, CASE WHEN k > n * {RISK!r}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}::DOUBLE) + (n - i) * ln(1 - {RISK!r}::DOUBLE)))) END AS p FROM tests),
facts(c, level, most) AS (VALUES {facts}),
admitted AS (SELECT stratum, c, greatest(0, coalesce(min(step) FILTER (p > level / (SELECT count(DISTINCT stratum) FROM held)) - 1, any_value(most))) AS step
  FROM p JOIN facts USING (c) GROUP BY ALL),
best AS (SELECT stratum, c, step FROM admitted QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY step DESC, c) = 1),
chosen AS (SELECT stratum, {columns} FROM best)
SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, {names},
  NOT base_failed AND {verdict} AS kept FROM b LEFT JOIN chosen USING (stratum)"""


ORACLES["op5_quality_rules"] = _quality()

ORACLES["op6_line_dedup"] = r"""WITH d AS (SELECT DISTINCT doc_id AS id, text AS t, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, t, i, array_to_string(ls[i + 1 : i + 3], chr(10)) AS s, least(len(ls), 3) AS n FROM (SELECT *, unnest(range(0, greatest(len(ls) - 3, 0) + 1)) AS i FROM d)),
v AS (SELECT *, min({'id': id, 't': md5(t), 'i': i}) OVER (PARTITION BY s) AS f FROM w WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
g AS (SELECT DISTINCT id, t, unnest(range(i, i + n)) AS line FROM v WHERE f != {'id': id, 't': md5(t), 'i': i}),
r AS (SELECT id, t, list(line) AS gone FROM g GROUP BY 1, 2)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) * (text IS NOT NULL)::INT AS n_lines, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text
FROM documents LEFT JOIN r ON r.id IS NOT DISTINCT FROM doc_id AND r.t = text"""

ORACLES["op10_decontamination"] = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
x AS (SELECT k, n, i, array_to_string(ws[i : i + n - 1], ' ') AS s FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT k, i, x.n, item_id FROM x JOIN q ON q.s = x.s AND q.n = x.n),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)"""


def _licenses() -> str:
    rows = ", ".join(
        "('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in bigrams(text))) for name, text in sorted(TEMPLATES.items())
    )
    return rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT DISTINCT k, u FROM (SELECT k, unnest(list_concat([t], string_split(t, chr(10)), string_split(regexp_replace(t, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)))) AS u FROM d)),
w AS (SELECT k, u, regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM u),
g AS (SELECT k, u, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS g FROM w WHERE len(ws) > 1),
x(id, b) AS (VALUES {rows}),
m AS (SELECT k, u, id, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, x WHERE len(g) < 200),
best AS (SELECT k, u, max(dice) AS dice, min(id) FILTER (f) AS id FROM (SELECT *, dice = max(dice) OVER (PARTITION BY k, u) AS f FROM m WHERE dice >= {THRESHOLD!r}) GROUP BY 1, 2),
doc AS (SELECT k, max(dice) AS dice, min(id) FILTER (f) AS license, count(*) AS n_units FROM (SELECT *, dice = max(dice) OVER (PARTITION BY k) AS f FROM best) GROUP BY 1)
SELECT doc_id, license, dice, coalesce(n_units, 0) AS n_units FROM d LEFT JOIN doc USING (k)"""


ORACLES["op2_license_scan"] = _licenses()

ORACLES["op1_ngram_join"] = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT k, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE c >= 0.8 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT k, k AS r FROM d UNION SELECT reach.k, e.y FROM reach JOIN e ON e.x = reach.r),
c AS (SELECT reach.k, min(d.doc_id) AS class_id FROM reach JOIN d ON d.k = reach.r GROUP BY ALL)
SELECT doc_id, class_id, (SELECT count(*) FROM e WHERE e.x = d.k) AS n_links FROM d JOIN c USING (k)"""

ORACLES["op3_warc"] = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1(h), 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31))::INT, 1) for k in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _repair() -> str:
    add = lambda s, cost, edit: f"printf('%08d', CAST(left({s}, 8) AS BIGINT) + {cost}) || '{edit}' || substr({s}, 9)"
    after = (2, 2, 3, 2)  # start, system, user, assistant: the state behind a new role
    keep = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    plain = []
    for q in range(4):
        kept = " ".join(f"WHEN i1 = '{r}' THEN {add(f'k{t}', 'more', 'K')}" for r, t in keep[q].items())
        given = add(f"k{after[q]}", "1 + more", "R")
        plain.append(f"least({add(f'k{q}', 2, 'D')}, CASE WHEN gone THEN 'z' {kept} ELSE 'z' END, CASE WHEN gone THEN 'z' ELSE {given} END) AS p{q}")
    once = ", ".join(f"p{q}, least(p{q}, {add(f'p{after[q]}', 5, 'I')}) AS b{q}" for q in range(4))
    twice = ", ".join(f"least(p{q}, {add(f'b{after[q]}', 5, 'I')}) AS k{q}" for q in range(4))
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, {crc} % 20 AS h
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END AS r,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) FROM c WHERE h <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS i FROM d),
o AS (SELECT *, left(r, 1) AS i1, row_number() OVER (PARTITION BY conv_id, r, t ORDER BY i) > 1 AS seen, regexp_replace(t, '[\\x20\\x09-\\x0D]+$', '') AS e FROM p),
f AS (SELECT *, e = '' AS blank, e <> '' AND seen AS duplicate, e <> '' AND NOT seen AND right(e, 1) NOT IN ('.', '!', '?') AS truncated,
  lag(i1) OVER (PARTITION BY conv_id ORDER BY i) || i1 AS pair FROM o),
g AS (SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS more FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
x AS (SELECT conv_id, n + 1 AS i, '00000000' AS k0, '00000010II' AS k1, '00000005I' AS k2, '00000000' AS k3 FROM n
  UNION ALL SELECT conv_id, i, {twice} FROM (SELECT conv_id, i, {once} FROM (SELECT g.conv_id, g.i, {", ".join(plain)}
  FROM x JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.i = x.i - 1))),
s AS (SELECT conv_id, CAST(left(k0, 8) AS BIGINT) AS cost, substr(k0, 9) AS audit FROM x WHERE i = 1),
a AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, j - length(replace(left(audit, j), 'I', '')) AS inserted, length(replace(left(audit, j), 'D', '')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM s)),
b AS (SELECT a.*, g.r, g.t, g.i1, coalesce(max(CASE WHEN place = 1 AND edit = 'K' AND i1 = 's' THEN 1 END) OVER (PARTITION BY a.conv_id), 0) AS led
  FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id AND g.i = a.j - a.inserted AND edit <> 'I' WHERE edit <> 'D'),
y AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN r WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(t, ''), chr(10) ORDER BY j) AS whole
  FROM b GROUP BY conv_id),
z AS (SELECT n.* EXCLUDE (n), cost, audit, whole FROM n JOIN s ON s.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM n.conv_id)
SELECT q.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id"""


ORACLES["op13_conversation_repair"] = _repair()

ORACLES["op12_suffix_dedup"] = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT k, id, i, substring(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS i FROM d)),
h AS (SELECT k, i FROM (SELECT k, id, i, min(id) OVER (PARTITION BY s) AS least FROM w) WHERE least < id),
g AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h)),
s AS (SELECT k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY k, g),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM s),
t AS (SELECT p.k, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(x), 2 * max(b) + 1) AS kept
  FROM p JOIN d ON d.k = p.k GROUP BY p.k)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t ON t.k = d.k"""
