"""SQL, for DuckDB, that states the results of the engine's queries independently of the engine."""

from __future__ import annotations

_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS INTEGER))"
_Z = f"SELECT doc_id, lang, source, {_BYTES} AS a, coalesce(array_to_string(list_transform({_BYTES}, lambda x: chr(x)), ''), '') AS z FROM documents WHERE text IS NOT NULL"
_PAIRS = "SELECT p[1] AS l, p[2] AS r, count(*) AS n FROM (SELECT unnest(list_zip(a[1:len(a)-1], a[2:len(a)])) AS p FROM {src} WHERE len(a) > 1) GROUP BY ALL"
_SCORED = """
SELECT *, n::DOUBLE / total AS support, left_n::DOUBLE * right_n::DOUBLE / total::DOUBLE AS expected,
  n::DOUBLE / (left_n::DOUBLE * right_n::DOUBLE / total::DOUBLE) AS lift,
  n::DOUBLE * (n::DOUBLE / (left_n::DOUBLE * right_n::DOUBLE / total::DOUBLE)) AS score
FROM (SELECT l, r, n, sum(n) OVER (PARTITION BY l) AS left_n, sum(n) OVER (PARTITION BY r) AS right_n, sum(n) OVER () AS total FROM {pairs})"""
_GATE = "n >= 4 AND support >= 0.001 AND lift >= 1.5"

#: The fixed dictionary of the catalogue: symbols of each rule in order.
_FIXED = ["th", "Āe", "e ", "an", "ăd", "ā ", "Ą ", "in"]
_ENCODED = "z"
for _k, _p in enumerate(_FIXED):
    _ENCODED = f"replace({_ENCODED}, '{_p}', chr({256 + _k}))"
_WORDS = ["the ", "and ", "the", "and", "th", "e ", "an", "in"]


def _mined(rules: int, first_id: int) -> str:
    """Common table expressions start(g, z) -> t(g, k, z, n0, l, r, n): the samples of each group after k rules, and the k-th rule."""
    pairs = "SELECT g, p[1] AS l, p[2] AS r, count(*) AS n FROM (SELECT g, unnest(list_zip(a[1:len(a)-1], a[2:len(a)])) AS p FROM (SELECT g, string_split(z, '') AS a FROM t WHERE length(z) > 1)) GROUP BY ALL"
    scored = _SCORED.format(pairs=f"({pairs})").replace("SELECT l, r, n", "SELECT g, l, r, n").replace("PARTITION BY l", "PARTITION BY g, l").replace("PARTITION BY r", "PARTITION BY g, r").replace("OVER ()", "OVER (PARTITION BY g)")
    best = f"SELECT g, l, r, n FROM ({scored}) WHERE {_GATE} QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, unicode(l), unicode(r)) = 1"
    return f"""t(g, k, z, n0, l, r, n) AS (SELECT g, 0, z, length(z), NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT FROM start
UNION ALL SELECT t.g, t.k + 1, replace(t.z, b.l || b.r, chr({first_id} + t.k)), t.n0, b.l, b.r, b.n FROM t JOIN ({best}) b USING (g) WHERE t.k < {rules})"""


def _train(rules: int, start: str, first_id: int) -> str:
    return f"""WITH RECURSIVE start AS (SELECT 0 AS g, z FROM ({start})), {_mined(rules, first_id)}
SELECT DISTINCT ({first_id - 1} + k)::BIGINT AS id, unicode(l)::BIGINT AS left, unicode(r)::BIGINT AS right, n AS frequency FROM t WHERE k > 0"""


_ITEMS = f"SELECT item_id, coalesce(array_to_string(list_transform({_BYTES}, lambda x: chr(x)), ''), '') AS z FROM benchmark WHERE text IS NOT NULL"


def _capacities(levels: tuple[int, ...]) -> str:
    """Mean cost after so many rules; the rules of a smaller budget are the first of a larger one's."""
    rows = " UNION ALL ".join(f"SELECT {c} AS capacity, least({c}, most)::INTEGER AS rules, (SELECT round(avg(length(z)::DOUBLE / nullif(n0, 0)), 9) FROM t WHERE k = least({c}, most)) AS cost FROM m" for c in levels)
    return f"WITH RECURSIVE start AS (SELECT 0 AS g, z FROM ({_ITEMS})), {_mined(max(levels), 256)}, m AS (SELECT max(k) AS most FROM t) {rows}"


def _growth(steps: int, rules: int) -> str:
    return f"""WITH RECURSIVE items AS (SELECT z, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS total FROM ({_ITEMS})),
start AS (SELECT g, z FROM items, range(1, {steps + 1}) x(g) WHERE i < total * g // {steps}), {_mined(rules, 256)},
s AS (SELECT g, max(k) AS rules, (SELECT max(total) FROM items) * g // {steps} AS samples FROM t GROUP BY g)
SELECT g::INTEGER AS step, samples, rules::BIGINT AS rules, greatest(rules - coalesce(lag(rules) OVER (ORDER BY g), 0), 0)::BIGINT AS growth FROM s"""


def _fnv(values: str) -> str:
    """Hexadecimal hash of a list of integers."""
    flat = f"flatten(list_transform({values}, lambda v: list_transform([0, 8, 16, 24, 32, 40, 48, 56], lambda k: ((v::BIGINT >> k) & 255)::HUGEINT)))"
    return f"printf('%016X', list_reduce(list_prepend(1469598103934665603::HUGEINT, {flat}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)"


_RULES = "SELECT o_orderkey AS idx, o_orderkey AS id, o_custkey AS \"left\", o_custkey * 65537 + o_orderkey AS \"right\", length(o_orderpriority) AS frequency FROM orders"
_TRAILS = "SELECT o_custkey AS trail_id, list(o_orderkey ORDER BY o_orderkey) AS symbols FROM orders GROUP BY 1"
_BLOCKS = f"SELECT trail_id, b AS block, symbols[b * 8 + 1 : b * 8 + 8] AS part FROM ({_TRAILS}), unnest(range(0, (len(symbols) - 1) // 8 + 1)) AS u(b)"
_FIELD = """WITH RECURSIVE e(i, v) AS (SELECT 0, 1 UNION ALL SELECT i + 1, CASE WHEN v * 2 > 255 THEN xor(v * 2, 285) ELSE v * 2 END FROM e WHERE i < 254),
x AS (SELECT list(v ORDER BY i) AS ex, (SELECT list(i ORDER BY v) FROM e) AS lg FROM e)"""


def _times(place: str, value: str) -> str:
    """Hexadecimal xor, over a group, of (place) times each byte of value."""
    byte = lambda k: f"({value} >> {8 * k}) & 255"
    return " || ".join(f"printf('%02X', bit_xor(CASE WHEN ({byte(k)}) = 0 THEN 0 ELSE ex[(lg[{place}] + lg[{byte(k)}]) % 255 + 1] END))" for k in range(7, -1, -1))


def _cuts(scored: str, medium: float, strong: float) -> str:
    q = lambda p: f"vals[floor({p} * (n - 1))::BIGINT + 1] * (1 - ({p} * (n - 1) - floor({p} * (n - 1)))) + vals[ceil({p} * (n - 1))::BIGINT + 1] * ({p} * (n - 1) - floor({p} * (n - 1)))"
    return f"cuts AS (SELECT {q(f'{medium}::DOUBLE')} AS mc, {q(f'{strong}::DOUBLE')} AS sc FROM (SELECT list(criticality ORDER BY criticality) AS vals, count(*) AS n FROM {scored}))"


_PROFILE = "CASE WHEN criticality >= sc AND sc > 0 THEN 'Strong' WHEN criticality >= mc AND mc > 0 THEN 'Medium' ELSE 'Light' END"
_PARTS = f"""WITH s AS (SELECT p_partkey + 256 AS id, coalesce(u.n, 0) AS usage, p_size::BIGINT AS birth_frequency,
  ln(1 + coalesce(u.n, 0)::DOUBLE) + 0.25 * ln(1 + p_size::DOUBLE) AS criticality
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) u ON l_partkey = p_partkey),
{_cuts('s', 0.70, 0.95)}, d AS (SELECT id, usage, birth_frequency, criticality, {_PROFILE} AS profile FROM s, cuts)"""
_PARITY = "CASE profile WHEN 'Strong' THEN 6 WHEN 'Medium' THEN 4 ELSE 2 END"
_ZIPF = "SELECT i + 256 AS id, 0::BIGINT AS \"left\", 0::BIGINT AS \"right\", greatest(2, floor(1e6 / (1 + i))::BIGINT // 1000) AS frequency, floor(1e6 / (1 + i))::BIGINT AS usage FROM range(1000) t(i)"


def _zipf_decided(medium: float, strong: float) -> str:
    return f"""z AS ({_ZIPF}), s AS (SELECT id, usage, ln(1 + usage::DOUBLE) + 0.25 * ln(1 + frequency::DOUBLE) AS criticality FROM z),
{_cuts('s', medium, strong)}, d AS (SELECT id, usage, criticality, {_PROFILE} AS profile FROM s, cuts)"""


_H = """s AS (SELECT doc_id AS ord, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
parts AS (SELECT ord, unnest(range(0, (n + 7) // 8)) AS pos, unnest(regexp_extract_all(h, '.{1,16}')) AS part FROM s),
nodes AS (SELECT ord, layer, pos * (8 >> layer) + k AS i, substr(part, (2 * k * (1 << layer) + 1)::BIGINT, (2 * (1 << layer))::BIGINT) AS key
  FROM (SELECT ord, pos, part, layer, unnest(range(0, (length(part) // 2 - (1 << (layer - 1)) - 1) // (1 << layer) + 1)) AS k
        FROM parts, (SELECT unnest([1, 2, 3]) AS layer) WHERE length(part) // 2 > (1 << (layer - 1))))"""
_FIRST = "min(ord::HUGEINT * 4000000000000 + layer * 1000000000000 + i)"
_REL = f"""WITH {_H}, g AS (SELECT key, count(*) AS ref_count, {_FIRST} AS f FROM nodes GROUP BY key),
r AS MATERIALIZED (SELECT key, ref_count, ((f // 1000000000000) % 4)::INTEGER AS layer, 255 + row_number() OVER (ORDER BY f) AS id, (1 << floor(log2(length(key) / 2 - 0.5))::INTEGER) AS half FROM g),
k AS (SELECT id, layer, ref_count, substr(key, 1, 2 * half) AS lk, substr(key, 2 * half + 1) AS rk FROM r)"""
_MOTIF = "[65, 66, 67, 68, 65, 66, 67, 68, 48, 48, 88, 89, 88, 89, 48, 48]"
_RAW = "list_transform({x}, lambda b: printf('%02X', b))"


def _digest(x: str) -> str:
    return f"md5(unhex(array_to_string({_RAW.format(x=x)}, '')))"


ORACLE: dict[str, str] = {
    "pair_counts": f"WITH b AS ({_Z}) SELECT l::BIGINT AS left, r::BIGINT AS right, n FROM ({_PAIRS.format(src='b')})",
    "pair_scores": f"WITH b AS ({_Z}), p AS ({_PAIRS.format(src='b')}), s AS ({_SCORED.format(pairs='p')}) SELECT l::BIGINT AS left, r::BIGINT AS right, n, left_n::BIGINT AS left_n, right_n::BIGINT AS right_n, round(support, 9) AS support, round(expected, 9) AS expected, round(lift, 9) AS lift, round(score, 9) AS score FROM s",
    "best_pair": f"WITH b AS ({_Z}), p AS ({_PAIRS.format(src='b')}), s AS ({_SCORED.format(pairs='p')}) SELECT l::BIGINT AS left, r::BIGINT AS right, n, round(score, 6) AS score FROM s WHERE {_GATE} ORDER BY s.score DESC, l, r LIMIT 1",
    "pair_frequency": f"WITH b AS ({_Z}), p AS ({_PAIRS.format(src='b')}) SELECT 'th' AS pair, coalesce(sum(n), 0)::BIGINT AS n FROM p WHERE l = 116 AND r = 104 UNION ALL SELECT 'll', coalesce(sum(n), 0)::BIGINT FROM p WHERE l = 108 AND r = 108",
    "replace_pair": f"WITH b AS ({_Z}) SELECT doc_id, length(replace(z, 'th', chr(256))) AS trail_length FROM b",
    "train_first": _train(16, f"SELECT z FROM ({_Z})", 256),
    "consolidate_first": _train(16, f"SELECT {_ENCODED} AS z FROM ({_Z})", 264),
    "encode_fixed_rules": f"WITH e AS (SELECT doc_id, z, {_ENCODED} AS e FROM ({_Z})) SELECT doc_id, length(z) AS input_bytes, length(e) AS trail_length, length(z) - length(e) AS rules_applied, md5(coalesce(array_to_string(list_transform(CASE WHEN e = '' THEN [] ELSE string_split(e, '') END, lambda c: unicode(c)), ','), '')) AS trail_md5 FROM e",
    "encode_cost": f"WITH e AS (SELECT lang, z, {_ENCODED} AS e FROM ({_Z})) SELECT lang, count(*) AS samples, round(avg(length(e)::DOUBLE / nullif(length(z), 0)), 9) AS symbols_per_byte, sum(length(e) + 16)::BIGINT AS model_cost, true AS exact FROM e GROUP BY lang",
    "rules_per_kib": f"SELECT source, sum(length(z))::BIGINT AS bytes, round(8::DOUBLE / (sum(length(z))::DOUBLE / 1024), 9) AS rules_per_kib FROM ({_Z}) GROUP BY source",
    "decode_roundtrip": "SELECT doc_id, octet_length(encode(text)) AS bytes, md5(text) AS md5 FROM documents WHERE text IS NOT NULL",
    "compiled_encode": f"WITH t AS (SELECT doc_id, regexp_extract_all(z, '({'|'.join(_WORDS)}|(?s:.))') AS t FROM ({_Z})) SELECT doc_id, len(t) AS trail_length, coalesce(list_sum(list_transform(list_filter(t, lambda x: length(x) > 1), lambda x: length(x))), 0)::BIGINT AS matched_bytes, len(list_filter(t, lambda x: length(x) > 1)) AS matched_rules FROM t",
    "trie_node_count": f"SELECT 1 + count(DISTINCT substr(w, 1, k)) AS nodes FROM (SELECT unnest({_WORDS}) AS w), unnest(range(1, 5)) AS u(k) WHERE k <= length(w)",
    "hier_relations": f"""{_REL} SELECT k.id, CASE WHEN length(lk) = 2 THEN CAST('0x' || lk AS BIGINT) ELSE a.id END AS "left", CASE WHEN length(rk) = 2 THEN CAST('0x' || rk AS BIGINT) ELSE b.id END AS "right", k.layer, k.ref_count FROM k LEFT JOIN r a ON a.key = lk LEFT JOIN r b ON b.key = rk""",
    "hier_ref_counts": f"WITH {_H}, g AS (SELECT key, count(*) AS ref_count, {_FIRST} AS f FROM nodes GROUP BY key) SELECT ((f // 1000000000000) % 4)::INTEGER AS layer, count(*) AS relations, sum(ref_count)::BIGINT AS refs, max(ref_count) AS most FROM g GROUP BY 1",
    "hier_trail_len": f"WITH {_H} SELECT s.ord AS doc_id, ceil(n / 8.0)::BIGINT AS trail_length, (SELECT count(*) FROM nodes WHERE nodes.ord = s.ord) AS relations_used FROM s",
    "hier_cost": f"WITH {_H}, f AS (SELECT o, count(*) AS c FROM (SELECT key, min(ord) AS o FROM nodes GROUP BY key) GROUP BY o) SELECT s.ord AS doc_id, coalesce(c, 0) AS new_relations, ceil(n / 8.0)::BIGINT + 2 * coalesce(c, 0) AS cost FROM s LEFT JOIN f ON o = s.ord",
    "hier_roundtrip": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL",
    "rule_hash": f"SELECT l_orderkey AS id, l_partkey AS \"left\", l_suppkey AS \"right\", l_linenumber::BIGINT AS frequency, {_fnv('[l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT]')} AS hash FROM lineitem",
    "trail_hash": f"SELECT trail_id, {_fnv('list_prepend(len(symbols), symbols)')} AS hash FROM ({_TRAILS})",
    "trail_block_hash": f"SELECT trail_id, block, {_fnv('list_prepend(len(part), part)')} AS hash FROM ({_BLOCKS})",
    "corrupted_rules": f"SELECT idx FROM ({_RULES}) WHERE id % 97 = 0 OR id % 101 = 0",
    "corrupted_blocks": f"SELECT trail_id, block FROM ({_BLOCKS}) WHERE len(list_filter(part, lambda x: x % 97 = 0)) > 0",
    "verify_trail": f"SELECT trail_id, len(list_filter(symbols, lambda x: x % 97 = 0)) = 0 AS intact FROM ({_TRAILS})",
    "rule_parity": f"SELECT idx // 8 AS grp, min(idx) AS begin_index, count(*) AS count, bit_xor(id) AS xor_id, bit_xor(\"left\") AS xor_left, bit_xor(\"right\") AS xor_right, bit_xor(frequency) AS xor_frequency FROM ({_RULES}) GROUP BY 1",
    "rule_dual_parity": _FIELD + f", r AS ({_RULES}) SELECT idx // 8 AS grp, min(idx) AS begin_index, count(*) AS count, " + ", ".join(f"printf('%016X', bit_xor(\"{f}\")) AS p_{f}, " + _times("idx % 8 + 1", f'"{f}"') + f" AS q_{f}" for f in ("id", "left", "right", "frequency")) + " FROM r, x GROUP BY 1",
    "trail_parity": f"SELECT trail_id, block, block * 8 AS begin_index, len(part) AS count, list_reduce(part, lambda a, b: xor(a, b)) AS xor_symbol FROM ({_BLOCKS})",
    "trail_dual_parity": _FIELD + f", t AS ({_BLOCKS}), u AS (SELECT trail_id, block, len(part) AS n, unnest(part) AS v, unnest(range(1, len(part) + 1)) AS place FROM t) SELECT trail_id, block, block * 8 AS begin_index, n AS count, printf('%016X', bit_xor(v)) AS p, " + _times("place", "v") + " AS q FROM u, x GROUP BY trail_id, block, n",
    "recover_one_rule": f"SELECT * FROM ({_RULES}) WHERE idx % 8 = (idx // 8) % 8",
    "recover_two_rules": f"WITH r AS ({_RULES}), g AS (SELECT idx // 8 AS grp, min(idx) AS b, count(*) AS c FROM r GROUP BY 1 HAVING count(*) >= 2) SELECT r.* FROM r JOIN g ON idx // 8 = grp WHERE idx = b + c - 1 OR idx = b + grp % (c - 1)",
    "recover_one_symbol": f"SELECT trail_id, block, array_to_string(part, ',') AS repaired FROM ({_BLOCKS})",
    "recover_two_symbols": f"SELECT trail_id, block, array_to_string(part, ',') AS repaired FROM ({_BLOCKS}) WHERE len(part) > 1",
    "interleave_order": "SELECT row_number() OVER (ORDER BY i % least(64, n), i) - 1 AS pos, i AS idx FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM orders))",
    "interleave_inverse": "SELECT i AS idx, row_number() OVER (ORDER BY i % least(64, n), i) - 1 AS pos, true AS inverse FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM orders))",
    "rule_usage": f"WITH e AS (SELECT {_ENCODED} AS e FROM ({_Z})) SELECT 256 + k AS id, coalesce(sum(length(e) - length(replace(e, chr((256 + k)::INTEGER), ''))), 0)::BIGINT AS usage FROM e, range(8) u(k) GROUP BY k",
    "rule_protection": f"{_PARTS} SELECT id, usage, birth_frequency, round(criticality, 9) AS criticality, profile, {_PARITY} AS parity FROM d",
    "protection_buckets": f"{_PARTS} SELECT profile, count(*)::INTEGER AS n, md5(string_agg((id - 256)::VARCHAR, ',' ORDER BY id)) AS positions_md5 FROM d GROUP BY profile",
    "parity_cost": f"{_PARTS} SELECT count(*) AS rules, count(*) FILTER (profile = 'Light') AS light, count(*) FILTER (profile = 'Medium') AS medium, count(*) FILTER (profile = 'Strong') AS strong, sum({_PARITY})::BIGINT AS adaptive_parity, count(*) * 6 AS uniform_strong_parity, round(1 - sum({_PARITY})::DOUBLE / (count(*) * 6), 9) AS saving_vs_strong, round(coalesce(sum(usage) FILTER (profile = 'Strong'), 0)::DOUBLE / sum(usage), 9) AS strong_usage_share FROM d",
    "trail_protection": f"""WITH e AS (SELECT doc_id, {_ENCODED} AS e FROM ({_Z})),
t AS (SELECT doc_id AS trail_index, length(e) AS symbols, coalesce(a.n, 0) AS access_count,
  CASE WHEN length(e) = 0 THEN 0.0 ELSE length(regexp_replace(e, '[^Ā-ć]', '', 'g'))::DOUBLE / length(e) END AS shared_rule_fraction
  FROM e LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a ON user_id = doc_id),
s AS (SELECT *, ln(1 + access_count::DOUBLE) + 0.75 * shared_rule_fraction + 0.10 * ln(1 + symbols::DOUBLE) AS criticality FROM t), {_cuts('s', 0.80, 0.98)}
SELECT trail_index, symbols, access_count, round(shared_rule_fraction, 9) AS shared_rule_fraction, round(criticality, 9) AS criticality, {_PROFILE} AS profile FROM s, cuts""",
    "burst_failure": """WITH p AS (SELECT e AS errors, s, unnest(range(s, s + e)) AS pos FROM (SELECT unnest([1, 4, 41]) AS e), range(4096) r(s) WHERE s + e <= 4096),
g AS (SELECT errors, s, 'contiguous' AS layout, pos // 64 AS g, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT errors, s, 'interleaved', pos % 64, count(*) FROM p GROUP BY ALL),
m AS (SELECT errors, layout, s, max(n) AS worst FROM g GROUP BY ALL)
SELECT errors::BIGINT AS errors, layout, round(count(*) FILTER (worst > 2)::DOUBLE / count(*), 9) AS probability FROM m GROUP BY ALL""",
    "max_burst": """WITH p AS (SELECT len, s, unnest(range(s, s + len)) AS pos FROM range(1, 140) l(len), range(0, 4096, 16) r(s) WHERE s + len <= 4096),
g AS (SELECT len, 'contiguous' AS layout, s, pos // 64 AS g, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT len, 'interleaved', s, pos % 64, count(*) FROM p GROUP BY ALL)
SELECT layout, min(len) - 1 AS max_burst FROM (SELECT layout, len, max(n) AS worst FROM g GROUP BY ALL) WHERE worst > 2 GROUP BY layout""",
    "overhead_model": """SELECT * FROM (VALUES ('rule_parity', 31.25), ('rule_integrity', 25.0), ('rule_total', 56.25), ('trail_parity', 6.25),
('trail_integrity', round(100.0 * (131072 + 8) / 8388608, 6)), ('trail_total', round(100.0 * (524288 + 131072 + 8) / 8388608, 6)),
('combined', round(100.0 * (10240 + 8192 + 524288 + 131072 + 8) / (32768 + 8388608), 6))) t(metric, overhead_pct)""".replace("31.25)", "31.25::DOUBLE)"),
    "group_parity": f"WITH {_zipf_decided(0.70, 0.95)}, c AS (SELECT profile, count(*) AS n FROM d GROUP BY 1) SELECT 'light' AS strategy, 125 * 2 AS parity UNION ALL SELECT 'strong', 125 * 6 UNION ALL SELECT 'adaptive', sum(ceil(n / 8.0) * {_PARITY})::BIGINT FROM c",
    "sweep_parity": " UNION ALL ".join(f"SELECT {m}::DOUBLE AS medium_q, {s}::DOUBLE AS strong_q, (WITH {_zipf_decided(m, s)}, c AS (SELECT profile, count(*) AS n FROM d GROUP BY 1) SELECT round(sum(ceil(n / 8.0) * {_PARITY}) / 1000.0, 9)::DOUBLE FROM c) AS mean_parity" for m in (0.5, 0.6, 0.7, 0.8) for s in (0.85, 0.9, 0.95, 0.98)),
    "read_window": "WITH w AS (SELECT page_id, substr(hex(encode(html)), 1025, 4096) AS h FROM pages) SELECT page_id, length(h) // 2 AS bytes, md5(unhex(h)) AS md5 FROM w WHERE length(h) // 2 >= 1024",
    "scale_windows": " UNION ALL ".join(f"SELECT {s}::BIGINT AS size, count(*) AS samples, coalesce(sum(n), 0)::BIGINT AS bytes, count(*) * {s} AS nominal_bytes FROM (SELECT least({s}, greatest(octet_length(encode(text)) - 512, 0)) AS n FROM documents) WHERE n >= {s // 2}" for s in (2048, 8192, 32768)),
    "gen_families": f"""WITH m AS (SELECT f, list_transform([0, 1, 2, 3, 0, 1, 6, 7, 8, 9, 10, 11, 8, 9, 14, 15], lambda i: (f * 37 + i * 11 + (i % 4) * f) % 256) AS m FROM range(32) t(f)),
x AS (SELECT f, list_transform(range(4096), lambda i: m[(i + (f * 3) % 16) % 16 + 1]) AS x FROM m)
SELECT f AS family, len(x) AS n, {_digest('x')} AS md5 FROM x""",
    "gen_corpora": f"""WITH x AS (
SELECT 'protection' AS corpus, f, list_transform(range(4096), lambda i: (f * 29 + (i % 32) * 7 + ((i // 8) % 5) * f) % 256) AS x FROM range(24) t(f) UNION ALL
SELECT 'mixed', f, list_transform(range(8192), lambda i: CASE WHEN (i + f) % 11 < 5 THEN 65 + f % 8 WHEN (i + 3 * f) % 17 < 8 THEN 97 + f % 8 ELSE (i * 13 + f * 7) % 256 END) FROM range(24) t(f))
SELECT corpus, f AS sample_ord, len(x) AS n, {_digest('x')} AS md5 FROM x""",
    "gen_noise": f"""WITH RECURSIVE r(k, v) AS (SELECT 0, 2463534242::BIGINT UNION ALL SELECT k + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT k, xor(b, b >> 17) AS c FROM (SELECT k, xor(v, (v << 13) & 4294967295) AS b FROM r WHERE k < 256))),
a AS (SELECT list_transform(range(4096), lambda i: CASE WHEN i > 0 AND i % 97 = 0 THEN ({_MOTIF}[(i + 3) % 16 + 1] + i) % 256 ELSE {_MOTIF}[(i + 3) % 16 + 1] END) AS x),
b AS (SELECT list_transform(range(4096), lambda i: CASE WHEN i % 61 = 0 THEN xor({_MOTIF}[(i + 5) % 16 + 1], ((7 + (i & 255)) % 256)::INTEGER) ELSE {_MOTIF}[(i + 5) % 16 + 1] END) AS x),
u AS (SELECT 0 AS k, x FROM a UNION ALL SELECT 1, x FROM b UNION ALL SELECT 2, (SELECT list(v & 255 ORDER BY k) FROM r WHERE k > 0)
  UNION ALL SELECT 3, list_concat((SELECT x[1:2048] FROM a), (SELECT x[2049:4096] FROM b)))
SELECT k, len(x) AS n, list_sum(x)::BIGINT AS total, {_digest('x')} AS md5 FROM u""",
    "zipf_usage": _ZIPF,
    "snapshot_roundtrip": f"SELECT doc_id AS trail_id, length(e) AS n, md5(coalesce(array_to_string(list_transform(CASE WHEN e = '' THEN [] ELSE string_split(e, '') END, lambda c: unicode(c)), ','), '')) AS md5 FROM (SELECT doc_id, {_ENCODED} AS e FROM ({_Z}))",
    "mined_recovery": f"SELECT id - 256 AS idx, * FROM ({_train(16, f'SELECT z FROM ({_Z})', 256)}) WHERE id % 8 = 3",
    "capacity_sweep": _capacities((64, 128, 256, 512)),
    "incremental_growth": _growth(12, 128),
    "retention_check": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, md5(text) AS md5 FROM benchmark WHERE text IS NOT NULL",
}
