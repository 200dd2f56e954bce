"""DuckDB SQL with the same results as the queries."""

from __future__ import annotations

import math

from ..functions.hashing import seed_hex
from ..operators.fingerprints import BITS, STOP_WORDS
from ..operators.sketches import bloom_params, cms_params
from ..sources.commands import GRAMMAR
from .queries import CAPACITY, DENSITY, SEGMENT

LOG = """log AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS ts, 'u' || lpad(user_id::VARCHAR, 4, '0') AS key,
  event_type || ':' || event_id AS value, event_type = 'error' AS tombstone FROM events),
sized AS (SELECT *, strlen(key)::BIGINT AS key_size, strlen(value)::BIGINT AS value_size, (29 + strlen(key) + strlen(value))::BIGINT AS size FROM log)"""


def newest(source: str, within: str = "") -> str:
    by = f"{within}, key" if within else "key"
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY ts DESC, seq DESC) = 1)"


LATEST = f"latest AS (SELECT * FROM {newest('log')}), live AS (SELECT * FROM latest WHERE NOT tombstone)"
RUNS = f"batched AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {CAPACITY} AS run_id FROM sized), runs AS (SELECT *, 1 AS level FROM {newest('batched', 'run_id')})"
CUSTOMER_RUNS = f"""c AS (SELECT c_custkey AS seq, c_custkey AS ts, c_name AS key, c_mktsegment AS value, (29 + strlen(c_name) + strlen(c_mktsegment))::BIGINT AS size FROM customer),
cb AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 200 AS run_id FROM c),
m AS (SELECT run_id, min(key) AS min_key, max(key) AS max_key, count(*) AS rows FROM cb GROUP BY run_id)"""
MIXED = "mixed AS (SELECT *, ['', 'bf ', 'cms ', 'hll ', 'fingerprint ', 'tokenLog '][(seq % 6 + 1)::INT] || key AS mkey FROM log)"

LINES = """lines AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS ts, 'u' || user_id AS k, event_id::VARCHAR AS n, event_type,
  [concat('put ', 'u' || user_id, ' ', event_type, ' ', event_id), concat('get u', user_id), concat('delete u', user_id), concat('prefixscan u 1 ', event_id), concat('bf put u', user_id, ' ', event_id),
   concat('rangescan a-u ', event_id, ' ', event_id), concat('hll check u', user_id, ' ', event_id), 'next', concat('fingerprint u', user_id, ' some text'), concat('cms make u', user_id), concat('hll check u', user_id),
   'exit', concat('simhash u', user_id, ' u', user_id), concat('put u', user_id), concat('rangeiterate a-u', user_id), concat('prefixiterate u', user_id), concat('cms destroy u', user_id)][(event_id % 17 + 1)::INT] AS line FROM events)"""
OPTION = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {code}" for _, code, p in GRAMMAR) + " ELSE 0 END"
KEY = r"regexp_extract(line, '^(?:put|get|delete|fingerprint|simhash|prefixscan|prefixiterate|(?:bf|cms|hll) (?:make|destroy|put|check)) (\w+)', 1)"
ARGUMENT = r"regexp_extract(line, '^(?:put|fingerprint|simhash|(?:bf|cms|hll) (?:put|check)) \w+ (.+)$', 1)"


def position(value: str, seed: str, size: int | str) -> str:
    return f"(('0x' || md5(encode({value}) || unhex({seed}))[1:16])::UBIGINT % {size})::BIGINT"


def seeds(k: int) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{seed_hex(i)}')" for i in range(k)) + ") AS s(i, seed))"


def varint(x: str) -> str:
    return f"(CASE {' '.join(f'WHEN {x} < {2 ** (7 * n)} THEN {n}' for n in range(1, 9))} ELSE 9 END)"


def bloom(source: str, n: int, p: float, name: str = "bloom") -> str:
    bits, k = bloom_params(n, p)
    return f"{name}_v AS (SELECT DISTINCT v FROM ({source})), {name} AS (SELECT DISTINCT {position('v', 'seed', bits)} AS pos FROM {name}_v, {seeds(k)})"


def cms(source: str, e: float, d: float) -> str:
    width, depth = cms_params(e, d)
    return f"cms AS (SELECT i AS row, {position('v', 'seed', width)} AS col, sum(n)::BIGINT AS cnt FROM (SELECT v, count(*) AS n FROM ({source}) GROUP BY v), {seeds(depth)} GROUP BY 1, 2)"


FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({v}, ''), lambda c: ascii(c)::UHUGEINT)), lambda a, b: xor((a * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, b))"


def registers(source: str, p: int, name: str = "reg") -> str:
    h = FNV.format(v="v")
    zeros = "CASE WHEN h = 0 THEN 64 ELSE (SELECT min(i) FROM range(0, 64) t(i) WHERE (h // power(2::DOUBLE, i)::UHUGEINT) % 2 = 1) END"
    return f"""{name}_h AS (SELECT {h} AS h FROM (SELECT DISTINCT v FROM ({source}))),
{name} AS (SELECT (h // {2 ** (64 - p)}::UHUGEINT)::INT AS bucket, max(1 + {zeros})::INT AS rank FROM {name}_h GROUP BY 1)"""


def fingerprints(source: str) -> str:
    """fps(id, fp) from (id, text)."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""src AS ({source}), w AS (SELECT id, unnest(regexp_extract_all(text, '\\w+')) AS word FROM src),
wc AS (SELECT id, word, count(*) AS n, ('0x' || md5(word)[17:32])::UBIGINT AS h FROM w WHERE word NOT IN ({stop}) GROUP BY id, word),
bits AS (SELECT id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS s FROM wc, range(0, {BITS}) t(i) GROUP BY id, i),
neg AS (SELECT id, sum((1::HUGEINT << (i + 1)::INT)) AS off FROM bits WHERE s < 0 GROUP BY id),
fps AS (SELECT src.id, (18446744073709551614::HUGEINT - coalesce(off, 0)) AS u FROM src LEFT JOIN neg ON neg.id = src.id),
fp AS (SELECT id, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS fp FROM fps)"""


def merkle(levels: int = 22) -> str:
    import hashlib

    empty, parts = bytes(20), ["n0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, unhex(sha1(encode(text))) AS hash FROM documents)"]
    for i in range(1, levels):
        parts.append(
            f"n{i} AS MATERIALIZED (SELECT l.pos // 2 AS pos, unhex(sha1(l.hash || coalesce(r.hash, unhex('{empty.hex()}')))) AS hash FROM n{i - 1} l LEFT JOIN n{i - 1} r ON r.pos = l.pos + 1"
            f" WHERE l.pos % 2 = 0 AND (SELECT count(*) FROM n{i - 1}) > 1)"
        )
        empty = hashlib.sha1(empty + empty).digest()
    return ", ".join(parts) + ", tree AS (" + " UNION ALL ".join(f"SELECT {i} AS level, pos, hash FROM n{i}" for i in range(levels)) + ")"


def empties(levels: int = 22) -> str:
    import hashlib

    rows, empty = [], bytes(20)
    for i in range(levels):
        rows.append(f"({i}, unhex('{empty.hex()}'))")
        empty = hashlib.sha1(empty + empty).digest()
    return f"empties(level, hash) AS (VALUES {', '.join(rows)})"


EMPTIES = empties()


def rate(source: str, group: str, capacity: int, cooldown: int) -> str:
    return f"""req AS (SELECT {group} AS g, ts, seq FROM {source}),
w(g, since) AS (SELECT DISTINCT g, 0::BIGINT FROM req UNION ALL SELECT g, nxt FROM (SELECT w.g, (SELECT min(r.ts) FROM req r WHERE r.g = w.g AND r.ts > w.since + {cooldown}) AS nxt FROM w) WHERE nxt IS NOT NULL),
placed AS (SELECT req.g, req.ts, req.seq, max(w.since) AS since FROM req JOIN w ON w.g = req.g AND w.since <= req.ts GROUP BY 1, 2, 3),
limited AS (SELECT g AS group_key, ts, seq, row_number() OVER (PARTITION BY g, since ORDER BY ts, seq) <= {capacity} AS allowed,
  greatest({capacity} - row_number() OVER (PARTITION BY g, since ORDER BY ts, seq), 0)::BIGINT AS tokens_left FROM placed)"""


def tiers(config_tables: int = 4, top: int = 4) -> str:
    """The level that each run ends in, and what it is merged with there."""
    cases = " ".join(f"WHEN run_id < {config_tables ** (lv - 1)} * (n // {config_tables ** (lv - 1)}) THEN {lv}" for lv in range(top, 1, -1))
    return f"""runs_n AS (SELECT *, (SELECT count(DISTINCT run_id) FROM runs) AS n FROM runs),
placed AS (SELECT *, CASE {cases} ELSE 1 END AS lv FROM runs_n),
grouped AS (SELECT *, run_id // power({config_tables}, lv - 1)::BIGINT AS grp FROM placed),
final AS (SELECT * FROM {newest('grouped', 'lv, grp')})"""


DENSE = "dense AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS nth, coalesce(sum(size) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"at\", coalesce(sum(16 + strlen(key)) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS index_at FROM runs)"
SEG = f"placed_s AS (SELECT seq, key, size, coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized), seg AS (SELECT seq, size, before // {SEGMENT - 8} + 1 AS segment, before % {SEGMENT - 8} + 8 AS \"at\" FROM placed_s)"
STRUCT = "acts AS (SELECT event_id AS seq, ['bf', 'cms', 'hll'][(event_id % 3 + 1)::INT] AS kind, 'n' || (user_id % 20) AS name, CASE WHEN event_id % 50 = 0 THEN 'make' WHEN event_id % 333 = 5 THEN 'destroy' ELSE 'put' END AS action, event_type AS argument FROM events), made AS (SELECT kind, name, argument AS parameters, seq AS made FROM (SELECT * FROM acts WHERE action IN ('make', 'destroy') QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY seq DESC) = 1) WHERE action = 'make')"
NAMED = """nacts0 AS (SELECT event_id AS seq, ['bf', 'cms', 'hll'][(event_id % 3 + 1)::INT] AS kind, 'n' || (user_id % 4) AS name,
  CASE WHEN event_id % 500 < 3 THEN 'make' WHEN event_id % 3331 = 7 THEN 'destroy' WHEN event_id % 7 = 0 THEN 'check' ELSE 'put' END AS action,
  CASE WHEN event_id % 500 < 3 THEN (CASE WHEN event_id % 1500 < 3 THEN ['0 0.1', '0.1 0.0', '260'] ELSE ['60 0.05', '0.05 0.1', '10'] END)[(event_id % 3 + 1)::INT]
  ELSE event_type || ':' || (user_id % 40) END AS argument FROM events),
nacts AS (SELECT * FROM nacts0 WHERE NOT (action = 'make' AND argument IN ('0 0.1', '0.1 0.0', '260'))),
nmade AS (SELECT kind, name, seq AS made FROM (SELECT * FROM nacts WHERE action IN ('make', 'destroy') QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY seq DESC) = 1) WHERE action = 'make'),
nput AS (SELECT a.kind, a.name, a.argument AS v, count(*) AS n FROM nacts a JOIN nmade m ON m.kind = a.kind AND m.name = a.name AND a.seq > m.made WHERE a.action = 'put' GROUP BY 1, 2, 3),
nask AS (SELECT DISTINCT a.kind, a.name, a.argument AS v FROM nacts a JOIN nmade m ON m.kind = a.kind AND m.name = a.name WHERE a.action = 'check')"""
BF60, CMS05, HLL10 = bloom_params(60, 0.05), cms_params(0.05, 0.1), 2.0**10


def le(x: str, size: int) -> str:
    digits = f"printf('%016x', {x}::BIGINT)"
    return " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(size))


def le_hex(x: int) -> str:
    return x.to_bytes(8, "little").hex()


def seed_table(n: int) -> str:
    return "".join(le_hex(32) + seed_hex(i) for i in range(n))


PART_LATEST = "SELECT p_name AS key, p_brand || '|' || p_type AS value, p_partkey AS seq FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1"
LIVE = f"WITH {LOG}, {LATEST} "
FLUSHED = f"WITH {LOG}, {RUNS} "
M10 = 2.0**10
ALPHA = 0.7213 / (1 + 1.079 / M10)
LN2, LN10 = math.log(2), math.log(10)

ORACLES = {
    "l4_iterate": LIVE + "SELECT row_number() OVER (ORDER BY key) AS call, key, value FROM live WHERE starts_with(key, 'u00')",
    "l5_iterate": LIVE + "SELECT row_number() OVER (ORDER BY key) AS call, key, value FROM live WHERE key BETWEEN 'u0010' AND 'u0050'",
    "s26_scan_lines": LIVE + ", p AS (SELECT row_number() OVER (ORDER BY key) AS place, key, value FROM live) SELECT place, place || '. key: ' || key || chr(9) || 'value: ' || value AS line FROM p",
    "x13_scan_arguments": rf"WITH {LINES} SELECT seq, nullif(regexp_extract(line, '^prefixscan (\w+) ', 1), '') AS prefix, nullif(regexp_extract(line, '^rangescan (\w+)-(\w+) ', 1), '') AS low, nullif(regexp_extract(line, '^rangescan (\w+)-(\w+) ', 2), '') AS high, regexp_extract(line, ' (\d+) (\d+)$', 1)::BIGINT AS page, regexp_extract(line, ' (\d+) (\d+)$', 2)::BIGINT AS size FROM lines WHERE {OPTION} IN (10, 11)",
    "d_check_bf": f"""WITH {NAMED}, bits AS (SELECT DISTINCT name, {position('v', 'seed', BF60[0])} AS pos FROM nput, {seeds(BF60[1])} WHERE kind = 'bf')
SELECT q.name, q.value, count(b.pos) = count(*) AS present FROM (SELECT name, v AS value, {position('v', 'seed', BF60[0])} AS pos FROM nask, {seeds(BF60[1])} WHERE kind = 'bf') q LEFT JOIN bits b ON b.name = q.name AND b.pos = q.pos GROUP BY 1, 2""",
    "d_check_cms": f"""WITH {NAMED}, cells AS (SELECT name, i, {position('v', 'seed', CMS05[0])} AS pos, sum(n)::BIGINT AS cnt FROM nput, {seeds(CMS05[1])} WHERE kind = 'cms' GROUP BY 1, 2, 3)
SELECT q.name, q.value, min(coalesce(c.cnt, 0))::BIGINT AS estimate FROM (SELECT name, v AS value, i, {position('v', 'seed', CMS05[0])} AS pos FROM nask, {seeds(CMS05[1])} WHERE kind = 'cms') q
LEFT JOIN cells c ON c.name = q.name AND c.i = q.i AND c.pos = q.pos GROUP BY 1, 2""",
    "d_check_hll": f"""WITH {NAMED}, hv AS (SELECT name, {FNV.format(v="v")} AS h FROM nput WHERE kind = 'hll'),
reg AS (SELECT name, (h // {2 ** 54}::UHUGEINT)::INT AS bucket, max(1 + CASE WHEN h = 0 THEN 64 ELSE (SELECT min(i) FROM range(0, 64) t(i) WHERE (h // power(2::DOUBLE, i)::UHUGEINT) % 2 = 1) END)::INT AS rank FROM hv GROUP BY 1, 2),
sums AS (SELECT name, sum(power(2.0, -rank)) AS s, count(*) AS used FROM reg GROUP BY 1),
raw AS (SELECT a.name, coalesce(used, 0) AS used, {0.7213 / (1 + 1.079 / HLL10) * HLL10 * HLL10}::DOUBLE / (coalesce(s, 0)::DOUBLE + 1024 - coalesce(used, 0)) AS r FROM (SELECT DISTINCT name FROM nask WHERE kind = 'hll') a LEFT JOIN sums ON sums.name = a.name)
SELECT name, round(CASE WHEN r <= 2560 AND used < 1024 THEN 1024 * ln(1024::DOUBLE / (1024 - used)) ELSE r END, 6) AS estimate FROM raw""",
    "d_fingerprint": f"WITH {fingerprints('SELECT source AS id, arg_max(text, doc_id) AS text FROM documents GROUP BY 1')} SELECT id AS name, fp FROM fp",
    "d_simhash": f"WITH {fingerprints('SELECT source AS id, arg_max(text, doc_id) AS text FROM documents GROUP BY 1')} SELECT x.id AS a, y.id AS b, bit_count(xor(x.fp, y.fp))::BIGINT AS distance FROM fp x, fp y WHERE y.id = 'src0'",
    "s5_record_layout": f"WITH {LOG} SELECT seq, {le('ts', 8)} || CASE WHEN tombstone THEN '01' ELSE '00' END || {le('key_size', 8)} || {le('value_size', 8)} || lower(hex(encode(key))) || lower(hex(encode(value))) AS layout FROM sized",
    "a8_bloom_bytes": f"""WITH {bloom('SELECT p_brand AS v FROM part', 100, 0.1)}, x AS (SELECT '{le_hex(100)}{le_hex(bloom_params(100, 0.1)[1])}{le_hex(bloom_params(100, 0.1)[0])}{seed_table(bloom_params(100, 0.1)[1])}'
  || (SELECT string_agg(CASE WHEN pos IS NULL THEN '00' ELSE '01' END, '' ORDER BY i) FROM range(0, {bloom_params(100, 0.1)[0]}) t(i) LEFT JOIN bloom ON pos = i) AS h) SELECT md5(unhex(h)) AS md5, (strlen(h) // 2)::BIGINT AS bytes FROM x""",
    "a8_cms_bytes": f"""WITH {cms('SELECT l_partkey::VARCHAR AS v FROM lineitem', 0.05, 0.05)}, x AS (SELECT '{le_hex(cms_params(0.05, 0.05)[1])}{le_hex(cms_params(0.05, 0.05)[0])}{seed_table(cms_params(0.05, 0.05)[1])}'
  || (SELECT string_agg({le('coalesce(cnt, 0)', 8)}, '' ORDER BY i) FROM range(0, {cms_params(0.05, 0.05)[0] * cms_params(0.05, 0.05)[1]}) t(i) LEFT JOIN cms ON row * {cms_params(0.05, 0.05)[0]} + col = i) AS h) SELECT md5(unhex(h)) AS md5, (strlen(h) // 2)::BIGINT AS bytes FROM x""",
    "j3_overlapping_runs": FLUSHED + ", m AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 2 ELSE 1 END AS level, min(key) AS lo, max(key) AS hi FROM runs GROUP BY run_id) SELECT a.run_id, b.run_id AS next_run_id FROM m a JOIN m b ON b.level = a.level + 1 AND a.lo <= b.hi AND a.hi >= b.lo",
    "s20_run_bloom": FLUSHED + f"SELECT DISTINCT run_id, {position('key', 'seed', bloom_params(CAPACITY, 0.1)[0])} AS pos FROM runs, {seeds(bloom_params(CAPACITY, 0.1)[1])}",
    "f4_lookup": FLUSHED + f""", bl AS (SELECT DISTINCT run_id, {position('key', 'seed', bloom_params(CAPACITY, 0.1)[0])} AS pos FROM runs, {seeds(bloom_params(CAPACITY, 0.1)[1])}),
m AS (SELECT run_id, min(key) AS lo, max(key) AS hi FROM runs GROUP BY run_id), ask AS (SELECT DISTINCT key FROM runs UNION ALL SELECT DISTINCT key || 'x' FROM runs),
sp AS (SELECT DISTINCT key, {position('key', 'seed', bloom_params(CAPACITY, 0.1)[0])} AS pos FROM ask, {seeds(bloom_params(CAPACITY, 0.1)[1])}),
nd AS (SELECT key, count(*) AS need FROM sp GROUP BY key), hv AS (SELECT sp.key, bl.run_id, count(*) AS have FROM sp JOIN bl ON bl.pos = sp.pos GROUP BY 1, 2)
SELECT hv.key, hv.run_id FROM hv JOIN nd ON nd.key = hv.key AND nd.need = hv.have JOIN m ON m.run_id = hv.run_id WHERE hv.key BETWEEN m.lo AND m.hi""",
    "s2_classify": f"WITH {LINES} SELECT seq, {OPTION} AS option, {OPTION} <> 0 AS charged, {KEY} AS key, {ARGUMENT} AS argument FROM lines",
    "s3_command_state": f"WITH {LINES}, ops AS (SELECT seq, ts, {KEY} AS key, {ARGUMENT} AS value, {OPTION} = 3 AS tombstone FROM lines WHERE {OPTION} IN (1, 3)) SELECT key, value, seq FROM {newest('ops')} WHERE NOT tombstone",
    "s4_records": f"WITH {LOG} SELECT seq, ts, key, value, tombstone, key_size, value_size FROM sized",
    "s5_record_bytes": f"WITH {LOG} SELECT tombstone, count(*) AS records, sum(size)::BIGINT AS bytes FROM sized GROUP BY tombstone",
    "s6_packed_bytes": f"WITH {LOG}, ids AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT DISTINCT key FROM log)) SELECT seq, id, ({varint('ts')} + 1 + {varint('id')} + CASE WHEN tombstone THEN 0 ELSE {varint('value_size')} + value_size END)::BIGINT AS packed_bytes FROM sized JOIN ids USING (key)",
    "s7_wal_segments": f"WITH {LOG}, {SEG} SELECT segment, count(*) AS records, sum(size)::BIGINT AS bytes, min(\"at\") AS first_at FROM seg GROUP BY segment",
    "s8_replay": LIVE + "SELECT key, value, ts, seq FROM live",
    "s9_truncate": f"WITH {LOG}, t AS (SELECT * FROM log WHERE seq >= 4000) SELECT key, value, seq, tombstone FROM {newest('t')}",
    "s10_watermarks": f"WITH {LOG}, {SEG}, b AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // {CAPACITY} AS batch FROM sized), f AS (SELECT batch, min(seq) AS seq FROM b GROUP BY batch) SELECT batch, seq, segment, \"at\" FROM f JOIN seg USING (seq)",
    "s11_recovery": LIVE + "SELECT key, value, seq FROM live",
    "s12_memtable_batches": f"WITH {LOG}, b AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {CAPACITY} AS batch FROM log) SELECT batch, count(*) AS operations, count(DISTINCT key) AS keys, min(seq) AS first_seq FROM b GROUP BY batch",
    "s13_sorted_memtable": FLUSHED + "SELECT run_id, key, value, seq, tombstone FROM runs",
    "s16_flush": FLUSHED + "SELECT run_id, level, key, value, seq, tombstone FROM runs",
    "s18_dense_index": FLUSHED + f", {DENSE} SELECT run_id, key, nth, \"at\" FROM dense",
    "s19_sparse_index": FLUSHED + f", {DENSE} SELECT run_id, key, nth, index_at FROM dense WHERE nth % {DENSITY} = 0",
    "s22_read_runs": FLUSHED + "SELECT run_id, key, value, seq FROM runs WHERE run_id IN (1, 2)",
    "s23_catalog": FLUSHED + "SELECT level, count(DISTINCT run_id) AS runs, true AS sized FROM runs GROUP BY level",
    "s25_populate": "SELECT (i % 100)::VARCHAR AS key, repeat((i % 100)::VARCHAR, 4) AS value, max(i) AS seq FROM range(0, 1000) t(i) GROUP BY i % 100",
    "m1_latest": LIVE + "SELECT key, value, ts, seq, tombstone FROM latest",
    "m1_latest_part": PART_LATEST,
    "f1_get": LIVE + "SELECT key, value FROM live WHERE key IN ('u0001', 'u0007', 'u0042', 'u0099', 'nobody')",
    "f2_get_memtable": f"WITH {LOG}, b AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {CAPACITY} AS batch FROM log), r AS (SELECT * FROM b WHERE batch >= 17) SELECT key, value FROM {newest('r')} WHERE NOT tombstone AND key IN ('u0001', 'u0007', 'u0042', 'u0099')",
    "f3_get_runs": LIVE + "SELECT key, value FROM live WHERE key IN ('u0001', 'u0007', 'u0042')",
    "f4_candidate_runs": f"WITH {CUSTOMER_RUNS} SELECT run_id, min_key, max_key FROM m WHERE min_key <= 'Customer#000000777' AND max_key >= 'Customer#000000777'",
    "f5_hide_system_keys": f"WITH {LOG}, {MIXED}, mm AS (SELECT seq, ts, mkey AS key, tombstone FROM mixed) SELECT key, 'user' AS namespace, seq FROM {newest('mm')} WHERE NOT tombstone AND NOT regexp_matches(key, '\\s.+$')",
    "f5_namespaces": f"WITH {LOG}, {MIXED} SELECT CASE WHEN contains(mkey, ' ') THEN split_part(mkey, ' ', 1) ELSE 'user' END AS namespace, count(*) AS records FROM mixed GROUP BY 1",
    "f6_prefix": LIVE + "SELECT key, value FROM live WHERE starts_with(key, 'u00')",
    "f7_range": LIVE + "SELECT key, value FROM live WHERE key BETWEEN 'u0010' AND 'u0050'",
    "f8_range_runs": f"WITH {CUSTOMER_RUNS} SELECT run_id, rows FROM m WHERE min_key <= 'Customer#000000500' AND max_key >= 'Customer#000000300'",
    "f9_tombstones": LIVE + "SELECT tombstone, count(*) AS keys FROM latest GROUP BY tombstone",
    "f10_checksums": f"WITH {LOG} SELECT seq, key FROM log WHERE seq % 100 = 7",
    "f11_proof_path": f"WITH {merkle()}, top AS (SELECT max(level) AS top FROM tree), way AS (SELECT n0.pos, l::INT AS level, top::INT AS top FROM n0, top, range(22) r(l) WHERE l <= top), " + EMPTIES + """
SELECT way.pos, way.top - way.level AS nth, way.level, lower(hex(coalesce(t.hash, e.hash))) AS hash FROM way JOIN empties e ON e.level = way.level
LEFT JOIN tree t ON t.level = way.level AND t.pos = CASE WHEN way.level = way.top THEN 0 ELSE xor(way.pos >> way.level, 1) END""",
    "l7_cache": f"""WITH {LOG}, ops AS (SELECT list([{{'key': key, 'seq': seq, 'value': value, 'tombstone': tombstone}}] ORDER BY seq) AS l FROM log),
held AS (SELECT list_reduce(l, lambda a, x: list_slice(list_concat(list_filter(a, lambda y: y.key <> x[1].key), list_filter(x, lambda y: NOT y.tombstone)), -5, -1), list_filter(l[1], lambda y: false)) AS h FROM ops),
r AS (SELECT unnest(h) AS r FROM held) SELECT r.key AS key, r.seq AS seq, r.value AS value FROM r""",
    "f11_merkle_contained": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE lang = 'en')",
    "l1_sorted": LIVE + "SELECT key, value FROM live ORDER BY key",
    "l2_prefix_scan": LIVE + "SELECT key, value FROM live WHERE starts_with(key, 'u00') ORDER BY key LIMIT 10 OFFSET 10",
    "l2_prefix_scan_past_end": LIVE + "SELECT key, value FROM live WHERE starts_with(key, 'u00') ORDER BY key LIMIT 10 OFFSET 980",
    "l3_range_scan": LIVE + "SELECT key, value FROM live WHERE key BETWEEN 'u0020' AND 'u0090' ORDER BY key LIMIT 15 OFFSET 30",
    "l3_customer_scan": "SELECT c_name AS key, arg_max(c_mktsegment, c_custkey) AS value FROM customer WHERE c_name BETWEEN 'Customer#000000100' AND 'Customer#000000900' GROUP BY c_name ORDER BY 1 LIMIT 20 OFFSET 80",
    "l4_pages": LIVE + ", p AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS nth FROM live) SELECT key, value, nth // 10 + 1 AS page, nth % 10 + 1 AS place FROM p",
    "w5_recent_puts": f"SELECT key, seq, value FROM ({PART_LATEST}) ORDER BY seq DESC LIMIT 5",
    "j1_merge_sources": LIVE + "SELECT key, value, seq FROM live",
    "j4_incorrect_elements": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')",
    "j5_bloom_join": "SELECT l_partkey, count(*) AS line_items FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13' GROUP BY l_partkey",
    "j6_fingerprint_pairs": f"WITH {fingerprints('SELECT doc_id AS id, text FROM documents')}, pairs AS (SELECT doc_id AS a, max(doc_id) OVER (PARTITION BY source) AS b FROM documents) SELECT a, b, bit_count(xor(x.fp, y.fp))::BIGINT AS distance FROM pairs JOIN fp x ON x.id = a JOIN fp y ON y.id = b",
    "j7_dictionary": f"WITH {LOG}, ids AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT DISTINCT key FROM log)) SELECT key, id, count(*) AS records FROM log JOIN ids USING (key) GROUP BY key, id",
    "u1_union": FLUSHED + ", u AS (SELECT key, seq FROM runs UNION ALL SELECT key, seq FROM log) SELECT key, count(*) AS versions, max(seq) AS seq FROM u GROUP BY key",
    "u3_set_difference": "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'",
    "a4_bloom_build": f"WITH {bloom('SELECT l_suppkey::VARCHAR AS v FROM lineitem', 100, 0.01)} SELECT pos FROM bloom",
    "a5_bloom_check": f"""WITH held AS (SELECT DISTINCT l_partkey::VARCHAR AS v FROM lineitem WHERE l_quantity = 50), n AS (SELECT greatest(count(*), 1)::DOUBLE AS n FROM held),
b AS (SELECT floor(n * {LN10 / LN2**2!r})::BIGINT AS bits, n FROM n), p AS (SELECT bits, greatest(floor(bits / n * {LN2!r}), 1) AS hashes FROM b),
bloom AS (SELECT DISTINCT {position('v', 'seed', 'bits')} AS pos FROM held, p, {seeds(4)} WHERE i < hashes),
q AS (SELECT value, {position('value', 'seed', 'bits')} AS pos FROM (SELECT DISTINCT p_partkey::VARCHAR AS value FROM part), p, {seeds(4)} WHERE i < hashes)
SELECT q.value, count(bloom.pos) = count(*) AS present FROM q LEFT JOIN bloom ON bloom.pos = q.pos GROUP BY q.value""",
    "a6_cms_build": f"WITH {cms('SELECT l_partkey::VARCHAR AS v FROM lineitem', 0.01, 0.01)} SELECT row, col, cnt FROM cms",
    "a7_cms_estimate": f"WITH {cms('SELECT l_partkey::VARCHAR AS v FROM lineitem', 0.01, 0.01)} SELECT value, min(coalesce(cnt, 0))::BIGINT AS estimate FROM (SELECT value, i, {position('value', 'seed', cms_params(0.01, 0.01)[0])} AS c FROM (SELECT DISTINCT p_partkey::VARCHAR AS value FROM part), {seeds(cms_params(0.01, 0.01)[1])}) q LEFT JOIN cms ON cms.row = q.i AND cms.col = q.c GROUP BY value",
    "a1_hll_registers": f"WITH {registers('SELECT l_partkey::VARCHAR AS v FROM lineitem', 10)} SELECT bucket, rank FROM reg",
    "a2_hll_estimate": f"WITH {registers('SELECT l_partkey::VARCHAR AS v FROM lineitem', 10)}, s AS (SELECT {ALPHA * M10 * M10!r} / (sum(power(2.0::DOUBLE, -rank)) + ({M10} - count(*))) AS raw, {M10} - count(*) AS empty FROM reg) SELECT round(CASE WHEN raw <= {2.5 * M10} AND empty > 0 THEN {M10}::DOUBLE * ln({M10}::DOUBLE / empty) WHEN raw > {2.0**32 / 30!r} THEN -{2.0**32} * ln(1 - raw / {2.0**32}) ELSE raw END, 4) AS estimate FROM s",
    "a3_hll_merge": f"WITH {registers('SELECT l_partkey::VARCHAR AS v FROM lineitem', 8)} SELECT bucket, rank FROM reg",
    "a2_distinct_count": "SELECT true AS close, count(DISTINCT l_partkey) AS exact FROM lineitem",
    "a11_word_counts": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\w+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(repr(x) for x in STOP_WORDS)}) GROUP BY 1, 2) SELECT word, sum(n)::BIGINT AS n, count(*) AS docs FROM c GROUP BY word",
    "a13_fingerprints": f"WITH {fingerprints('SELECT doc_id AS id, text FROM documents')} SELECT id, fp FROM fp",
    "a9_merkle_levels": f"WITH {merkle()} SELECT level, count(*) AS nodes, min(CASE WHEN pos = 0 THEN lower(hex(hash)) END) AS first_hash FROM tree GROUP BY level",
    "a9_merkle_root": f"WITH {merkle()} SELECT level, lower(hex(hash)) AS root FROM tree ORDER BY level DESC LIMIT 1",
    "a14_manifest": FLUSHED + "SELECT run_id, level, min(key) AS min_key, max(key) AS max_key, count(*) AS rows, sum(size)::BIGINT AS bytes FROM runs GROUP BY run_id, level",
    "a15_levels": FLUSHED + f", {tiers()} SELECT lv AS level, count(DISTINCT grp) AS runs, count(*) AS rows, sum(size)::BIGINT AS bytes FROM final GROUP BY lv",
    "x2_positions": f"SELECT s_suppkey, i AS seed, {position('s_name', 'seed', 100003)} AS pos FROM supplier, {seeds(3)}",
    "x5_fnv": f"SELECT s_suppkey, (CASE WHEN u >= 9223372036854775808::UHUGEINT THEN u::HUGEINT - 18446744073709551616::HUGEINT ELSE u::HUGEINT END)::BIGINT AS h FROM (SELECT s_suppkey, {FNV.format(v='s_name')} AS u FROM supplier)",
    "x6_hamming": "SELECT event_id, bit_count(xor(event_id, user_id))::BIGINT AS distance FROM events",
    "d_put_overwrite": LIVE + f", a AS (SELECT seq, ts, key, value, tombstone FROM log UNION ALL SELECT seq + 1000000000, 4000000000, key, 'new', false FROM log WHERE tombstone) SELECT key, value, seq FROM {newest('a')} WHERE NOT tombstone",
    "d_delete": LIVE + "SELECT live.key, value, true AS tombstone, 1000000 + n AS seq FROM live JOIN (VALUES ('u0001', 1::BIGINT), ('u0002', 2), ('u0003', 3), ('zzz', 4)) AS k(key, n) ON k.key = live.key",
    "d_make_destroy": f"WITH {STRUCT} SELECT kind, name, parameters, made FROM made",
    "d_add_elements": f"WITH {STRUCT} SELECT a.kind, a.name, count(*) AS elements, count(DISTINCT a.argument) AS kinds FROM acts a JOIN made m ON m.kind = a.kind AND m.name = a.name AND a.seq > m.made WHERE a.action = 'put' GROUP BY 1, 2",
    "c2_size_tiered": FLUSHED + f", {tiers()} SELECT lv AS level, count(DISTINCT grp) AS runs FROM final GROUP BY lv",
    "c3_leveled_state": LIVE + "SELECT key, value, seq FROM live",
    "c4_compacted_state": LIVE + "SELECT key, value, seq, tombstone FROM latest",
    "t1_rate_limit": f"WITH RECURSIVE {LOG}, {rate('log', 'key', 2, 21600)} SELECT group_key, ts, seq, allowed, tokens_left FROM limited",
    "t2_charged": f"WITH RECURSIVE {LINES}, ch AS (SELECT ts, seq FROM lines WHERE {OPTION} <> 0), {rate('ch', chr(39) + 'all' + chr(39), 5, 21600)} SELECT allowed, count(*) AS requests FROM limited GROUP BY allowed",
    "t3_request_log": f"WITH RECURSIVE {LOG}, {rate('log', 'key', 2, 21600)} SELECT group_key, ts, arg_max(tokens_left, seq) AS tokens_left FROM limited GROUP BY group_key, ts",
    "t4_ring": f"WITH {LOG}, b AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // {CAPACITY} AS batch FROM log) SELECT batch, batch % 3 AS slot, CASE WHEN batch >= 3 THEN batch - 3 END AS flushed, max(seq) AS last_seq FROM b GROUP BY batch",
    "t6_stream_latest": LIVE + "SELECT key, value, seq, tombstone FROM latest",
}
