"""Queries over the text-similarity operators, and the SQL that checks them.

All run over whole tables. ``turns`` are the conversation turns, ``steps`` the
pairs of a turn and the next one of its conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon as C
from ..functions import cells, codec
from ..functions import similarity as S
from ..functions import generate
from ..functions.encode import PLANES, add_planes, encode_cte, trit_array, with_norms
from ..functions.lens import _HITS, CHAINS, LENSES, STATIC_IDF
from ..operators import csidf, dedup, evalmetrics, fields, joins, route, stage2, tiles
from ..operators.storage import spread, store
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

T_PAIR, T_REF = 0.7, 0.62
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations)"
ENC = f"WITH RECURSIVE {TURNS}, {encode_cte('turns')}"
STEPS = "steps AS (SELECT a.*, b.id AS id_b FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
BOTH = f"{ENC}, {STEPS}, two AS (SELECT s.id AS sid, s.id_b FROM steps s)"
FROM_TWO = "FROM two JOIN enc a ON a.id = two.sid JOIN enc b ON b.id = two.id_b"
DOCREF = f"WITH d AS (SELECT doc_id AS id, text FROM documents), {encode_cte('d', name='enc')}, {encode_cte('benchmark', 'item_id', 'text', 'ref')}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", "text")


def _enc(spark: SparkSession, d: str) -> DataFrame:
    return add_planes(_turns(spark, d)).drop("text")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return add_planes(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).drop("text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return add_planes(_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")).drop("text")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Turn pairs as ``a`` and ``b``."""
    e = store(_enc(spark, d), "turns")
    return e.alias("a").join(e.alias("b"), F.expr("a.conv_id = b.conv_id AND b.turn = a.turn + 1"))


def _step_select(spark: SparkSession, d: str, **exprs: str) -> DataFrame:
    return _steps(spark, d).select(F.col("a.id").alias("id"), *(F.expr(f"round({x}, 6)").alias(n) for n, x in exprs.items()))


def _step_sql(**exprs: str) -> str:
    return f"{BOTH} SELECT two.sid AS id, {', '.join(f'round({x}, 6) AS {n}' for n, x in exprs.items())} {FROM_TWO}"


# encoding


@query(f"{ENC} SELECT id, {', '.join(PLANES)} FROM enc")
def encode_planes(spark, d):
    return _enc(spark, d).select("id", *PLANES)


@query(f"WITH d AS (SELECT doc_id AS id, text FROM documents), {encode_cte('d')} SELECT id AS doc_id, {', '.join(PLANES)} FROM enc")
def encode_documents(spark, d):
    return _docs(spark, d).select(F.col("id").alias("doc_id"), *PLANES)


_CHANNEL_SQL = " UNION ALL ".join(f"SELECT id, {c * 60} + i AS channel, ((p{c} >> i) & 1) + 2 * ((q{c} >> i) & 1) AS value FROM enc, range(60) r(i)" for c in range(4))


@query(f"{ENC}, long AS ({_CHANNEL_SQL}) SELECT id, channel::INTEGER AS channel, value::INTEGER AS value FROM long WHERE value > 0")
def encode_channels_long(spark, d):
    rows = _enc(spark, d).select("id", F.posexplode(trit_array()).alias("channel", "value"))
    return rows.where("value > 0").select("id", "channel", F.col("value").cast("int").alias("value"))


@query(f"{ENC} SELECT id, round({S.fill_ratio('')}, 6) AS fill, {', '.join(f'{S.bc(f"(p{c} | q{c})")} AS active_{n}' for c, n in enumerate(CHAINS))} FROM enc")
def fill_ratio(spark, d):
    return _enc(spark, d).select("id", F.expr(f"round({S.fill_ratio('')}, 6)").alias("fill"), *(F.expr(S.bc(f"(p{c} | q{c})")).alias(f"active_{n}") for c, n in enumerate(CHAINS)))


@query(f"{ENC}, long AS ({_CHANNEL_SQL}), packs AS (SELECT id, channel // 5 AS b, sum(value * CASE channel % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 9 WHEN 3 THEN 27 ELSE 81 END)::INTEGER AS v FROM long GROUP BY ALL) SELECT id, string_agg(printf('%02X', v), '' ORDER BY b) AS packed FROM packs GROUP BY id")
def pack_hex(spark, d):
    return codec.add_packed(_enc(spark, d)).select("id", F.hex("packed").alias("packed"))


@query("WITH t AS (SELECT conv_id * 1000 + turn AS id, strlen(text)::BIGINT AS n, regexp_extract_all(hex(encode(text)), '..') AS b FROM conversations) SELECT id, least(n, 12)::INTEGER AS char_count, n > 12 AS is_truncated, CASE WHEN n > 12 THEN list_reduce(list_prepend(2166136261, list_transform(b[12:], lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) ELSE 0 END::BIGINT AS overflow_hash FROM t")
def positional_encode_info(spark, d):
    size, cut, rest = codec.encode_info(F.col("text"))
    return _turns(spark, d).select("id", size.cast("int").alias("char_count"), cut.alias("is_truncated"), rest.alias("overflow_hash"))


@query("SELECT p_partkey, p_name AS decoded, false AS was_cut FROM part WHERE strlen(p_name) <= 12 UNION ALL SELECT p_partkey, substr(p_name, 1, 11), true FROM part WHERE strlen(p_name) > 12")
def positional_round_trip(spark, d):
    return codec.add_positional(_table(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "decoded", "was_cut")


@query(f"WITH {TURNS} " + " UNION ALL ".join(f"SELECT id AS original_id, {c} AS copy, text, {generate.mutate_sql('text', c)} AS mutated FROM turns" for c in (0, 1)))
def near_duplicate_fixture(spark, d):
    return generate.near_duplicates(_turns(spark, d), "id", "text", 2)


# canonical forms


def _canon_sql(preset: str) -> str:
    return f"SELECT doc_id, md5({C.canon_sql('text', preset)}) AS digest FROM documents"


def _canon(spark, d, column):
    return _table(spark, d, "documents").select("doc_id", F.md5(column).alias("digest"))


@query(_canon_sql("general"))
def canon_general(spark, d):
    return _canon(spark, d, C.canon(F.col("text"), "general"))


@query(_canon_sql("policy"))
def canon_policy(spark, d):
    return _canon(spark, d, C.canon(F.col("text"), "policy"))


@query(_canon_sql("code"))
def canon_code(spark, d):
    return _canon(spark, d, C.canon(F.col("text"), "code"))


@query(_canon_sql("uuid"))
def canon_uuid(spark, d):
    return _canon(spark, d, C.strip_uuids(F.col("text")))


@query(_canon_sql("support"))
def canon_support(spark, d):
    return _canon(spark, d, C.canon(F.col("text"), "support"))


# similarity of two texts

_DETAIL = {n: S.chain_cosine("a.", "b.", c) for c, n in enumerate(CHAINS)} | {"combined": S.lens_cosine("a.", "b."), "flat": S.flat_cosine("a.", "b.")}


@query(_step_sql(**_DETAIL, hamming=S.hamming("a.", "b.")))
def compare_detail(spark, d):
    return _step_select(spark, d, **_DETAIL, hamming=S.hamming("a.", "b."))


_LENS = {f"lens_{n}": S.lens_cosine("a.", "b.", n) for n in LENSES} | {"lens_custom": S.lens_cosine("a.", "b.", "0.4,0.3,0.2,0.1")}


@query(_step_sql(**_LENS))
def compare_all_lenses(spark, d):
    return _step_select(spark, d, **_LENS)


_RAW = S.lens_cosine("a.", "b.")
_CHECK = {"raw": _RAW, "calibrated": S.calibrated(_RAW, "a.", "b."), "reported": S.reported_calibration(_RAW, "a.", "b.")}


@query(_step_sql(**_CHECK).replace(f" {FROM_TWO}", f", {S.calibrated(_RAW, 'a.', 'b.')} >= 0.61e0 AS is_duplicate {FROM_TWO}"))
def check_calibrated(spark, d):
    cols = [F.expr(f"round({x}, 6)").alias(n) for n, x in _CHECK.items()]
    return _steps(spark, d).select(F.col("a.id").alias("id"), *cols, F.expr(f"{_CHECK['calibrated']} >= 0.61e0").alias("is_duplicate"))


_IDF = {"idf": S.idf_cosine("a.", "b."), "idf_lens_joint": S.idf_lens_joint("a.", "b."), "idf_lens_chain": S.idf_lens_chain("a.", "b.")}


@query(_step_sql(**_IDF))
def idf_cosines(spark, d):
    return _step_select(spark, d, **_IDF)


_CENTER = {"centered": S.centered_cosine("a.", "b."), **{f"centered_{n}": S.centered_cosine("a.", "b.", (c,)) for c, n in enumerate(CHAINS)}}


@query(_step_sql(**_CENTER))
def centered_cosines(spark, d):
    return _step_select(spark, d, **_CENTER)


@query(_step_sql(similarity=_RAW))
def packed_compare(spark, d):
    """Turn pairs compared by their packed vectors alone."""
    p = store(codec.add_packed(_enc(spark, d)).select("id", "conv_id", "turn", "packed"), "packed")
    nxt = p.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("packed").alias("next"))
    found = codec.compare_packed(p.join(nxt, ["conv_id", "turn"]).select("id", "packed", "next"), "packed", "next")
    return found.select("id", F.round("similarity", 6).alias("similarity"))


# joins

_PAIR_WHERE = f"a.id < b.id AND {S.lens_cosine('a.', 'b.')} >= {T_PAIR}e0"


@query(f"{ENC} SELECT a.id AS i, b.id AS j, round({_RAW}, 6) AS similarity FROM enc a JOIN enc b ON {_PAIR_WHERE}")
def batch_pairs_dedup(spark, d):
    return joins.pairs(_enc(spark, d), "id", T_PAIR).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(f"{ENC} SELECT a.id AS i, b.id AS j, {', '.join(f'round({x}, 6) AS {n}' for n, x in {'similarity': _RAW, **{n: _DETAIL[n] for n in CHAINS}}.items())} FROM enc a JOIN enc b ON {_PAIR_WHERE}")
def batch_pairs_detail(spark, d):
    found = joins.pairs(_enc(spark, d), "id", T_PAIR, detail=True)
    return found.select("i", "j", *(F.round(n, 6).alias(n) for n in ("similarity", *CHAINS)))


@query(f"WITH d AS (SELECT doc_id AS id, text FROM documents), {encode_cte('d')} SELECT a.id AS i, b.id AS j, round({_RAW}, 6) AS similarity FROM enc a JOIN enc b ON {_PAIR_WHERE}")
def batch_pairs_documents(spark, d):
    return joins.pairs(_docs(spark, d), "id", T_PAIR).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(f"{ENC}, p AS (SELECT count(*) AS n FROM enc a JOIN enc b ON {_PAIR_WHERE}) SELECT (SELECT count(*) FROM enc)::BIGINT AS lines, n::BIGINT AS pair_count, greatest((SELECT count(*) FROM enc) - n, 0)::BIGINT AS unique_count FROM p")
def batch_summary(spark, d):
    return dedup.batch_summary(store(_enc(spark, d), "turns"), "id", T_PAIR)


@query(f"{DOCREF} SELECT a.id AS doc_id, b.id AS item_id, round({_RAW}, 6) AS similarity FROM enc a JOIN ref b ON {_RAW} >= {T_REF}e0")
def batch_vs_reference(spark, d):
    found = joins.pairs_with_reference(_docs(spark, d), "id", _items(spark, d), "id", T_REF)
    return found.select(F.col("id").alias("doc_id"), F.col("ref_id").alias("item_id"), F.round("similarity", 6).alias("similarity"))


def _nearest_sql(expr: str) -> str:
    return f"{DOCREF}, s AS (SELECT a.id, b.id AS ref_id, {expr} AS x FROM enc a, ref b) SELECT id AS doc_id, x >= {T_REF}e0 AS is_duplicate, ref_id AS match_id, round(x, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, ref_id) = 1"


@query(_nearest_sql(_RAW))
def nearest_neighbour(spark, d):
    found = joins.nearest(_docs(spark, d), "id", _items(spark, d), "id", T_REF)
    return found.select(F.col("id").alias("doc_id"), "is_duplicate", "match_id", F.round("similarity", 6).alias("similarity"))


@query(_nearest_sql(S.calibrated(_RAW, "a.", "b.")))
def nearest_calibrated(spark, d):
    found = joins.nearest(_docs(spark, d), "id", _items(spark, d), "id", T_REF, calibrate=True)
    return found.select(F.col("id").alias("doc_id"), "is_duplicate", "match_id", F.round("similarity", 6).alias("similarity"))


def _topk_sql(expr: str, k: int, least: str = "") -> str:
    return f"{DOCREF}, s AS (SELECT a.id, b.id AS ref_id, {expr} AS x FROM enc a, ref b), r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY x DESC, ref_id) AS rank, ref_id, x FROM s {least}) SELECT id AS doc_id, rank::INTEGER AS rank, ref_id AS item_id, round(x, 6) AS similarity FROM r WHERE rank <= {k}"


def _topk(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "rank", F.col("ref_id").alias("item_id"), F.round("similarity", 6).alias("similarity"))


@query(_topk_sql(S.flat_cosine("a.", "b."), 5))
def topk_flat(spark, d):
    return _topk(joins.top_k(_docs(spark, d), "id", _items(spark, d), "id", 5))


@query(_topk_sql(S.lens_cosine("a.", "b.", "support"), 3, "WHERE x >= 0.55"))
def retriever_topk(spark, d):
    return _topk(joins.top_k(_docs(spark, d), "id", _items(spark, d), "id", 3, "support", 0.55))


@query(f"{DOCREF} SELECT id AS doc_id FROM enc a WHERE EXISTS (SELECT 1 FROM ref b WHERE {_RAW} >= {T_REF}e0)")
def semi_similar(spark, d):
    return joins.similar_to_any(_docs(spark, d), "id", _items(spark, d), "id", T_REF).select(F.col("id").alias("doc_id"))


@query(f"{DOCREF} SELECT id AS doc_id FROM enc a WHERE NOT EXISTS (SELECT 1 FROM ref b WHERE {_RAW} >= {T_REF}e0)")
def anti_similar(spark, d):
    return dedup.unlike_index(_docs(spark, d), "id", _items(spark, d), "id", T_REF).select(F.col("id").alias("doc_id"))


@query(f"WITH d AS (SELECT doc_id AS id, text FROM documents), {encode_cte('d')} SELECT min(id) AS first_id, count(*) AS members FROM enc GROUP BY {', '.join(PLANES)} HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    return joins.exact_groups(_docs(spark, d), "id")


# greedy deduplication

T_SCAN = 0.66
_SCAN_WHERE = f"a.id < b.id AND {_RAW} >= {T_SCAN}e0"
SCAN_CTE = f"""{ENC}, edges AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {_RAW} AS x FROM enc a JOIN enc b ON {_SCAN_WHERE}),
near AS MATERIALIZED (SELECT j, list(i) AS before, row_number() OVER (ORDER BY j) AS n FROM edges GROUP BY j),
walk(n, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT near.n, CASE WHEN len(list_filter(near.before, lambda e: NOT list_contains(walk.gone, e))) > 0 THEN list_append(walk.gone, near.j) ELSE walk.gone END FROM walk JOIN near ON near.n = walk.n + 1),
dropped AS MATERIALIZED (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY n DESC LIMIT 1)),
found AS MATERIALIZED (SELECT j AS id, i AS match_id, x FROM edges WHERE j IN (SELECT id FROM dropped) AND i NOT IN (SELECT id FROM dropped) QUALIFY row_number() OVER (PARTITION BY j ORDER BY x DESC, i) = 1),
scan AS MATERIALIZED (SELECT enc.id, match_id IS NOT NULL AS is_duplicate, match_id, x FROM enc LEFT JOIN found USING (id))"""


@query(f"{SCAN_CTE} SELECT id, is_duplicate, match_id, round(x, 6) AS similarity FROM scan")
def scan_dedup(spark, d):
    found = dedup.scan(store(_enc(spark, d), "turns"), "id", T_SCAN)
    return found.select("id", "is_duplicate", "match_id", F.round("similarity", 6).alias("similarity"))


@query(f"{SCAN_CTE}, best AS (SELECT a.id, max({_RAW}) AS x FROM enc a JOIN enc b ON b.id < a.id JOIN scan s ON s.id = b.id AND NOT s.is_duplicate GROUP BY a.id) SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_duplicate) AS kept, count(*) FILTER (WHERE is_duplicate) AS duplicates, count(DISTINCT match_id) AS clusters, (SELECT round(avg(x), 6) FROM best) AS mean_similarity, (SELECT round(max(x), 6) FROM best) AS max_similarity, round(count(*) FILTER (WHERE is_duplicate) / count(*), 6) AS duplicate_rate FROM scan")
def scan_summary(spark, d):
    s = dedup.summary(store(_enc(spark, d), "turns"), "id", T_SCAN)
    rounded = ("mean_similarity", "max_similarity", "duplicate_rate")
    return s.select("total", "kept", "duplicates", "clusters", *(F.round(c, 6).alias(c) for c in rounded))


@query(f"{SCAN_CTE} SELECT match_id AS canonical, count(*) AS duplicates FROM scan WHERE is_duplicate GROUP BY match_id")
def scan_clusters(spark, d):
    found = dedup.scan(store(_enc(spark, d), "turns"), "id", T_SCAN)
    return found.where("is_duplicate").groupBy(F.col("match_id").alias("canonical")).agg(F.count("*").alias("duplicates"))


@query(f"{DOCREF}, hit AS (SELECT a.id, b.id AS ref_id, {_RAW} AS x FROM enc a JOIN ref b ON {_RAW} >= {T_REF}e0) SELECT b.id, false AS is_new, 'index' AS origin FROM ref b UNION ALL SELECT e.id, true, 'batch' FROM enc e WHERE e.id NOT IN (SELECT id FROM hit) AND e.id IN (SELECT min(id) FROM enc WHERE id NOT IN (SELECT id FROM hit) GROUP BY {', '.join(PLANES)})")
def append_index(spark, d):
    """Documents unlike the benchmark join its index, copies (similarity 1) once."""
    docs, items = store(_docs(spark, d), "docs"), _items(spark, d)
    fresh = dedup.unlike_index(docs, "id", items, "id", T_REF)
    first = docs.join(fresh, "id", "left_semi").groupBy(*PLANES).agg(F.min("id").alias("id"))
    new = first.select("id", F.lit(True).alias("is_new"), F.lit("batch").alias("origin"))
    return items.select("id", F.lit(False).alias("is_new"), F.lit("index").alias("origin")).unionByName(new)


@query(f"""{ENC}, link AS MATERIALIZED (SELECT b.id, a.id AS up FROM enc a JOIN enc b ON {_SCAN_WHERE} QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY {_RAW} DESC, a.id) = 1),
climb(id, up) AS (SELECT id, up FROM link UNION ALL SELECT climb.id, link.up FROM climb JOIN link ON climb.up = link.id)
SELECT min(up) AS canonical, id AS member FROM climb GROUP BY id""")
def dedup_clusters(spark, d):
    found = dedup.clusters(store(_enc(spark, d), "turns"), "id", T_SCAN)
    return found.select("canonical", F.explode("members").alias("member"))


# routing

_TRIT = "CAST(((p{c} >> i) & 1) + 2 * ((q{c} >> i) & 1) AS BIGINT)"
_INIT = [2166136261 ^ (c * 2654435769 & 0xFFFFFFFF) for c in range(4)]


def _band_sql(enc: str, probes: tuple[int, ...], name: str) -> str:
    parts = []
    for k, p in enumerate((None, *probes)):
        for c in range(4):
            v = _TRIT.format(c=c) if p is None else f"CASE WHEN i = {p} THEN ({_TRIT.format(c=c)} + 1) % 3 ELSE {_TRIT.format(c=c)} END"
            parts.append(f"SELECT id, {c} AS band, (list_reduce(list_prepend({_INIT[c]}::BIGINT, list_transform(range(60), lambda i: {v})), lambda h, x: (xor(h, x) * 16777619) & 4294967295) % 4096)::INTEGER AS bucket, {k} AS probe FROM {enc}")
    return f"{name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_BALANCED = (0, 15, 30)
BANDS = f"{ENC}, {_band_sql('enc', _BALANCED, 'ask')}, have AS (SELECT id AS ref_id, band, bucket FROM ask WHERE probe = 0)"
CAND = f"{BANDS}, firsts AS (SELECT id, ref_id, min(band * 10 + probe) AS place FROM ask JOIN have USING (band, bucket) GROUP BY ALL), cand AS MATERIALIZED (SELECT id, ref_id FROM firsts QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, ref_id) <= 500)"


@query(f"{BANDS} SELECT id, band::INTEGER AS band, bucket, probe::INTEGER AS probe FROM ask")
def band_keys(spark, d):
    return route.band_keys(_enc(spark, d), "id", _BALANCED)


@query(f"{CAND} SELECT id, ref_id FROM cand")
def route_candidates(spark, d):
    e = store(_enc(spark, d), "turns")
    return route.candidates(e, "id", e, "id")


@query(f"{CAND}, s AS (SELECT a.id, b.id AS ref_id, {_RAW} AS x FROM cand JOIN enc a ON a.id = cand.id JOIN enc b ON b.id = cand.ref_id) SELECT id, x >= {T_PAIR}e0 AS is_duplicate, ref_id AS match_id, round(x, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, ref_id) = 1")
def route_query(spark, d):
    e = store(_enc(spark, d), "turns")
    found = route.nearest_routed(e, "id", e, "id")
    return found.select("id", (F.col("similarity") >= T_PAIR).alias("is_duplicate"), "match_id", F.round("similarity", 6).alias("similarity"))


@query(f"{CAND}, n AS (SELECT id, count(*) AS k FROM cand GROUP BY id), t AS (SELECT count(*) AS total FROM enc) SELECT enc.id, CASE WHEN total < 500 THEN total ELSE coalesce(k, 0) END::BIGINT AS candidates_checked, total::BIGINT AS total_entries, round(CASE WHEN total < 500 THEN total ELSE coalesce(k, 0) END / total, 6) AS candidate_ratio, 'balanced' AS recall_mode FROM enc LEFT JOIN n USING (id), t")
def route_stats(spark, d):
    e = store(_enc(spark, d), "turns")
    rows = route.query_stats(e, "id", e, "id")
    return rows.select("id", "candidates_checked", "total_entries", F.round("candidate_ratio", 6).alias("candidate_ratio"), "recall_mode")


@query(f"{BANDS}, full_ AS (SELECT b.band, g.bucket, count(have.ref_id) AS size FROM (VALUES (0), (1), (2), (3)) b(band) CROSS JOIN range(4096) g(bucket) LEFT JOIN have ON have.band = b.band AND have.bucket = g.bucket GROUP BY ALL) SELECT band::INTEGER AS band, round(avg(size), 6) AS mean_size, max(size) AS max_size, count(*) FILTER (WHERE size = 0) AS empty, list_sort(list(size))[{int(4096 * 0.95) + 1}] AS p95, list_sort(list(size))[{int(4096 * 0.99) + 1}] AS p99, count(*) FILTER (WHERE size = 1) AS n1, count(*) FILTER (WHERE size BETWEEN 2 AND 3) AS n2_3, count(*) FILTER (WHERE size BETWEEN 4 AND 7) AS n4_7, count(*) FILTER (WHERE size BETWEEN 8 AND 15) AS n8_15, count(*) FILTER (WHERE size >= 16) AS n16 FROM full_ GROUP BY band")
def bucket_health(spark, d):
    return route.bucket_health(_enc(spark, d), "id").withColumn("mean_size", F.round("mean_size", 6))


@query(f"{BANDS}, sz AS (SELECT count(*) AS size FROM have GROUP BY band, bucket), t AS (SELECT count(*) AS n FROM enc) SELECT n::BIGINT AS total_entries, count(*) AS occupied, round(avg(size), 6) AS mean_occupied, round(least(avg(size) * 16, 500, n), 6) AS expected_candidates, 'balanced' AS recall_mode FROM sz, t GROUP BY n")
def route_global_stats(spark, d):
    rows = route.global_stats(store(_enc(spark, d), "turns"), "id")
    return rows.select("total_entries", "occupied", F.round("mean_occupied", 6).alias("mean_occupied"), F.round("expected_candidates", 6).alias("expected_candidates"), "recall_mode")


@query(f"{CAND}, brute AS (SELECT DISTINCT unnest([a.id, b.id]) AS id FROM enc a JOIN enc b ON {_SCAN_WHERE}), hit AS (SELECT DISTINCT a.id FROM cand JOIN enc a ON a.id = cand.id JOIN enc b ON b.id = cand.ref_id WHERE a.id <> b.id AND {_RAW} >= {T_SCAN}e0) SELECT count(*) AS brute_duplicates, count(hit.id) AS routed_duplicates, round(CASE WHEN count(*) > 0 THEN count(hit.id) / count(*) ELSE 1 END, 6) AS recall FROM brute LEFT JOIN hit USING (id)")
def route_recall(spark, d):
    return route.recall(store(_enc(spark, d), "turns"), "id", T_SCAN).withColumn("recall", F.round("recall", 6))


def _either(n: str, a: str, b: str) -> str:
    """Candidates by routing, or all pairs where the index is small."""
    return f"cand AS MATERIALIZED (SELECT id, ref_id FROM firsts WHERE (SELECT count(*) FROM {n}) >= 500 QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, ref_id) <= 500 UNION ALL SELECT a.id, b.id FROM {a} a, {b} b WHERE (SELECT count(*) FROM {n}) < 500)"


@query(f"{DOCREF}, {_band_sql('ref', _BALANCED, 'ask')}, {_band_sql('enc', (), 'have_')}, have AS (SELECT id AS ref_id, band, bucket FROM have_), firsts AS (SELECT id, ref_id, min(band * 10 + probe) AS place FROM ask JOIN have USING (band, bucket) GROUP BY ALL), {_either('enc', 'ref', 'enc')}, routed AS (SELECT c.id, max({_RAW}) AS x, count(*) AS n FROM cand c JOIN ref a ON a.id = c.id JOIN enc b ON b.id = c.ref_id GROUP BY c.id), brute AS (SELECT a.id, max({_RAW}) AS x FROM ref a, enc b GROUP BY a.id), r AS (SELECT brute.x >= {T_REF}e0 AS hit, coalesce(routed.x, 0) >= {T_REF}e0 AS found, coalesce(n, 0) AS n FROM brute LEFT JOIN routed USING (id)), q AS (SELECT count(*) AS queries, count(*) FILTER (WHERE hit) AS brute_matches, count(*) FILTER (WHERE hit AND found) AS routed_matches, avg(n) AS avg_candidates, avg((n >= 500)::INTEGER) AS overflow_rate FROM r), s AS (SELECT *, CASE WHEN brute_matches > 0 THEN routed_matches / brute_matches ELSE 1 END AS recall, (SELECT max(k) FROM (SELECT count(*) AS k FROM have GROUP BY band, bucket)) / ((SELECT count(*) FROM enc) / 4096) AS bucket_skew FROM q) SELECT (SELECT count(*) FROM enc) AS corpus_size, queries, 'balanced' AS recall_mode, brute_matches, routed_matches, round(recall, 6) AS recall, round(avg_candidates, 6) AS avg_candidates, round(overflow_rate, 6) AS overflow_rate, round(bucket_skew, 6) AS bucket_skew, CASE WHEN recall >= 0.99 AND overflow_rate < 0.05 THEN 'PASS' WHEN recall >= 0.95 OR overflow_rate < 0.1 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM s")
def route_report(spark, d):
    out = route.recall_report(store(_docs(spark, d), "docs"), "id", store(_items(spark, d), "items"), "id", T_REF)
    rounded = ("recall", "avg_candidates", "overflow_rate", "bucket_skew")
    return out.select(*(F.round(c, 6).alias(c) if c in rounded else c for c in out.columns))


@query(f"{DOCREF} SELECT b.id AS item_id, a.id AS doc_id, round({S.flat_cosine('a.', 'b.')}, 6) AS similarity FROM enc a, ref b")
def similarity_vector(spark, d):
    """The flat similarity of every benchmark item and every document."""
    found = joins.scored(_docs(spark, d), "id", _items(spark, d), "id", S.flat_cosine("a.", "b."))
    return found.select(F.col("ref_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


# corpus weights

_DF = " UNION ALL ".join(f"SELECT {c * 60} + i AS channel, sum(((p{c} | q{c}) >> i) & 1) AS df, count(*) AS n FROM {{enc}}, range(60) r(i) GROUP BY i" for c in range(4))
WEIGHTS = f"{BOTH}, freq AS ({_DF.format(enc='enc')}), lg AS (SELECT *, log2(n / (1 + df)::DOUBLE) AS raw FROM freq), wt AS MATERIALIZED (SELECT channel, df, n, CASE WHEN max(raw) OVER () <= 0 THEN 1.0 ELSE greatest(raw / max(raw) OVER (), 0.01) END::DOUBLE AS weight FROM lg)"
_LONG_TWO = "long AS MATERIALIZED (SELECT id, channel, value FROM (" + _CHANNEL_SQL + ") WHERE value > 0)"
PAIR_W = f"""{WEIGHTS}, {_LONG_TWO},
num AS (SELECT two.sid, a.channel // 60 AS c, sum(weight * a.value * b.value) AS ab FROM two JOIN long a ON a.id = two.sid JOIN long b ON b.id = two.id_b AND a.channel = b.channel JOIN wt ON wt.channel = a.channel GROUP BY ALL),
sq AS MATERIALIZED (SELECT id, long.channel // 60 AS c, sum(weight * value * value) AS s FROM long JOIN wt USING (channel) GROUP BY ALL),
parts AS (SELECT two.sid, g.c, coalesce(ab, 0) AS ab, coalesce(sa.s, 0) AS sa, coalesce(sb.s, 0) AS sb FROM two CROSS JOIN range(4) g(c) LEFT JOIN num ON num.sid = two.sid AND num.c = g.c LEFT JOIN sq sa ON sa.id = two.sid AND sa.c = g.c LEFT JOIN sq sb ON sb.id = two.id_b AND sb.c = g.c),
sims AS (SELECT sid AS id, CASE WHEN sqrt(sum(sa)) * sqrt(sum(sb)) < 1e-12 THEN 0 ELSE least(sum(ab) / (sqrt(sum(sa)) * sqrt(sum(sb))), 1) END AS flat,
  sum([0.5, 0.5, 0.7, 1.0][c + 1]::DOUBLE * CASE WHEN sqrt(sa) * sqrt(sb) < 1e-12 THEN 0 ELSE least(ab / (sqrt(sa) * sqrt(sb)), 1) END) / 2.7e0 AS lens FROM parts GROUP BY sid)"""


@query(f"{WEIGHTS} SELECT channel::INTEGER AS channel, df::BIGINT AS df, n::BIGINT AS n, round(weight, 6) AS weight FROM wt")
def csidf_weights(spark, d):
    return csidf.weights(csidf.document_frequency(_enc(spark, d))).withColumn("weight", F.round("weight", 6))


@query(f"{DOCREF}, merged AS (SELECT * FROM enc UNION ALL SELECT * FROM ref), freq AS ({_DF.format(enc="merged")}) SELECT channel::INTEGER AS channel, df::BIGINT AS df, n::BIGINT AS n FROM freq")
def csidf_merge(spark, d):
    return csidf.merge(csidf.document_frequency(_docs(spark, d)), csidf.document_frequency(_items(spark, d)))


def _weighted_steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = store(_enc(spark, d), "turns")
    freq = csidf.document_frequency(e)
    w = csidf.collect_weights(freq)
    two = e.alias("a").join(e.alias("b"), F.expr("a.conv_id = b.conv_id AND b.turn = a.turn + 1"))
    two = two.select(F.col("a.id").alias("id"), *(F.col(f"a.{p}") for p in PLANES), *(F.col(f"b.{p}").alias(f"{p}_b") for p in PLANES))
    return csidf.score_pairs(csidf.score_pairs(two, w, None, name="flat"), w, "dedup", name="lens"), freq


@query(f"{PAIR_W} SELECT id, round(flat, 6) AS flat, round(lens, 6) AS lens FROM sims")
def csidf_pairs(spark, d):
    return _weighted_steps(spark, d)[0].select("id", F.round("flat", 6).alias("flat"), F.round("lens", 6).alias("lens"))


@query(f"{PAIR_W} SELECT round(min(flat), 6) AS min_similarity, round(avg(flat), 6) AS mean_similarity, round(max(flat), 6) AS max_similarity, (SELECT count(*) FROM wt WHERE weight < 0.5) AS low_channels FROM sims")
def noise_floor(spark, d):
    scored, freq = _weighted_steps(spark, d)
    out = csidf.noise_floor(scored, freq, "flat")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns[:3]), "low_channels")


_CAND_W = CAND.split("cand AS MATERIALIZED")[0] + _either("enc", "enc", "enc")


@query(f"""{_CAND_W}, {WEIGHTS.split(ENC + ', ')[1].split(', ', 1)[1].split('two AS (SELECT s.id AS sid, s.id_b FROM steps s), ')[-1]}, {_LONG_TWO},
num AS (SELECT cand.id, ref_id, a.channel // 60 AS c, sum(weight * a.value * b.value) AS ab FROM cand JOIN long a ON a.id = cand.id JOIN long b ON b.id = ref_id AND a.channel = b.channel JOIN wt ON wt.channel = a.channel GROUP BY ALL),
sq AS MATERIALIZED (SELECT id, long.channel // 60 AS c, sum(weight * value * value) AS s FROM long JOIN wt USING (channel) GROUP BY ALL),
sims AS (SELECT cand.id, cand.ref_id, sum([0.5, 0.5, 0.7, 1.0][g.c + 1]::DOUBLE * CASE WHEN sqrt(coalesce(sa.s, 0)) * sqrt(coalesce(sb.s, 0)) < 1e-12 THEN 0 ELSE least(coalesce(ab, 0) / (sqrt(sa.s) * sqrt(sb.s)), 1) END) / 2.7e0 AS x FROM cand CROSS JOIN range(4) g(c) LEFT JOIN num ON num.id = cand.id AND num.ref_id = cand.ref_id AND num.c = g.c LEFT JOIN sq sa ON sa.id = cand.id AND sa.c = g.c LEFT JOIN sq sb ON sb.id = cand.ref_id AND sb.c = g.c GROUP BY ALL)
SELECT id, round(max(x), 6) >= {T_PAIR}e0 AS is_duplicate, round(max(x), 6) AS similarity FROM sims GROUP BY id""")
def route_weighted(spark, d):
    """The best weighted similarity among routed candidates; which of equal ones it is hangs on the last digit."""
    e = store(_enc(spark, d), "turns")
    found = route.query_weighted(e, "id", e, "id", csidf.collect_weights(csidf.document_frequency(e)), T_PAIR)
    best = F.round("similarity", 6)
    return found.select("id", (best >= T_PAIR).alias("is_duplicate"), best.alias("similarity"))


# fields

_FIELDS = fields.FieldConfig(("title", "body"), (1.0, 0.8), "body")
_FIELD_COLS = {"title": "url", "body": "html"}
FIELD_CTE = f"WITH {encode_cte('pages', 'page_id', 'url', 'e0')}, {encode_cte('pages', 'page_id', 'html', 'e1')}, enc AS (SELECT e0.id, {', '.join(f'e{i}.{n} AS {n}_{i}' for i in (0, 1) for n in (*PLANES, 's0', 's1', 's2', 's3'))} FROM e0 JOIN e1 USING (id))"
_FC, _FCI = fields.field_cosine(_FIELDS), fields.field_cosine(_FIELDS, idf=True)
T_FIELD = 0.66


def _pages(spark: SparkSession, d: str) -> DataFrame:
    enc = fields.encode_fields(_table(spark, d, "pages").select("page_id", "url", "html"), _FIELDS, _FIELD_COLS)
    return store(fields.field_vectors(enc, _FIELDS, "page_id"), "pages")


def _field_pairs(spark: SparkSession, d: str, expr: str, t: float, idf: bool = False) -> DataFrame:
    both = tiles.likely_pairs(_pages(spark, d), fields.measure(_FIELDS, idf), t).where(f"a.id <> b.id AND {expr} >= {t}e0")
    return both.select(F.least("a.id", "b.id").alias("i"), F.greatest("a.id", "b.id").alias("j"), F.expr(f"round({expr}, 6)").alias("similarity"))


@query(f"{FIELD_CTE} SELECT a.id AS i, b.id AS j, round({_FC}, 6) AS similarity FROM enc a JOIN enc b ON a.id < b.id AND {_FC} >= {T_FIELD}e0")
def field_pairs(spark, d):
    return _field_pairs(spark, d, _FC, T_FIELD)


@query(f"{FIELD_CTE} SELECT a.id AS i, b.id AS j, round({_FCI}, 6) AS similarity FROM enc a JOIN enc b ON a.id < b.id AND {_FCI} >= 0.7e0")
def field_pairs_idf(spark, d):
    return _field_pairs(spark, d, _FCI, 0.7, idf=True)


@query(f"{FIELD_CTE}, s AS (SELECT a.id, b.id AS match_id, {_FC} AS x FROM enc a JOIN enc b ON a.id <> b.id) SELECT id, match_id, round(x, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, match_id) = 1")
def field_nearest(spark, d):
    e = _pages(spark, d)
    both = tiles.likely_best(e, e, fields.measure(_FIELDS), "other")
    found = joins.best(both.select(F.col("a.id").alias("id"), F.col("b.id").alias("ref_id"), F.expr(_FC).alias("similarity")))
    return found.withColumn("similarity", F.round("similarity", 6))


_DOC_FIELDS = fields.FieldConfig(("title", "body"), (0.5, 1.0), "body")
_DF2 = fields.field_cosine(_DOC_FIELDS)
_DOC_CTE = f"WITH t AS (SELECT doc_id, lang || ' ' || source AS title, text FROM documents), {encode_cte('t', 'doc_id', 'title', 'e0')}, {encode_cte('t', 'doc_id', 'text', 'e1')}, enc AS (SELECT e0.id, {', '.join(f'e{i}.{n} AS {n}_{i}' for i in (0, 1) for n in (*PLANES, 's0', 's1', 's2', 's3'))} FROM e0 JOIN e1 USING (id))"


@query(f"{_DOC_CTE}, {_band_sql('e1', _BALANCED, 'ask')}, have AS (SELECT id AS ref_id, band, bucket FROM ask WHERE probe = 0), firsts AS (SELECT id, ref_id, min(band * 10 + probe) AS place FROM ask JOIN have USING (band, bucket) GROUP BY ALL), {_either('enc', 'enc', 'enc')}, s AS (SELECT a.id, b.id AS ref_id, {_DF2} AS x FROM cand JOIN enc a ON a.id = cand.id JOIN enc b ON b.id = cand.ref_id) SELECT id, x >= {T_FIELD}e0 AS is_duplicate, ref_id AS match_id, round(x, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, ref_id) = 1")
def field_routed(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("title"), "text")
    enc = fields.encode_fields(rows, _DOC_FIELDS, {"title": "title", "body": "text"})
    e = store(fields.field_vectors(enc, _DOC_FIELDS, "doc_id"), "fields")
    return fields.nearest_routed(e, "id", e, "id", _DOC_FIELDS, T_FIELD).withColumn("similarity", F.round("similarity", 6))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return _table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id, text AS body, source AS tag FROM documents")
def field_extraction(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("source").alias("id"), "text")).alias("line"))
    return fields.from_json(rows, fields.FieldConfig(), "line").select("doc_id", "body", "tag")


# second stage

_GATE = stage2.Model(stage2.random_projection(42), "diagonal")


def _gate_sql() -> dict[str, str]:
    gate = stage2.majority([w.diagonal() for w in _GATE.projection])
    mask = lambda v, c: sum(1 << i for i in range(60) if gate[60 * c + i] == v)
    out = {}
    for c in range(4):
        out[f"p{c}"] = f"(p{c} & {mask(2, c)}) | (q{c} & {mask(1, c)}) | {mask(0, c)}"
        out[f"q{c}"] = f"(q{c} & {mask(2, c)}) | (p{c} & {mask(1, c)})"
    return out


GATED = ", ".join(f"({x})::BIGINT AS {n}" for n, x in _gate_sql().items())


@query(f"{ENC} SELECT id, {GATED} FROM enc")
def diagonal_gate(spark, d):
    planes = stage2.gate_planes(_GATE)
    return _enc(spark, d).select("id", *(planes[p].alias(p) for p in sorted(planes)))


@query(f"{ENC} SELECT id, {GATED} FROM enc")
def diagonal_projection(spark, d):
    out = stage2.add_stage2(_enc(spark, d), _GATE)
    return out.select("id", *(F.col(f"{p}_s2").alias(p) for p in PLANES))


def _projected(mode: str, weights) -> Query:
    def run(spark, d):
        out = stage2.add_stage2(_enc(spark, d), stage2.Model(weights(), mode))
        return out.select("id", *(F.col(f"{p}_s2").alias(p) for p in PLANES))

    return run


def _projection_sql(mode: str, w) -> str:
    """Dot products with the weights' rows, written out as digits; the votes of three copies; planes from channels."""
    value = {"mod3": "v::BIGINT", "block": "v::BIGINT", "sign": "v::BIGINT - 1", "sparse": "CASE v WHEN '2' THEN 1 WHEN '1' THEN -1 ELSE 0 END"}[mode]
    shift = 0 if mode in ("mod3", "block") else 1
    size = 60 if mode == "block" else 240
    digits = ", ".join(f"'{''.join(map(str, row))}'" for row in w.reshape(-1, size).tolist())
    dot = "list_dot_product(x.v, w.v)"
    vote = f"({dot}::BIGINT % 3)" if not shift else f"(sign({dot})::BIGINT + 1)"
    chans = "(" + " || ".join(f"list_transform(range(60), lambda i: ({_TRIT.format(c=c)} - {shift})::DOUBLE)" for c in range(4)) + ")"
    slices = f"SELECT id, c, {chans}[c * 60 + 1 : c * 60 + 60] AS v FROM enc, range(4) g(c)" if mode == "block" else f"SELECT id, 0 AS c, {chans} AS v FROM enc"
    planes = ", ".join(f"sum(CASE WHEN ch // 60 = {c} AND val = {n} THEN 1::BIGINT << (ch % 60)::INTEGER ELSE 0 END)::BIGINT AS {p}{c}" for p, n in (("p", 1), ("q", 2)) for c in range(4))
    return f"""{ENC}, lines AS (SELECT unnest([{digits}]) AS d, unnest(range({len(w.reshape(-1, size))})) AS r),
    w AS MATERIALIZED (SELECT r // 240 AS k, r % 240 AS ch, {'(r % 240) // 60' if mode == 'block' else '0'} AS c, list_transform(string_split(d, ''), lambda v: ({value})::DOUBLE) AS v FROM lines),
    x AS MATERIALIZED ({slices}),
    votes AS (SELECT id, ch, max(CASE WHEN k = 0 THEN {vote} END) AS a, max(CASE WHEN k = 1 THEN {vote} END) AS b, max(CASE WHEN k = 2 THEN {vote} END) AS d FROM x JOIN w USING (c) GROUP BY id, ch),
    chosen AS (SELECT id, ch, CASE WHEN b = d AND a <> b THEN b ELSE a END AS val FROM votes)
    SELECT id, {planes} FROM chosen GROUP BY id"""


for _name, _mode, _weights in (
    ("mod3_projection", "mod3", lambda: stage2.random_projection(42)),
    ("sign_projection", "sign", lambda: stage2.random_projection(42)),
    ("sparse_projection", "sparse", lambda: stage2.random_projection(42)),
    ("block_projection", "block", lambda: stage2.random_blocks(42)),
):
    QUERIES[_name] = _projected(_mode, _weights)
    ORACLE_SQL[_name] = _projection_sql(_mode, _weights())


@query()
def cascade_depths(spark, d):
    return stage2.encode_depths(store(_enc(spark, d), "turns"), "id", stage2.Model.random(512, 7), 3)


_HEB = stage2.HebbianConfig(threshold=0.6, weighted=True)
_WEIGHT = f"CASE WHEN {S.lens_cosine('a.', 'b.', 'uniform')} > 0.6e0 THEN 1 + floor(({S.lens_cosine('a.', 'b.', 'uniform')} - 0.6e0) * 10) ELSE -(1 + floor((0.6e0 - {S.lens_cosine('a.', 'b.', 'uniform')}) * 3)) END"


def _training(spark: SparkSession, d: str) -> DataFrame:
    rows = _steps(spark, d).select(F.col("a.id").alias("id"), F.expr(S.lens_cosine("a.", "b.", "uniform")).alias("s"), *(F.col(f"a.{p}") for p in PLANES), *(F.col(f"b.{p}").alias(f"{p}_b") for p in PLANES))
    return rows.withColumn("w", stage2.signed_magnitude(F.col("s"), _HEB))


_CELL = lambda x, c: f"(((({x}p{c} >> i) & 1) + 2 * (({x}q{c} >> i) & 1)) - 1)"
HEBB = f"{BOTH}, wp AS MATERIALIZED (SELECT a.id AS aid, b.id AS bid, ({_WEIGHT})::BIGINT AS w {FROM_TWO}), diag AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {c * 60} + i AS i, sum(w * {_CELL("b.", c)} * {_CELL("a.", c)})::BIGINT AS counter FROM wp JOIN enc a ON a.id = aid JOIN enc b ON b.id = bid, range(60) r(i) GROUP BY r.i' for c in range(4))})"


@query(f"{HEBB} SELECT i::INTEGER AS i, counter FROM diag")
def hebbian_diagonal(spark, d):
    return stage2.accumulate(_training(spark, d), "w").where("i = j").select("i", "counter")


_CHAN = f"chan AS MATERIALIZED (SELECT id, channel, (value - 1)::BIGINT AS v FROM ({_CHANNEL_SQL}))"
FULL = f"{BOTH}, wp AS MATERIALIZED (SELECT a.id AS aid, b.id AS bid, ({_WEIGHT})::BIGINT AS w {FROM_TWO}), {_CHAN}, acc AS MATERIALIZED (SELECT y.channel AS i, x.channel AS j, sum(w * y.v * x.v)::BIGINT AS counter FROM wp JOIN chan x ON x.id = aid JOIN chan y ON y.id = bid GROUP BY ALL), lim AS (SELECT floor(count(*) * 0.15) AS most FROM acc), cut AS (SELECT min(t) AS t FROM (SELECT DISTINCT abs(counter) AS t FROM acc UNION SELECT 0) c, lim WHERE (SELECT count(*) FROM acc WHERE abs(counter) > c.t) <= most)"


@query(f"{FULL} SELECT i::INTEGER AS i, j::INTEGER AS j, counter FROM acc")
def hebbian_full(spark, d):
    return stage2.accumulate(_training(spark, d), "w").select("i", "j", "counter")


@query(f"{FULL} SELECT max(abs(counter)) AS max_abs, count(*) FILTER (WHERE counter > 0) AS positive, count(*) FILTER (WHERE counter < 0) AS negative, count(*) FILTER (WHERE counter = 0) AS zero, 0::BIGINT AS saturated FROM acc")
def accumulator_stats(spark, d):
    return stage2.accumulator_stats(stage2.accumulate(_training(spark, d), "w"))


@query(f"{FULL} SELECT t AS threshold FROM cut")
def auto_threshold(spark, d):
    return stage2.auto_threshold(store(stage2.accumulate(_training(spark, d), "w"), "counters"), 0.15)


@query(f"{FULL} SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN counter > t THEN 2 WHEN counter < -t THEN 1 ELSE 0 END::INTEGER AS weight FROM acc, cut")
def freeze_density(spark, d):
    acc = store(stage2.accumulate(_training(spark, d), "w"), "counters")
    cut = stage2.auto_threshold(acc, 0.15)
    return stage2.freeze(acc.crossJoin(F.broadcast(cut)), F.col("threshold"))


@query(f"{FULL}, r AS (SELECT i, j, counter, row_number() OVER (PARTITION BY i ORDER BY abs(counter) DESC, j) AS n FROM acc) SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN n > 8 OR counter = 0 THEN 0 WHEN counter > 0 THEN 2 ELSE 1 END::INTEGER AS weight FROM r")
def sparse_freeze(spark, d):
    return stage2.freeze_sparse(stage2.accumulate(_training(spark, d), "w"), 8)


_NORM_SQL = ", ".join(f"sqrt({S.norm2('', c)}::DOUBLE) AS s{c}" for c in range(4))
G2 = f"{BOTH}, g AS MATERIALIZED (SELECT *, {_NORM_SQL} FROM (SELECT id, {GATED} FROM enc))"
_FROM4 = f"{FROM_TWO} JOIN g x ON x.id = a.id JOIN g y ON y.id = b.id"
_BUCKETS = (0.5, 0.4, 0.6, 0.3, 0.7, 0.5, 0.2, 0.8, 0.9, 1.0)
_BLEND = {
    "linear": S.linear_blend("a.", "b.", "x.", "y."),
    "s2_centered": S.centered_cosine("x.", "y."),
    "gated": S.centered_cosine("a.", "b.", masks=_GATE.gate_masks()),
    "chain_blend": S.chain_blend("a.", "b.", "x.", "y.", (0.6, 0.5, 0.7, 0.8)),
    "adaptive": S.adaptive_blend("a.", "b.", "x.", "y.", _BUCKETS),
}


@query(f"{G2} SELECT two.sid AS id, {', '.join(f'round({x}, 6) AS {n}' for n, x in _BLEND.items())} {_FROM4}")
def stage2_blends(spark, d):
    e = store(_enc(spark, d), "turns")
    planes = stage2.gate_planes(_GATE)
    g = with_norms(e.select("id", *(planes[p].alias(p) for p in sorted(planes))))
    two = e.alias("a").join(e.alias("b"), F.expr("a.conv_id = b.conv_id AND b.turn = a.turn + 1"))
    four = two.join(g.alias("x"), F.expr("x.id = a.id")).join(g.alias("y"), F.expr("y.id = b.id"))
    return four.select(F.col("a.id").alias("id"), *(F.expr(f"round({x}, 6)").alias(n) for n, x in _BLEND.items()))


# cells


@query("WITH p AS (SELECT p_partkey, p_partkey % 7 AS cell, p_partkey // 7 % 6 AS domain, p_partkey // 42 % 3 AS state, p_partkey % 12 AS tick FROM part), t AS (SELECT *, CASE domain WHEN 0 THEN tick % 3 WHEN 2 THEN tick % 2 WHEN 3 THEN 2 - tick % 3 WHEN 4 THEN tick % 2 ELSE 0 END AS trit FROM p) SELECT p_partkey, trit::INTEGER AS trit, state::INTEGER AS output, substr(CASE WHEN cell = 0 THEN '000' WHEN trit > 0 THEN '012' ELSE ['001', '010', '100', '012', '210', '120'][cell] END, state::INTEGER + 1, 1)::INTEGER AS state, CASE WHEN cell = 0 OR domain = 1 AND cell = 1 THEN 0 WHEN cell < 4 THEN 1 ELSE 2 END::INTEGER AS left_rank FROM t")
def cell_steps(spark, d):
    """One step of a cell of each kind, domain and state, and the rank that its signal leaves."""
    k = F.col("p_partkey")
    rows = _table(spark, d, "part").select(k, (k % 7).cast("int").alias("cell"), (F.floor(k / 7) % 6).cast("int").alias("domain"), (F.floor(k / 42) % 3).cast("int").alias("state"), (k % 12).cast("int").alias("tick"))
    quark = lambda n: F.element_at(F.array(*(F.lit(q[n]) for q in cells.QUARKS)), F.col("cell") + 1)
    rows = rows.withColumns({**{f"q{n}": quark(n) for n in range(3)}, **{f"o{n}": F.lit(cells.IDENTITY) for n in range(3)}, **{f"e{n}": F.lit(n) for n in range(3)}})
    rows = rows.withColumn("trit", cells.tape(F.col("domain"), F.col("tick")))
    left = cells.lowered_rank(F.lit(2), F.col("domain"), F.col("cell"))
    return cells.step(rows, F.col("trit")).select("p_partkey", "trit", "output", "state", left.alias("left_rank"))


# evaluation

_EVAL = {"s1": S.lens_cosine("a.", "b.", "uniform"), "s2": S.flat_cosine("a.", "b."), "gold": S.chain_cosine("a.", "b.", 3)}
EVAL = f"{BOTH}, ev AS MATERIALIZED (SELECT two.sid AS id, {', '.join(f'round({x}, 6) AS {n}' for n, x in _EVAL.items())} {FROM_TWO})"


def _rho_sql(x: str, y: str, src: str, by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    pp = f"PARTITION BY {by}, " if by else "PARTITION BY "
    cols = f"{by}, " if by else ""
    return f"(SELECT {cols}count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE 1 - 6 * sum(d * d) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END AS rho FROM (SELECT {cols}rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({pp}{x}) - 1) / 2.0 - rank() OVER ({p} ORDER BY {y}) - (count(*) OVER ({pp}{y}) - 1) / 2.0 AS d FROM {src}) {f'GROUP BY {by}' if by else ''})"


def _eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return store(_step_select(spark, d, **_EVAL), "scores")


@query(f"{EVAL} SELECT n, round(rho, 6) AS rho FROM {_rho_sql('s1', 'gold', 'ev')}")
def spearman_lens(spark, d):
    return evalmetrics.spearman(_eval_rows(spark, d), "s1", "gold").withColumn("rho", F.round("rho", 6))


_GRID = "grid AS (SELECT i / 20.0 AS alpha FROM range(21) r(i)), bl AS MATERIALIZED (SELECT alpha::DOUBLE AS alpha, round(alpha::DOUBLE * s1 + (1 - alpha::DOUBLE) * s2, 9) AS s, gold FROM ev, grid)"


@query(f"{EVAL}, {_GRID} SELECT alpha, n, round(rho, 6) AS rho FROM {_rho_sql('s', 'gold', 'bl', 'alpha')}")
def alpha_grid(spark, d):
    return evalmetrics.alpha_grid(_eval_rows(spark, d), "s1", "s2", "gold").withColumn("rho", F.round("rho", 6))


_TENTHS = "rows_ AS (SELECT *, floor(s1 * 10)::INTEGER AS bucket FROM ev WHERE s1 < 1), bl AS MATERIALIZED (SELECT bucket, alpha, round(alpha * s1 + (1 - alpha) * s2, 9) AS s, gold FROM rows_, (SELECT i / 10.0::DOUBLE AS alpha FROM range(11) r(i)))"


@query(f"{EVAL}, {_TENTHS}, rho AS {_rho_sql('s', 'gold', 'bl', 'bucket, alpha')}, best AS (SELECT bucket, CASE WHEN n < 3 THEN 0.5e0 ELSE alpha END AS alpha FROM rho QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY rho DESC, alpha) = 1) SELECT b::INTEGER AS bucket, coalesce(alpha, 0.5e0) AS alpha FROM range(10) g(b) LEFT JOIN best ON best.bucket = b")
def adaptive_alpha(spark, d):
    return evalmetrics.adaptive_alpha(_eval_rows(spark, d), "s1", "s2", "gold")


_SWEEP = [0.5 + 0.05 * i for i in range(9)]


@query(f"{EVAL}, t AS (SELECT unnest({[round(t, 2) for t in _SWEEP]})::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE s1 >= threshold AND gold >= 0.5) AS tp, count(*) FILTER (WHERE s1 >= threshold AND gold < 0.5) AS fp, count(*) FILTER (WHERE s1 < threshold AND gold >= 0.5) AS fn FROM ev, t GROUP BY threshold), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c) SELECT threshold, tp, fp, fn, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6)::DOUBLE AS f1 FROM r")
def f1_sweep(spark, d):
    rows = _eval_rows(spark, d).withColumn("actual", F.col("gold") >= 0.5)
    out = evalmetrics.threshold_sweep(rows, "s1", "actual", [round(t, 2) for t in _SWEEP])
    return out.select("threshold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"{ENC}, r AS (SELECT enc.*, conv_id, turn % 3 = 1 AS dup FROM enc JOIN turns USING (id)), best AS (SELECT a.id, a.conv_id, b.conv_id AS other, {_RAW} AS x FROM r a JOIN r b ON a.dup AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_RAW} DESC, b.id) = 1), cross_ AS MATERIALIZED (SELECT {_RAW} AS x FROM r a JOIN r b ON NOT a.dup AND NOT b.dup AND a.id < b.id AND a.conv_id <> b.conv_id AND {_RAW} >= 0.5e0), t AS (SELECT unnest({[round(t, 2) for t in _SWEEP]})::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE x >= threshold AND conv_id = other) AS tp, count(*) FILTER (WHERE x >= threshold AND conv_id <> other) + (SELECT count(*) FROM cross_ WHERE cross_.x >= threshold) AS fp, count(*) FILTER (WHERE x < threshold) AS fn FROM best, t GROUP BY threshold), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c) SELECT threshold, tp, fp, fn, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6)::DOUBLE AS f1 FROM p")
def dedup_sweep(spark, d):
    """Every third turn counts as a known duplicate, a conversation as a group."""
    e = store(_enc(spark, d).withColumn("dup", F.col("turn") % 3 == 1), "turns")
    out = evalmetrics.dedup_sweep(e, "id", "conv_id", "dup", [round(t, 2) for t in _SWEEP])
    return out.select("threshold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_LABEL = "CASE WHEN gold >= 0.6 THEN 'similar' WHEN gold >= 0.3 THEN 'neutral' ELSE 'dissimilar' END"


@query(f"{EVAL} SELECT {_LABEL} AS label, count(*) AS n, round(avg(abs(s1 - gold)), 6) AS mae FROM ev GROUP BY 1")
def mae_by_label(spark, d):
    rows = _eval_rows(spark, d).withColumn("label", readers.label_of(F.col("gold")))
    return evalmetrics.mean_absolute_error(rows, "s1", "gold", ("label",)).withColumn("mae", F.round("mae", 6))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r")
def split_stratified(spark, d):
    return evalmetrics.stratified_split(_table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


@query(f"{EVAL}, p AS (SELECT t.role AS source, t.text AS text_a, u.text AS text_b, gold AS score, CASE WHEN turn % 5 = 4 THEN 'other' WHEN gold >= 0.6 THEN 'similar' WHEN gold >= 0.3 THEN 'neutral' ELSE 'dissimilar' END AS label, t.turn FROM ev JOIN turns t USING (id) JOIN turns u ON u.conv_id = t.conv_id AND u.turn = t.turn + 1), q AS (SELECT source, text_a, CASE WHEN turn % 7 = 2 THEN '' ELSE text_b END AS text_b, CASE WHEN turn % 3 = 1 THEN score + 1 ELSE score END AS score, label FROM p) SELECT source, count(*) AS rows, count(*) FILTER (WHERE coalesce(text_a, '') = '' OR coalesce(text_b, '') = '') AS missing_text, count(*) FILTER (WHERE score IS NULL OR NOT score BETWEEN 0 AND 1) AS bad_score, count(*) FILTER (WHERE label IS NULL OR label NOT IN ('similar', 'neutral', 'dissimilar')) AS bad_label FROM q GROUP BY source".replace("(WHERE turn", "(WHERE t.turn").replace("CASE WHEN turn % 5", "CASE WHEN t.turn % 5"))
def validate_pairs(spark, d):
    t = _turns(spark, d)
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    rows = _eval_rows(spark, d).join(t, "id").join(nxt, ["conv_id", "turn"])
    # every third turn gets a score, every fifth a label and every seventh a text that the check must count
    text_b = F.when(F.col("turn") % 7 == 2, "").otherwise(F.col("text_b")).alias("text_b")
    score = F.when(F.col("turn") % 3 == 1, F.col("gold") + 1).otherwise(F.col("gold")).alias("score")
    label = F.when(F.col("turn") % 5 == 4, "other").otherwise(readers.label_of(F.col("gold"))).alias("label")
    return evalmetrics.validate_pairs(rows.select(F.col("text").alias("text_a"), text_b, score, label, F.col("role").alias("source")))


@query("WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source) SELECT source, round(n * (n - 1) / 2 * 1e-3, 6) AS remote_cost, round(0.4 + n * (n - 1) / 2 * 1e-6 + n * (n - 1) / 2 * (1 - 0.95::DOUBLE) * 1e-3, 6) AS mixed_cost FROM c")
def cost_model(spark, d):
    rows = _table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents")).withColumn("share_resolved", F.lit(0.95))
    out = evalmetrics.cost_model(rows)
    return out.select("source", F.round("remote_cost", 6).alias("remote_cost"), F.round("mixed_cost", 6).alias("mixed_cost"))


@query(f"SELECT i::INTEGER AS channel, round(CASE WHEN i >= 180 THEN 1.5e0 ELSE 1e0 END / (1 + substr('{''.join(_HITS)}', i::INTEGER + 1, 1)::INTEGER), 4) AS weight FROM range(240) r(i)")
def static_idf_table(spark, d):
    return spark.createDataFrame([(i, w) for i, w in enumerate(STATIC_IDF)], "channel int, weight double")
