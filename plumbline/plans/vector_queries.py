"""Vector queries over the embeddings table, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, quantize
from ..operators import aggregate, ann, cluster, collection, log, matching, search, workload

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label; vectors in double precision."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths 1 to 7, so that metrics that agree on unit vectors differ."""
    return members(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * (1 + F.col("id") % 7)))


def _with(df: DataFrame, vec) -> DataFrame:
    return df.withColumn("vec", vec(F.col("vec")))


def _few(df: DataFrame, n: int = 5) -> DataFrame:
    return df.filter(F.col("id") < n)


def _fixed(df: DataFrame) -> DataFrame:
    """The query set of the statement: every id divisible by 50."""
    return df.filter(F.col("id") % 50 == 0)


# SQL pieces ---------------------------------------------------------------------------------------------------------

V = "embedding::DOUBLE[]"
SCALED = "list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7))"
SIGN = "list_transform(embedding::DOUBLE[], lambda x: (x > 0)::INT)"
NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"
I8 = f"list_transform(embedding::DOUBLE[], lambda x: trunc(greatest(-127.0::DOUBLE, least(127.0::DOUBLE, x * 127 / {NORM})))::TINYINT)"
U8 = f"list_transform(embedding::DOUBLE[], lambda x: trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, x * 255 / {NORM})))::SMALLINT)"
_I = "range(1, len(v) + 1)"


def _s(body: str) -> str:
    return f"list_sum(list_transform({_I}, lambda i: {body}))"


DIST = {
    "ip": f"1 - {_s('v[i] * q[i]')}",
    "cos": f"1 - {_s('v[i] * q[i]')} / (sqrt({_s('q[i] * q[i]')}) * sqrt({_s('v[i] * v[i]')}))",
    "l2sq": _s("(v[i] - q[i]) * (v[i] - q[i])"),
    "pearson": f"1 - (len(v) * {_s('v[i] * q[i]')} - list_sum(v) * list_sum(q)) / sqrt((len(v) * {_s('q[i] * q[i]')} - list_sum(q) ** 2) * (len(v) * {_s('v[i] * v[i]')} - list_sum(v) ** 2))",
    "divergence": _s("q[i] * ln((q[i] + 1.1920928955078125e-07) / ((v[i] + q[i]) / 2 + 1.1920928955078125e-07)) + v[i] * ln((v[i] + 1.1920928955078125e-07) / ((v[i] + q[i]) / 2 + 1.1920928955078125e-07))") + " / 2",
    "hamming": _s("(v[i] <> q[i])::INT") + "::DOUBLE",
    "tanimoto": f"1 - {_s('v[i] * q[i]')}::DOUBLE / {_s('greatest(v[i], q[i])')}",
    "sorensen": f"1 - 2 * {_s('v[i] * q[i]')}::DOUBLE / (list_sum(v) + list_sum(q))",
    "int_cos": f"CASE WHEN {_s('v[i]::DOUBLE * q[i]')} <> 0 THEN 1 - {_s('v[i]::DOUBLE * q[i]')} / (sqrt({_s('v[i]::DOUBLE * v[i]')}) * sqrt({_s('q[i]::DOUBLE * q[i]')})) ELSE 0 END",
    "int_ip": f"1 - {_s('v[i]::DOUBLE * q[i]')}",
    "int_l2sq": _s("(v[i]::DOUBLE - q[i]) * (v[i]::DOUBLE - q[i])"),
}


def pairs_sql(dist: str, vec: str = V, members_if: str = "TRUE", queries_if: str = "vec_id < 5") -> str:
    return (
        f"c AS (SELECT vec_id AS id, {vec} AS v FROM embeddings WHERE {members_if}), p AS (SELECT vec_id AS qid, {vec} AS q FROM embeddings WHERE {queries_if}), "
        f"d AS (SELECT qid, id, round({dist}, 6) + 0.0 AS distance FROM p, c)"
    )


def ranked_sql(k: int) -> str:
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d), top AS (SELECT * FROM r WHERE rank <= {k})"


def topk_sql(dist: str, vec: str = V, k: int = 5, **where) -> str:
    return f"WITH {pairs_sql(dist, vec, **where)}, {ranked_sql(k)} SELECT qid, id, distance, rank FROM top"


# Distances ------------------------------------------------------------------------------------------------------------


def _topk(name: str, metric: str, sql: str, vec, base=members, kind: str = "f32"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _with(base(spark, sf_dir), vec)
        return search.search(rows, _few(rows), 5, metric, kind=kind, plan="expression")

    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _with(base(spark, sf_dir), vec)
        return search.search(rows, _fixed(rows), 5, metric, kind=kind)

    run.__name__, whole.__name__ = name, f"{name}_whole"
    query(sql)(run)
    query()(whole)


def _same(v):
    return v


def _to_double(f):
    return lambda v: f(v).cast("array<double>")


_ABS = "list_transform(embedding::DOUBLE[], lambda x: abs(x))"
_topk("ip_top5", "ip", topk_sql(DIST["ip"], SCALED), _same, scaled)
_topk("cos_top5", "cos", topk_sql(DIST["cos"], SCALED), _same, scaled)
_topk("l2sq_top5", "l2sq", topk_sql(DIST["l2sq"], SCALED), _same, scaled)
_topk("pearson_top5", "pearson", topk_sql(DIST["pearson"], SCALED), _same, scaled)
_topk("jsd_abs_top5", "divergence", topk_sql(DIST["divergence"], _ABS), lambda v: F.transform(v, F.abs))
_topk("hamming_sign_top5", "hamming", topk_sql(DIST["hamming"], SIGN), quantize.binarize)
_topk("tanimoto_sign", "tanimoto", topk_sql(DIST["tanimoto"], SIGN), quantize.binarize)
_topk("sorensen_sign", "sorensen", topk_sql(DIST["sorensen"], SIGN), quantize.binarize)
_topk("cos_i8_top5", "cos", topk_sql(DIST["int_cos"], I8), _to_double(quantize.quantize_i8), kind="i8")
_topk("l2sq_i8_top5", "l2sq", topk_sql(DIST["int_l2sq"], I8), _to_double(quantize.quantize_i8), kind="i8")
_topk("ip_i8_top5", "ip", topk_sql(DIST["int_ip"], I8), _to_double(quantize.quantize_i8), kind="i8")
_topk("cos_u8", "cos", topk_sql(DIST["int_cos"], U8), _to_double(quantize.quantize_u8), kind="u8")
_topk("l2sq_u8", "l2sq", topk_sql(DIST["int_l2sq"], U8), _to_double(quantize.quantize_u8), kind="u8")


@query(f"""WITH s AS (SELECT vec_id AS id, list_filter({_I.replace('v)', 'embedding)')}, lambda i: embedding[i] > 0) AS a FROM embeddings)
SELECT p.id AS qid, c.id AS id, round(1 - len(list_intersect(p.a, c.a))::DOUBLE / nullif(len(list_distinct(list_concat(p.a, c.a))), 0), 6) + 0.0 AS distance
FROM s p, s c WHERE p.id < 5""")
def jaccard_dims(spark, sf_dir):
    """Sets of the positive dimensions, of any sizes."""
    on = lambda v: F.filter(F.transform(v, lambda x, i: F.when(x > 0, i + 1)), lambda i: i.isNotNull())
    s = _with(members(spark, sf_dir), on)
    return search.pairwise(s, _few(s), metrics.jaccard_sets)


@query(f"""WITH {pairs_sql('2 * asin(sqrt(sin((radians(v[1]) - radians(q[1])) / 2) ** 2 + cos(radians(q[1])) * cos(radians(v[1])) * sin(radians(v[2] - q[2]) / 2) ** 2))',
 '[embedding[1]::DOUBLE * 90, embedding[2]::DOUBLE * 180]', queries_if='vec_id < 20')} SELECT qid, id, distance FROM d""")
def haversine_pairs(spark, sf_dir):
    rows = _with(members(spark, sf_dir), lambda v: F.array(v[0] * 90, v[1] * 180))
    return search.pairwise(rows, _few(rows, 20), "haversine")


@query("SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE), (2, 0.0, 1.0), (3, 0.0, -5.0)) t(id, cos, ip)")
def cos_zero_edges(spark, sf_dir):
    rows = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 2.0]), (2, [0.0, 0.0], [0.0, 0.0]), (3, [2.0, 0.0], [3.0, 0.0])], "id long, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    return rows.select("id", search.rounded(metrics.cosine(a, b)).alias("cos"), search.rounded(metrics.inner_product(a, b)).alias("ip"))


@query(f"WITH {pairs_sql(DIST['hamming'], SIGN)} SELECT qid, id, distance FROM d")
def hamming_packed(spark, sf_dir):
    rows = _with(members(spark, sf_dir), lambda v: quantize.pack_bits(quantize.binarize(v)))
    return search.pairwise(rows, _few(rows), metrics.packed_hamming)


@query(topk_sql(_s("abs(v[i] - q[i])")))
def custom_metric_top5(spark, sf_dir):
    """A user-defined metric (city block) given as a function of two Columns."""
    rows = members(spark, sf_dir)
    city = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return search.search(rows, _few(rows), 5, city, plan="expression")


# Storage kinds --------------------------------------------------------------------------------------------------------


def _exploded(df: DataFrame, kind: str) -> DataFrame:
    return df.select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.col("x").cast(kind).alias("x"))


def _exploded_sql(vec: str, kind: str) -> str:
    return f"WITH s AS (SELECT vec_id AS id, {vec} AS v FROM embeddings) SELECT id, (i - 1)::BIGINT AS pos, v[i]::{kind} AS x FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM s)"


@query(_exploded_sql(I8, "INT"))
def quantize_i8(spark, sf_dir):
    return _exploded(_with(members(spark, sf_dir), quantize.quantize_i8), "int")


@query(_exploded_sql(f"list_transform({I8}, lambda y: round(y::DOUBLE / 127, 6) + 0.0)", "DOUBLE"))
def dequantize_i8(spark, sf_dir):
    back = lambda v: F.transform(quantize.dequantize_i8(quantize.quantize_i8(v)), lambda x: search.rounded(x))
    return _exploded(_with(members(spark, sf_dir), back), "double")


@query(_exploded_sql(U8, "INT"))
def quantize_u8(spark, sf_dir):
    return _exploded(_with(members(spark, sf_dir), quantize.quantize_u8), "int")


@query(_exploded_sql(f"list_transform({U8}, lambda y: round(y::DOUBLE / 255, 6) + 0.0)", "DOUBLE"))
def dequantize_u8(spark, sf_dir):
    back = lambda v: F.transform(quantize.dequantize_u8(quantize.quantize_u8(v)), lambda x: search.rounded(x))
    return _exploded(_with(members(spark, sf_dir), back), "double")


@query(_exploded_sql(SIGN, "INT"))
def binarize(spark, sf_dir):
    return _exploded(_with(members(spark, sf_dir), lambda v: quantize.unbinarize(quantize.binarize(v))), "int")


@query()
def low_precision_round_trips(spark, sf_dir):
    """Mean absolute error of each storage kind after a round trip."""
    rows = members(spark, sf_dir)
    error = lambda k: F.aggregate(F.zip_with("vec", quantize.stored_as(F.col("vec"), k), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    kinds = ["f16", "bf16", "e5m2", "e4m3", "e3m2", "e2m3", "i8", "u8", "b1"]
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), error(k).alias("error")) for k in kinds])).alias("e")).groupBy("e.kind").agg(F.round(F.avg("e.error") / 64, 6).alias("mean_error"))


@query()
def vector_bytes_round_trip(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    back = quantize.decode_vector(quantize.encode_vector(F.col("embedding")))
    return e.select("vec_id", F.octet_length(quantize.encode_vector(F.col("embedding"))).alias("bytes"), (back == F.col("embedding")).alias("same"))


# Search ---------------------------------------------------------------------------------------------------------------


@query(topk_sql(DIST["ip"], SCALED, 10, members_if="label = 3", queries_if="vec_id < 20"))
def search_filtered_by_label(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    return search.search(rows, _few(rows, 20), 10, "ip", predicate=F.col("label") == 3)


@query(topk_sql(DIST["ip"], SCALED, 10, queries_if="TRUE"))
def search_batch_all(spark, sf_dir):
    """Every vector as a query: the matrix plan."""
    rows = scaled(spark, sf_dir)
    return search.search(rows, rows, 10, "ip")


@query(f"WITH {pairs_sql(DIST['l2sq'], V, queries_if='vec_id < 20')} SELECT qid, id, distance FROM d WHERE distance <= 1.5")
def search_radius(spark, sf_dir):
    rows = members(spark, sf_dir)
    return search.within(rows, _few(rows, 20), 1.5, "l2sq")


@query(f"""WITH {pairs_sql(DIST['hamming'], SIGN, queries_if='vec_id < 20')}, h AS (SELECT *, row_number() OVER (PARTITION BY qid, id % 2 ORDER BY distance, id) AS n FROM d),
r AS (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id % 2, id) AS rank FROM h WHERE n <= 10) SELECT * FROM r WHERE rank <= 10""")
def search_merge_two_halves(spark, sf_dir):
    """Bit distances have many ties: among equal ones the incoming half, that of the even ids, goes first."""
    rows = _with(members(spark, sf_dir), quantize.binarize)
    even, odd = (search.search(rows.filter(F.col("id") % 2 == h), _few(rows, 20), 10, "hamming", plan="expression") for h in (0, 1))
    return search.merge_hits(odd, even, 10)


@query(f"""WITH {pairs_sql(DIST['cos'], SCALED, members_if='label = 3 AND vec_id < 60')}, {ranked_sql(10)}, s AS (SELECT qid, unnest(range(1, 11)) AS rank FROM p)
SELECT s.qid, s.rank, coalesce(id, 0) AS id, coalesce(distance, 'nan'::DOUBLE) AS distance FROM s LEFT JOIN top USING (qid, rank)""")
def search_padded(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    q = _few(rows)
    return search.padded(search.search(rows.filter(F.col("id") < 60), q, 10, "cos", predicate=F.col("label") == 3), q, 10)


@query()
def search_padded_whole(spark, sf_dir):
    """All members of the label, and k ten wider than their number, so that every query is padded."""
    rows = scaled(spark, sf_dir)
    q, k = _fixed(rows), rows.filter(F.col("label") == 3).count() + 10
    return search.padded(search.search(rows, q, k, "cos", predicate=F.col("label") == 3), q, k)


@query(f"WITH {pairs_sql(_s('(v[i] - q[i]) * (v[i] - q[i])'), '[embedding[1]::DOUBLE, embedding[2]::DOUBLE]', queries_if='vec_id = 0')} SELECT id, round({_s('(v[i] - 0.5::DOUBLE) * (v[i] - 0.5::DOUBLE)')}, 6) + 0.0 AS distance FROM c ORDER BY distance, id LIMIT 10")
def search_single_limit(spark, sf_dir):
    rows = _with(members(spark, sf_dir), lambda v: F.array(v[0], v[1]))
    return search.search_one(rows, [0.5, 0.5], 10, "l2sq")


@query(f"WITH {pairs_sql(DIST['l2sq'], SCALED, members_if='vec_id * 2 <= 501 AND NOT (vec_id % 5 = 0 AND vec_id * 2 + 301 <= 501)')}, {ranked_sql(5)} SELECT qid, id, distance, rank FROM top")
def search_as_of(spark, sf_dir):
    """The collection as its command log makes it up to an index: vectors are inserted in id order, some deleted later."""
    rows = scaled(spark, sf_dir)
    inserts = rows.select((F.col("id") * 2).alias("log_index"), "id", F.lit("upsert").alias("cmd"), F.col("vec").alias("value"))
    deletes = rows.filter(F.col("id") % 5 == 0).select((F.col("id") * 2 + 301).alias("log_index"), "id", F.lit("delete").alias("cmd"), F.lit(None).cast("array<double>").alias("value"))
    state = log.live_state(inserts.union(deletes), 501)
    return search.search(state.select("id", F.col("value").alias("vec")), _few(rows), 5, "l2sq")


@query("SELECT vec_id AS qid, n AS visited_members, n AS computed_distances, least(n, 10) AS count FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id < 5")
def search_stats(spark, sf_dir):
    rows = members(spark, sf_dir)
    return search.search_stats(rows, _few(rows), 10)


@query(f"WITH {pairs_sql(DIST['ip'], SCALED)}, {ranked_sql(5)} SELECT qid, min(id) FILTER (rank = 1) AS front, min(id) FILTER (rank = 5) AS back, bool_or(id = 7) AS has_7, count(*) AS n FROM top GROUP BY qid")
def search_result_access(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    hits = search.collected(search.search(rows, _few(rows), 5, "ip"))
    at = lambda i: F.element_at("hits", i)["id"]
    return hits.select("qid", at(1).alias("front"), at(-1).alias("back"), F.exists("hits", lambda h: h["id"] == 7).alias("has_7"), F.size("hits").cast("long").alias("n"))


@query()
def search_diverse(spark, sf_dir):
    rows = members(spark, sf_dir)
    return search.diverse(search.search(rows, _few(rows), 50, "l2sq"), rows, 10, "l2sq")


@query()
def ann_recall(spark, sf_dir):
    """Recall at 10 of the inverted file with three quarters of its lists probed."""
    rows = members(spark, sf_dir)
    q = rows.filter(F.col("id") % 50 == 0)
    centroids, listed = ann.build_ivf(rows, 16)
    return ann.recall(ann.search_ivf(centroids, listed, q, 10, 12), search.search(rows, q, 10, "l2sq"))


# Joins and matching ---------------------------------------------------------------------------------------------------


@query(f"WITH {pairs_sql(DIST['ip'], SCALED, members_if='vec_id % 2 = 1', queries_if='vec_id % 2 = 0')}, {ranked_sql(3)} SELECT qid AS l, id AS r, distance, rank FROM top")
def knn_join_even_odd(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    return matching.knn_join(rows.filter(F.col("id") % 2 == 0), rows.filter(F.col("id") % 2 == 1), 3, "ip")


@query(f"""WITH RECURSIVE {pairs_sql(DIST['ip'], SCALED, members_if='vec_id < 80 AND vec_id % 2 = 1', queries_if='vec_id < 80 AND vec_id % 2 = 0')},
g(step, l, r, distance, ls, rs) AS (
  SELECT 0, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT * FROM (SELECT g.step + 1, d.qid, d.id, d.distance, list_append(g.ls, d.qid), list_append(g.rs, d.id) FROM g, d
    WHERE NOT list_contains(g.ls, d.qid) AND NOT list_contains(g.rs, d.id) ORDER BY d.distance, d.qid, d.id LIMIT 1))
SELECT l, r, distance FROM g WHERE step > 0""")
def greedy_match_40x40(spark, sf_dir):
    rows = scaled(spark, sf_dir).filter(F.col("id") < 80)
    return matching.match(rows.filter(F.col("id") % 2 == 0), rows.filter(F.col("id") % 2 == 1), "ip", proposals=0)


@query()
def greedy_match_whole(spark, sf_dir):
    """All even against all odd ids, without a cap on lists."""
    rows = scaled(spark, sf_dir)
    return matching.match(rows.filter(F.col("id") % 2 == 0), rows.filter(F.col("id") % 2 == 1), "ip", proposals=0)


@query()
def stable_match_capped(spark, sf_dir):
    """All even against all odd ids, lists of ln(n) + 1."""
    rows = scaled(spark, sf_dir)
    return matching.match(rows.filter(F.col("id") % 2 == 0), rows.filter(F.col("id") % 2 == 1), "l2sq")


@query("SELECT e.vec_id AS id, e.label FROM embeddings e SEMI JOIN (SELECT vec_id * 3 AS k FROM embeddings) o ON e.vec_id = o.k")
def semi_join_keys(spark, sf_dir):
    rows = members(spark, sf_dir).select("id", "label")
    return rows.join(rows.select((F.col("id") * 3).alias("id")), "id", "left_semi")


@query("SELECT e.vec_id AS id, e.label FROM embeddings e ANTI JOIN (SELECT vec_id * 3 AS k FROM embeddings) o ON e.vec_id = o.k")
def anti_join_keys(spark, sf_dir):
    rows = members(spark, sf_dir).select("id", "label")
    return rows.join(rows.select((F.col("id") * 3).alias("id")), "id", "left_anti")


# Aggregations ---------------------------------------------------------------------------------------------------------

_AGG = "count(x) AS count, coalesce(round(avg(x), 6) + 0.0, 3.4028234663852886e38) AS mean, coalesce(round(min(x), 6) + 0.0, 3.4028234663852886e38) AS min, coalesce(round(max(x), 6) + 0.0, 3.4028234663852886e38) AS max"


def _between_sql(pairs: str, key: str, where: str = "TRUE") -> str:
    return f"WITH k AS ({pairs}), c AS (SELECT {key} AS id, {SCALED} AS v FROM embeddings WHERE {where}), x AS (SELECT k.a, k.b, {_s('v[i] * q[i]')} AS s FROM k LEFT JOIN c ON c.id = k.a LEFT JOIN (SELECT id, v AS q FROM c) o ON o.id = k.b), y AS (SELECT a, b, 1 - s AS x FROM x) SELECT a, b, {_AGG} FROM y GROUP BY a, b"


def _pairs(spark: SparkSession, a, b) -> DataFrame:
    return spark.range(0, 20).select(a(F.col("id")).alias("a"), b(F.col("id")).alias("b"))


@query(_between_sql("SELECT i AS a, i + 100 AS b FROM range(20) t(i)", "vec_id"))
def distance_between_ids(spark, sf_dir):
    return aggregate.distance_between(scaled(spark, sf_dir), _pairs(spark, lambda i: i, lambda i: i + 100))


@query(_between_sql("SELECT i AS a, i * 1000 AS b FROM range(20) t(i)", "vec_id"))
def distance_between_missing(spark, sf_dir):
    return aggregate.distance_between(scaled(spark, sf_dir), _pairs(spark, lambda i: i, lambda i: i * 1000))


@query(_between_sql("SELECT i // 10 AS a, i % 10 AS b FROM range(20) t(i)", "label::BIGINT"))
def distance_between_multi(spark, sf_dir):
    """Keys with several vectors: the label stands for the key."""
    rows = scaled(spark, sf_dir).select(F.col("label").cast("long").alias("id"), "vec")
    return aggregate.distance_between(rows, _pairs(spark, lambda i: F.floor(i / 10), lambda i: i % 10), plan="matrix")


@query(f"WITH c AS (SELECT label::BIGINT AS a, {SCALED} AS v FROM embeddings), y AS (SELECT a, 1 - 0.125::DOUBLE * list_sum(v) AS x FROM c) SELECT a, {_AGG} FROM y GROUP BY a")
def distance_to_vector(spark, sf_dir):
    rows = scaled(spark, sf_dir).select(F.col("label").cast("long").alias("id"), "vec")
    keys = rows.select(F.col("id").alias("a")).distinct()
    return aggregate.distance_to(rows, keys, F.array_repeat(F.lit(0.125), 64))


@query("WITH s AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings) SELECT label::BIGINT AS cluster, (i - 1)::BIGINT AS pos, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS x FROM s GROUP BY label, i")
def centroid_per_label(spark, sf_dir):
    out = aggregate.centroids(members(spark, sf_dir).withColumn("cluster", F.col("label").cast("long")))
    return out.select("cluster", F.posexplode("vec").alias("pos", "x")).select("cluster", F.col("pos").cast("long").alias("pos"), search.rounded(F.col("x")).alias("x"))


@query("SELECT count(*) AS size, max(len(embedding))::BIGINT AS dimensions, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings")
def memory_usage(spark, sf_dir):
    return aggregate.memory_usage(members(spark, sf_dir), 32)


# Clustering -----------------------------------------------------------------------------------------------------------

_NEAREST = f"WITH {pairs_sql(DIST['l2sq'], V, members_if='REPS_IF', queries_if='TRUE')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d), a AS (SELECT qid AS id, id AS cluster, distance FROM r WHERE rank = 1)"


@query(_NEAREST.replace("REPS_IF", "vec_id < 10") + " SELECT id, cluster, distance FROM a")
def kmeans_assign_first10(spark, sf_dir):
    rows = members(spark, sf_dir)
    return cluster.assign(rows, _few(rows, 10))


@query(_NEAREST.replace("REPS_IF", "vec_id < 10") + ", s AS (SELECT a.cluster, unnest(range(1, len(e.embedding) + 1)) AS i, e.embedding FROM a JOIN embeddings e ON e.vec_id = a.id) SELECT cluster, (i - 1)::BIGINT AS pos, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS x FROM s GROUP BY cluster, i")
def kmeans_update_first10(spark, sf_dir):
    rows = members(spark, sf_dir)
    out = cluster.update(rows, cluster.assign(rows, _few(rows, 10)))
    return out.select("cluster", F.posexplode("vec").alias("pos", "x")).select("cluster", F.col("pos").cast("long").alias("pos"), search.rounded(F.col("x")).alias("x"))


@query()
def kmeans_full(spark, sf_dir):
    return cluster.kmeans(members(spark, sf_dir), 10)[1]


LEVEL = "floor(-ln((((vec_id * 48271 + 11) % 65537)::DOUBLE + 1) / 65538) / ln(16.0::DOUBLE))::BIGINT"


@query(f"SELECT vec_id AS id, {LEVEL} AS level FROM embeddings")
def level_by_hash(spark, sf_dir):
    return members(spark, sf_dir).select("id", cluster.level_of(F.col("id")).alias("level"))


@query(_NEAREST.replace("REPS_IF", LEVEL + " >= 1") + " SELECT id, cluster, distance FROM a")
def cluster_rep_nn(spark, sf_dir):
    rows = members(spark, sf_dir)
    return cluster.cluster_vectors(rows, rows, 1, "l2sq")


@query(_NEAREST.replace("REPS_IF", LEVEL + " >= 1") + ", k AS (SELECT e.label::BIGINT AS id, cluster, distance, row_number() OVER (PARTITION BY e.label ORDER BY distance, cluster) AS n FROM a JOIN embeddings e ON e.vec_id = a.id) SELECT id, cluster, distance FROM k WHERE n = 1")
def cluster_of_keys(spark, sf_dir):
    return cluster.cluster_keys(members(spark, sf_dir), 1, key="label").select(F.col("label").cast("long").alias("id"), "cluster", "distance")


@query()
def cluster_merged(spark, sf_dir):
    rows = members(spark, sf_dir)
    return cluster.cluster_queries(rows, rows, 8, "l2sq").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# Lookups --------------------------------------------------------------------------------------------------------------


@query("SELECT i * 7 AS id, e.vec_id IS NOT NULL AS present, (e.vec_id IS NOT NULL)::BIGINT AS count FROM range(200) t(i) LEFT JOIN embeddings e ON e.vec_id = i * 7")
def contains_keys(spark, sf_dir):
    return collection.contains(members(spark, sf_dir), spark.range(0, 200).select((F.col("id") * 7).alias("id")))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def count_by_label(spark, sf_dir):
    return members(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 100")
def export_keys_page(spark, sf_dir):
    return collection.export_keys(members(spark, sf_dir), 100, 50)


@query("SELECT CASE WHEN vec_id = 3 AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = 1000003) THEN 1000003 ELSE vec_id END AS id, label FROM embeddings")
def rename_id(spark, sf_dir):
    return collection.rename(members(spark, sf_dir).select("id", "label"), 3, 1000003)


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id = 42")
def get_key(spark, sf_dir):
    return collection.get(members(spark, sf_dir).select("id", "label"), 42)


@query("""WITH s AS (SELECT vec_id * 2 AS k, 1 AS seq FROM embeddings UNION ALL SELECT vec_id * 3, 2 FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS turn FROM s)
SELECT k AS id, seq, (e.vec_id IS NULL AND turn = 1) AS accepted FROM n LEFT JOIN embeddings e ON e.vec_id = k""")
def add_refuses_duplicates(spark, sf_dir):
    """Ids that exist are refused, and those that come twice are added once."""
    rows = members(spark, sf_dir).select("id")
    new = rows.select((F.col("id") * 2).alias("id"), F.lit(1).alias("seq")).union(rows.select(F.col("id") * 3, F.lit(2)))
    yes, no = collection.add(rows, new)
    return yes.withColumn("accepted", F.lit(True)).unionByName(no.withColumn("accepted", F.lit(False)))


@query("""WITH RECURSIVE w(id, d, s) AS (SELECT vec_id, 0, ((vec_id::HUGEINT * 11400714819323198485) + 11400714819323198485) & 18446744073709551615 FROM embeddings
 UNION ALL SELECT id, d + 1, (WITHOUT) FROM w WHERE d < 6),
x AS (SELECT id, d - 1 AS dim, ((s * 2685821657736338717) & 65535)::BIGINT AS part FROM w WHERE d > 0) SELECT id, dim, part FROM x""".replace(
    "(WITHOUT)", "xor(xor(xor(s, s >> 12), (xor(s, s >> 12) << 25) & 18446744073709551615), xor(xor(s, s >> 12), (xor(s, s >> 12) << 25) & 18446744073709551615) >> 27)"))
def workload_vectors(spark, sf_dir):
    """The generator's vector of every id."""
    made = members(spark, sf_dir).select("id", workload.vector_for(F.col("id"), 6).alias("vec"))
    return made.select("id", F.posexplode("vec").alias("dim", "value")).select("id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double") * 65535).cast("long").alias("part"))


@query("SELECT i, CASE WHEN i % 10 < 5 THEN 'upsert' WHEN i % 10 < 7 THEN 'delete' ELSE 'search' END AS op FROM range(5000) t(i)")
def workload_full(spark, sf_dir):
    return workload.operations(spark, 5000, "full")


@query("SELECT count(*) AS removed FROM embeddings WHERE vec_id < 700 AND vec_id % 7 = 0")
def remove_keys_count(spark, sf_dir):
    return collection.remove_count(members(spark, sf_dir), spark.range(0, 100).select((F.col("id") * 7).alias("id")))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id >= 100 OR vec_id % 7 <> 0")
def delete_keys(spark, sf_dir):
    gone = spark.range(0, 100).filter(F.col("id") % 7 == 0)
    return collection.delete(members(spark, sf_dir), gone).select("id")
