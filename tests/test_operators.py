"""Properties of search, mutations, matching, clustering, the log and its codecs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import quantize
from plumbline.operators import aggregate, cluster, collection, log, maintenance, matching, search
from plumbline.sources import segments
from plumbline.streaming.apply import TableApplier, dedup_stream


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(3).normal(size=(60, 6))
    return spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(60)], "id long, vec array<double>, label int").cache()


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("metric", ["ip", "cos", "l2sq", "pearson"])
def test_plans_agree(rows, metric):
    q = rows.filter("id < 7")
    assert as_set(search.search(rows, q, 4, metric)) == as_set(search.search(rows, q, 4, metric, plan="expression"))


def test_ties_go_to_the_smallest_ids(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, vec array<double>").repartition(3)
    got = search.search(same, same.filter("id = 9"), 5, "l2sq").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4]


def test_k_edges(spark, rows):
    q = rows.filter("id < 2")
    assert search.search(rows, q, 0).count() == 0
    assert search.search(rows, q, 500).count() == 120
    assert search.search(rows.filter("id < 0"), q, 3).count() == 0
    assert search.search(rows, q.filter("id < 0"), 3).count() == 0


def test_filter_is_below_the_top_k(rows):
    got = search.search(rows, rows.filter("id < 3"), 10, predicate=F.col("label") == 1)
    assert got.count() == 30 and {r.id % 3 for r in got.collect()} == {1}


def test_merge_pad_collect(rows):
    q = rows.filter("id < 3")
    whole = search.search(rows, q, 8, "l2sq")
    a, b = (search.search(rows.filter(F.col("id") % 2 == h), q, 8, "l2sq") for h in (0, 1))
    assert as_set(search.merge_hits(a, b, 8).select("qid", "id")) == as_set(whole.select("qid", "id"))
    wide = search.padded(search.search(rows.filter("id < 4"), q, 8), q, 8)
    assert wide.count() == 24 and wide.filter(F.isnan("distance")).count() == 12
    assert all(len(r.hits) == 8 for r in search.collected(whole).collect())


def test_no_blocking_pair(rows):
    left, right = rows.filter(F.col("id") % 2 == 0), rows.filter(F.col("id") % 2 == 1)
    m = {r.l: (r.r, r.distance) for r in matching.match(left, right, "l2sq", proposals=0).collect()}
    assert len(m) == 30 and len({r for r, _ in m.values()}) == 30
    of = {r: (l, d) for l, (r, d) in m.items()}
    for p in matching.knn_join(left, right, 30, "l2sq").collect():
        assert not (p.distance < m[p.l][1] and p.distance < of[p.r][1])


def test_kmeans(rows):
    centroids, stats = cluster.kmeans(rows, 4, iterations=20)
    assert centroids.count() == 4 and stats.first().computed_distances == 60 * 4 * stats.first().iterations
    one, few = (cluster.kmeans(rows, 4, iterations=i, tolerance=0, few=0)[1].first().aggregate_distance for i in (1, 6))
    assert few <= one
    for bad in (1, 60):
        with pytest.raises(ValueError):
            cluster.kmeans(rows, bad)
    assert cluster.cluster_queries(rows, rows, 2, "l2sq", level=0).select("cluster").distinct().count() <= 2


def test_mutations(spark, rows):
    v = rows.select("id", "vec")
    up = spark.createDataFrame([(1, [9.0] * 6, 1), (1, [8.0] * 6, 2), (99, [7.0] * 6, 1)], "id long, vec array<double>, seq int")
    out = collection.upsert(v, up)
    assert out.count() == 61 and collection.get(out, 1).first().vec[0] == 8.0
    assert collection.delete(out, spark.range(50, 500)).count() == 50
    assert collection.rename(v, 1, 2).filter("id = 1").count() == 1 and collection.rename(v, 1, 777).filter("id = 777").count() == 1
    c = collection.VectorCollection(v, 6, "l2sq").upsert(500, [0.0] * 6).delete(3)
    assert c.search([0.0] * 6, 1).first().id == 500 and c.state.count() == 60
    for bad in (lambda: c.search([0.0] * 6, 0), lambda: c.upsert(1, [0.0]), lambda: c.upsert(-1, [0.0] * 6)):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def commands(spark):
    rng = np.random.default_rng(5)
    data = [(i, int(rng.integers(0, 20)), "delete" if rng.random() < 0.3 else "upsert", float(i), f"r{int(rng.integers(0, 150))}") for i in range(300)]
    return spark.createDataFrame(data, "log_index long, id long, cmd string, value double, request_id string").cache()


def test_replay_equals_apply(commands):
    for at in (0, 100, 299):
        assert as_set(log.replay(log.live_state(commands, at), commands, at)) == as_set(log.live_state(commands))
    assert as_set(log.live_state(commands.union(commands))) == as_set(log.live_state(commands))
    assert log.live_state(commands.filter("id < 0")).count() == 0


def test_windowed_requests(commands):
    assert as_set(log.windowed_requests(commands, 10_000)) == as_set(log.first_requests(commands))
    assert log.windowed_requests(commands, 5).count() > log.first_requests(commands).count()


def test_percentiles_and_policy(spark):
    r = spark.range(1, 2001).select(F.lit("a").alias("m"), F.col("id").cast("double").alias("v"))
    assert aggregate.nearest_rank(r, "m", "v", [0.99]).first().value == 1980.0
    s = spark.createDataFrame([(0.2, 0.0, 0, False), (0.21, 0.0, 0, False), (0.0, 0.11, 0, False), (0.0, 0.0, 604800, False), (0.9, 0.9, 0, True)], "delete_ratio double, fragmentation_ratio double, since_s long, busy boolean")
    assert [x.action for x in maintenance.decide(s).collect()] == ["idle", "compact", "isolate_compact", "compact", "skip"]


def test_topology(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcde"], "node_id string")
    got = {r.node_id: r.source for r in log.assign_topology(nodes).collect()}
    assert got == {"a": "leader", "b": "leader", "c": "leader", "d": "a", "e": "b"}


def test_records_stop_at_damage():
    data = segments.encode_records([b"one", b"", b"three"])
    assert segments.decode_records(data)[0] == [b"one", b"", b"three"]
    for at in (0, 5, 9, 13):
        bad = bytearray(data)
        bad[at] ^= 1
        assert segments.decode_records(bytes(bad))[0] == []
    assert segments.decode_records(data[:-1])[0] == [b"one", b""]


def test_segments_drop_what_follows_damage(spark):
    rows = spark.range(100).select(F.col("id").alias("log_index"), F.repeat(F.lit("x"), 20).cast("binary").alias("payload"))
    packed = segments.pack_segments(segments.assign_segments(rows, 320))
    assert segments.unpack_segments(packed).count() == 100 and packed.count() == 10
    cut = packed.withColumn("data", F.when(F.col("segment") == 4, F.expr("substring(data, 1, 100)")).otherwise(F.col("data")))
    assert segments.unpack_segments(cut).count() == 43


def test_snapshot(spark, rows, tmp_path):
    segments.save_snapshot(rows, str(tmp_path), index=7, term=1, metric="ip", data_type="f32")
    back, meta = segments.load_snapshot(spark, str(tmp_path), 7, dim=6, metric="ip", data_type="f32")
    assert back.count() == 60 and meta["raft_index"] == 7
    with pytest.raises(ValueError):
        segments.load_snapshot(spark, str(tmp_path), 7, dim=5, metric="ip", data_type="f32")


def test_stream_equals_batch(spark, commands, tmp_path):
    for i in range(3):
        commands.filter(F.floor(F.col("log_index") / 100) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    applier = TableApplier(str(tmp_path / "state"))
    stream = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(applier).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    state = applier.read(spark)
    assert as_set(state.filter("cmd <> 'delete'").select("id", "value", "log_index")) == as_set(log.live_state(commands))
    applier(commands.limit(1), 0)  # a batch that comes again changes nothing
    assert as_set(applier.read(spark)) == as_set(state)


def test_stream_dedup(spark, commands, tmp_path):
    commands.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = dedup_stream(spark.readStream.schema(commands.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert as_set(spark.read.parquet(str(tmp_path / "out"))) == as_set(log.first_requests(commands))


def test_blocks_of_queries_and_centroids(spark, monkeypatch):
    """More queries or centroids than one broadcast holds give the same results in blocks."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=4).round(2).tolist()) for i in range(60)], "id long, vec array<double>")
    few = rows.filter("id % 3 = 0")
    want = [sorted(map(tuple, f().collect())) for f in (lambda: cluster.assign(rows, few), lambda: search.pairwise(rows, few, "l2sq"), lambda: search.search(rows, few, 3, "l2sq"))]
    monkeypatch.setattr(search, "BLOCK_BYTES", 100)
    assert len(search.query_blocks(few)) > 3
    got = [sorted(map(tuple, f().collect())) for f in (lambda: cluster.assign(rows, few), lambda: search.pairwise(rows, few, "l2sq"), lambda: search.search(rows, few, 3, "l2sq"))]
    assert got == want


def test_storage_kinds_with_nulls(spark):
    rows = [(1, [3.0, 4.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1e9, -0.3, 0.02])]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    for kind in ("f16", "bf16", "e5m2", "e4m3", "e3m2", "e2m3", "i8", "u8", "b1", "f32"):
        got = {r.id: r.v for r in frame.select("id", quantize.stored_as(F.col("vec"), kind).alias("v")).collect()}
        for i, v in rows:
            assert (got[i] is None) == (v is None)
            if v:
                np.testing.assert_allclose(got[i], quantize.round_trip(np.array(v), kind), rtol=1e-6)
    back = frame.select("id", quantize.decode_vector(quantize.encode_vector(F.col("vec").cast("array<float>"))).alias("v")).collect()
    assert {r.id: r.v for r in back}[2] is None and {r.id: r.v for r in back}[1] == [3.0, 4.0] and {r.id: r.v for r in back}[3] == []
    odd = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),), (None,), (bytearray(8),)], "b binary")
    assert [r.v for r in odd.coalesce(1).select(quantize.decode_vector(F.col("b")).alias("v")).collect()] == [None, [], None, [0.0, 0.0]]


def test_outcomes_of_requests(spark):
    rows = [(1, "a", True, ""), (2, "b", False, "full"), (3, "a", False, "late"), (4, "c", True, ""), (5, "", True, ""), (6, "b", True, ""), (7, None, True, "")]
    found = log.request_outcomes(spark.createDataFrame(rows, "log_index long, request_id string, success boolean, error string"), 3)
    assert sorted(map(tuple, found.collect())) == [("a", 3, True, False, "late"), ("b", 2, True, False, "full"), ("c", 4, False, False, "")]
    assert [r.request_id for r in log.outcome_snapshot(found).collect()] == ["b", "a"]


def test_snapshot_is_replaced_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vec array<double>")
    for n in (2, 1):
        segments.save_snapshot(rows.limit(n), f"file://{tmp_path}", index=5, term=1, metric="ip", data_type="f32")
        assert segments.load_snapshot(spark, f"file://{tmp_path}", 5, dim=1, metric="ip", data_type="f32")[0].count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["snap=5"]


def test_suffix_is_overwritten(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "log_index long, term long, id long")
    own = make((1, 1, 10), (2, 1, 20), (3, 2, 30), (4, 2, 40), (5, 2, 50))
    assert sorted(map(tuple, log.overwrite_suffix(own, make((2, 1, 20), (3, 3, 31), (4, 3, 41))).collect())) == [(1, 1, 10), (2, 1, 20), (3, 3, 31), (4, 3, 41)]
    assert log.overwrite_suffix(own, make((2, 1, 20))).count() == 5 and log.overwrite_suffix(own, make((6, 2, 60))).count() == 6

