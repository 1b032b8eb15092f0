"""Command-log queries over the events table, each with its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, collection, log, maintenance
from ..session import checkpoint_dir
from ..sources import segments
from ..streaming.apply import TableApplier, commands_from_events

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


_LOG = "c AS (SELECT event_id AS log_index, user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS cmd, value, user_id::VARCHAR || '-' || props AS request_id FROM events)"
_LAST = f"WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY log_index DESC) AS rn FROM c), s AS (SELECT id, log_index, cmd, value FROM n WHERE rn = 1)"


@query(f"{_LAST} SELECT id, value, log_index FROM s WHERE cmd <> 'delete'")
def apply_latest_state(spark, sf_dir):
    return log.live_state(commands(spark, sf_dir))


@query(f"{_LAST} SELECT id, log_index FROM s WHERE cmd = 'delete'")
def apply_deleted_ids(spark, sf_dir):
    return log.deleted_ids(commands(spark, sf_dir))


_HALF = "(SELECT max(event_id) // 2 FROM events)"


def _half(rows: DataFrame) -> int:
    return (rows.agg(F.max("log_index")).first()[0] or 0) // 2


@query(f"WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY log_index DESC) AS rn FROM c WHERE log_index <= {_HALF}) SELECT id, value, log_index FROM n WHERE rn = 1 AND cmd <> 'delete'")
def read_as_of(spark, sf_dir):
    rows = commands(spark, sf_dir)
    return log.live_state(rows, _half(rows))


@query(f"{_LAST} SELECT id, value, log_index FROM s WHERE cmd <> 'delete'")
def replay_from_snapshot(spark, sf_dir):
    rows = commands(spark, sf_dir)
    half = _half(rows)
    return log.replay(log.live_state(rows, half), rows, half)


@query(f"WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY log_index) AS rn FROM c) SELECT log_index, id, cmd, value, request_id FROM n WHERE rn = 1")
def dedup_first_wins(spark, sf_dir):
    return log.first_requests(commands(spark, sf_dir))


@query(f"WITH {_LOG} SELECT request_id, min(log_index) AS log_index FROM c GROUP BY request_id ORDER BY 2 DESC LIMIT 100")
def dedup_last_window(spark, sf_dir):
    return log.last_window(commands(spark, sf_dir), 100)


@query()
def dedup_bounded_window(spark, sf_dir):
    return log.windowed_requests(commands(spark, sf_dir), 1000)


@query(f"WITH {_LOG} SELECT log_index, id, cmd FROM c WHERE log_index >= 500 ORDER BY log_index LIMIT 64")
def read_from(spark, sf_dir):
    return log.read_from(commands(spark, sf_dir), 500, 64).select("log_index", "id", "cmd")


@query(f"WITH {_LOG} SELECT log_index, id FROM c WHERE log_index < coalesce((SELECT min(log_index) FROM c WHERE log_index % 997 = 996), 9223372036854775807)")
def valid_prefix(spark, sf_dir):
    return log.valid_prefix(commands(spark, sf_dir), F.col("log_index") % 997 != 996).select("log_index", "id")


@query(f"WITH {_LOG} SELECT log_index, id FROM c WHERE log_index < 700")
def truncate_suffix(spark, sf_dir):
    return log.truncate_suffix(commands(spark, sf_dir), 700).select("log_index", "id")


@query(f"WITH {_LOG}, s AS (SELECT *, log_index // 128 AS segment FROM c), k AS (SELECT segment FROM s GROUP BY segment HAVING max(log_index) >= 300) SELECT log_index, segment FROM s SEMI JOIN k USING (segment)")
def truncate_before(spark, sf_dir):
    rows = commands(spark, sf_dir).withColumn("segment", F.floor(F.col("log_index") / 128))
    return log.truncate_before(rows, 300).select("log_index", "segment")


_BRANCH = "b AS (SELECT log_index, log_index % 3 AS term, id FROM c UNION ALL SELECT log_index, 2 AS term, id + 1 AS id FROM c WHERE log_index % 5 = 0 AND log_index % 3 <> 2)"


@query(f"WITH {_LOG}, {_BRANCH}, n AS (SELECT *, row_number() OVER (PARTITION BY log_index ORDER BY term DESC) AS rn FROM b) SELECT log_index, term, id FROM n WHERE rn = 1")
def conflict_highest_term(spark, sf_dir):
    c = commands(spark, sf_dir)
    other = c.filter((F.col("log_index") % 5 == 0) & (F.col("log_index") % 3 != 2)).select("log_index", F.lit(2).cast("long").alias("term"), (F.col("id") + 1).alias("id"))
    return log.resolve_conflicts(c.select("log_index", (F.col("log_index") % 3).alias("term"), "id").unionByName(other))


@query("SELECT i AS log_index, CASE WHEN e.event_id IS NOT NULL THEN i // 100 END AS term FROM (SELECT i * 50 AS i FROM range(40) t(i)) LEFT JOIN events e ON e.event_id = i")
def term_lookup(spark, sf_dir):
    rows = commands(spark, sf_dir).withColumn("term", F.floor(F.col("log_index") / 100))
    return log.term_at(rows, spark.range(0, 40).select((F.col("id") * 50).alias("log_index")))


_GAPS = "g AS (SELECT event_id + event_id // 7 * 3 + event_id // 1500 * 700 AS log_index FROM events)"


def _with_gaps(spark, sf_dir):
    """The same log with gaps between its indexes."""
    i = F.col("log_index")
    return commands(spark, sf_dir).withColumn("log_index", (i + F.floor(i / 7) * 3 + F.floor(i / 1500) * 700).cast("long"))


@query(f"WITH {_GAPS} SELECT log_index, (row_number() OVER (ORDER BY log_index) - 1) // 64 AS batch FROM g")
def batch_assignment(spark, sf_dir):
    return log.batches(_with_gaps(spark, sf_dir))


@query(f"""WITH RECURSIVE {_GAPS}, p(i) AS (SELECT min(log_index) FROM g WHERE log_index > 1000
 UNION ALL SELECT n.i FROM (SELECT min(g.log_index) AS i FROM p JOIN g ON g.log_index > p.i + 1000) n WHERE n.i IS NOT NULL) SELECT i AS log_index FROM p WHERE i IS NOT NULL""")
def snapshot_points(spark, sf_dir):
    return log.snapshot_points(_with_gaps(spark, sf_dir), 1000)


@query(f"""WITH {_LOG}, f AS (SELECT log_index, log_index // 1000 AS term, id FROM c WHERE log_index <= (SELECT max(event_id) * 3 // 4 FROM events)),
l AS (SELECT log_index, CASE WHEN log_index < (SELECT max(event_id) // 3 FROM events) THEN log_index // 1000 ELSE log_index // 1000 + 1 END AS term, id * 10 AS id FROM c WHERE log_index <= (SELECT max(event_id) // 2 FROM events)),
b AS (SELECT min(log_index) AS bad FROM f JOIN l USING (log_index) WHERE f.term <> l.term)
SELECT * FROM f WHERE log_index < coalesce((SELECT bad FROM b), 9223372036854775807)
UNION ALL SELECT l.* FROM l WHERE log_index >= coalesce((SELECT bad FROM b), 9223372036854775807)""")
def overwrite_suffix(spark, sf_dir):
    """A follower ahead of the leader: its entries from the first other term on go, also those past the leader's last."""
    c = commands(spark, sf_dir)
    last = c.agg(F.max("log_index")).first()[0] or 0
    i, term = F.col("log_index"), F.floor(F.col("log_index") / 1000)
    own = c.filter(i <= last * 3 // 4).select("log_index", term.alias("term"), "id")
    leader = c.filter(i <= last // 2).select("log_index", F.when(i < last // 3, term).otherwise(term + 1).alias("term"), (F.col("id") * 10).alias("id"))
    return log.overwrite_suffix(own, leader)


_OUTCOMES = f"""{_LOG}, o AS (SELECT *, value < 400 AS success, CASE WHEN value < 400 THEN '' ELSE 'limit' END AS error FROM c),
r AS (SELECT request_id, max(log_index) FILTER (log_index <= {_HALF}) AS done, min(log_index) FILTER (log_index > {_HALF}) AS first FROM o GROUP BY request_id),
s AS (SELECT r.request_id, coalesce(done, first) AS log_index, done IS NOT NULL AS committed, done IS NOT NULL AND o.success AS success, CASE WHEN done IS NOT NULL THEN o.error ELSE '' END AS error FROM r JOIN o ON o.log_index = coalesce(done, first))"""


def _outcomes(spark, sf_dir):
    rows = commands(spark, sf_dir)
    high = F.col("value") >= 400
    return log.request_outcomes(rows.withColumn("success", ~high).withColumn("error", F.when(high, "limit").otherwise("")), _half(rows))


@query(f"WITH {_OUTCOMES} SELECT * FROM s")
def request_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(f"WITH {_OUTCOMES} SELECT request_id, log_index, success, error FROM s WHERE committed")
def outcome_snapshot(spark, sf_dir):
    return log.outcome_snapshot(_outcomes(spark, sf_dir))


@query(f"""WITH {_LOG}, e AS (SELECT log_index, cmd, coalesce(lag(cmd) OVER (PARTITION BY id ORDER BY log_index), 'delete') AS before FROM c),
n AS (SELECT log_index, CASE WHEN cmd <> 'delete' AND before = 'delete' THEN 1 WHEN cmd = 'delete' AND before <> 'delete' THEN -1 ELSE 0 END::BIGINT AS event FROM e),
l AS (SELECT *, sum(event) OVER (ORDER BY log_index) AS live FROM n),
m AS (SELECT *, greatest(0, max(live) OVER (ORDER BY log_index)) AS slots FROM l) SELECT log_index, event, (slots - live)::BIGINT AS free, slots::BIGINT AS slots FROM m""")
def slot_counters(spark, sf_dir):
    return log.slot_counters(commands(spark, sf_dir), 1000)


@query(f"{_LAST} SELECT count(*) FILTER (cmd <> 'delete') AS size, count(*) FILTER (cmd = 'delete') AS deleted, count(*) AS total_slots FROM s")
def state_sizes(spark, sf_dir):
    return collection.sizes(log.latest(commands(spark, sf_dir)))


@query(f"""{_LAST}, z AS (SELECT count(*) FILTER (cmd <> 'delete') AS size, count(*) FILTER (cmd = 'delete') AS deleted, count(*) AS total_slots FROM s)
SELECT deleted / total_slots AS delete_ratio, (total_slots - size) / total_slots AS fragmentation_ratio, t.since_s, t.busy,
 CASE WHEN t.busy THEN 'skip' WHEN deleted / total_slots > 0.2 OR t.since_s >= 604800 THEN 'compact' WHEN (total_slots - size) / total_slots > 0.1 THEN 'isolate_compact' ELSE 'idle' END AS action
FROM z, (VALUES (0::BIGINT, false), (604800, false), (0, true)) t(since_s, busy)""")
def delete_ratio_policy(spark, sf_dir):
    sizes = maintenance.ratios(collection.sizes(log.latest(commands(spark, sf_dir))))
    cases = spark.createDataFrame([(0, False), (604800, False), (0, True)], "since_s long, busy boolean")
    return maintenance.decide(sizes.select("delete_ratio", "fragmentation_ratio").crossJoin(F.broadcast(cases)))


@query(f"{_LAST} SELECT id, value FROM s WHERE cmd <> 'delete'")
def compact_live(spark, sf_dir):
    return maintenance.compact(log.latest(commands(spark, sf_dir))).select("id", "value")


@query("""WITH r AS (SELECT unnest([0.5, 0.95, 0.99, 0.999]::DOUBLE[]) AS ratio), n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, ratio, value FROM n, r WHERE i = greatest(1, ceil(ratio * n))""")
def latency_percentiles(spark, sf_dir):
    return aggregate.nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value", [0.5, 0.95, 0.99, 0.999])


@query("""WITH a AS (SELECT event_type AS mode, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS s, count(*) FILTER (value > 400) AS f FROM events GROUP BY event_type)
SELECT mode, n, round(s, 6) AS seconds, round(n / nullif(round(s, 6), 0), 6) AS per_second, round(f / n * 100, 6) AS error_rate FROM a""")
def throughput_by_mode(spark, sf_dir):
    return aggregate.throughput(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", F.col("value") > 400)


@query("SELECT event_type AS metric, count(value) AS count, round(avg(value), 6) AS mean_us, max(value) AS max_us FROM events GROUP BY event_type")
def perf_counters(spark, sf_dir):
    return aggregate.counters(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")


@query("SELECT user_id, event_id, round(avg(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_mean FROM events")
def ack_running_mean(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    return log.running_mean(e, "user_id", "event_id", "value").select("user_id", "event_id", F.round("running_mean", 4).alias("running_mean"))


@query("WITH a AS (SELECT s_suppkey AS node, s_suppkey * 7919 % 1000 AS m FROM supplier), r AS (SELECT m, row_number() OVER (ORDER BY m DESC, node) AS r, count(*) OVER () AS n FROM a) SELECT m AS commit_index FROM r WHERE r = n // 2 + 1")
def commit_index_by_quorum(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return log.commit_index(s.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 7919 % 1000).alias("match_index")))


@query(f"""WITH {_LOG}, a AS (SELECT s_suppkey AS node, s_suppkey * 7919 % 1000 AS m FROM supplier), r AS (SELECT m, row_number() OVER (ORDER BY m DESC, node) AS r, count(*) OVER () AS n FROM a)
SELECT max(log_index) AS commit_index FROM c WHERE log_index // 7 % 3 = 2 AND log_index <= (SELECT m FROM r WHERE r = n // 2 + 1)""")
def commit_index_current_term(spark, sf_dir):
    """Only entries of the current term are committed by counting."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    acks = s.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 7919 % 1000).alias("match_index"))
    return log.commit_index(acks, commands(spark, sf_dir).withColumn("term", F.floor(F.col("log_index") / 7) % 3), 2)


@query("WITH v AS (SELECT n_regionkey::BIGINT AS term, n_nationkey % 3 > 0 AS granted FROM nation) SELECT term, count(*) FILTER (granted) AS granted, count(*) FILTER (granted) >= count(*) // 2 + 1 AS elected FROM v GROUP BY term")
def vote_majority(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return log.vote_majority(n.select(F.col("n_regionkey").cast("long").alias("term"), F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 3 > 0).alias("granted")))


@query("""WITH r AS (SELECT s_suppkey AS node_id, row_number() OVER (ORDER BY s_suppkey) AS r, count(*) OVER () AS n FROM supplier), h AS (SELECT *, ceil(n / 2) AS half FROM r)
SELECT h.node_id, CASE WHEN h.r <= h.half THEN 'mentor' ELSE 'follower' END AS role, CASE WHEN h.r <= h.half THEN 'leader' ELSE m.node_id::VARCHAR END AS source FROM h LEFT JOIN h m ON m.r <= m.half AND h.r - h.half = m.r""")
def topology_assign(spark, sf_dir):
    return log.assign_topology(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("node_id")))


@query("SELECT i AS attempt, least(2000.0, 50.0 * 2.0 ** i)::BIGINT AS wait_ms FROM range(12) t(i)")
def retry_backoff(spark, sf_dir):
    return spark.range(0, 12).select(F.col("id").alias("attempt"), log.retry_backoff(F.col("id")).alias("wait_ms"))


@query(f"""WITH RECURSIVE {_LOG}, z AS (SELECT log_index, strlen(request_id) + 12 AS size, row_number() OVER (ORDER BY log_index) AS n FROM c),
w(n, log_index, segment, used) AS (SELECT n, log_index, 0::BIGINT, size FROM z WHERE n = 1
 UNION ALL SELECT z.n, z.log_index, CASE WHEN w.used + z.size > 1000 THEN w.segment + 1 ELSE w.segment END, CASE WHEN w.used + z.size > 1000 THEN z.size ELSE w.used + z.size END FROM w JOIN z ON z.n = w.n + 1)
SELECT log_index, segment FROM w""")
def segment_rotation(spark, sf_dir):
    """A segment ends before the record that would take it past its bound."""
    rows = commands(spark, sf_dir).select("log_index", F.col("request_id").cast("binary").alias("payload"))
    return segments.assign_segments(rows, 1000).select("log_index", "segment")


@query("SELECT event_id AS log_index, md5(user_id::VARCHAR || '-' || props) AS payload_md5 FROM events")
def segment_round_trip(spark, sf_dir):
    """The log packed into binary segments and read back."""
    rows = commands(spark, sf_dir).select("log_index", F.col("request_id").cast("binary").alias("payload"))
    back = segments.unpack_segments(segments.pack_segments(segments.assign_segments(rows, 64 << 10)))
    return back.select("log_index", F.md5("payload").alias("payload_md5"))


@query(f"{_LAST} SELECT id, value, log_index FROM s WHERE cmd <> 'delete'")
def streaming_apply(spark, sf_dir):
    """The events as a stream of files, applied batch by batch."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{base}/in")
    applier = TableApplier(f"{base}/state")
    stream = commands_from_events(spark.readStream.schema(schema).parquet(f"{base}/in"))
    stream.writeStream.foreachBatch(applier).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    state = applier.read(spark)
    return state.filter(F.col("cmd") != "delete").select("id", "value", "log_index")
