"""The command log (log_index, term, type, cmd, id, value, request_id) and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def live_state(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """id, value, log_index of live ids: the latest command wins and deletes drop. Entries that are no commands have no effect."""
    return latest(log, as_of).filter(F.col("cmd") != "delete").select("id", "value", "log_index")


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The last command of each id as one aggregate, pre-aggregated before its shuffle."""
    rows = log if as_of is None else log.filter(F.col("log_index") <= as_of)
    if "type" in log.columns:
        rows = rows.filter(F.col("type") == "normal")
    last = rows.groupBy("id").agg(F.max_by(F.struct("log_index", "cmd", "value"), "log_index").alias("last"))
    return last.select("id", "last.log_index", "last.cmd", "last.value")


def deleted_ids(log: DataFrame) -> DataFrame:
    return latest(log).filter(F.col("cmd") == "delete").select("id", "log_index")


def replay(snapshot: DataFrame, log: DataFrame, snapshot_index: int) -> DataFrame:
    """State from a snapshot (id, value, log_index) and the commands after its index."""
    tail = latest(log.filter(F.col("log_index") > snapshot_index)).select("id", F.col("log_index").alias("i2"), "cmd", F.col("value").alias("v2"))
    both = snapshot.join(tail, "id", "full")
    live = both.filter(F.col("cmd").isNull() | (F.col("cmd") != "delete"))
    new = F.col("i2").isNotNull()
    return live.select("id", F.when(new, F.col("v2")).otherwise(F.col("value")).alias("value"), F.when(new, F.col("i2")).otherwise(F.col("log_index")).alias("log_index"))


def first_requests(log: DataFrame) -> DataFrame:
    """Request-id idempotency: the first command of each request id stays; empty ids are never duplicates."""
    named = log.filter(F.col("request_id") != "")
    first = named.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in log.columns if c != "request_id"]), "log_index").alias("r"))
    rest = log.filter((F.col("request_id") == "") | F.col("request_id").isNull())
    return first.select("request_id", "r.*").select(*log.columns).unionByName(rest)


def last_window(log: DataFrame, size: int) -> DataFrame:
    """The newest ``size`` request ids by first occurrence, in insertion order."""
    first = log.filter(F.col("request_id") != "").groupBy("request_id").agg(F.min("log_index").alias("log_index"))
    return first.orderBy(F.desc("log_index")).limit(size)


def windowed_requests(log: DataFrame, size: int) -> DataFrame:
    """Exact bounded window: a repeat is refused only while its id is among the newest ``size`` accepted ids. One ordered pass."""

    def run(pdf):
        from collections import OrderedDict

        seen: OrderedDict = OrderedDict()
        keep = []
        for r in pdf.sort_values("log_index")["request_id"]:
            fresh = r == "" or r not in seen
            keep.append(fresh)
            if fresh and r != "":
                seen[r] = True
                if len(seen) > size:
                    seen.popitem(last=False)
        return pdf.sort_values("log_index")[keep]

    one = log.withColumn("__one", F.lit(1))
    return one.groupBy("__one").applyInPandas(run, one.schema).drop("__one")


def read_from(log: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """Entries from ``start`` on, in order, at most ``most``."""
    out = log.filter(F.col("log_index") >= start)
    return out.orderBy("log_index").limit(most) if most is not None else out


def valid_prefix(log: DataFrame, valid: Column) -> DataFrame:
    """All entries before the first invalid one."""
    first = log.filter(~valid).agg(F.min("log_index").alias("bad"))
    return log.crossJoin(F.broadcast(first)).filter(F.col("bad").isNull() | (F.col("log_index") < F.col("bad"))).drop("bad")


def truncate_suffix(log: DataFrame, start: int) -> DataFrame:
    return log.filter(F.col("log_index") < start)


def truncate_before(log: DataFrame, index: int) -> DataFrame:
    """Drop whole segments that end before ``index``; log has a segment column."""
    ends = log.groupBy("segment").agg(F.max("log_index").alias("last")).filter(F.col("last") >= index).select("segment")
    return log.join(ends, "segment", "left_semi")


def numbered(rows: DataFrame, by: str, width: int = 1 << 16) -> DataFrame:
    """rows with ``number``, their place from 0 in the order of the long column ``by``. Rows are counted by blocks of values, so no task orders them all."""
    block = F.floor(F.col(by) / width)
    upto = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = rows.withColumn("block", block).withColumn("inside", F.row_number().over(W.partitionBy("block").orderBy(by)))
    return inside.join(before, "block").select(*rows.columns, (F.col("before") + F.col("inside") - 1).alias("number"))


def overwrite_suffix(log: DataFrame, leader: DataFrame) -> DataFrame:
    """A follower's log after the leader's entries: from the first index where both have an entry of another term on, its own entries go; new ones are appended."""
    theirs = leader.select(F.col("log_index").alias("i"), F.col("term").alias("t"))
    both = log.join(theirs, F.col("log_index") == F.col("i"), "left")
    first = both.filter(F.col("i").isNotNull() & (F.col("t") != F.col("term"))).agg(F.min("log_index").alias("bad"))
    kept = log.crossJoin(F.broadcast(first)).filter(F.col("bad").isNull() | (F.col("log_index") < F.col("bad"))).drop("bad")
    new = leader.join(kept.select(F.col("log_index").alias("k")), F.col("log_index") == F.col("k"), "left_anti")
    return kept.unionByName(new.select(*log.columns))


def resolve_conflicts(log: DataFrame) -> DataFrame:
    """Of entries with equal index the highest term stays."""
    best = log.groupBy("log_index").agg(F.max_by(F.struct(*[c for c in log.columns if c != "log_index"]), "term").alias("r"))
    return best.select("log_index", "r.*").select(*log.columns)


def term_at(log: DataFrame, indexes: DataFrame) -> DataFrame:
    return indexes.join(log.select("log_index", "term"), "log_index", "left")


def batches(log: DataFrame, most: int = 64) -> DataFrame:
    """log_index, batch: entries in order in batches of ``most``, whatever gaps their indexes have."""
    return numbered(log.select("log_index"), "log_index").select("log_index", F.floor(F.col("number") / most).cast("long").alias("batch"))


def commit_index(acks: DataFrame, log: DataFrame | None = None, term: int | None = None) -> DataFrame:
    """One row: the largest index acknowledged by a majority of nodes. acks: node, match_index.

    With a log (log_index, term) and the current term, the largest such index whose entry is of that term, null if there is none.
    """
    # of n values, the one with n // 2 before it from the top is the lower median
    most = acks.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY match_index)").cast("long").alias("commit_index"))
    if log is None:
        return most
    own = log.filter(F.col("term") == term).select("log_index")
    return own.crossJoin(F.broadcast(most)).filter(F.col("log_index") <= F.col("commit_index")).agg(F.max("log_index").alias("commit_index"))


def vote_majority(votes: DataFrame) -> DataFrame:
    """term, granted, elected. votes: term, node, granted."""
    out = votes.groupBy("term").agg(F.count_if("granted").alias("granted"), F.count(F.lit(1)).alias("n"))
    return out.select("term", "granted", (F.col("granted") >= F.floor(F.col("n") / 2) + 1).alias("elected"))


def snapshot_points(log: DataFrame, threshold: int) -> DataFrame:
    """log_index of entries at which a snapshot is due: where the index is more than ``threshold`` past that of the last snapshot, at first 0.

    Each point depends on the one before, so one task passes over the ordered indexes; it holds a batch of them at a time.
    """

    def run(batches):
        import pyarrow as pa

        last = 0
        for batch in batches:
            index, due, at = batch.column(0).to_numpy(), [], 0
            while (at := int(index.searchsorted(last + threshold, side="right"))) < len(index):
                last = int(index[at])
                due.append(last)
            yield pa.RecordBatch.from_arrays([pa.array(due, pa.int64())], ["log_index"])

    ordered = log.filter(F.col("log_index").isNotNull()).select(F.col("log_index").cast("long")).orderBy("log_index")
    return ordered.coalesce(1).mapInArrow(run, "log_index long")


def request_outcomes(log: DataFrame, committed: int, size: int | None = None) -> DataFrame:
    """request_id, log_index, committed, success, error of each request id: what a repeat of it is answered with.

    log: log_index, request_id and, of applied entries, success and error. An entry past ``committed`` is pending, without an outcome; a
    committed one replaces whatever was stored before, a pending one only what was not there. ``size``: the newest ids by log_index.
    """
    done = F.col("log_index") <= committed
    named = log.filter(F.col("request_id") != "")
    row = lambda *c: F.struct("log_index", *c)
    out = named.groupBy("request_id").agg(
        F.max(F.when(done, row("success", "error"))).alias("last"), F.min(F.when(~done, F.col("log_index"))).alias("first"),
    )
    known = F.col("last").isNotNull()
    out = out.select(
        "request_id", F.coalesce("last.log_index", "first").alias("log_index"), known.alias("committed"),
        (known & F.coalesce("last.success", F.lit(False))).alias("success"), F.when(known, F.coalesce("last.error", F.lit(""))).otherwise("").alias("error"),
    )
    return out if size is None else out.orderBy(F.desc("log_index"), "request_id").limit(size)


def outcome_snapshot(outcomes: DataFrame) -> DataFrame:
    """The committed outcomes in the order of a snapshot: by log_index, then request_id."""
    return outcomes.filter("committed").select("request_id", "log_index", "success", "error").orderBy("log_index", "request_id")


def slot_counters(log: DataFrame, blocks: int = 1 << 16) -> DataFrame:
    """log_index, event, free, slots: slots freed by deletes and taken again by later inserts, as running aggregates.

    event is 1 for an insert of an id that is not live, -1 for a delete of one that is, 0 else. An insert takes a free slot if there is one.
    """
    by_id = W.partitionBy("id").orderBy("log_index")
    before = F.coalesce(F.lag("cmd").over(by_id), F.lit("delete"))
    event = F.when((F.col("cmd") != "delete") & (before == "delete"), 1).when((F.col("cmd") == "delete") & (before != "delete"), -1).otherwise(0)
    rows = log.select("log_index", event.cast("long").alias("event"), F.floor(F.col("log_index") / blocks).alias("block"))
    # live(t) is the running sum; slots(t) its running maximum, as a new slot is made only when none is free
    inside = W.partitionBy("block").orderBy("log_index").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("here", F.sum("event").over(inside)).withColumn("top", F.max("here").over(inside))
    ends = rows.groupBy("block").agg(F.sum("event").alias("sum"), F.max("here").alias("high"))
    past = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("live", F.coalesce(F.sum("sum").over(past), F.lit(0)))
    ends = ends.withColumn("most", F.coalesce(F.max(F.col("live") + F.col("high")).over(past), F.lit(0))).select(F.col("block").alias("b"), "live", "most")
    slots = F.greatest("most", F.col("live") + F.col("top"), F.lit(0))
    return rows.join(ends, F.col("block") == F.col("b")).select("log_index", "event", (slots - F.col("live") - F.col("here")).alias("free"), slots.alias("slots"))


def retry_backoff(attempt: Column, base_ms: int = 50, max_ms: int = 2000) -> Column:
    return F.least(F.lit(float(max_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt)).cast("long")


def running_mean(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.avg(value).over(w))


def assign_topology(nodes: DataFrame) -> DataFrame:
    """node_id, role, source for the healthy peers of a leader: the first half mentors under it, the i-th other follows the i-th mentor."""
    r = nodes.select("node_id", F.row_number().over(W.orderBy("node_id")).alias("r"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("n"))
    r = r.withColumn("half", F.ceil(F.col("n") / 2))
    mentors = r.filter(F.col("r") <= F.col("half")).select(F.col("node_id").alias("mentor"), F.col("r").alias("mr"))
    out = r.join(mentors, F.col("r") - F.col("half") == F.col("mr"), "left")
    mentor = F.col("r") <= F.col("half")
    return out.select("node_id", F.when(mentor, "mentor").otherwise("follower").alias("role"), F.when(mentor, "leader").otherwise(F.col("mentor").cast("string")).alias("source"))
