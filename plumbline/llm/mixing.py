"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target of words: its weight's share of all words, at most ``most`` times its size,
the excess reshared by weight until no source is above. A source first gives as many complete epochs as
its target holds; the rest is drawn without replacement by exponential keys -ln(u)/quality in ascending
order, whole documents until the budget is spent: a document is drawn if at least half of it fits.
u comes from md5 of the doc_id, or of the text where that is null, so reruns agree.

Decisions are made on narrow rows: ids, sources, sizes and keys. What a source draws is a prefix of its rows in key
order, so the decision about a whole document is a comparison with its source's last drawn row, and texts move once
at most, to meet their weights.

No source is sorted in one task. Keys are cut into ranges of the key's own distribution function (uniform
for a given quality), sizes are summed per (source, range), the prefix sums run over ranges,
and only the one range per source where the budget ends is sorted, equal rows of it as one.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in the weight order;
rows repeating a doc_id share its key and are ordered by size, equal rows being
interchangeable; empty tables give empty results; columns of the input that clash with the new ones are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import table

#: Words are runs of bytes other than these separators.
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: str, text: str, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of the id, or of the text where that is null."""
    of_text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), of_text)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, source_size -> the same with target. One row per source comes in; the fill level is found over them all."""
    named = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(named)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    # Sources fill up in the order of cap/weight; the level is where the rest of the words meets the rest of the weights.
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("all", F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    s = s.withColumn("level", F.max("fits").over(every))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(
    df: DataFrame,
    quality: DataFrame | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 7,
    rows_per_range: int = 2000,
    keep: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken; with ``keep``, after the columns of ``df``.

    quality: rows (doc_id, weight) with a positive sampling weight; documents without one have weight 1.
    """
    scale = 1 << 20
    if quality is not None:
        quality = quality.select(F.col("doc_id").alias("q"), F.col("weight").cast("double").alias("w")).filter(F.col("w") > 0).groupBy("q").agg(F.max("w").alias("w"))

    def keyed(*more: Column) -> DataFrame:
        """id, source, size, key, fine of every row: fine is a range number that grows with the key (the distribution function at weight 1)."""
        rows = df.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), words(text).alias("size"), (-F.log(uniform(doc_id, text, seed))).alias("e"), *more)
        rows = rows.join(quality, F.col("id") == F.col("q"), "left") if quality is not None else rows.withColumn("w", F.lit(1.0))
        rows = rows.withColumn("key", F.col("e") / F.coalesce("w", F.lit(1.0)))
        return rows.withColumn("fine", F.floor((1 - F.exp(-F.col("key"))) * scale).cast("long"))

    base = table(keyed().select("id", "source", "size", "key", "fine"), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sizes.select("source", "source_size"), weights, most).join(sizes.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(scale) * F.lit(float(rows_per_range)) / F.col("n"))).cast("long"))
    plan = table(plan.drop("n"), "mix-plan")
    range_ = F.floor(F.col("fine") / F.col("width")).cast("long")

    def with_plan(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(by.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).drop("source2")

    ranges = with_plan(base, plan).groupBy("source", range_.alias("range")).agg(F.sum("size").alias("in_range"), F.first("budget").alias("budget"))
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    ranges = ranges.withColumn("end", F.sum("in_range").over(upto))
    # the range where the budget ends; all before it are drawn whole
    border = ranges.filter(F.col("end") >= F.col("budget")).groupBy("source").agg(F.min(F.struct("range", (F.col("end") - F.col("in_range")).alias("start"))).alias("b"))
    border = border.select(F.col("source").alias("s3"), F.col("b.range").alias("last"), F.col("b.start").alias("start"))
    plan = plan.join(border, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")

    # Equal rows of the border range are one; the last of them that is drawn, and how many of its rows are.
    row = F.struct("key", F.col("id").isNull().alias("none"), "id", "size")
    equal = with_plan(base, plan).filter(range_ == F.col("last")).groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("times"), F.first("start").alias("start"), F.first("budget").alias("budget"))
    before = W.partitionBy("source").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.col("start") - F.coalesce(F.sum(F.col("size") * F.col("times")).over(before), F.lit(0))
    fit = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).otherwise(F.when(left >= 0, F.col("times")).otherwise(0))
    drawn = equal.select("source", row.alias("row"), "times", F.least(F.col("times"), fit).cast("long").alias("fit")).filter(F.col("fit") > 0)
    drawn = drawn.groupBy("source").agg(F.max(F.struct("row", "fit", "times")).alias("d"))
    drawn = drawn.select(F.col("source").alias("s4"), F.col("d.row").alias("end"), F.col("d.fit").alias("fit"), F.col("d.times").alias("times"))
    plan = table(plan.join(drawn, F.col("source").eqNullSafe(F.col("s4")), "left").drop("s4"), "mix-decisions")

    new = {"size", "source_size", "target", "taken"}
    own = [c for c in df.columns if c.lower() not in new] if keep else []
    rows = with_plan(keyed(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")) if keep else base, plan)
    here = (range_ == F.col("last")) & F.col("end").isNotNull()
    split = here & (row == F.col("end")) & (F.col("fit") < F.col("times"))
    whole = F.col("last").isNull() | (range_ < F.col("last")) | (here & (row <= F.col("end")))
    out = rows.withColumn("drawn", whole)
    if not plan.filter(F.col("fit") < F.col("times")).isEmpty():  # equal rows of which only some are drawn
        nth = F.row_number().over(W.partitionBy("source").orderBy("id"))
        out = out.filter(~F.coalesce(split, F.lit(False))).union(rows.filter(split).withColumn("drawn", nth <= F.col("fit")))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("drawn"), 1).otherwise(0))
    head = [F.col(f"row.`{c}`").alias(c) for c in own] if keep else [F.col("id").alias("doc_id")]
    return out.select(*head, "size", "source_size", "target", taken.cast("long").alias("taken"))


def label_quality(labels: DataFrame) -> DataFrame:
    """Weights from 0/1 quality labels: good documents are drawn twice as fast."""
    return labels.filter(F.col("doc_id").isNotNull()).select("doc_id", (1.0 + F.coalesce(F.col("quality"), F.lit(0))).alias("weight"))
