"""Shared folder, table writing and skew-safe joins for the corpus operators."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_plumbline_shared", None)
        if not path:
            path = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
            spark._plumbline_shared = path
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage: survives lost executors."""
    spark = df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, qualified with its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = files.makeQualified(path).toString()
    return f"file://{text[5:]}" if text.startswith("file:/") and not text.startswith("file://") else text


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """An existing path goes when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


_scopes: list[dict[str, SparkSession]] = [{}]
_swept = [0.0]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scope:
    """Scratch tables written inside go when it ends, but those kept: they pass to the scope around it."""

    def __enter__(self) -> Scope:
        _scopes.append({})
        self.kept: set[str] = set()
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t.scratch_path for t in tables}

    def __exit__(self, kind, *_) -> None:
        own = _scopes.pop()
        for path, spark in own.items():
            if path in self.kept or kind is not None:
                _scopes[-1][path] = spark
            else:
                _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Scratch tables that nothing reads any more go before the operator ends."""
    for path in [t.scratch_path for t in tables]:
        for own in _scopes:
            if spark := own.pop(path, None):
                _delete(spark, path)


def release(spark: SparkSession, in_use: DataFrame) -> None:
    """Scratch tables that finished operators left for their results go, but those that ``in_use`` reads."""
    read = [f.replace("file:///", "file:/") for f in in_use.inputFiles()] if _scopes[0] else []
    for path in list(_scopes[0]):
        plain = path.replace("file:///", "file:/")
        if not any(f.startswith(f"{plain}/") for f in read):
            if _scopes[0].pop(path) is spark:
                _delete(spark, path)


def _sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; it learns of them when the JVM collects garbage."""
    if time.monotonic() - _swept[0] > 3:
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()


#: Whether the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read it back. The shuffle files of the write go with its end, as nothing else can read them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    drop_at_exit(spark, path)
    _scopes[-1][path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _sweep(spark)
    return out


def respread(df: DataFrame) -> DataFrame:
    """Break an aggregate's partitioning, so that a following join deals both sides anew and AQE can split hot keys."""
    return df.repartition(shuffle_partitions(df.sparkSession))


def gathered(df: DataFrame) -> DataFrame:
    """As ``respread`` for rows that are few or small, without moving them: a task goes through up to sixteen partitions, as long as every core has two tasks."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 16))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


class Sieve:
    """A bitmap of the hashes of some values, to leave most other rows out before they are shuffled.

    It has about eight bits a value, 64 MB at most, whatever the number of values: that bounds what is broadcast. Rows whose value is
    among them always pass; the exact join that follows decides about the others that do.
    """

    SIDE, MOST = 32_768, 1 << 29

    def __init__(self, values: DataFrame):
        (name,) = values.columns
        wanted = 8 * max(self.SIDE, values.count())
        self.bits = min(self.MOST, 1 << (wanted - 1).bit_length())
        place = self._place(F.col(name))
        bits = values.groupBy(F.floor(place / self.SIDE).cast("long").alias("at")).agg(F.bitmap_construct_agg(place % self.SIDE).alias("bits"))
        self.table = table(bits, "sieve")

    def _place(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value, F.lit(17)), F.lit(self.bits))

    def _marked(self, df: DataFrame, value: Column) -> DataFrame:
        at, bits = unused(df, "sieve_at"), unused(df, "sieve_bits")
        place = self._place(value)
        joined = df.join(F.broadcast(self.table.select(F.col("at").alias(at), F.col("bits").alias(bits))), F.floor(place / self.SIDE) == F.col(at), "left")
        byte = F.conv(F.hex(F.substring(bits, (F.floor(place % self.SIDE / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return joined.withColumn(at, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))

    def passed(self, df: DataFrame, value: Column, through: bool = True) -> DataFrame:
        """The rows of ``df`` that pass, or those that don't."""
        marked = self._marked(df, value)
        mark = F.col(unused(df, "sieve_at"))
        return marked.filter(mark if through else ~mark).select(*[F.col(f"`{c}`") for c in df.columns])


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
