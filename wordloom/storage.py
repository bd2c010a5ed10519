"""Shared-folder storage: cutting lineage, bounded joins and distributed running sums.

Everything here works on a cluster whose executors share only the folder that
``spark.checkpoint.dir`` names; nothing is written to a machine-local folder there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructField, StructType

#: Used only by a local master whose session names no shared folder (tests, the bench).
LOCAL_FALLBACK = "/tmp/checkpoints/wordloom"
#: A side is broadcast only when its counted rows and measured bytes stay at or under these.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20
#: Keys of so many rows are dealt to several tasks, and at most so many keys are (a proven bound).
HOT_ROWS, HOT_KEYS = 256, 20_000
#: Rows of a range, about, where rows are dealt by range; their number follows the counted rows.
ROWS_PER_RANGE = 200_000
#: Of stored input, where each text becomes many rows: bytes of a partition. Unknown sizes count as at least UNKNOWN_BYTES.
BYTES_PER_PART, UNKNOWN_BYTES = 2 << 20, 1 << 50


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see; an error where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/wl-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`shared_path` once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and later uses
    read columns and row groups selectively instead of recomputing.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialize` that nothing reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table._shared_path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> Iterator[None]:
    """Within it, Arrow batches hold at most so many rows and bytes; the session's own settings come back after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sortable(df: DataFrame) -> list[Column]:
    """All columns as values that can be compared: those that hold maps, variants or intervals as JSON text."""
    plain = lambda t: not any(x in t.simpleString() for x in ("map<", "variant", "interval"))
    return [F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) for f in df.schema]


def _bytes(field: StructField) -> Column:
    """About how many bytes a value takes: the length of texts and of bytes, of nested values as JSON."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
        return F.greatest(F.size(c), F.lit(0)) * 8
    if isinstance(kind, (ArrayType, StructType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("v")))), F.lit(0))
    return F.lit(8)


def is_small(table: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table has at most so many rows and bytes."""
    if table.limit(limit + 1).count() > limit:
        return False
    total = sum((_bytes(f) for f in table.schema), F.lit(0))
    return (table.agg(F.sum(total.cast("long"))).first()[0] or 0) <= size


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
               limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Join on ``keys``, broadcasting ``small`` only after counting its rows and bytes.

    ``small`` must be materialised already. Beyond the limits the join stays a
    shuffle join, which adaptive execution splits where a key is hot.
    """
    return big.join(F.broadcast(small) if is_small(small, limit, size) else small, keys, how)


def hot_keys(table: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame | None:
    """``key, deals`` of the keys of a materialised table that have many rows; null if none has.

    Many is ``least`` rows or a 20,000th of the table, whichever is more, so 20,000 keys at most are hot.
    ``deals`` is the number of tasks' worth of rows.
    """
    counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    least = max(least, -(-table.count() // HOT_KEYS))
    hot = counts.filter(F.col("rows") > least).select(key, F.ceil(F.col("rows") / least).cast("int").alias("deals"))
    hot = materialize(hot, "hot-keys")
    return None if hot.isEmpty() else hot


def join_dealt(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, spread: Column, how: str = "inner") -> DataFrame:
    """Join on ``key`` where ``many`` has the :func:`hot_keys` ``hot``: rows of a hot key are dealt by ``spread``
    to several tasks, and those of ``one`` with that key are repeated for each."""
    if hot is None:
        return many.join(one, key, how)
    deals = F.coalesce("deals", F.lit(1))
    dealt = many.join(F.broadcast(hot), key, "left").withColumn("__deal", F.pmod(F.xxhash64(spread), deals).cast("int")).drop("deals")
    copies = one.join(F.broadcast(hot), key, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return dealt.join(copies, [key, "__deal"], how).drop("__deal")


def join_skewed(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join on ``key``, of which ``many`` may have any number of rows and ``one`` has one; both are materialised.

    ``one`` is broadcast if it is small; else hot keys are dealt to several tasks by ``spread``.
    """
    if is_small(one):
        return many.join(F.broadcast(one), key, how)
    return join_dealt(many, one, key, hot_keys(many, key), spread, how)


def dealt_fine(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to partitions that hold about 2 MB each of what ``stored``, the tables it comes from, takes as files.

    For rows that grow manifold afterwards: adaptive execution joins partitions by the bytes that were shuffled, which
    says nothing of the rows to come, and leaves these as they are. Where Spark doesn't know the size, its own number stays.
    """
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        return df.repartition(key)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // BYTES_PER_PART)), key)


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, in order; ``df`` is materialised.

    Rows are dealt to ranges of group and order, which split any group and even rows that are all
    alike; the sums of the ranges are added up, a few rows for each group, and each row adds the
    running sum inside its own range. Rows alike in order come in any order.
    """
    part, tie, total, base = (f"__{out}_{x}" for x in ("part", "tie", "total", "base"))
    ranges = max(-(-df.count() // ROWS_PER_RANGE), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *group, *order, tie)
                        .withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*group, part).agg(F.sum(value).alias(total))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sums.select(*group, part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base)), "bases")
    inside = Window.partitionBy(*group, part).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (join_small(dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))), bases, [*group, part])
            .withColumn(out, F.col(base) + F.col(out)).drop(base, part, tie))
