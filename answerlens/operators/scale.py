"""Building blocks that keep large and skewed groups spread over many tasks.

Small sides are not hinted: Spark broadcasts by the measured size of a side, at runtime with AQE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from answerlens.session import shared_dir


_WRITTEN: list[str] = []


def written() -> list[str]:
    """Folders of the tables materialized so far in this process and not removed."""
    return list(_WRITTEN)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialized tables that nothing reads any more."""
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        if name in _WRITTEN:
            _WRITTEN.remove(name)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame that several consumers read to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and makes later column pruning
    and filter push-down work on Parquet.  Frames built on it stay lazy, so the files are kept until
    they are removed.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/answerlens/{spark.sparkContext.applicationId}"


def with_group_total(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """Add group aggregates as columns: partial aggregation plus a join on the keys.

    Used in place of an unordered window, which would pull a whole group into one task.
    """
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(sums, keys, "left")


# Buckets of a group whose rows are ranked, and sampled rows from which a bucket's borders are taken.
BUCKETS, SAMPLED = 64, 16


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """Exact 1..n rank per group without a single task holding the group.

    ``bucket`` must be monotone in the leading order column.  Rank = rows in earlier buckets of
    the group + row number inside the bucket; only bucket counts meet per group.
    """
    b, base, n = "__bucket", "__base", "__n"
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    local = df.withColumn(out, F.row_number().over(inside))
    return (
        local.join(bases, keys + [b])
        .withColumn(out, (F.col(out) + F.col(base)).cast("long"))
        .drop(b, base)
    )


def ranked_evenly(df: DataFrame, keys: list[str], place: Column, out: str) -> DataFrame:
    """``ranked`` by an ascending order struct, in buckets of about equal size whatever its values.

    The borders are rows of the group, drawn by a hash at a rate that gives about BUCKETS * SAMPLED of
    them however large the group is.  Any borders give exact ranks; the draw only evens the buckets out.
    """
    at = "__place"
    placed = df.withColumn(at, place)
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    rate = F.greatest(F.lit(1), F.floor(F.col("__rows") / (BUCKETS * SAMPLED)))
    drawn = F.pmod(F.xxhash64(at, *keys), rate) == 0
    borders = placed.select(*keys, at).join(counts, keys).filter(drawn).groupBy(*keys).agg(
        F.array_sort(F.collect_list(at)).alias("__drawn")
    ).select(*keys, F.transform(
        F.sequence(F.lit(1), F.lit(BUCKETS - 1)),
        lambda k: F.get("__drawn", F.floor(k * F.size("__drawn") / BUCKETS).cast("int")),
    ).alias("__borders"))
    number = F.size(F.filter("__borders", lambda x: x <= F.col(at)))
    cut = placed.join(borders, keys, "left").withColumn("__no", number).drop("__borders")
    return ranked(cut, keys, [F.col(at)], F.col("__no"), out).drop("__no", at)


def running_max(df: DataFrame, keys: list[str], order: list, bucket: Column, value: str) -> DataFrame:
    """Replace ``value`` by its maximum over the group up to the row, split like ``ranked``.

    ``bucket`` must be monotone in the leading order column.
    """
    b, m = "__bucket", "__before"
    df = df.withColumn(b, bucket)
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, b).agg(F.max(value).alias(m)).select(
        *keys, b, F.max(m).over(earlier).alias(m)
    )
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(value, F.max(value).over(inside))
    return local.join(tops, keys + [b]).withColumn(value, F.greatest(value, m)).drop(b, m)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark prunes to k per map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
