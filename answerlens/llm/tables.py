"""Written intermediates and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerlens.operators.scale import materialize


#: Rows that go to a Python worker at a time.  Texts are long, so the usual 10,000 would be tens of megabytes at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let this session hand texts to Python workers in small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def row_key(columns: list[str]) -> Column:
    """A number for the contents of a row; a null in one column is not a null in another."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each linked node: (node, label), for links (a, b) of longs.

    Alternates the two star steps: every neighbour above a node is tied to the node's smallest
    neighbour, then every neighbour below.  Each step is a min per node and one join, written to the shared folder, so
    hubs of any degree are aggregated before the shuffle and no chain of plans builds up.  It ends when a round
    changes nothing.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")),
                F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            )).alias("e")
        ).select("e.u", "e.v").filter("u > v").distinct()
        edges = materialize(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(edges.select("v", "v").distinct().toDF("node", "label"))
