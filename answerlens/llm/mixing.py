"""Mixing sources to target weights with pivotal dependent rounding."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from answerlens.operators.scale import materialize

WEIGHTS = (5, 2, 1)
MOST = 3.0
SEED = 20_011
#: Documents that one task pairs, and residuals that one node of the reduction tree combines.
CHUNK, FAN_IN = 4096, 256
_EVEN = 1e-9
_NO_ID = -(1 << 63)


def words_in(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to (source, source_size): the weights 5, 2, 1 in turn, at most 3 times a source's size.

    With shares w * level, capped ones give their excess to the rest by weight; the level is raised until nothing is
    above its cap.  Each step is an aggregate of the source table.
    """
    # One row per source, not per document: the order of sources needs no split.
    ordered = sources.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("turn") - 1) % len(WEIGHTS) + 1).cast("int"))
    table = materialize(ordered.select("source", "source_size", "n_docs", weight.alias("weight")))
    cap = MOST * F.col("source_size")
    total, weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total / weights if total else 0.0), None
    while level != before:
        over = cap < F.col("weight") * level
        used, free = table.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        before, level = level, max(level, (total - (used or 0.0)) / free if free else level)
    return table.withColumn("target", F.least(cap, F.col("weight") * level))


def pivot(size: np.ndarray, p: np.ndarray, draw: np.random.Generator) -> int:
    """Round ``p`` in place to zeros and ones by pivotal steps that keep the sum of size * p.

    A step takes two fractional items and moves words from one to the other until one of them is integral; the
    direction is drawn so that each keeps its expectation.  Returns the item left fractional, or -1.
    """
    u = draw.random(len(p))
    i = -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        up_i, down_i = (1 - p[i]) * size[i], p[i] * size[i]
        up_j, down_j = (1 - p[j]) * size[j], p[j] * size[j]
        to_i, to_j = min(up_i, down_j), min(down_i, up_j)
        if u[j] * (to_i + to_j) < to_j:
            p[i] = 1.0 if up_i <= down_j else p[i] + to_i / size[i]
            p[j] = 0.0 if down_j <= up_i else p[j] - to_i / size[j]
        else:
            p[i] = 0.0 if down_i <= up_j else p[i] - to_j / size[i]
            p[j] = 1.0 if up_j <= down_i else p[j] + to_j / size[j]
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return i


def _round(level: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if "n" in frame:
            frame = frame.loc[frame.index.repeat(frame["n"])].drop(columns="n")
        frame = frame.sort_values([c for c in ("key", "size", "row", "p", "chunk") if c in frame], kind="stable")
        source, chunk = frame["source"].iloc[0], int(frame["next"].iloc[0])
        name = zlib.crc32(b"" if source is None else source.encode()) + (source is None)
        draw = np.random.default_rng([SEED, level, chunk, name])
        size, p = frame["size"].to_numpy(np.float64), frame["p"].to_numpy(np.float64).copy()
        left = pivot(size, p, draw)
        if last and left >= 0:
            p[left] = float(draw.random() < p[left])
        return frame.drop(columns="next").assign(p=p, chunk=chunk)

    return run


def dealt(rows: DataFrame, own: list[str]) -> DataFrame:
    """Add ``chunk`` and ``n``: equal rows counted, in numbers of at most CHUNK that go to one chunk after the other.

    Rows without an id and of one size are equal, so their hash alone would send all of them to one chunk.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__all"))
    parts = counted.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__all") - 1) / CHUNK))))
    chunks = F.ceil(F.col("n_docs") / CHUNK).cast("long")
    return parts.select(
        *rows.columns, F.pmod(F.pmod(F.xxhash64("key", "size", *own), chunks) + F.col("__part"), chunks).alias("chunk"),
        F.least(F.lit(CHUNK), F.col("__all") - F.col("__part") * CHUNK).cast("long").alias("n"),
    )


def mix_sources(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """Copies of each document such that every source comes near its target.

    A source's documents all want ``target / source_size`` copies.  The whole part is given; the fractional parts are
    rounded by pivotal steps in chunks of about CHUNK documents, and what a chunk leaves fractional goes up a reduction
    tree, FAN_IN residuals to a node, until one document per source is left and drawn.  Words are moved, so the
    words taken of a source differ from its target by less than one document.  Only ids and sizes are shuffled.

    Null texts have size 0; documents of size 0 draw by themselves and take nothing.  Null sources form the last source.
    Repeated rows are rounded each for itself, those equal in id and size dealt to several chunks.  Equal input gives
    equal output.  Further columns are ignored.
    ``row`` is a long that tells rows of one id, or of none, apart; it is drawn with and returned as ``row``.
    Returns doc_id, source, size, source_size, target, copies, taken.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key")
    own = [] if row is None else ["row"]
    told = [] if row is None else [row.alias("row")]
    sized = materialize(docs.select(
        key, F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), *told
    ))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(sources)
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = dealt(sized.join(
        goal.select(F.col("source").alias("name"), "source_size", "target", "n_docs"), F.col("source").eqNullSafe(F.col("name"))
    ).drop("name"), own)
    whole = F.floor(x + _EVEN)
    rows = rows.select(
        "key", "source", "size", "source_size", "target", whole.cast("long").alias("whole"),
        F.when(x - whole > _EVEN, x - whole).otherwise(F.lit(0.0)).alias("p"),
        "chunk", "n", *own,
    )
    coin = F.pmod(F.xxhash64(F.lit(SEED), F.col("key"), *own), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("p", F.when(F.col("size") == 0, (coin < F.col("p")).cast("double")).otherwise(F.col("p")))
    schema = "key long, source string, size long, source_size long, target double, whole long, p double, chunk long" + ", row long" * len(own)
    done, level, left, step = [], 0, max(1, -(-most // CHUNK)), 1
    while True:
        last = left == 1
        grouped = rows.withColumn("next", F.floor(F.col("chunk") / step)).groupBy("source", "next")
        rounded = materialize(grouped.applyInPandas(_round(level, last), schema))
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rounded.filter(~fractional))
        if last:
            break
        rows, level, left, step = rounded.filter(fractional), level + 1, -(-left // FAN_IN), FAN_IN
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    copies = F.col("whole") + F.col("p").cast("long")
    doc_id = F.when(F.col("key") != _NO_ID, F.col("key")).cast(kind).alias("doc_id")
    return out.select(doc_id, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *own)
