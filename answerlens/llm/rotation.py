"""Near-duplicate vectors through randomly rotated binary codes with correction factors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from answerlens.llm.tables import components
from answerlens.operators.scale import materialize

THRESHOLD = 0.93
SEED = 7_919
#: Half width of the confidence bound, in standard errors of the estimate.
WIDTH = 4.0
#: Groups of up to this many distinct vectors are compared whole; larger ones are cut by bits of the codes.
WHOLE_GROUP = 16_384
BUCKET = 2_048
#: Chance to miss a pair at the threshold when a group is cut.
MISS = 1e-5
BLOCK = 1_024


def rotation(dim: int) -> np.ndarray:
    """Random rotation of ``dim`` dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their sign bits, and the correction: the inner product of vector and code direction."""
    turned = unit @ rotation(unit.shape[1])
    return turned, turned >= 0, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def bounds(bits: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors (rows) with rotated ones (columns), and the half width per row.

    The code direction has inner product ``factor`` with its vector, so <code, other> / factor is unbiased over
    rotations; its error shrinks with the dimension.
    """
    dim = bits.shape[1]
    code = np.where(bits, 1.0, -1.0) / math.sqrt(dim)
    estimate = (code @ turned.T) / factor[:, None]
    error = WIDTH * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    return estimate, error[:, None]


def tables_for(n: int, threshold: float = THRESHOLD, whole: int = WHOLE_GROUP) -> tuple[int, int]:
    """Bits of a key and number of keys for a group of ``n`` vectors.

    Two vectors at the threshold differ in a sign bit with the chance angle / pi.
    """
    if n <= whole:
        return 0, 1
    bits = min(24, math.ceil(math.log2(n / min(BUCKET, whole))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-share))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)  # keeps squares within range
    vectors = vectors / scale
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give equal vectors of a label one 64-bit name; rows that link with nothing get none."""
    for batch in batches:
        names, dims = [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2)):
            name = dim = None
            if label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(values).all() and values.any():
                    dim = len(values)
                    text = str(label).encode() + b"|" + values.tobytes()
                    name = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
            names.append(name)
            dims.append(dim)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.int64()), pa.array(dims, pa.int32())],
            ["vec_id", "label", "vector", "node", "dim"],
        )


def _keyed(whole: int):
    """Keys of each vector in its group's tables: bits of the code under further permutations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, sizes = (batch.column(k).to_numpy() for k in (3, 4))
            out: list[list[int] | None] = [None] * len(batch)
            for dim, size in {*zip(dims.tolist(), sizes.tolist())}:
                rows = np.flatnonzero((dims == dim) & (sizes == size))
                bits, tables = tables_for(size, whole=whole)
                unit = _unit(_matrix(batch.column(2).take(pa.array(rows))))
                keys = np.zeros((len(rows), tables), np.int64)
                draw = np.random.default_rng([SEED, dim, bits])
                for t in range(tables if bits else 0):
                    # Fresh directions, so that tables do not share bits however few dimensions there are.
                    side = unit @ draw.normal(size=(dim, bits)) >= 0
                    keys[:, t] = side @ (1 << np.arange(bits, dtype=np.int64))
                for row, own in zip(rows.tolist(), keys.tolist()):
                    out[row] = own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(5),
                 pa.array(out, pa.list_(pa.int64()))], ["node", "label", "vector", "dim", "copies", "keys"],
            )

    return run


def _compared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket: for each vector its links, and its smallest partner reached here."""
    at = key[2].as_py()
    left = pc.equal(table.column("side"), 0)
    same = key[4].as_py() == key[5].as_py()
    sides = [table.filter(left)]
    sides.append(sides[0] if same else table.filter(pc.invert(left)))
    node, copies, keys, unit = [], [], [], []
    for side in sides:
        side = side.combine_chunks()
        node.append(side.column("node").to_numpy())
        copies.append(side.column("copies").to_numpy())
        if not len(side):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        keys.append(_lists(side.column("keys"), np.int64))
        unit.append(_unit(_lists(side.column("vector"), np.float64)))
    _, bits, factor = encode(unit[0])
    turned = unit[1] @ rotation(unit[1].shape[1])
    estimate, error = bounds(bits, factor, turned)
    i, j = np.nonzero(estimate + error >= THRESHOLD)
    if same:
        i, j = i[i < j], j[i < j]
    exact = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 18):
        a, b = i[k:k + (1 << 18)], j[k:k + (1 << 18)]
        exact[k:k + (1 << 18)] = np.einsum("ij,ij->i", unit[0][a], unit[1][b]) >= THRESHOLD
    i, j = i[exact], j[exact]
    fresh = np.ones(len(i), bool)
    for t in range(at):  # a pair counts in the first table in which it shares a bucket
        fresh &= keys[0][i, t] != keys[1][j, t]
    i, j = i[fresh], j[fresh]
    if same:
        names = node[0]
        links = np.bincount(i, copies[0][j], len(names)) + np.bincount(j, copies[0][i], len(names))
    else:
        names = np.concatenate(node)
        links = np.concatenate((
            np.bincount(i, copies[1][j], len(node[0])), np.bincount(j, copies[0][i], len(node[1])),
        ))
        j = j + len(node[0])
    root = np.arange(len(names))
    rank = np.argsort(np.argsort(names))
    label = rank.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    by_rank = np.sort(names)
    root = by_rank[label]
    hit = links > 0
    return pa.table({
        "node": pa.array(names[hit]), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array(root[hit]),
    })


def _lists(column: pa.ChunkedArray, kind) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy().astype(kind)
    return flat.reshape(len(column), -1)


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", whole: int = WHOLE_GROUP,
) -> DataFrame:
    """Per vector the number of others with equal label and cosine >= THRESHOLD, its group and whether it is kept.

    Equal vectors of a label form one node with a number of copies, so copies are never paired.  Within a label the
    nodes of a bucket are compared block by block: rotated sign codes with their correction factor estimate each inner
    product, and where the upper confidence bound reaches the threshold the cosine is recomputed in double precision.
    A label with up to ``whole`` distinct vectors is one bucket; a larger one is cut by sign bits in so many
    tables that a pair at the threshold is missed with a chance of MISS.  Blocks give back link counts and the
    smallest partner reached, never pairs.

    Null, empty, zero vectors and those with null or non-finite components, and rows without label, have no links and
    are their own group.  Vectors of different length never link.  Rows that share an id are
    rows of their own.  Further columns are ignored.
    """
    kind, of = vectors.schema[id_column].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    element = vectors.schema[vector_column].dataType.simpleString()
    named = materialize(
        vectors.select(F.col(id_column).alias("vec_id"), "label", F.col(vector_column).alias("vector"))
        .mapInArrow(_named, f"vec_id {kind}, label {of}, vector {element}, node long, dim int")
    )
    nodes = materialize(named.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.first("dim").alias("dim"),
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"),
    ))
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    sized = nodes.join(sizes, ["label", "dim"]).select("node", "label", "vector", "dim", "size", "copies")
    keyed = materialize(
        sized.mapInArrow(_keyed(whole), f"node long, label {of}, vector {element}, dim int, copies long, keys array<bigint>")
    )
    spread = keyed.select("*", F.posexplode("keys").alias("t", "key"))
    group = ["label", "dim", "t", "key"]
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    counts = spread.groupBy(*group).agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Each pair of blocks meets once: a row goes to its own block against every block.
    placed = spread.join(counts, group).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        *group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "vector", "keys",
    )
    met = placed.groupBy(*group, "x", "y").applyInArrow(_compared, "node long, links long, root long")
    links = materialize(met)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    tied = nodes.select("node", "copies", "least").join(labels, "node", "left").join(degree, "node", "left").select(
        "node", "least", F.coalesce("label", "node").alias("name"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    least = tied.groupBy("name").agg(F.min("least").alias("component_id"))
    found = tied.join(least, "name").select("node", "n_links", "component_id")
    return named.select("vec_id", "node").join(found, "node", "left").select(
        F.col("vec_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
