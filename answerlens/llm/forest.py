"""MinHash near-duplicates through an LSH forest: sorted signature orders with common-prefix neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerlens.llm.tables import components, row_key, shuffle_partitions
from answerlens.llm.words import Slice, mix, per_group, slices, U
from answerlens.operators.scale import materialize

SHINGLE = 5
#: Linked when 100 * |A and B| >= SIMILARITY * |A or B|.
SIMILARITY = 75
#: Sorted orders, each by LEVELS minhash values of 16 bits.  Neighbours share at least SHALLOW values: at a similarity
#: of 0.75 a pair does so in one of 24 orders or more with a chance of 1 - (1 - 0.75^4)^24 = 0.9999.
TREES, LEVELS, SHALLOW = 24, 8, 4
#: In a region (documents of one order that share SHALLOW values) of up to this many, all pairs are candidates.
REGION = 16
#: In a denser one each document first meets so many next ones, which share the longest prefixes there.
NEAREST = 2
#: Documents of dense regions on either side of a comparison when what is left is settled.
BLOCK = 512
#: Bits of the cells that count in how many documents of dense regions a shingle is (4 MB).
FREQUENCY_BITS = 20
_SALT = mix(np.arange(1, TREES * LEVELS + 1, dtype=U) * U(0x2545F4914F6CDD1D))


def shingle_sets(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a slice's documents, sorted by document: document, hash, and the number for each."""
    at = part.window_starts(SHINGLE)
    short = np.flatnonzero((part.n_words > 0) & (part.n_words < SHINGLE))
    doc = np.concatenate((part.doc[at], short))
    h = np.concatenate((part.word_spans(at, at + SHINGLE), part.word_spans(part.first[short], part.first[short + 1])))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=part.docs)


def signatures(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """TREES rows of two longs for each set that begins at ``head``: the order's values, 16 bits each, first on top."""
    x = (h >> U(32)).astype(np.uint32)
    out = np.empty((len(head), TREES, 2), np.int64)
    for tree in range(TREES):
        key = np.zeros((len(head), 2), U)
        for level in range(LEVELS):
            salt = int(_SALT[tree * LEVELS + level])
            least = np.minimum.reduceat((x ^ np.uint32(salt >> 32)) * np.uint32(salt & 0xFFFFFFFF | 1), head)
            value = mix(least.astype(U) + U(tree * LEVELS + level)) & U(0xFFFF)
            half = level * 2 // LEVELS
            key[:, half] = (key[:, half] << U(16)) | value
        out[:, tree] = key.view(np.int64)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(1), lower=True):
            doc, h, n, node = _node_of(part)
            used = np.flatnonzero(n)
            keys = np.zeros((part.docs, TREES, 2), np.int64)
            if len(used):
                keys[used] = signatures(h, np.searchsorted(doc, used))
            flat = pa.array(keys.reshape(-1))
            lists = pa.FixedSizeListArray.from_arrays(flat, TREES * 2).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.lo, part.docs), batch.column(2).slice(part.lo, part.docs), pa.array(node),
                 pa.array(n.astype(np.int64)), lists], ["doc_id", "print", "node", "n_shingles", "keys"],
            )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a sorted run; then, with their order, the members of regions that pairs do not exhaust.

    Those are dense regions and the ones at either border of the run, which may go on in another task.
    """
    carry, opened = None, False
    for batch in batches:
        tree, top, node, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(tree):
            continue
        if carry is not None:
            tree, top, node, n = (np.concatenate(x) for x in zip(carry, (tree, top, node, n)))
        new = np.ones(len(tree), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (top[1:] != top[:-1])
        region = np.cumsum(new) - 1
        size = np.bincount(region)[region]
        a, b = [], []
        for step in range(1, REGION):
            at = np.flatnonzero(region[step:] == region[:-step]) if step < len(tree) else np.zeros(0, int)
            if step > NEAREST:
                at = at[size[at] <= REGION]
            few, many = np.minimum(n[at], n[at + step]), np.maximum(n[at], n[at + step])
            at = at[100 * few >= SIMILARITY * many]
            a.append(node[at])
            b.append(node[at + step])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        yield _rows(pairs[:, 0], pairs[:, 1], None)
        left = size > REGION
        if not opened:
            left |= region == 0
            opened = True
        yield _rows(node[left], top[left], tree[left])
        carry = tuple(x[-REGION:] for x in (tree, top, node, n))
    if carry is not None:
        tree, top, node, _ = carry
        last = (tree == tree[-1]) & (top == top[-1])
        yield _rows(node[last], top[last], tree[last])


def _rows(a: np.ndarray, b: np.ndarray, tree: np.ndarray | None) -> pa.RecordBatch:
    trees = pa.nulls(len(a), pa.int32()) if tree is None else pa.array(tree, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), trees], ["a", "b", "tree"])


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of neighbours in the forest, and (node, family) for what the pairs leave open.

    ``nodes`` has node, n_shingles and keys.  The rows of all orders are dealt out by ranges of (order, values, node), so
    a region of any size spreads over tasks.  A family joins dense regions that share a document.
    """
    rows = nodes.select("node", "n_shingles", "keys", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select(
        "tree", F.element_at("keys", F.col("tree") * 2 + 1).alias("top"),
        F.element_at("keys", F.col("tree") * 2 + 2).alias("rest"), "node", F.col("n_shingles").alias("n"),
    )
    order = ["tree", "top", "rest", "node"]
    dealt = rows.repartitionByRange(shuffle_partitions(nodes), *order).sortWithinPartitions(*order)
    found = materialize(dealt.select("tree", "top", "node", "n").mapInArrow(_neighbours, "a long, b long, tree int"))
    pairs = found.filter("tree is null").select("a", "b").distinct()
    open_ = found.filter("tree is not null").select(F.col("a").alias("node"), F.col("b").alias("top"), "tree").distinct()
    first = open_.groupBy("tree", "top").agg(F.min("node").alias("first"))
    families = components(open_.join(first, ["tree", "top"]).select(F.col("node").alias("a"), F.col("first").alias("b")))
    return pairs, families.withColumnRenamed("label", "family")


def _cells(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> U(64 - FREQUENCY_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies of shingles, by cells."""
    cells = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for batch in batches:
        for part in slices(batch.column(0), lower=True):
            cells += np.bincount(_cells(shingle_sets(part)[1]), minlength=len(cells))
    if cells.any():
        rows = cells.reshape(64, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(64)), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "cells"]
        )


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.int64) for x in frame["cells"]], axis=0)
    return pd.DataFrame({"part": frame["part"].iloc[:1], "cells": [total.tobytes()]})


def frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts the shingles of each cell are, together.  Any such table orders shingles; this one by rarity."""
    schema = "part long, cells binary"
    summed = texts.mapInArrow(_counted, schema).groupBy("part").applyInPandas(_added, schema)
    out = np.zeros((64, (1 << FREQUENCY_BITS) // 64), np.int64)
    for part, cells in summed.collect():  # 64 rows
        out[part] = np.frombuffer(cells, np.int64)
    return out.reshape(-1)


def _rarest(shared):
    """The rarest shingles of each document, as many as two similar sets cannot both do without.

    Of n shingles at least ceil(SIMILARITY * n / 100) are in a similar set.  If shingles are in one order for all, the
    first n + 1 minus that number of either set therefore have one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), lower=True):
                doc, h, n = shingle_sets(part)
                order = np.lexsort((h, shared.value[_cells(h)], doc))
                doc, h = doc[order], h[order]
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                pick = place <= (n + -SIMILARITY * n // 100)[doc]
                doc, h = doc[pick], h[pick]
                at = pa.array(doc + part.lo)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(1, 5)), pa.array(n[doc].astype(np.int64)), pa.array(h.view(np.int64))],
                    ["family", "node", "label", "asks", "n", "shingle"],
                )

    return run


def _settled(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Links between a block of open documents of a family and a block of its members, one for each group reached."""
    side = rows.column("side").to_numpy()
    node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
    sets: list[np.ndarray] = []
    for part in slices(rows.column("text"), lower=True):
        _, h, n = shingle_sets(part)
        sets += np.split(h, np.cumsum(n)[:-1])
    members, asking = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    size = np.array([len(sets[k]) for k in members], np.int64)
    a, b = [], []
    if len(members) and len(asking):
        every = np.concatenate([sets[k] for k in members])
        owner = np.repeat(np.arange(len(members)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for k in asking:
            own = sets[k]
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            count = hi - lo
            at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(members))
            near = (100 * common >= SIMILARITY * (len(own) + size - common)) & (label[members] != label[k])
            hit = members[np.flatnonzero(near)]
            hit = hit[np.unique(label[hit], return_index=True)[1]]
            a += [node[k]] * len(hit)
            b += node[hit].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _useful(rare: DataFrame) -> DataFrame:
    """The rows of shingles that lie in two groups, one of them open, with the block of each document.

    Blocks hold documents of like set sizes: a size class spans less than similar sets may differ by, so sizes rule out all
    but neighbouring classes, and a class of many documents is cut into blocks by hash.
    """
    held = rare.groupBy("family", "shingle").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max("asks").alias("open")
    ).filter("open and low < high").select("family", "shingle")
    useful = materialize(rare.join(held, ["family", "shingle"]).withColumn(
        "class", F.floor(F.log("n") / F.log(F.lit(100 / SIMILARITY))).cast("long")
    ))
    blocks = useful.select("family", "class", "node").distinct().groupBy("family", "class").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")
    )
    own = F.shiftleft("class", 40) + F.pmod(F.xxhash64("node"), F.col("blocks"))
    return useful.join(blocks, ["family", "class"]).select("family", "shingle", "node", "label", "asks", "n", own.alias("own"))


def meetings(families: DataFrame, labels: DataFrame, bodies: DataFrame) -> DataFrame:
    """Who is compared: family, block of members, block of open documents (asking), side (1: open), node, label.

    A document outside its family's largest group meets a block only if it shares one of its rarest shingles with a
    member of another group and a fitting size there, and a member comes only if an asking one shares one of its rarest with it.
    Each shingle is reduced to the blocks that hold it first, and a document meets that list in one row for each of its
    shingles, so rows follow the shingles and not the pairs of documents that share them.
    """
    known = families.join(labels, "node", "left").select("family", "node", F.coalesce("label", "node").alias("label"))
    sizes = known.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(
        F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")
    ).filter("most < n").select("family", "largest")
    placed = materialize(known.join(sizes, "family").select(
        "family", "node", "label", (F.col("label") != F.col("largest")).alias("asks")
    ))
    columns = ["family", "block", "asking", "side", "node", "label"]
    if placed.isEmpty():
        none = F.lit(0).cast("long")
        return placed.withColumns({"block": none, "asking": none, "side": F.lit(0)}).select(*columns)
    texts = placed.join(bodies, "node").select("text", "family", "node", "label", "asks")
    shared = families.sparkSession.sparkContext.broadcast(frequencies(texts.select("text")))
    useful = _useful(materialize(texts.mapInArrow(
        _rarest(shared), "family long, node long, label long, asks boolean, n long, shingle long"
    )))

    def ranges(of: Column) -> Column:
        values = [f(F.when(of, F.col(c))).alias(name) for f, c, name in (
            (F.min, "n", "least"), (F.max, "n", "most"), (F.min, "label", "low"), (F.max, "label", "high"),
        )]
        return F.struct(*values)

    tiles = useful.groupBy("family", "shingle", "own").agg(
        ranges(F.lit(True)).alias("all"), ranges(F.col("asks")).alias("open")
    ).groupBy("family", "shingle").agg(F.collect_list(F.struct("own", "all", "open")).alias("tiles"))

    def fitting(side: str) -> Column:
        """Blocks with a document of another group and of a fitting size."""
        def fits(tile: Column) -> Column:
            other = tile[side]
            size = (F.col("n") * SIMILARITY <= other["most"] * 100) & (other["least"] * SIMILARITY <= F.col("n") * 100)
            return F.coalesce(size & ((other["low"] != F.col("label")) | (other["high"] != F.col("label"))), F.lit(False))

        return F.transform(F.filter("tiles", fits), lambda t: t["own"])

    nowhere = F.array().cast("array<bigint>")
    met = useful.join(tiles, ["family", "shingle"]).select(
        "family", "node", "label", "own", F.when(F.col("asks"), fitting("all")).otherwise(nowhere).alias("asked"),
        fitting("open").alias("asking"),
    ).filter("size(asked) > 0 or size(asking) > 0").groupBy("family", "node", "label", "own").agg(
        F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked"),
        F.array_distinct(F.flatten(F.collect_list("asking"))).alias("asking"),
    )
    met = materialize(met)
    open_ = met.select("family", F.explode("asked").alias("block"), F.col("own").alias("asking"), F.lit(1).alias("side"), "node", "label")
    members = met.select("family", F.col("own").alias("block"), F.explode("asking").alias("asking"), F.lit(0).alias("side"), "node", "label")
    return open_.union(members)


def settle(families: DataFrame, labels: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, b) that the candidates of dense regions missed.

    Members of a family outside its largest group are compared exactly with all members of other groups that can be
    similar, block by block.  Two of the largest group need no comparison, since they are together already.
    """
    rows = meetings(families, labels, bodies).join(bodies, "node")
    return rows.groupBy("family", "block", "asking").applyInArrow(_settled, "a long, b long")


def _node_of(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets of a slice and one 64-bit name for each set (0: no words)."""
    doc, h, n = shingle_sets(part)
    node = np.zeros(part.docs, np.int64)
    used = np.flatnonzero(n)
    if len(used):
        head = np.searchsorted(doc, used)
        node[used] = mix(np.add.reduceat(mix(h), head) ^ n[used].astype(U)).view(np.int64)
    return doc, h, n, node


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set that the node stands for."""
    for batch in batches:
        names = [_node_of(part)[3] for part in slices(batch.column(1), lower=True)]
        if names:
            yield batch.filter(pa.array(np.concatenate(names) == batch.column(0).to_numpy()))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets are similar enough."""
    for batch in batches:
        sides = []
        for column in (2, 3):
            sets: list[np.ndarray] = []
            for part in slices(batch.column(column), lower=True):
                _, h, n = shingle_sets(part)
                sets += np.split(h, np.cumsum(n)[:-1])
            sides.append(sets)
        keep = []
        for x, y in zip(*sides):
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            union = len(both) - common
            keep.append(union > 0 and 100 * common >= SIMILARITY * union)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _print() -> Column:
    """What a row is found by: its doc_id and text, so rows that share an id, or have none, stay apart."""
    return F.xxhash64("doc_id", "text").alias("print")


def _worded() -> Column:
    """Whether a text has a word, as in ``words``."""
    return F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _first() -> Column:
    """The smallest row of a group: null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print")).alias("first")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, node and n_shingles, and per node with words its first row and its group's label."""
    texts = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(texts.select("doc_id", "text", _print()).mapInArrow(
        _signed, f"doc_id {kind}, print long, node long, n_shingles long, keys array<bigint>"
    ))
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(
        _first(), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")
    )
    nodes = materialize(nodes.select("node", "first.doc_id", "first.print", "n_shingles", "keys"))
    pairs, families = candidates(nodes)
    pairs = materialize(pairs)
    wanted = pairs.select("a").union(pairs.select("b")).union(families.select("node")).distinct().toDF("node")
    # One text for each node that takes part.
    holders = nodes.select("node", "print").join(wanted, "node", "left_semi")
    bodies = materialize(
        texts.select(_print(), "text").join(holders, "print").select("node", "text")
        .mapInArrow(_own_text, "node long, text string").dropDuplicates(["node"])
    )
    left, right = bodies.toDF("a", "text_a"), bodies.toDF("b", "text_b")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    links = materialize(both.mapInArrow(_confirmed, "a long, b long"))
    labels = components(links.union(settle(families, components(links), bodies)))
    groups = nodes.select("node", "doc_id", "print").join(labels, "node", "left").select(
        "node", "doc_id", "print", F.coalesce("label", "node").alias("label")
    )
    return signed.select("doc_id", "node", "n_shingles"), groups


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document its shingle count, the smallest doc_id of its group and whether it is that one.

    Documents with equal shingle sets form one node.  Nodes are sorted by their minhash values in several orders; the
    candidates are neighbours with a common prefix.  How long the prefix must be adapts to the region: where few
    documents share SHALLOW values all of them are compared, where many do only the closest in the order.  Every
    candidate is confirmed on the full sets, and confirmed links are closed to groups.  In dense regions, what is then
    outside the largest group is compared exactly with all the rest, so density costs no link.

    Documents without words (null or empty) link with nothing and are kept.  Null ids never become a group's
    smallest id while another exists.  Repeated rows fall into one node; each gets its row.  Further columns are ignored.
    """
    members, groups = _grouped(docs)
    least = groups.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = groups.join(least, "label").select("node", "component_id")
    return members.join(found, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group, and every row without words.

    The row that stays has the group's smallest doc_id (null ids last); among rows of that id it is fixed by their
    contents, so it is the same in every run.  Rows that only share a doc_id, or have none, do not touch each other.
    """
    _, groups = _grouped(docs)
    stay = groups.groupBy("label").agg(_first()).select("first.print").distinct()
    # Rows of equal id and text become one before they meet the choice, so no number of copies lands in one task.
    row = F.min_by(F.struct(*docs.columns), row_key(docs.columns)).alias("row")
    one = docs.filter(_worded()).groupBy(_print()).agg(row)
    # The prints grow with the documents, so they are merged at every size and never broadcast.
    kept = one.join(stay.hint("merge"), "print").select("row.*")
    return kept.union(docs.filter(~_worded()))
