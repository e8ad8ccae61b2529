"""Removal of word windows that an earlier document already holds, behind a count-min prefilter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from answerlens.llm.tables import shuffle_partitions
from answerlens.llm.words import Slice, ids_of, mix, slices, U

WINDOW = 13
#: Documents whose ids agree in all but these low bits travel together.
RANGE_BITS = 10
#: The sketch has two rows of at most this many cells.  Each is merged to one bit, "counted twice or more", so what is
#: broadcast never exceeds 2 * 2^MAX_CELL_BITS / 8 bytes (64 MB); beyond that more windows are estimated
#: repeated and grouped exactly, and none is lost.
MAX_CELL_BITS = 28
MIN_CELL_BITS = 16
CHUNK_BITS = 20
ROWS = 2
FAN_IN = 32
SKETCH_SCHEMA = "row int, chunk int, part int, once binary, twice binary"
SKETCH_ARROW = pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("part", pa.int32()), ("once", pa.binary()),
                          ("twice", pa.binary())])
_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Hash blocks of the exact grouping, for about so many windows each.
BLOCK_WINDOWS = 1 << 20
#: Windows estimated repeated that a task gathers before it sends them.
HELD_WINDOWS = 2_000_000
_LAST = np.iinfo(np.int64).max
#: Ranges from here on hold rows without an id, dealt by their texts; all of them count as document _LAST.
_NO_ID_SPAN = 1 << (63 - RANGE_BITS)
#: Windows of the whole input for each range of rows without an id.
NO_ID_WINDOWS = 1 << 19


def windows(part: Slice, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of ``n`` words."""
    at = part.window_starts(n)
    return at, part.word_spans(at, at + n)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes ^ U(_SEEDS[row])) >> U(64 - bits)).astype(np.int64)


def pack_bits(bits: np.ndarray) -> bytes:
    """A bit map as the gaps between its ones, a byte for each and 255 as "go on", or as it is if that is shorter."""
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    if len(at) >= len(bits):
        return b"\0" + bits.tobytes()
    gaps = np.diff(at, prepend=0)
    end = np.cumsum(gaps // 255 + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 255, np.uint8)
    out[end - 1] = gaps % 255
    return b"\1" + out.tobytes()


def unpack_bits(packed: bytes, size: int) -> np.ndarray:
    """The bit map of ``size`` bytes again."""
    body = np.frombuffer(packed, np.uint8, offset=1)
    if packed[0] == 0:
        return body.copy()
    ones = np.zeros(size * 8, np.uint8)
    ones[np.cumsum(body, dtype=np.int64)[body != 255]] = 1
    return np.packbits(ones, bitorder="little")


class Sketch:
    """A task's count-min counters, saturating at two: one bit for "seen", one for "seen twice"."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        for row in range(ROWS):
            cells = np.sort(_cells(hashes, row, self.bits))
            again = np.zeros(len(cells), bool)
            again[1:] = cells[1:] == cells[:-1]
            byte = cells >> 3
            bit = np.left_shift(np.uint8(1), (cells & 7).astype(np.uint8))
            head = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
            seen = np.bitwise_or.reduceat(bit, head)
            more = np.bitwise_or.reduceat(bit * again, head)
            byte = byte[head]
            self.twice[row, byte] |= more | (self.once[row, byte] & seen)
            self.once[row, byte] |= seen

    def chunks(self) -> Iterator[dict]:
        step = _chunk_bytes(self.bits)
        for row in range(ROWS):
            for k in range(0, self.once.shape[1], step):
                once = self.once[row, k:k + step]
                if once.any():
                    yield {"row": row, "chunk": k // step, "once": pack_bits(once),
                           "twice": pack_bits(self.twice[row, k:k + step])}


def _sketched(bits: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None
        for batch in batches:
            for part in slices(batch.column(0)):
                sketch = sketch or Sketch(bits)
                sketch.add(windows(part, n)[1])
        task = TaskContext.get().partitionId()
        for row in sketch.chunks() if sketch else ():
            yield pa.RecordBatch.from_pylist([row | {"part": task}], SKETCH_ARROW)

    return run


def _chunk_bytes(bits: int) -> int:
    return 1 << min(bits, CHUNK_BITS) - 3


def _merged(bits: int):
    """Sum of the sketches of one chunk, as far as it matters: which cells reach one and two."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros((2, _chunk_bytes(bits)), np.uint8)
        for a, b in zip(frame["once"], frame["twice"]):
            a, b = unpack_bits(a, len(once)), unpack_bits(b, len(once))
            twice |= b | (once & a)
            once |= a
        return pd.DataFrame({
            "row": frame["row"].iloc[:1], "chunk": frame["chunk"].iloc[:1], "part": frame["part"].iloc[:1] // FAN_IN,
            "once": [pack_bits(once)], "twice": [pack_bits(twice)],
        })

    return run


def repeated_cells(texts: DataFrame, bits: int, n: int = WINDOW) -> np.ndarray:
    """The merged sketch of all windows: for each row a bit map of the cells counted twice or more.

    Partition sketches are added up in a tree, chunk by chunk, so no task meets more than FAN_IN of them.
    """
    parts, left = texts.mapInArrow(_sketched(bits, n), SKETCH_SCHEMA), texts.rdd.getNumPartitions()
    while left > 1:
        parts = parts.groupBy("row", "chunk", F.floor(F.col("part") / FAN_IN)).applyInPandas(_merged(bits), SKETCH_SCHEMA)
        left = -(-left // FAN_IN)
    out = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
    step = _chunk_bytes(bits)
    for row, chunk, twice in parts.select("row", "chunk", "twice").collect():  # at most out.nbytes
        out[row, chunk * step:(chunk + 1) * step] = unpack_bits(twice, step)
    return out


def estimated_repeated(cells: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which windows the sketch counts twice or more; true for every window that occurs twice."""
    out = np.ones(len(hashes), bool)
    for row in range(ROWS):
        at = _cells(hashes, row, bits)
        out &= (cells[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def _candidates(cells, bits: int, n: int, blocks: int):
    """Windows estimated repeated, once per range of documents with the first and last id, packed by hash block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, spans = ids_of(batch.column(0)), batch.column(2).to_numpy()
            for part in slices(batch.column(1)):
                at, hashes = windows(part, n)
                flagged = estimated_repeated(cells.value, bits, hashes)
                doc = part.doc[at[flagged]]
                held.append((hashes[flagged], ids[part.lo:part.hi][doc], spans[part.lo:part.hi][doc]))
                if sum(len(h) for h, *_ in held) > HELD_WINDOWS:
                    yield from _packed(held, blocks)
                    held = []
        yield from _packed(held, blocks)

    return run


def _packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, hashes, spans, first, last) of the windows that a task holds, one per block."""
    if not any(len(h) for h, *_ in held):
        return
    h, d, span = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((d, h, span))
    h, d, span = h[order], d[order], span[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (span[1:] != span[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(h)])) - 1
    h, span = h[head], span[head]
    first, last = (x & ((1 << RANGE_BITS) - 1) for x in (d[head], d[tail]))
    block = ((h >> U(40)) % U(blocks)).astype(np.int64)
    order = np.lexsort((span, block))
    block = block[order]
    new = np.ones(len(order), bool)
    new[1:] = block[1:] != block[:-1]
    cut = [*np.flatnonzero(new), len(order)]
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        pick = order[a:b]
        rows.append((int(block[a]), h[pick].tobytes(), span[pick].tobytes(), first[pick].astype("<u2").tobytes(), last[pick].astype("<u2").tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["block", "hashes", "spans", "first", "last"])


def _grouped(frame: pd.DataFrame) -> pd.DataFrame:
    """Exact grouping of a hash block: each range gets back its windows that start earlier elsewhere."""
    h = np.frombuffer(b"".join(frame["hashes"]), U)
    span = np.frombuffer(b"".join(frame["spans"]), np.int64)
    least_id = np.minimum(span, _NO_ID_SPAN - 1) << RANGE_BITS
    first, last = (least_id + np.frombuffer(b"".join(frame[c]), "<u2") for c in ("first", "last"))
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]])))
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(first[order], head), np.diff(np.concatenate((head, [len(h)]))))
    hit = np.flatnonzero(least < last)
    hit = hit[np.argsort(span[hit], kind="stable")]
    h, least, span = h[hit], least[hit], span[hit]
    names, cut = np.unique(span, return_index=True)
    rows = [(k, h[a:b].tobytes(), least[a:b].tobytes()) for k, a, b in zip(names, cut, [*cut[1:], len(h)])]
    return pd.DataFrame(rows, columns=["span", "hashes", "least"])


KEPT_SCHEMA = "n_words long, n_removed long, kept_sha256 string"


def _removed(n: int, with_text: bool, kept_columns: list[str]):
    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(found.column("hashes").to_pylist()), U)
        least = np.frombuffer(b"".join(found.column("least").to_pylist()), "<i8")
        order = np.lexsort((least, h))
        h, least = h[order], least[order]
        ids = ids_of(texts.column("__id").combine_chunks())
        counts, removed, digests, bodies = [], [], [], []
        for part in slices(texts.column("__text")):
            gone = np.zeros(len(part.start), bool)
            if len(h):
                at, hashes = windows(part, n)
                place = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                hit = (h[place] == hashes) & (least[place] < ids[part.lo:part.hi][part.doc[at]])
                gone = part.covered(at[hit], n)
            counts.append(part.n_words)
            removed.append(part.per_doc(gone))
            raw = part.data.tobytes()
            for d in range(part.docs):
                lo, hi = part.first[d], part.first[d + 1]
                keep = np.flatnonzero(~gone[lo:hi]) + lo
                body = b" ".join(raw[a:b] for a, b in zip(part.start[keep].tolist(), part.end[keep].tolist()))
                digests.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    whole = len(keep) == hi - lo
                    bodies.append(texts.column("__text")[part.lo + d] if whole else pa.scalar(body.decode("utf-8")))
        none = [np.zeros(0, np.int64)]
        out = {c: texts.column(c) for c in kept_columns} | {
            "n_words": pa.array(np.concatenate(counts or none)), "n_removed": pa.array(np.concatenate(removed or none)),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if with_text:
            out["kept_text"] = pa.array([b.as_py() for b in bodies], pa.string())
        return pa.table(out)

    return run


def expected_windows(texts: DataFrame) -> int:
    """About as many windows as so much text holds."""
    return (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6


def cell_bits(expected: int) -> int:
    """Three to six cells for each window, within the bound."""
    return min(MAX_CELL_BITS, max(MIN_CELL_BITS, (3 * expected).bit_length()))


def remove_repeats(
    docs: DataFrame, n: int = WINDOW, keep: list[str] | None = None, with_text: bool = False, bits: int | None = None,
) -> DataFrame:
    """Per document the words left after removing windows that start in a document with a smaller doc_id.

    1. Every task counts its windows in a count-min sketch; the merged sketch overestimates each count.
    2. Windows estimated repeated, and only those, are grouped exactly: per range of ids and hash one entry with the
       range's first and last document, so a passage that very many documents share is reduced before the shuffle.
    3. Ranges get back the windows that start earlier, meet their texts and drop the covered words.

    Windows are judged on the input.  A window that recurs only inside one document stays.  ``keep`` names further
    columns to return; ``with_text`` adds ``kept_text``: the text as it was if it lost nothing, else the kept words joined
    by one space.

    Null and empty texts have no words (the digest of the empty string).  A null doc_id counts as larger than all
    others.  Rows that share a doc_id do not remove from each other.  Further columns are ignored.
    """
    spark = docs.sparkSession
    keep = list(dict.fromkeys(["doc_id", *(keep or [])]))
    texts = docs.select("text")
    expected = expected_windows(texts)
    bits = bits or cell_bits(expected)
    cells = spark.sparkContext.broadcast(repeated_cells(texts, bits, n))
    blocks = max(shuffle_partitions(docs), expected // BLOCK_WINDOWS)
    deal = F.pmod(F.xxhash64("text"), F.lit(1 + expected // NO_ID_WINDOWS)) + _NO_ID_SPAN
    span = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), RANGE_BITS), deal)
    found = docs.select("doc_id", "text", span.alias("span")).mapInArrow(
        _candidates(cells, bits, n, blocks), "block long, hashes binary, spans binary, first binary, last binary"
    )
    replies = found.groupBy("block").applyInPandas(_grouped, "span long, hashes binary, least binary")
    inner = [f"__c{k}" for k in range(len(keep))]
    sides = docs.select(
        span.alias("span"), F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"),
        *[F.col(c).alias(a) for c, a in zip(keep, inner)],
    )
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join(f"{a} {k}" for a, k in zip(inner, kinds)) + ", " + KEPT_SCHEMA + ", kept_text string" * with_text
    out = sides.groupBy("span").cogroup(replies.groupBy("span")).applyInArrow(_removed(n, with_text, inner), schema)
    return out.withColumnsRenamed(dict(zip(inner, keep)))
