"""Packing documents into token sequences by length patterns fitted with non-negative least squares."""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerlens.llm.words import Slice, slices, U
from answerlens.operators.scale import materialize, ranked

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Lengths are rounded up to this many bins when patterns are fitted.
BINS = 512
#: Token ids of distinct words that one Python worker remembers.
REMEMBERED = 3_000_000
#: Pieces of one length are numbered in buckets.
BUCKET_ROWS = 4096
#: Bytes of text for which words are looked up together.
SLICE = 2 << 20
_TOGETHER = 50
_MARK, _MARK_ID = "<|endoftext|>", 49407


class WordTokens:
    """Token ids of words, looked up by hash; words not seen yet go through the tokenizer.

    This tokenizer never joins characters across white space, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each worker its core
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has.

        Words go in groups, each followed by the mark that ends a text; words that may hold a mark go by themselves.
        """
        odd = [k for k, w in enumerate(words) if "<|" in w]
        plain = [w for w in words if "<|" not in w] if odd else words
        groups = [_MARK.join(plain[k:k + _TOGETHER]) + _MARK for k in range(0, len(plain), _TOGETHER)]
        coded = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.array([i for e in coded for i in e.ids], np.uint16)
        ends = np.flatnonzero(ids == _MARK_ID)
        size = np.diff(ends, prepend=-1) - 1
        ids = np.delete(ids, ends)
        if odd:
            own = [self.tokenizer.encode(words[k], add_special_tokens=False).ids for k in odd]
            at = np.cumsum(size) - size
            every, place = [], 0
            for k, x in zip(odd, own):  # back among the plain ones
                upto = k - len(every) // 2
                every += [ids[at[place] if place < len(at) else len(ids):at[upto] if upto < len(at) else len(ids)], np.array(x, np.uint16)]
                place = upto
            every.append(ids[at[place] if place < len(at) else len(ids):])
            ids = np.concatenate(every)
            size = np.insert(size, [k - j for j, k in enumerate(odd)], [len(x) for x in own])
        return ids, size

    def of(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of ids of each word of the slice; ``self.ids`` holds them."""
        if len(self.known) > REMEMBERED:
            self.forget()
        order = np.argsort(part.word_hash)
        ranked = part.word_hash[order]
        head = np.ones(len(order), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        unique, first = ranked[head], order[head]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(head) - 1
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != unique[inside]
        if new.any():
            raw = part.data.tobytes()
            ids, size = self._encode([
                raw[a:b].decode("utf-8", "replace")
                for a, b in zip(part.start[first[new]].tolist(), part.end[first[new]].tolist())
            ])
            at = self.used + np.cumsum(size) - size
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.ids[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            self.known = np.insert(self.known, place[new], unique[new])
            self.at = np.insert(self.at, place[new], at)
            self.size = np.insert(self.size, place[new], size)
            place += np.cumsum(new) - new  # both are sorted, so each moved up by the new ones before it
        return self.at[place][inverse], self.size[place][inverse]

    def documents(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's documents, each ended by id 0, and where each document begins (and the end)."""
        at, size = self.of(part)
        words = np.concatenate(([0], np.cumsum(size)))
        before = words[:-1]
        source = np.repeat(at - before, size) + np.arange(words[-1])
        out = np.zeros(words[-1] + part.docs, np.uint32)
        doc_of_token = np.repeat(part.doc, size)
        out[np.arange(words[-1]) + doc_of_token] = self.ids[source]
        return out, words[part.first] + np.arange(part.docs + 1)


_TOKENS: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, WordTokens(path))
        for batch in batches:
            for part in slices(batch.column(1), limit=SLICE):
                ids, begin = tokens.documents(part)
                total = np.diff(begin)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(part.docs), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                place = (begin[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(place.tolist(), (place + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, part.docs).take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def few_document_patterns(bins: int) -> np.ndarray:
    """All ways to fill ``bins`` with up to three lengths, largest first (0: no document)."""
    a, b = np.meshgrid(np.arange(1, bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    good = (b <= a) & (c >= 0) & (c <= b)
    return np.stack((a[good], b[good], c[good]), 1)


def fit_patterns(patterns: np.ndarray, histogram: np.ndarray, group: int = 16, rounds: int = 400) -> dict[int, float]:
    """Non-negative least squares by an active set: repeat counts of patterns that come near the histogram.

    ``histogram[k]`` counts documents of k bins; entry 0 is ignored.  Each round admits the patterns that promise most,
    solves for the admitted ones and drops those that would turn negative.
    """
    want = histogram.astype(float).copy()
    want[0] = 0.0

    def columns(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(want), len(rows)))
        for k in range(patterns.shape[1]):
            np.add.at(out, (patterns[rows, k], np.arange(len(rows))), 1.0)
        out[0] = 0.0
        return out

    active, x = np.zeros(0, np.int64), np.zeros(0)
    left = want.copy()
    best = np.inf
    for _ in range(rounds):
        slack = left.copy()
        slack[0] = 0.0
        gain = slack[patterns].sum(1)
        gain[active] = -np.inf
        pick = np.argsort(-gain, kind="stable")[:group]
        pick = pick[gain[pick] > 1e-6 * max(1.0, want.max())]
        if not len(pick):
            break
        active, x = np.concatenate((active, pick)), np.concatenate((x, np.zeros(len(pick))))
        while True:
            a = columns(active)
            y = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ want)
            if (y > 0).all():
                break
            low = y <= 0
            ratio = np.full(len(y), np.inf)
            ratio[low] = x[low] / np.maximum(x[low] - y[low], 1e-300)
            step = min(1.0, ratio.min())
            x = np.maximum(x + step * (y - x), 0.0)
            keep = ~(low & (ratio <= step + 1e-12))
            active, x = active[keep], x[keep]
            if not len(active):
                y = np.zeros(0)
                break
        x = y
        left = want - columns(active) @ x if len(active) else want.copy()
        now = float(left @ left)
        if now > best * (1 - 1e-4):
            break
        best = now
    return dict(zip(active.tolist(), x.tolist()))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is packed, so that every document of the histogram has a place.

    Fitted patterns are rounded and used as far as documents last; the residual is packed best fit, longest first,
    with all documents of a length in one step.  Work and memory depend on the capacity, not on the documents.
    """
    width = -(-capacity // BINS)
    bins = -(-capacity // width)
    left = dict(histogram)
    counts = np.zeros(bins + 1)
    for length, n in histogram.items():
        counts[-(-length // width)] += n
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    full: dict[tuple[int, ...], int] = defaultdict(int)

    def put(pattern: tuple[int, ...], n: int) -> None:
        space = capacity - sum(pattern)
        (open_[space] if space else full)[pattern] += n

    patterns = few_document_patterns(bins)
    fitted = fit_patterns(patterns, counts)
    for k, x in sorted(fitted.items(), key=lambda kx: (-kx[1], kx[0])):
        wanted, slots = int(x + 0.5), [int(b) for b in patterns[k] if b]
        while wanted > 0:
            lengths, used = [], Counter()
            for k, b in enumerate(slots):
                if k and k == len(slots) - 1:  # the last one takes what fits best, of whichever bin
                    near = range(capacity - sum(lengths), 0, -1)
                else:
                    near = range(b * width, (b - 1) * width, -1)
                length = next((x for x in near if left.get(x, 0) > used[x]), None)
                if length is None:
                    break
                lengths.append(length)
                used[length] += 1
            if len(lengths) < len(slots):
                break
            n = min([wanted, *(left[length] // m for length, m in used.items())])
            for length, m in used.items():
                left[length] -= n * m
            put(tuple(lengths), n)
            wanted -= n
    spaces = np.zeros(capacity + 1, bool)
    for s in open_:
        spaces[s] = True
    for length in sorted(left, reverse=True):
        c = left[length]
        while c > 0:
            fits = np.flatnonzero(spaces[length:])
            if not len(fits):
                each = capacity // length
                if c >= each:
                    pattern, n = (length,) * each, c // each
                else:
                    pattern, n = (length,) * c, 1
                c -= len(pattern) * n
                put(pattern, n)
                spaces[capacity - sum(pattern)] = capacity > sum(pattern)
                continue
            s = int(fits[0]) + length
            pattern = next(iter(open_[s]))
            have = open_[s].pop(pattern)
            spaces[s] = bool(open_[s])
            m = s // length
            n = min(have, c // m)
            rest = have - n
            if n:
                put(pattern + (length,) * m, n)
                spaces[s - m * length] |= s > m * length
                c -= n * m
            if rest and 0 < c < m:
                put(pattern + (length,) * c, 1)
                spaces[s - c * length] = True
                c, rest = 0, rest - 1
            if rest:
                open_[s][pattern] += rest
                spaces[s] = True
    for group in open_.values():
        for pattern, n in group.items():
            full[pattern] += n
    return sorted(full.items())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset) for each slot of each pattern."""
    out, taken, sequence = [], defaultdict(int), 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            out.append((length, taken[length] + 1, taken[length] + n, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every text (null: empty) becomes its token ids and id 0.  Longer ones are cut every ``capacity`` ids.  Only the
    histogram of lengths, at most ``capacity`` numbers, meets on the driver; the pattern table made from it is as
    bounded.  Pieces of a length are numbered in hashed buckets, and the number leads to the place in a sequence.

    Repeated rows are packed each for itself, null ids pass through, an empty table gives no rows, further columns
    are ignored.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = materialize(
        docs.select("doc_id", "text").mapInArrow(
            _pieces(tokenizer_path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
        )
    )
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots = places(plan(histogram, capacity)) if histogram else []
    table = spark.createDataFrame(
        slots, "slot_length long, first_rank long, last_rank long, first_sequence long, offset long"
    )
    buckets = max(64, max(histogram.values(), default=0) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = ranked(pieces, ["length"], order, bucket, "rank")
    placed = numbered.join(
        F.broadcast(table),  # a few rows per length, so bounded by the capacity
        (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")),
    )
    sequence = F.col("first_sequence") + F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset"
    )
