"""Language-model scores by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from answerlens.llm.tables import shuffle_partitions
from answerlens.llm.words import Slice, crc_of_ids, mix, slices, U
from answerlens.operators.scale import materialize

#: Bytes of context.
ORDER = 5
#: Edges of the trie that are sent to the tasks, 12 bytes each and some 28 for each context.  If training finds more, the contexts seen most are sent
#: with all their edges, and bytes after other contexts meet their probabilities in a join: the bound sets the way only.
MAX_EDGES = 1 << 22
#: Contexts up to this order number at most 2^16, so their totals may be broadcast.
_SHORT = 2
#: Words whose counts are sent to the tasks (16 bytes each); all rarer words meet their counts in a join.
MAX_WORDS = 1 << 19
#: Bytes that UTF-8 never uses.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256
WORD, EDGE, TOTAL = 0, 1, 2
_TOKENS, _TEXTS = 0, 1
_PENDING = 1_000_000


class Tally:
    """Counts of 64-bit keys within a task."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, keys: np.ndarray) -> None:
        unique, n = np.unique(keys, return_counts=True)
        self.parts.append((unique, n))
        self.rows += len(unique)
        if self.rows > _PENDING and len(self.parts) > 1:
            merged = self.total()
            self.parts, self.rows = [merged], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        return keys[head], np.add.reduceat(n, head) if len(head) else n

    def drain(self, kind: int, blocks: int) -> Iterator[pa.RecordBatch]:
        """The counts, packed by blocks of hashed keys."""
        keys, n = self.total()
        self.parts, self.rows = [], 0
        block = (mix(keys) % U(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        keys, n = keys[order], n[order].astype("<u4")
        cut = np.searchsorted(block[order], np.arange(blocks + 1))
        rows = [(kind, k, keys[a:b].tobytes(), n[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                 *(pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3))], ["kind", "block", "keys", "counts"],
            )


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of a block's keys over all tasks."""
    keys = np.frombuffer(b"".join(frame["keys"]), U)
    n = np.frombuffer(b"".join(frame["counts"]), "<u4")
    unique, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, inverse, n)
    return pd.DataFrame({"kind": frame["kind"].iloc[0], "key": unique.view(np.int64), "n": total})


def symbols(part: Slice, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte and text end: the bytes before it and itself as one number, and the document."""
    size = np.diff(part.bounds)
    doc = np.repeat(np.arange(part.docs), size)
    room = ORDER + 1
    text = np.full(len(part.data) + room * part.docs, BEFORE, np.uint8)
    text[np.arange(len(part.data)) + doc * room + ORDER] = part.data
    ends = part.bounds[1:] + np.arange(1, part.docs + 1) * room - 1
    text[ends] = END
    owner = np.repeat(np.arange(part.docs), size + room)
    key = np.zeros(len(text) - ORDER, U)
    for k in range(ORDER + 1):
        key = key << U(8) | text[k:len(text) - ORDER + k]
    coded = text[ORDER:] != BEFORE
    if wanted is not None:
        coded &= wanted[owner[ORDER:]]
    return key[coded], owner[ORDER:][coded]


def _gathered(blocks: int):
    """A task's counts of words and of bytes after their contexts, over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, edges, totals = Tally(), Tally(), Tally()
        for batch in batches:
            train = crc_of_ids(batch.column(0).to_pylist()) % 10 != 0
            for part in slices(batch.column(1), lower=True):
                own = train[part.lo:part.hi]
                words.add(part.word_hash[own[part.doc]])
                edges.add(symbols(part, own)[0])
                totals.parts.append((
                    np.array([_TOKENS, _TEXTS], U), np.array([own.sum() + part.n_words[own].sum(), own.sum()]),
                ))
        yield from words.drain(WORD, blocks)
        yield from edges.drain(EDGE, blocks)
        yield from totals.drain(TOTAL, blocks)

    return run


class Lookup:
    """Open-addressing table from 64-bit keys to numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, kind=np.float64):
        self.bits = max(4, int(1.4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, U)
        self.values = np.full(1 << self.bits, np.nan, kind)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = np.flatnonzero(np.isnan(self.values[slot[left]]))
            _, one = np.unique(slot[left[free]], return_index=True)
            won = left[free[one]]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            rest = np.ones(len(left), bool)
            rest[free[one]] = False
            left = left[rest]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, nan for unknown ones."""
        out = np.full(len(keys), np.nan)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            value = self.values[slot]
            hit = self.keys[slot] == keys[left]
            out[left[hit]] = value[hit]
            more = ~(hit | np.isnan(value))
            left, slot = left[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out


def _halves(counts: np.ndarray) -> np.ndarray:
    """Counts less a half, in halves."""
    return 2.0 * counts - 1


class Trie:
    """Byte contexts of 0..ORDER bytes with the counts of what followed them, laid out as sorted arrays.

    It holds all edges of its contexts and, with a context, its suffixes.  If it is not ``complete`` there are others, and
    bytes after a context of ORDER bytes that it lacks have no probability here.

    Escape estimation: a byte seen n times in a context of T counts and D distinct bytes has (n - 1/2) / T, a new one
    D / 2T.  After an escape, bytes of the longer context are excluded: they leave T and D of the shorter one, which is
    worked out per context beforehand, since what follows a context also follows its suffix.

    It is built once, in the driver, and its arrays are all that a task holds of it: an edge takes 12 bytes.
    """

    def __init__(self, edges: list[tuple[np.ndarray, np.ndarray]], complete: bool = True):
        """``edges[o]``: sorted keys (o context bytes, then the byte) and counts."""
        self.complete = complete
        self.edges, self.counts, self.contexts, self.plain, self.excluded = [], [], [], [], []
        for order, (keys, counts) in enumerate(edges):
            n = _halves(counts)  # with D halves for new bytes they add up to 2T
            context = keys >> U(8)
            head = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), context[1:] != context[:-1])))
            distinct = np.diff(np.concatenate((head, [len(keys)]))).astype(np.float64)
            total = np.add.reduceat(n, head) if len(head) else n[:0]
            less = (np.zeros(0), np.zeros(0))
            if order and len(head):
                low_keys, low_n = self.edges[-1], self.counts[-1]
                at = self._find(low_keys, keys & U((1 << 8 * order) - 1))
                both = np.where(at >= 0, _halves(low_n[at]), 0.0) if len(low_n) else np.zeros(len(keys))
                place = self._find(self.contexts[-1], context[head] & U((1 << 8 * (order - 1)) - 1))
                low_total, low_distinct = self.plain[-1]
                less = (np.maximum(0.0, low_total[place] - np.add.reduceat(both, head)),
                        np.maximum(0.0, low_distinct[place] - np.add.reduceat((at >= 0).astype(float), head)).astype(np.uint16))
            self.edges.append(keys)
            self.counts.append(counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts)
            self.contexts.append(context[head])
            self.plain.append((total, distinct.astype(np.uint16)))  # 257 bytes at most, with END
            self.excluded.append(less)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 if absent."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after its context, nan if the trie lacks the context and is not complete."""
        # Neighbours in order of the keys are neighbours in the arrays; most keys of a text come many times.
        keys, back = np.unique(keys, return_inverse=True)
        return self._of_distinct(keys)[back]

    def _of_distinct(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), np.nan)
        left = np.arange(len(keys))
        if not self.complete:
            left = left[self._find(self.contexts[-1], keys >> U(8)) >= 0]
        out[left] = 0.0
        came = np.full(len(left), -1)  # the longer context that was escaped from
        for order in range(len(self.edges) - 1, -1, -1):
            if not len(left):
                return out
            own = keys[left] & U((1 << 8 * (order + 1)) - 1)
            context = self._find(self.contexts[order], own >> U(8))
            edge = self._find(self.edges[order], own)
            total, distinct = (
                x[np.maximum(context, 0)].astype(np.float64) if len(x) else np.zeros(len(left)) for x in self.plain[order]
            )
            if order + 1 < len(self.edges) and (came >= 0).any():
                less_total, less_distinct = self.excluded[order + 1]
                total = np.where(came >= 0, less_total[came], total)
                distinct = np.where(came >= 0, less_distinct[came], distinct)
            known = (context >= 0) & (distinct > 0)
            room = np.where(known, total + distinct, 1.0)
            hit = known & (edge >= 0)
            if hit.any():
                out[left[hit]] += np.log10(_halves(self.counts[order][edge[hit]]) / room[hit])
            escaped = known & ~hit
            out[left[escaped]] += np.log10(distinct[escaped] / room[escaped])
            came, left = context[~hit], left[~hit]
        used = self.plain[0][1][0] if len(self.plain[0][1]) else 0.0
        out[left] -= np.log10(max(1.0, SYMBOLS - used))
        return out


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """Rows of the highest counts, at most ``most``: the cut is found from a histogram of at most 1,024 numbers."""
    step = F.floor(F.log2("n") * 16)
    histogram = sorted(table.groupBy(step.alias("s")).count().collect(), reverse=True)
    kept, least = 0, 0
    for s, n in histogram:
        if kept + n > most:
            least = s + 1
            break
        kept += n
    return table.filter(step >= least)


def _step() -> Column:
    """Counts by sixteenths of an octave: at most 1,024 steps."""
    return F.floor(F.log2("c") * 16)


def _context_totals(edges: list[DataFrame]) -> list[DataFrame]:
    """Of each order's contexts: occurrences ``c``, and in halves ``total`` and ``distinct`` of the bytes that followed.

    ``gone`` is the part of the shorter context's total that its own bytes hold there.  An edge has at most 256 that are
    one byte longer, so no key of the join is hot.
    """
    out = []
    for order, table in enumerate(edges):
        table = table.withColumn("halves", 2.0 * F.col("n") - 1)
        if order:
            low = edges[order - 1].select(F.col("key").alias("low"), (2.0 * F.col("n") - 1).alias("below"))
            table = table.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1))).join(low, "low")
        else:
            table = table.withColumn("below", F.lit(0.0))
        out.append(materialize(table.groupBy(F.shiftright("key", 8).alias("context")).agg(
            F.sum("n").alias("c"), F.sum("halves").alias("total"), F.count(F.lit(1)).cast("double").alias("distinct"),
            F.sum("below").alias("gone"),
        )))
    return out


def _sent(edges: list[DataFrame], contexts: list[DataFrame], most: int) -> list[DataFrame]:
    """All edges of the contexts seen most, at most ``most`` of them.

    One least count holds for all orders: a suffix is seen at least as often as the context, so it is sent as well.
    """
    histogram = None
    for table in contexts:
        part = table.groupBy(_step().alias("s")).agg(F.sum("distinct").alias("n"))
        histogram = part if histogram is None else histogram.union(part)
    kept, least = 0, 0
    for s, n in sorted(histogram.groupBy("s").agg(F.sum("n")).collect(), reverse=True):
        if kept + n > most:
            least = s + 1
            break
        kept += n
    return [
        table.withColumn("context", F.shiftright("key", 8))
        .join(seen.filter(_step() >= least).select("context"), "context", "left_semi").select("key", "n")
        for table, seen in zip(edges, contexts)
    ]


def _exact(wanted: DataFrame, edges: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(symbol, log): log10 probabilities of distinct bytes after their contexts, from the counts of the whole corpus.

    The rule of ``Trie.log10``, an order at a time: each byte meets its context and its edge by equality.
    """
    zero = F.lit(0.0)
    state = wanted.select("symbol").distinct().select(
        "symbol", zero.alias("log"), F.lit(False).alias("done"), zero.alias("less"), zero.alias("fewer"),
    )
    for order in range(ORDER, -1, -1):
        own = F.col("symbol").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        seen = contexts[order].select("context", "total", "distinct", "gone")
        state = state.select("*", own.alias("key"), F.shiftright(own, 8).alias("context"))
        state = state.join(F.broadcast(seen) if order <= _SHORT else seen, "context", "left")
        state = state.join(edges[order], "key", "left")
        total = F.greatest(zero, F.col("total") - F.col("less"))
        distinct = F.greatest(zero, F.col("distinct") - F.col("fewer"))
        known = F.col("total").isNotNull() & (distinct > 0) & ~F.col("done")
        hit = known & F.col("n").isNotNull()
        state = state.select(
            "symbol",
            (F.col("log") + F.when(hit, F.log10((2.0 * F.col("n") - 1) / (total + distinct)))
             .when(known, F.log10(distinct / (total + distinct))).otherwise(zero)).alias("log"),
            (F.col("done") | hit).alias("done"),
            F.coalesce("gone", zero).alias("less"), F.coalesce("distinct", zero).alias("fewer"),
        )
    # ``fewer`` is now the number of bytes that the corpus has at all.
    unseen = F.log10(F.greatest(F.lit(1.0), F.lit(float(SYMBOLS)) - F.col("fewer")))
    return state.select("symbol", F.when(F.col("done"), F.col("log")).otherwise(F.col("log") - unseen).alias("log"))


def _counted(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) and their numbers."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    head = np.flatnonzero(new)
    return doc[head], keys[head], np.diff(np.concatenate((head, [len(doc)])))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            held = crc_of_ids(batch.column(0).to_pylist()) % 10 == 0
            for part in slices(batch.column(1), lower=True):
                keys, owner = symbols(part)
                found = trie.log10(keys)
                absent = np.isnan(found)
                score = np.bincount(owner, np.where(absent, 0.0, found), part.docs).astype(np.float64)
                logs = words.get(part.word_hash)
                rare = np.isnan(logs)
                base = np.bincount(part.doc, np.where(rare, 0.0, logs), part.docs).astype(np.float64)
                known = np.bincount(part.doc[~rare], minlength=part.docs)
                rows = row + np.arange(part.docs)
                row += part.docs
                none = pa.nulls(part.docs, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), batch.column(0).slice(part.lo, part.docs), pa.array(held[part.lo:part.hi]),
                     pa.array(part.n_words + 1), pa.array(known), pa.array(base), pa.array(score), none, none, none], _SCORED,
                )
                for place, (doc, key, n) in enumerate(
                    (_counted(part.doc[rare], part.word_hash[rare]), _counted(owner[absent], keys[absent]))
                ):
                    no = [pa.nulls(len(doc), kind) for kind in
                          (batch.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    both = [pa.nulls(len(doc), pa.int64())] * 2
                    both[place] = pa.array(key.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), *no, *both, pa.array(n)], _SCORED)

    return run


_SCORED = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "key", "symbol", "tf"]


def score_documents(docs: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Log10 probabilities of all texts, learned from the documents whose crc32(doc_id) mod 10 is not 0.

    Texts are lower-cased (A-Z).  ``score`` is the code length, as log10, of a text's bytes and its end under a trie of
    byte contexts up to ORDER bytes, trained on all training texts: escape estimation by the number of distinct
    bytes, with exclusion of the bytes that the longer context already offered.  ``base_score`` is the smoothed
    unigram score of the words and one end.

    Counts of words and contexts are summed over the corpus in one aggregate, packed by blocks of hashed keys.  Tasks get the
    contexts seen most (``max_edges`` edges) and the counts of the most frequent words.  Rarer words, and bytes after
    rarer contexts, are counted per document and joined to their counts and probabilities, so no bound changes a score.

    Null texts count as empty: one end token.  A null doc_id has the checksum of an empty text and is held out.
    Repeated rows are scored each for itself; without training rows all bytes are equally likely.  Further columns
    are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text")
    gathered = source.mapInArrow(_gathered(4 * shuffle_partitions(docs)), "kind int, block long, keys binary, counts binary")
    counts = materialize(gathered.groupBy("kind", "block").applyInPandas(_summed, "kind int, key long, n long"))
    totals = {r[0]: r[1] for r in counts.filter(F.col("kind") == TOTAL).select("key", "n").collect()}
    tokens, texts = totals.get(_TOKENS, 0), totals.get(_TEXTS, 0)
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    distinct = words.count() + (texts > 0)
    edges = [counts.filter(F.col("kind") == EDGE).select("key", "n")]
    for order in range(ORDER - 1, -1, -1):
        key = F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("key")
        edges.insert(0, materialize(edges[0].groupBy(key).agg(F.sum("n").alias("n"))))
    complete = sum(table.count() for table in edges) <= max_edges
    contexts = [] if complete else _context_totals(edges)
    trie = []
    for table in edges if complete else _sent(edges, contexts, max_edges):
        found = table.toArrow()
        keys, n = found.column("key").to_numpy().astype(U), found.column("n").to_numpy()
        by = np.argsort(keys)
        trie.append((keys[by], n[by]))
    frequent = _most_frequent(words, MAX_WORDS).toArrow()
    logs = np.log10(frequent.column("n").to_numpy() + 0.1)
    shared = spark.sparkContext.broadcast((Trie(trie, complete), Lookup(frequent.column("key").to_numpy().view(U), logs)))
    del trie, frequent, logs
    scored = materialize(source.mapInArrow(
        _scored(shared),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, "
        "key long, symbol long, tf long",
    ))
    rare = scored.filter("key is not null").select("row", "key", "tf").join(words, "key", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more_known"),
    )
    texts_scored = scored.filter("n_tokens is not null").drop("key", "symbol", "tf").join(rare, "row", "left")
    score = F.col("score")
    if not complete:
        absent = scored.filter("symbol is not null").select("row", "symbol", "tf")
        logs = absent.join(_exact(absent, edges, contexts), "symbol").groupBy("row").agg(
            F.sum(F.col("tf") * F.col("log")).alias("more_score")
        )
        texts_scored = texts_scored.join(logs, "row", "left")
        score = score + F.coalesce("more_score", F.lit(0.0))
    norm = float(np.log10(tokens + 0.1 * (distinct + 1)))
    end = float(np.log10(texts + 0.1))
    return texts_scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end - F.col("n_tokens") * norm).alias("base_score"), score.alias("score"),
    )
