"""Alignment of two tokenizers' tokens through anchors before space-marked tokens and remembered windows."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from answerlens.llm.words import Powers, U, mix, prefix_hash, span_hash
from answerlens.operators.scale import materialize

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Windows, and links in them, that one Python worker remembers.
REMEMBERED, REMEMBERED_LINKS = 150_000, 3_000_000
#: Pairs of ids whose counts go to every task (24 MB); rarer ones meet theirs in a join.
KNOWN_PAIRS = 1 << 20
#: Texts of more characters go through the general encoder, which takes runs of any length.
QUICK_CHARS = 1 << 16
#: Bytes of text that are aligned together.
SLICE = 1 << 19
_POWERS = Powers(0x9E3779B97F4A7C15)


class Sides:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each worker its core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        tokens = self._bytes_of_a()
        self.quick_a = self._ranked(path_a, tokens)
        self.bytes_a = self._pool(tokens)
        self.bytes_b = self._pool(self._bytes_of_b())
        self.names = [str(k) for k in range(max(len(x[1]) for x in (self.bytes_a, self.bytes_b)))]

    def _bytes_of_a(self) -> list[bytes]:
        # Byte-level vocabularies write printable bytes as themselves, the others as code points from 256 on (fixed values).
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            out[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out

    @staticmethod
    def _ranked(path: str, tokens: list[bytes]):
        """The same vocabulary as ranks, which give the same ids faster; None if its ids are not ranks of its merges."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        step, model = whole["pre_tokenizer"], whole["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = whole["normalizer"] is None and step["type"] == "ByteLevel" and not step["add_prefix_space"] and step.get("use_regex", True)
        if not plain or any(model["vocab"][x + y] != 256 + k for k, (x, y) in enumerate(merges)):
            return None
        ranks = {tokens[k]: k for k in range(256 + len(merges))}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _bytes_of_b(self) -> list[bytes]:
        model = self.b
        return [
            bytes([int(model.id_to_piece(k)[1:-1], 16)]) if model.is_byte(k)
            else b"" if model.is_control(k) or model.is_unknown(k)
            else model.id_to_piece(k).replace("▁", " ").encode()
            for k in range(model.get_piece_size())
        ]

    @staticmethod
    def _pool(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, and per id: where its bytes begin, how many they are, and whether a space is first."""
        size = np.array([len(t) for t in tokens], np.int64)
        at = np.cumsum(size) - size
        return np.frombuffer(b"".join(tokens), np.uint8), at, size, np.array([t[:1] == b" " for t in tokens])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of space+text on side A and of text on side B (which adds the space) of non-empty texts."""
        of_b = self.b.encode(texts, num_threads=1)
        return [self._encode_a(" " + t) for t in texts], [np.array(ids, np.int64) for ids in of_b]

    def _encode_a(self, text: str) -> np.ndarray:
        if self.quick_a is None or len(text) > QUICK_CHARS:
            return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        return self.quick_a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers begin..end of all rows, one after another."""
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _spelled(pool, ids: np.ndarray) -> np.ndarray:
    """Bytes of a sequence of tokens."""
    data, at, size, _ = pool
    return data[_ranges(at[ids], at[ids] + size[ids])]


class Windows:
    """Alignments of windows, remembered by their ids on both sides."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.n_groups, self.n_links, self.place = (np.zeros(0, np.int64) for _ in range(3))
        self.links, self.used = np.zeros(1 << 14, np.int64), 0

    @property
    def full(self) -> bool:
        return len(self.texts) > REMEMBERED or self.used > REMEMBERED_LINKS

    def _align(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray) -> None:
        """Align new windows, given one after another, and keep the result.

        Links are id of A times 2^32 plus id of B, in order.
        """
        links, _, at_a, at_b = _overlaps(self.sides, a, b)
        both = at_a & at_b
        x, y = np.cumsum(at_a)[both], np.cumsum(at_b)[both]
        ids_a = [*map(self.sides.names.__getitem__, a.tolist())]
        ids_b = [*map(self.sides.names.__getitem__, b.tolist())]
        groups, i, j = [], 0, 0
        for p, q in zip(x.tolist(), y.tolist()):
            if p == i + 1 and q == j + 1:
                groups.append(f"{ids_a[i]}|{ids_b[j]}")
            else:
                groups.append(f"{','.join(ids_a[i:p])}|{','.join(ids_b[j:q])}")
            i, j = p, q
        # The windows end at shared ends: where they lie among the groups and the links.
        last_group = np.searchsorted(x, cut_a, "right")
        last_link = np.flatnonzero(both)[last_group - 1] + 1
        n_groups, n_links = np.diff(last_group, prepend=0), np.diff(last_link, prepend=0)
        at = [0, *last_group.tolist()]
        self.texts += [";".join(groups[p:q]) if q > p + 1 else groups[p] for p, q in zip(at, at[1:])]
        self.n_groups, self.n_links = np.append(self.n_groups, n_groups), np.append(self.n_links, n_links)
        self.place = np.append(self.place, self.used + last_link - n_links)
        while self.used + len(links) > len(self.links):
            self.links = np.concatenate((self.links, np.zeros_like(self.links)))
        self.links[self.used:self.used + len(links)] = links
        self.used += len(links)

    def of(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Remembered numbers of the windows of some documents one after another, and where each document's begin.

        A window begins where a token that is marked by a space begins on both sides, so both have an end there;
        every text begins with such a place.
        """
        _, _, size_a, marked_a = self.sides.bytes_a
        _, _, size_b, marked_b = self.sides.bytes_b
        starts_a, starts_b = np.flatnonzero(marked_a[a]), np.flatnonzero(marked_b[b])
        n_a, n_b = size_a[a], size_b[b]
        at_a, at_b = (np.cumsum(n_a) - n_a)[starts_a], (np.cumsum(n_b) - n_b)[starts_b]
        begins_a, begins_b = (np.zeros(int(n_a.sum()) + 1, bool) for _ in range(2))
        begins_a[at_a], begins_b[at_b] = True, True
        cut_a, cut_b = starts_a[begins_b[at_a]], starts_b[begins_a[at_b]]
        stop_a, stop_b = np.append(cut_a[1:], len(a)), np.append(cut_b[1:], len(b))
        name = span_hash(prefix_hash(mix(a.astype(U) + U(1)), _POWERS), _POWERS, cut_a, stop_a)
        name = mix(name) + span_hash(prefix_hash(mix(b.astype(U) + U(1)), _POWERS), _POWERS, cut_b, stop_b)
        _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        own = np.empty(len(first), np.int64)
        # The key of a window is its ids on both sides, as bytes, with a mark between them that is no id.
        raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        cuts = [x[first] for x in (cut_a, stop_a, cut_b, stop_b)]
        new, known = [], self.number
        for k, (i, p, j, q) in enumerate(zip(*((4 * x).tolist() for x in cuts))):
            key = raw_a[i:p] + b"\xff\xff\xff\xff" + raw_b[j:q]
            number = known.get(key)
            if number is None:
                number = known[key] = len(known)
                new.append(k)
            own[k] = number
        if new:
            begin_a, end_a, begin_b, end_b = (x[new] for x in cuts)
            self._align(a[_ranges(begin_a, end_a)], b[_ranges(begin_b, end_b)], np.cumsum(end_a - begin_a))
        return own[inverse], np.searchsorted(cut_a, first_a)

    def links_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links of some windows, and how many each has."""
        n = self.n_links[entries]
        return self.links[_ranges(self.place[entries], self.place[entries] + n)], n


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of values; a run may be empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[np.append(first, len(values))])


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some SLICE bytes, or one row."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, hi
        lo = hi


_SIDES: dict[tuple[str, str], Sides] = {}


def _sides(paths: tuple[str, str]) -> Sides:
    return _SIDES.get(paths) or _SIDES.setdefault(paths, Sides(*paths))


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, a binary, b binary, pair long, uses long"


def _documents(paths: tuple[str, str], digest: bool):
    """Rows of documents (pair is null), then the uses of id pairs by this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(paths)
        windows, uses = Windows(sides), np.zeros(0, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            column = batch.column(1)
            for lo, hi in _parts(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)):
                texts = column.slice(lo, hi - lo).to_pylist()
                a, b = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
                held = [k for k, t in enumerate(texts) if t]
                for k, x, y in zip(held, *sides.encode([texts[k] for k in held])):
                    raw = np.frombuffer(b" " + texts[k].encode(), np.uint8)
                    if np.array_equal(_spelled(sides.bytes_a, x), raw) and np.array_equal(_spelled(sides.bytes_b, y), raw):
                        a[k], b[k] = x, y
                n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
                entries, first = windows.of(np.concatenate(a), np.concatenate(b), np.cumsum(n_a) - n_a)
                now = np.bincount(entries, minlength=len(windows.texts))
                now[:len(uses)] += uses
                uses = now
                names, last = entries.tolist(), np.append(first, len(entries)).tolist()
                groups = [";".join([windows.texts[e] for e in names[x:y]]) for x, y in zip(last, last[1:])]
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                none = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n_a), pa.array(n_b),
                     pa.array(_summed(windows.n_groups[entries], first)), pa.array(_summed(windows.n_links[entries], first)),
                     pa.array(groups, pa.string()), _packed(a), _packed(b), none, none],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "pair", "uses"],
                )
                if windows.full:
                    yield _uses(windows, uses, kind)
                    windows.forget()
                    uses = np.zeros(0, np.int64)
        if kind is not None:
            yield _uses(windows, uses, kind)

    return run


def _packed(side: list[np.ndarray]) -> pa.Array:
    """Ids of each document as little-endian bytes, 16 bits each where all fit."""
    wide = any(len(x) and x.max() > 0xFFFF for x in side)
    return pa.array([(b"\x04" if wide else b"\x02") + x.astype("<u4" if wide else "<u2").tobytes() for x in side], pa.binary())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[:1] == b"\x04" else "<u2", offset=1).astype(np.int64)


def _uses(windows: Windows, uses: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    every = np.arange(len(windows.texts))
    links, n = windows.links_of(every)
    pairs, at = np.unique(links, return_inverse=True)
    total = np.bincount(at, np.repeat(uses[every], n), len(pairs)).astype(np.int64)
    none = pa.nulls(len(pairs), pa.int64())
    empty = pa.nulls(len(pairs), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(pairs), kind), none, none, none, none, pa.nulls(len(pairs), pa.string()), empty, empty, pa.array(pairs), pa.array(total)],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "pair", "uses"],
    )


def _overlaps(sides: Sides, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of whole texts one after another, the byte at which each ends, and whether tokens of A and of B end there."""
    end_a, end_b = np.cumsum(sides.bytes_a[2][a]), np.cumsum(sides.bytes_b[2][b])
    at_a, at_b = (np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool) for _ in range(2))
    at_a[end_a], at_b[end_b] = True, True
    # Tokens of either side cover the same bytes, so each stretch between two ends is one overlap.
    ends = np.flatnonzero(at_a | at_b)
    at_a, at_b = at_a[ends], at_b[ends]
    links = (a[np.cumsum(at_a) - at_a] << 32) | b[np.cumsum(at_b) - at_b]
    return links, ends, at_a, at_b


def _measured(paths: tuple[str, str], known):
    """Per document the best links and counts by the known pairs (pair is null), and the uses of pairs that are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        sides = _sides(paths)
        names = ["row", "pair", "uses", "n_best", "count_sum"]
        for batch in batches:
            for lo, hi in _parts(pc.binary_length(batch.column(1)).to_numpy()):
                a, b = ([_unpacked(raw) for raw in batch.column(k).slice(lo, hi - lo).to_pylist()] for k in (1, 2))
                links, ends, _, _ = _overlaps(sides, np.concatenate(a), np.concatenate(b))
                last = np.cumsum([int(sides.bytes_a[2][x].sum()) for x in a])
                first = np.searchsorted(ends, np.concatenate(([0], last[:-1])), "right")
                at = np.searchsorted(pairs, links)
                hit = pairs[at] == links  # the last known pair is larger than any
                rows, none = batch.column(0).slice(lo, hi - lo), pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows, none, none, pa.array(_summed(hit & best[at], first)),
                     pa.array(_summed(np.where(hit, counts[at], 0), first))], names,
                )
                odd = np.flatnonzero(~hit)
                if len(odd):
                    owner, rare = np.searchsorted(last, ends[odd]), links[odd]
                    order = np.lexsort((rare, owner))
                    owner, rare = owner[order], rare[order]
                    head = np.ones(len(owner), bool)
                    head[1:] = (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1])
                    uses = np.diff(np.append(np.flatnonzero(head), len(owner)))
                    none = pa.nulls(len(uses), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(owner[head])), pa.array(rare[head]), pa.array(uses), none, none], names,
                    )

    return run


def _paths(paths: tuple[str, str] | None) -> tuple[str, str]:
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)
    return paths


def align_texts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links and its groups of ids as text: ``a1,a2|b1;a3|b2,b3``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_documents(_paths(paths), False), f"doc_id {kind}, {_ALIGNED}")
    return found.filter("pair is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def _frequent(pairs: DataFrame, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most used pairs, at most ``known``, sorted: pair, count, whether it is its B id's best."""
    level = F.floor(F.log2("count"))
    levels = sorted(((r[0], r[1]) for r in pairs.groupBy(level.alias("level")).count().collect()), reverse=True)  # 63 rows
    least, room = 64, known
    for power, n in levels:
        if n > room:
            break
        least, room = power, room - n
    table = pairs.filter(level >= least).select("pair", "count", "best").toArrow()
    columns = [table.column(k).to_numpy() for k in range(3)]
    order = np.argsort(columns[0])
    # One more pair, larger than any and never best, ends every search.
    return tuple(np.append(c[order], e) for c, e in zip(columns, (np.int64(2**63 - 1), np.int64(0), np.False_)))


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, known: int = KNOWN_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Two tables: per document its alignment (groups as a digest) with n_best and count_sum, and the id pairs (a, b, count, best).

    Both tokenizers encode the whole text.  Where a token that a space marks begins on both sides, both have an end: such
    anchors cut a document into windows of ids, and a window is aligned once for all its repeats in a task.  Groups are cut at
    every shared end, links are all overlaps.  Counts of id pairs cover the whole table; the most used ones go to
    every task, at most ``known``, and what a document holds of rarer ones meets its counts in a join, so ``known`` sets
    memory and never results.

    Null and empty texts, and texts that the tokens of a side do not spell exactly, have no tokens: zeros and ''.  Repeated
    rows count and come back each for itself, null ids pass through, an empty table gives no rows, further columns are
    ignored.
    """
    paths = _paths(paths)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "text").mapInArrow(_documents(paths, True), f"doc_id {kind}, {_ALIGNED}")
    # Written, so the numbers stay what they are.
    found = materialize(coded.withColumn("row", F.monotonically_increasing_id()))
    rows = found.filter("pair is null")
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counted = found.filter("pair is not null").groupBy("pair").agg(F.sum("uses").alias("count")).withColumn("b", id_b)
    counted = materialize(counted)
    top = counted.groupBy("b").agg(F.max("count").alias("top"))  # a row for each id of B
    pairs = materialize(counted.join(top, "b").select("pair", "b", "count", (F.col("count") == F.col("top")).alias("best")))
    shared = spark.sparkContext.broadcast(_frequent(pairs, known))
    measured = materialize(rows.select("row", "a", "b").mapInArrow(
        _measured(paths, shared), "row long, pair long, uses long, n_best long, count_sum long"
    ))
    rare = measured.filter("pair is not null").select("row", "pair", "uses").join(pairs, "pair").select(
        "row", F.when(F.col("best"), F.col("uses")).otherwise(0).alias("n_best"), (F.col("uses") * F.col("count")).alias("count_sum")
    )
    sums = measured.filter("pair is null").select("row", "n_best", "count_sum").union(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    result = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256"), "row").join(
        sums, "row"
    ).drop("row")
    table = pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("b").cast("int"), "count", "best")
    return result, table
