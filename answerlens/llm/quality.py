"""Repetition rules: characters inside repeated n-grams and lines, measured with rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from answerlens.llm.words import Slice, mix, per_group, slices, U

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: n-gram length -> largest share of the word characters that may lie in repeats of n-grams of that length.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of the word characters in lines that repeat an earlier line.
MAX_LINE_SHARE = 0.2
#: A header that comes again is no fault: if a document has at most so many repeated lines, those of at most so many words
#: do not count towards the shares.
HEADER_LINES, HEADER_WORDS = 2, 12

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ngram_share double, "
    "line_share double, base_failed boolean, kept boolean"
)


def _repeated(part: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word windows of ``n`` that occur again in their document: all of them, and those after the first."""
    at = part.window_starts(n)
    if not len(at):
        return at, at
    order, same = per_group(part.word_spans(at, at + n) ^ mix(part.doc[at].astype(U) + U(1)))
    twice = same.copy()
    twice[:-1] |= same[1:]
    return at[order[twice]], at[order[same]]


def _lines(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of lines with a word, whether the line repeats an earlier one, and the line of each word."""
    breaks = np.flatnonzero(part.data == 10)
    start = np.unique(np.concatenate((part.bounds[:-1], breaks + 1)))
    line = np.searchsorted(start, part.start, "right") - 1
    used, line = np.unique(line, return_inverse=True)
    begin = start[used]
    stops = np.unique(np.concatenate((breaks, part.bounds[1:])))
    end = stops[np.searchsorted(stops, begin, "right")]
    doc = np.searchsorted(part.bounds, begin, "right") - 1
    again = np.zeros(len(used), bool)
    if len(used):
        order, same = per_group(part.byte_spans(begin, end) ^ mix(doc.astype(U) + U(1)))
        again[order] = same
    return doc, again, line


def measure(part: Slice) -> dict[str, np.ndarray]:
    """All measures of a slice's documents."""
    lead = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
    chars = lead[part.end] - lead[part.start]
    word_chars = part.per_doc(chars)
    doc, again, line = _lines(part)
    repeats = part.per_doc(part.covered(_repeated(part, 3)[0], 3))
    dup_lines = np.bincount(doc[again], minlength=part.docs)
    header = again & (np.bincount(line, minlength=len(doc)) <= HEADER_WORDS) & (dup_lines[doc] <= HEADER_LINES)
    chars = chars * ~header[line]
    room = np.maximum(word_chars, 1)
    over = np.zeros(part.docs, bool)
    worst = np.zeros(part.docs)
    for n, most in MAX_NGRAM_SHARE.items():
        share = part.per_doc(chars * part.covered(_repeated(part, n)[1], n)) / room
        over |= share > most
        worst = np.maximum(worst, share)
    line_share = part.per_doc(chars * again[line]) / room
    failed = (part.n_words < MIN_WORDS) | (100 * repeats > MAX_REPEATED_PERCENT * part.n_words)
    return {
        "n_words": part.n_words, "word_chars": word_chars, "n_symbols": part.per_doc_bytes(_SYMBOL[part.data]),
        "n_dup_lines": dup_lines, "n_repeat_words": repeats,
        "ngram_share": worst, "line_share": line_share, "base_failed": failed,
        "kept": ~failed & ~over & (line_share <= MAX_LINE_SHARE),
    }


def repetition_rules(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row of measures per document and whether it is kept; the texts are read in place, without a shuffle.

    A document fails the base rule below 50 words or when more than half of its words lie in 3-word windows found
    twice.  It is further rejected when the characters in *later* occurrences of its n-grams (n from 5 to 10) or of
    its lines exceed a share of its word characters; up to two short lines that come again do not count.  With ``keep_rows`` the kept input rows come back, unchanged.

    Null or empty texts have zeros everywhere and fail the base rule.  Repeated rows are judged each for itself, null
    ids pass through, an empty table gives no rows; further columns are ignored.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                values = measure(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, part.docs), *map(pa.array, values.values())],
                    ["doc_id", *values],
                )

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                yield batch.slice(part.lo, part.docs).filter(pa.array(measure(part)["kept"]))

    if keep_rows:
        return docs.mapInArrow(filtered, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {kind}, {SCHEMA}")
