"""Quality rules: repetition inside a text by its suffix array.

The words of a text form a sequence.  Adjacent suffixes in suffix order give the
LCP intervals; the widest interval around a suffix gives the longest substring
at its position that occurs elsewhere in the text.  The spans of all repeated
substrings of at least ``min_words`` words are united.  A text is kept if the
united spans cover no more than ``max_covered`` of its words and no repeat is
longer than ``max_repeat`` words.

Null and empty texts have no words and fail the base rule.  Repeated rows give
repeated results; a text's result depends on that text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellmosaic.llm import common, suffixes

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(x) for x in SYMBOLS]] = True


def repeats(words: common.Words, least: int = 4) -> np.ndarray:
    """Of each word, the length in words of the longest repeat in its text that starts there; repeats under ``least`` (4 at most) count as 0."""
    n = len(words.code)
    if not n:
        return np.zeros(0, dtype=np.int64)
    sizes = np.diff(words.first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(words.first[1:], sizes)
    order, ranks, rank = suffixes.suffix_order(words.code, end, text)
    lcp = np.zeros(n + 1, dtype=np.int64)
    shared = ranks[min(least.bit_length() - 1, 2, len(ranks) - 1)][order]
    near = np.flatnonzero(shared[1:] == shared[:-1])
    lcp[near + 1] = suffixes.common_prefix(order[near], order[near + 1], end, ranks)
    lcp[lcp < least] = 0
    return np.maximum(lcp[:-1], lcp[1:])[rank]


def covered(start_length: np.ndarray, least: int) -> np.ndarray:
    """True for each word inside a repeat of at least ``least`` words."""
    n = len(start_length)
    step = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(start_length >= least)
    np.add.at(step, at, 1)
    np.subtract.at(step, at + start_length[at], 1)
    return np.cumsum(step[:-1]) > 0


def repeated_lines(texts: pa.Array, blank_only: np.ndarray = common._BLANK) -> np.ndarray:
    """Of each text, the number of lines that have a word and equal an earlier line of it."""
    data, offset = common.text_bytes(texts)
    out = np.zeros(len(offset) - 1, dtype=np.int64)
    if not len(data):
        return out
    breaks = np.flatnonzero(data == 10)
    counts = np.searchsorted(breaks, offset)
    blob = data.tobytes()
    for d in np.flatnonzero(np.diff(counts) > 0).tolist():
        lines = [x for x in blob[offset[d] : offset[d + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        out[d] = len(lines) - len(set(lines))
    return out


def _measure(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        texts = part.column("text")
        w = common.words_of(texts)
        longest_at = repeats(w, min(4, min_words))
        window = covered(np.where(longest_at >= WINDOW, longest_at, 0), WINDOW)
        wide = covered(longest_at, min_words)
        head = np.zeros(len(w.data) + 1, dtype=np.int64)
        np.cumsum(common.code_points(w.data) & ~common._BLANK[w.data], out=head[1:])
        longest = np.zeros(len(w.first) - 1, dtype=np.int64)
        full = np.flatnonzero(np.diff(w.first))
        if len(full):
            longest[full] = np.maximum.reduceat(longest_at, w.first[full])
        limits = w.offset
        columns = [
            part.column("doc_id"),
            np.diff(w.first),
            head[limits[1:]] - head[limits[:-1]],
            common.per_text(_SYMBOL[w.data], limits),
            repeated_lines(texts),
            common.per_text(window, w.first),
            common.per_text(wide, w.first),
            longest,
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=_NAMES)


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def repetition_quality(docs: DataFrame, *, min_words: int = 5, max_covered: float = 0.25, max_repeat: int = 40, base_min_words: int = 20, base_repeat_percent: int = 30) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, base_failed, method_kept and kept.

    Runs in one pass without a shuffle.  Extra columns of ``docs`` are ignored.
    """
    measured = docs.select("doc_id", "text").mapInArrow(lambda it: _measure(it, min_words), "doc_id long, " + ", ".join(f"{x} long" for x in _NAMES[1:]))
    out = measured.selectExpr("*", f"n_words < {base_min_words} OR 100 * n_repeat_words > {base_repeat_percent} * n_words AS base_failed")
    out = out.selectExpr("*", f"n_covered_words <= {max_covered}D * n_words AND longest_repeat <= {max_repeat} AS method_kept")
    return out.selectExpr("*", "NOT base_failed AND method_kept AS kept")
