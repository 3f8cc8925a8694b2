"""Suffix-array dedup: bytes inside strings of a fixed length that occur elsewhere.

Every window of ``length`` bytes has a seed: of its substrings of 40 bytes the one
with the least hash, the leftmost of equals.  Equal windows have equal seeds at
equal places, so a window needs to be compared only with windows of its seed.
Consecutive windows of one seed form a run; what a run covers is its context.

1. Runs are counted by seed and context.  Windows of a context that occurs twice
   are repeated.  Seeds with one context are settled.
2. For other seeds the contexts, each once, are brought together by seed, ``CROWD``
   or so at a time.  In each block the suffixes are ordered, and the previous and
   next smaller positions in suffix order give the longest previous factors:
   windows whose factor reaches ``length`` are later copies.
3. A seed with more contexts has several blocks.  The windows that are first in
   their block go on, as strings, and are dealt again by seeds of more bytes,
   which part what only the short seed had in common.  The last seed is the whole
   window, so counting settles what is left.

Windows of a run contain its seed, so repeated windows of a run cover one span.
Null texts count as empty; texts shorter than ``length`` lose nothing.  Repeated
rows are repeats of each other, whatever their doc_id; with ``keep_first`` one of
them stays.  Ties between equal ranks go to the smaller key.  A very long text is
read in pieces that overlap.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmosaic.llm import common, suffixes

LENGTH = 200
SEED = 40
CROWD = 512
#: Bytes whose suffixes are ordered at a time.
BLOCK_BYTES = 1 << 19
#: Bytes whose windows are hashed at a time, however long the text is.
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, longer when asked for."""

    n = 0
    up = down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(cls.n, base, dtype=np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any substrings of ``data`` from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.int64).max)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, limits: np.ndarray, length: int, bytes_: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, first, windows, seed, context) of all runs of seeds of ``bytes_``; ``first`` is the byte in the text where the first window starts."""
    out = []
    width = length - bytes_ + 1
    for base in range(0, max(len(data) - length + 1, 0), _PIECE):
        part = data[base : base + _PIECE + length - 1]
        h = Hashes(part)
        n = len(part) - bytes_ + 1
        seed = h.of(slice(0, n), slice(bytes_, bytes_ + n))
        packed = ((seed >> np.uint64(25)) << np.uint64(24)).astype(np.int64) | np.arange(n)
        at = least_in_windows(packed, width) & ((1 << 24) - 1)
        text = np.searchsorted(limits, base + np.arange(len(at)), side="right") - 1
        inside = np.flatnonzero(base + np.arange(len(at)) + length <= limits[text + 1])
        if not len(inside):
            continue
        place = at[inside]
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)
        heads = np.flatnonzero(new)
        first = inside[heads]
        count = np.diff(np.append(heads, len(inside)))
        offset = place[heads] - first
        context = _mixed(h.of(first, first + count + length - 1) ^ (count.astype(np.uint64) << np.uint64(20)) ^ offset.astype(np.uint64))
        out.append((text[first], base + first - limits[text[first]], count, seed[place[heads]], context))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    text, first, count, seed, context = (np.concatenate(x) for x in zip(*out))
    return text, first, count, seed.view(np.int64), context.view(np.int64)


def _emit_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, limit=_PIECE):
        text, first, count, seed, context = runs(*common.text_bytes(part.column("text")), length)
        yield pa.RecordBatch.from_arrays(
            [part.column("key").take(pa.array(text)), part.column("rank").take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(seed), pa.array(context)],
            names=["key", "rank", "first", "windows", "seed", "context"],
        )


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of all, as binary."""
    limits = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=limits[1:])
    at = np.repeat(start - limits[:-1], end - start) + np.arange(limits[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The contexts of the runs ``wanted`` of each text."""
    for part in common.slices(batches, limit=_PIECE):
        data, limits = common.text_bytes(part.column("text"))
        wanted = part.column("wanted")
        flat = wanted.flatten()
        counts = wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(part.num_rows), counts)
        first, windows = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("first", "windows"))
        start = limits[text] + first
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [part.column("key").take(take), part.column("rank").take(take), flat.field("first"), flat.field("seed"), flat.field("part"), flat.field("parts"), _strings(data, start, start + windows + length - 1)],
            names=["key", "rank", "first", "seed", "part", "parts", "context"],
        )


def repeated_starts(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(limits, later, any): for each byte of the joined strings, whether a string of ``length`` starts there that also starts earlier, or anywhere else."""
    limits = np.zeros(len(strings) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in strings], out=limits[1:])
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    end = np.repeat(limits[1:], np.diff(limits))
    later, anywhere = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    if not len(data):
        return limits, later, anywhere
    order, ranks, _ = suffixes.suffix_order(data, end)
    # Suffixes that share fewer symbols than the largest power of two up to ``length`` have no factor of that length.
    level = length.bit_length() - 1
    if len(ranks) <= level:
        return limits, later, anywhere
    shared = ranks[level][order]
    near = np.concatenate([[False], shared[1:] == shared[:-1]])
    near[:-1] |= near[1:]
    order = order[near]
    longest, source = suffixes.previous_factors(order, end, ranks)
    full = longest >= length
    later[order[full]] = True
    # A first copy is the neighbour in suffix order of a later one.
    between = suffixes.common_prefix(order[:-1], order[1:], end, ranks) >= length
    anywhere[order[:-1][between]] = True
    anywhere[order[1:][between]] = True
    return limits, later, anywhere


def _ranges(where: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) of maximal runs of consecutive places inside strings."""
    if not len(where):
        return where, where, where
    owner = np.searchsorted(limits, where, side="right") - 1
    new = np.ones(len(where), dtype=bool)
    new[1:] = (where[1:] != where[:-1] + 1) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], where[heads], where[np.append(heads[1:], len(where)) - 1]


_SETTLED = "key long, rank long, start long, stop long, context binary"


def _settle(batches: Iterator[pa.RecordBatch], length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Of a partition that is sorted by seed, part, rank, key and first: the spans of repeated windows, and the strings of first windows of blocks that have others of their seed."""
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        strings = [r[3] for r in rows]
        limits, later, anywhere = repeated_starts(strings, length)
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        key, rank, first = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        owner, a, b = _ranges(np.flatnonzero(later if keep_first else anywhere), limits)
        starts = ~later
        starts &= np.arange(len(data)) + length <= np.repeat(limits[1:], np.diff(limits))
        starts &= np.repeat(np.array([r[5] > 1 for r in rows]), np.diff(limits))
        onward, c, d = _ranges(np.flatnonzero(starts), limits)
        both = np.concatenate([owner, onward])
        begin, last = np.concatenate([a, c]), np.concatenate([b, d])
        shift = first[both] - limits[both]
        lengths = np.concatenate([np.zeros(len(owner), np.int64), d - c + length])
        context = _strings(data, begin, begin + lengths)
        return pa.RecordBatch.from_arrays([pa.array(key[both]), pa.array(rank[both]), pa.array(begin + shift), pa.array(last + shift + length), context], names=["key", "rank", "start", "stop", "context"])

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("key", "rank", "first", "context", "seed", "parts", "part"))):
            if rows and row[4] == rows[-1][4] and row[6] == rows[-1][6] and row[:3] == rows[-1][:3]:
                continue  # a row that comes twice
            # Parts of one seed are ordered each for itself.
            if rows and (row[4] == rows[-1][4] and row[6] != rows[-1][6] or size >= BLOCK_BYTES and row[4] != rows[-1][4]):
                yield flush()
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield flush()


def _emit_again(batches: Iterator[pa.RecordBatch], length: int, bytes_: int) -> Iterator[pa.RecordBatch]:
    """The runs of strings by longer seeds, with their contexts."""
    for part in common.slices(batches, "context", _PIECE):
        data, limits = common.text_bytes(part.column("context"))
        row, first, count, seed, context = runs(data, limits, length, bytes_)
        start = limits[row] + first
        take = pa.array(row)
        base = part.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part.column("key").take(take), part.column("rank").take(take), pa.array(base[row] + first), pa.array(count.astype(np.int32)), pa.array(seed), pa.array(context), _strings(data, start, start + count + length - 1)],
            names=["key", "rank", "first", "windows", "seed", "context", "string"],
        )


def _folded(found: DataFrame, shared: common.Shared, length: int, keep_first: bool, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(spans, runs): of ``found`` the spans that counting settles, and the runs that others of their seed have to be compared with, each context once, with its ``part`` of ``parts``."""
    order = F.struct("rank", "key", "first")
    contexts = found.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least"))
    seeds = contexts.groupBy("seed").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("contexts")).where("all > 1")
    marked = contexts.join(seeds, "seed").select("seed", "context", "n", "least", "contexts")
    known = found.join(marked, ["seed", "context"])
    parts = F.ceil(F.col("contexts") / CROWD).cast("int")
    copies = known.select(
        "key", "rank", "first", "windows", "seed", (F.col("n") > 1).alias("twice"), order.eqNullSafe(F.col("least")).alias("leads"), (F.col("contexts") > 1).alias("mixed"),
        parts.alias("parts"), F.pmod(F.xxhash64("context"), parts.cast("long")).cast("int").alias("part"), *extra,
    )
    copies = shared.put(copies, free=True)
    settled = copies.where("twice AND NOT leads" if keep_first else "twice").select("key", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") + F.lit(length - 1)).cast("long").alias("stop"))
    return settled, copies.where("mixed AND leads")


def repeated_spans(rows: DataFrame, shared: common.Shared, *, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(key, spans) of ``rows`` (key, rank, text): in each text the bytes [start, stop) of repeated strings of ``length`` bytes.

    With ``keep_first`` the first copy by rank, key and position is no repeat.
    """
    if length < 2 * SEED:
        raise ValueError(f"length must be {2 * SEED} or more")
    runs_schema = "key long, rank long, first int, windows int, seed long, context long"
    found = shared.put(rows.select("key", "rank", "text").mapInArrow(lambda it: _emit_runs(it, length), runs_schema))
    # Most seeds stand once; the others' runs are less than half of all.
    several = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    several = shared.put(several)  # so that both sides of the join are plain shuffles, of which Spark can split a hot seed
    live = shared.put(found.join(several, "seed", "left_semi"), free=True)
    shared.drop(found)
    settled, apart = _folded(live, shared, length, keep_first)
    shared.drop(live)
    spans = [settled]
    wanted = apart.groupBy("key").agg(F.collect_list(F.struct("first", "windows", "seed", "part", "parts")).alias("wanted"))
    with_text = rows.select("key", "rank", "text").join(wanted, "key").select("key", "rank", "text", "wanted")
    strings = with_text.mapInArrow(lambda it: _contexts(it, length), "key long, rank long, first int, seed long, part int, parts int, context binary")
    # Seeds of more and more bytes, up to the whole window.
    longer = sorted({min(length, SEED + (length - SEED) * k // 4) for k in range(1, 5)})
    for k, bytes_ in enumerate([*longer, None]):
        ordered = strings.repartition("seed", "part").sortWithinPartitions("seed", "part", "rank", "key", "first")
        done = shared.put(ordered.mapInArrow(lambda it: _settle(it, length, keep_first), _SETTLED), free=True)
        spans.append(done.where("length(context) = 0").select("key", "start", "stop"))
        onward = done.where("length(context) > 0").select("key", "rank", "start", "context")
        if bytes_ is None or not onward.limit(1).count():
            break
        again = shared.put(onward.mapInArrow(lambda it, b=bytes_: _emit_again(it, length, b), "key long, rank long, first long, windows int, seed long, context long, string binary"))
        settled, apart = _folded(again, shared, length, keep_first, ("string",))
        shared.drop(again)
        spans.append(settled)
        if bytes_ == length:
            break  # a seed has one context
        strings = apart.select("key", "rank", "first", "seed", "part", "parts", F.col("string").alias("context"))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    return every.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own: a hash of doc_id and text, as doc_id may be null or repeated."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("rank"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _united(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return start[heads], reach[np.append(heads[1:], len(start)) - 1]


def _cut(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        data, limits = common.text_bytes(part.column("text"))
        blob = data.tobytes()
        spans = part.column("spans")
        flat, offsets = spans.flatten(), np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        starts, stops = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "stop"))
        removed, count, kept = [], [], []
        for d in range(part.num_rows):
            whole = blob[limits[d] : limits[d + 1]]
            a, b = _united(starts[offsets[d] : offsets[d + 1]], stops[offsets[d] : offsets[d + 1]]) if offsets[d + 1] > offsets[d] else (starts[:0], stops[:0])
            removed.append(int((b - a).sum()))
            count.append(len(a))
            if len(a):
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(whole)]
                whole = b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2]))
            kept.append(hashlib.sha256(whole).hexdigest() if digests else whole)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(limits)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string() if digests else pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, keep_first: bool = True, digests: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes left over, or their SHA-256.

    With ``keep_first``, of rows that agree in doc_id and text one is the first,
    and the others lose all bytes if they have ``length`` or more.
    """
    shared = common.Shared(docs.sparkSession, "repeats")
    rows = keyed(docs)
    spans = repeated_spans(rows, shared, length=length, keep_first=keep_first)
    joined = rows.join(spans, "key", "left").select("key", "doc_id", "text", "spans")
    if keep_first:
        size = F.octet_length("text").cast("long")
        again = (F.row_number().over(W.partitionBy("key").orderBy("key")) > 1) & (size >= length)
        joined = joined.withColumn("spans", F.when(again, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop")))).otherwise(F.col("spans")))
    joined = joined.select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda it: _cut(it, digests), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digests else 'binary'}")
