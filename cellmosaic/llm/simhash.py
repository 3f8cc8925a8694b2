"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into 16 segments of 4 bits; the counts of set bits of its
segments are its place in a grid.  Two fingerprints at Hamming distance 2 or
less have places at Manhattan distance 2 or less, so each place is entered in
the grid cells at distance 1 or less and two such places meet in a common cell
(the range join; Manhattan distance is the lower bound).  Inside cells that
several fingerprints share, each is entered at the bit strings of the cell that
are at Hamming distance 1 or less from it.  Fingerprints that meet there are at
distance 2 or less, at most 65 can meet, and they are linked to the least of
them after an exact check.  No pairs are formed, and no cell is capped.

Null and empty texts have no words and fingerprint zero; equal texts have equal
fingerprints.  Repeated rows stay separate rows of one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmosaic.llm import common
from cellmosaic.llm.components import connected_components

SEED = 42
#: Shingles whose bits are counted in 8-bit lanes at a time.
_LANE = 255
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the word shingles of all texts and the limits of each text's."""
    w = common.words_of(texts, encode=False)
    counts = np.diff(w.first)
    length = w.end - w.start
    at = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length + 1, out=at[1:])
    joined = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    word = np.ones(int(at[-1]), dtype=bool)
    word[at[1:] - 1] = False
    joined[word] = _LOWER[w.data[~common._BLANK[w.data]]]
    each = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    limits = np.zeros(len(each) + 1, dtype=np.int64)
    np.cumsum(each, out=limits[1:])
    text = np.repeat(np.arange(len(each)), each)
    start = w.first[:-1][text] + np.arange(len(text)) - limits[:-1][text]
    last = np.minimum(start + size, w.first[1:][text]) - 1
    blob, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(blob[a:b], SEED) for a, b in zip(at[start].tolist(), (at[last] + length[last]).tolist())]
    return np.array(hashes, dtype=np.uint64), limits


def majority_bits(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Of each text the 64 bits that are set in over half of its hashes."""
    counts = np.diff(limits)
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    lanes = -(-counts[full] // _LANE)
    first = np.zeros(len(full) + 1, dtype=np.int64)
    np.cumsum(lanes, out=first[1:])
    lane_text = np.repeat(np.arange(len(full)), lanes)
    lane_start = limits[full][lane_text] + _LANE * (np.arange(first[-1]) - first[lane_text])
    mask = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & mask, lane_start)
        per_lane = sums.view(np.uint8).reshape(-1, 8).astype(np.int32)
        total = np.add.reduceat(per_lane, first[:-1], axis=0)
        set_bits = 2 * total > counts[full][:, None]
        for byte in range(8):
            out[full] |= set_bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        bits = majority_bits(*shingle_hashes(part.column("text"), size))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])


def fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, bits) of every row of ``docs``; ``size`` words a shingle."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprints(it, size), "doc_id long, bits long")


def segment_counts(bits: Column) -> Column:
    """The popcounts of the 16 segments of 4 bits, each in its own 4 bits of a long."""
    ones = [F.shiftrightunsigned(bits, k).bitwiseAND(F.lit(0x1111111111111111)) for k in range(4)]
    return ones[0] + ones[1] + ones[2] + ones[3]  # at most 4 in any segment: no carry, no overflow


_STEP = [1 << (4 * j) for j in range(16)]


def cells_near(place: Column) -> Column:
    """The grid cells at Manhattan distance 1 or less of a place."""
    up = [F.when(F.shiftrightunsigned(place, 4 * j).bitwiseAND(F.lit(15)) < 4, place + F.lit(s)) for j, s in enumerate(_STEP)]
    down = [F.when(F.shiftrightunsigned(place, 4 * j).bitwiseAND(F.lit(15)) > 0, place - F.lit(s)) for j, s in enumerate(_STEP)]
    return F.array_compact(F.array(place, *up, *down))


_EXACT = """filter(CASE WHEN cell = place THEN array(bits) ELSE transform(sequence(0, 3),
    k -> bits ^ shiftleft(1L, bit_count(abs(cell - place) - 1) + k)) END, m -> cell = place OR bit_count(m) - bit_count(bits) = signum(cell - place))"""


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that connect the fingerprints ``distinct`` (bits) within 2 bits of each other, without pairs."""
    placed = distinct.select("bits", segment_counts(F.col("bits")).alias("place"))
    entered = placed.select("bits", "place", F.explode(cells_near(F.col("place"))).alias("cell"))
    shared = entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    exact = entered.join(shared, "cell", "left_semi").select("bits", F.explode(F.expr(_EXACT)).alias("meeting"))
    met = exact.groupBy("meeting").agg(F.collect_set("bits").alias("all")).where("size(all) > 1")
    found = met.select(F.array_min("all").alias("v"), F.explode("all").alias("u"))
    return found.where("u <> v AND bit_count(u ^ v) <= 2").distinct()


def components(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, bits, component_id) of every row; component_id is the smallest doc_id reachable over links of 2 bits or less."""
    shared = common.Shared(docs.sparkSession, "simhash")
    marked = shared.put(fingerprints(docs, size))
    distinct = shared.put(marked.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct), shared)
    joined = distinct.join(roots, distinct.bits == roots.node, "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(named, "root").select("bits", "component_id")
    return marked.join(labels, "bits").select("doc_id", "bits", "component_id")


#: Of one text in ``SAMPLE``, shingles that at least ``OFTEN`` texts have are put last in the order of prefixes, ``MOST`` of them at most.
SAMPLE, OFTEN, MOST = 16, 4, 1 << 20
#: Texts that share a shingle are compared in blocks of so many on either side.
BLOCK = 4096
#: Rows that are compared at a time, unless one group has more.
_ROWS = 1 << 15


def prefix_length(size: int, similarity: float) -> int:
    """Texts at ``similarity`` share one of so many first shingles, whatever order all texts' shingles have."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def _often(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each text's distinct shingles."""
    for part in common.slices(batches):
        hashes, limits = shingle_hashes(part.column("text"), size)
        sets = [np.unique(hashes[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["mark"])


def frequent_shingles(named: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts have, by a sample; any list gives the same links, a good one fewer candidates."""
    some = named.where(F.pmod(F.col("text_key"), F.lit(SAMPLE)) == 0).dropDuplicates(["text_key"]).select("text")
    counted = some.mapInArrow(lambda it: _often(it, size), "mark long").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(counted.orderBy(F.desc("n"), "mark").limit(MOST).select("mark").toPandas()["mark"].to_numpy(dtype=np.int64).view(np.uint64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _narrow(shingles: np.ndarray) -> np.ndarray:
    """The set of a text's shingles by 32 bits each, as it is compared."""
    return np.unique((shingles >> np.uint64(32)).astype(np.uint32)).view(np.int32)


#: Buckets of the smallest sketch.
SKETCH = 512


def _sketches(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, whether it holds an odd number of the text's shingles: with about a bucket a shingle, and with half as many.

    Two sketches of one size differ in no more bits than their sets do in
    shingles, so sketches that differ in too many rule a pair out without its sets.
    """
    buckets = max(SKETCH, 1 << max(len(shingles) - 1, 1).bit_length())
    odd = np.bincount(shingles.view(np.uint32) & np.uint32(buckets - 1), minlength=buckets).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64), np.packbits(odd[: buckets // 2] ^ odd[buckets // 2 :]).view(np.int64)


def _folded(sketch: np.ndarray) -> np.ndarray:
    """A sketch of ``SKETCH`` buckets from a larger one."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH // 64), axis=0)


def _prefixed(batches: Iterator[pa.RecordBatch], size: int, similarity: float, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        hashes, limits = shingle_hashes(part.column("text"), size)
        bits = pa.array(majority_bits(hashes, limits).view(np.int64))
        marks, sizes, sketches, shares = [], [], [], []
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
            whole = np.unique(hashes[a:b])
            if len(often) and len(whole):
                last = often[np.minimum(np.searchsorted(often, whole), len(often) - 1)] == whole
                ordered = np.concatenate([whole[~last], whole[last]])
                shares.append(1000 * int(last.sum()) // len(whole))
            else:
                ordered = whole
                shares.append(0)
            # Texts without words meet at 0.
            marks.append(ordered[: prefix_length(len(ordered), similarity)].view(np.int64) if len(whole) else np.zeros(1, np.int64))
            narrow = _narrow(whole)
            sizes.append(len(narrow))
            sketches.append(_sketches(narrow))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), bits, pa.array(sizes, pa.int32()), pa.array(shares, pa.int32()), _lists(marks), *(_lists([x[k] for x in sketches]) for k in range(2)), _lists([_folded(x[0]) for x in sketches])],
            names=["doc_id", "text_key", "bits", "n", "common", "marks", "sketch", "half", "fold"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        hashes, limits = shingle_hashes(part.column("text"), size)
        sets = [_narrow(hashes[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
        yield pa.RecordBatch.from_arrays([part.column("text_key"), _lists(sets)], names=["text_key", "shingles"])


def _keyed(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _alike(a: str, b: str, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both)


def _near(n: str, m: str, similarity: float) -> Column:
    return F.least(n, m) + F.lit(1e-9) >= F.lit(similarity) * F.greatest(n, m)


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v) that sizes and sketches do not rule out."""
    side = lambda name, mark: sketches.select(F.col("text_key").alias(name), *(F.col(x).alias(f"{x}_{mark}") for x in ("n", "sketch", "half")))
    both = pairs.select("u", "v").join(side("u", "a"), "u").join(side("v", "b"), "v").where(_near("n_a", "n_b", similarity))
    # Sizes are near, so one sketch has twice the buckets of the other at most.
    a = F.when(F.size("sketch_a") <= F.size("sketch_b"), F.col("sketch_a")).otherwise(F.col("half_a"))
    b = F.when(F.size("sketch_b") <= F.size("sketch_a"), F.col("sketch_b")).otherwise(F.col("half_b"))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return both.where(apart <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)).select("u", "v")


def _verified(pairs: DataFrame, named: DataFrame, shared: common.Shared, size: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v) of text keys whose shingle sets reach ``similarity``; sets are made of the texts in ``pairs`` only."""
    keys = pairs.select(F.col("u").alias("text_key")).union(pairs.select("v")).distinct()
    once = named.select("text_key", "text").dropDuplicates(["text_key"])
    sets = shared.put(once.join(keys, "text_key", "left_semi").mapInArrow(lambda it: _sets(it, size), "text_key long, shingles array<int>"), free=True)
    both = pairs.join(sets.select(F.col("text_key").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("text_key").alias("v"), F.col("shingles").alias("b")), "v")
    found = shared.put(both.where(_alike("a", "b", similarity)).select("u", "v"), free=True)
    shared.drop(sets)
    return found


def grid_pairs(marked: DataFrame, shared: common.Shared) -> DataFrame:
    """Pairs (u, v) of text keys that the grid links: one for each text whose fingerprint another text has, and one for each link of fingerprints."""
    texts = shared.put(marked.select("text_key", "bits").distinct())
    least = shared.put(texts.groupBy("bits").agg(F.min("text_key").alias("rep")))
    same = texts.join(least, "bits").where("text_key <> rep").select(F.col("text_key").alias("u"), F.col("rep").alias("v"))
    linked = shared.put(links(least.select("bits")))
    named = linked.join(least.select(F.col("bits").alias("u"), F.col("rep").alias("rep_u")), "u").join(least.select(F.col("bits").alias("v"), F.col("rep").alias("rep_v")), "v")
    return same.union(named.select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")))


def _compared(group: np.ndarray, u: np.ndarray, n: np.ndarray, root: np.ndarray, own: np.ndarray, fold: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one group that differ in root and, where ``own`` is not -1, in block, and whose sizes and folded sketches do not rule each other out."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(heads, len(group)))
    end = np.repeat(heads + size, size)
    alive, found = np.arange(len(group)), []
    for d in range(1, int(size.max(initial=0))):
        alive = alive[alive + d < end[alive]]
        j = alive + d
        fit = (root[alive] != root[j]) & ((own[alive] < 0) | (own[alive] != own[j]))
        fit &= np.minimum(n[alive], n[j]) + 1e-9 >= similarity * np.maximum(n[alive], n[j])
        i, j = alive[fit], j[fit]
        if not len(i):
            continue
        apart = np.bitwise_count(fold[i] ^ fold[j]).sum(axis=1, dtype=np.int64)  # of unsigned numbers: of others numpy counts the absolute value's bits
        fit = apart <= (n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        found.append((i[fit], j[fit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _meet(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Candidates of a partition that is sorted by mark and block; no pair of a group leaves it but those that may be alike."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def pairs(table: pa.Table) -> pa.RecordBatch:
        whole = {name: table.column(name).combine_chunks() for name in table.column_names}
        u, n, root, own, mark, low, high = (whole[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("u", "n", "root", "own", "mark", "low", "high"))
        new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        fold = whole["fold"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(u), -1)
        i, j = _compared(np.cumsum(new), u, n, root, np.where(low == high, -1, own), fold, similarity)
        both = np.unique(np.stack([np.maximum(u[i], u[j]), np.minimum(u[i], u[j])], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < _ROWS:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(x).to_numpy() for x in ("mark", "low", "high")]
        last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if len(last):
            cut = int(last[-1]) + 1
            yield pairs(table.slice(0, cut))
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if held:
        yield pairs(pa.Table.from_batches(held))


def _in_blocks(entered: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of ``entered`` (mark, u, n, root) that share a mark, differ in root and may be alike.

    Texts are compared where they meet.  A mark with more than ``BLOCK`` texts is
    cut into blocks, and each two of its blocks meet in a place of their own.
    """
    crowds = entered.groupBy("mark").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > BLOCK).select("mark", F.ceil(F.col("texts") / BLOCK).cast("int").alias("blocks"))
    dealt = entered.join(crowds, "mark", "left").withColumn("own", F.pmod(F.xxhash64("u"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    placed = dealt.select("*", other.alias("other")).select("mark", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "u", "n", "root")
    placed = placed.join(sketches.select(F.col("text_key").alias("u"), "fold"), "u")
    sorted_ = placed.repartition("mark", "low", "high").sortWithinPartitions("mark", "low", "high")
    return sorted_.mapInArrow(lambda it: _meet(it, similarity), "u long, v long")


def similar_links(named: DataFrame, marked: DataFrame, shared: common.Shared, size: int, similarity: float) -> DataFrame:
    """Links (u, v) of text keys that connect all whose shingle sets reach ``similarity``.

    The grid links fingerprints within 2 bits first, and shingle sets verify its
    links; so most copies of a large group hang together before anything else is
    compared.  For the pairs that are further apart in bits, candidates share a
    shingle of their prefixes, so no pair is missed.  Texts that share one are
    compared with one of them first, that with the largest share of frequent
    shingles, as what copies were made from has; and then in blocks with every one
    that is not yet connected to them.  A text that is linked stays as a partner
    of the others; only pairs in one component are left out.

    Sketches rule most candidates out before the shingle sets of the others are
    made and joined.
    """
    every = marked.select(F.explode("marks").alias("mark"), F.col("text_key").alias("u"), "n", "common")
    # Most marks belong to one text; a grouped minimum, combined before its shuffle, leaves them out.
    several = every.groupBy("mark").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low < high").select("mark")
    several = shared.put(several)  # so that both sides of the join are plain shuffles, of which Spark can split a hot mark
    entered = shared.put(every.join(several, "mark", "left_semi").distinct(), free=True)
    pairs = shared.put(grid_pairs(marked, shared))
    # Equal texts are one row.
    sketches = shared.put(marked.groupBy("text_key").agg(*(F.first(x).alias(x) for x in ("n", "sketch", "half", "fold"))), free=True)
    likely = shared.put(_likely(pairs, sketches, similarity))
    found = _verified(likely, named, shared, size, similarity)
    shared.drop(pairs, likely)
    for in_blocks in (False, True):
        # Marks of one component have no more to compare.
        roots = connected_components(found, shared).select(F.col("node").alias("u"), F.col("root").alias("of"))
        labelled = shared.put(entered.select("mark", "u", "n", "common").join(roots, "u", "left").select("mark", "u", "n", "common", F.coalesce("of", "u").alias("root")))
        apart = labelled.groupBy("mark").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("mark")
        rest = shared.put(labelled.join(apart, "mark", "left_semi"), free=True)
        shared.drop(entered, labelled)
        entered = rest
        if in_blocks:
            met = _in_blocks(entered, sketches, similarity)
        else:
            first = entered.groupBy("mark").agg(F.max(F.struct("common", "u", "n", "root")).alias("first")).select("mark", F.col("first.u").alias("v"), F.col("first.n").alias("n_v"), F.col("first.root").alias("root_v"))
            met = entered.join(first, "mark").where((F.col("root") != F.col("root_v")) & _near("n", "n_v", similarity) & (F.col("u") != F.col("v")))
        pairs = shared.put(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), free=True)
        likely = shared.put(_likely(pairs, sketches, similarity), free=True)
        found = found.union(_verified(likely, named, shared, size, similarity))
        shared.drop(pairs, likely)
    return found


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of texts whose sets of ``size``-word shingles are alike: the one with the smallest doc_id, null last.

    The grid links what differs in up to 2 bits.  Texts at that similarity differ
    in up to 15 bits, where the grid no longer separates, so the other candidates
    are texts that share a shingle of their prefixes; shingle sets decide in both
    cases.  Equal texts are told by 64 bits, shingles by 32.  Texts without words are one group.  Of repeated rows
    one stays; of rows that share a doc_id but not a group, each.
    """
    shared = common.Shared(docs.sparkSession, "near")
    named = docs.select("doc_id", "text", _keyed(docs).alias("text_key"))
    often = frequent_shingles(named, size)
    marked = shared.put(named.mapInArrow(lambda it: _prefixed(it, size, similarity, often), "doc_id long, text_key long, bits long, n int, common int, marks array<long>, sketch array<long>, half array<long>, fold array<long>"), free=True)
    texts = shared.put(marked.groupBy("text_key").agg(F.min("doc_id").alias("least")))
    roots = connected_components(similar_links(named, marked, shared, size, similarity), shared)
    grouped = texts.join(roots, texts.text_key == roots.node, "left").select("text_key", "least", F.coalesce("root", "text_key").alias("root"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "text_key")).alias("first"))
    kept = first.select(F.col("first.least").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    key, kept_id, kept_key = common.fresh(docs.columns, "text_key", "kept_id", "kept_key")
    rows, kept = docs.withColumn(key, _keyed(docs)), kept.toDF(kept_id, kept_key)
    rows = rows.join(kept, rows.doc_id.eqNullSafe(kept[kept_id]) & (rows[key] == kept[kept_key]), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).select(*docs.columns)
