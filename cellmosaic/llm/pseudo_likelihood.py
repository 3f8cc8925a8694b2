"""LM scoring by masked pseudo-likelihood.

Words, in lower case, are counted in a distributed table.  They are the leaves'
content of a tree of two levels: words that are common enough have a leaf of
their own, the others share leaves by their last two letters, and leaves have
about equal mass.  The tree, the network and its buckets of context grow with
the vocabulary.  A small network reads the words on either side of a masked one
and predicts its branch and then its leaf; inside its leaf a word has its
share of the leaf's counts.  All three factors sum to one.

Texts are dealt into blocks.  The distinct words of a block come back to it with
their counts, so no task holds the vocabulary.  Every partition trains a copy of
the network from the same start, on all its words, and the copies are averaged
by their words; that is done ``ROUNDS`` times, each from the last average.  Sums
are whole numbers, so their order does not matter.  A batch is made of windows
of ``WINDOW`` places, in which each word is read once for itself and all its
neighbours.  The score of a text is the sum of the log-probabilities of all its
words, each given both sides.

Approximate are the reading of the context (neighbours are hashed to buckets),
the choice inside a leaf, which the context does not change, and the averaging
of copies, through which scores depend on how the table is partitioned.  Words
themselves are never hashed together.  Null and empty texts have no words and
score 0.  A word that the model has not seen counts as one that stands once in
its leaf.  Repeated rows get equal scores if they are in one block.  A very long
text is a block of its own.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm import common

WIDTH, SIDE, ROUNDS = 12, 2, 2
BATCH, RATE, SEED = 4096, 0.5, 7
#: Words that stand together in a batch, in training.
WINDOW = 64
#: Bytes of a word that is hashed by itself.
LONG_WORD = 64
#: Parameters of a row, when copies of the network are added.
PIECE = 1024
#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
_FIXED = float(1 << 16)
_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
#: The table of ``zlib.crc32``, from its values of single bytes.
_CRC = np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], dtype=np.uint32)


def sizes_for(words: int) -> tuple[int, int]:
    """Branches (and leaves of each) of the tree, and buckets of context, for a vocabulary."""
    return max(8, round(4 * words**0.125)), 1 << max(12, int(8 * words**0.5 - 1).bit_length())


@dataclass
class Tree:
    """``own`` are the words that have a leaf, ``own_leaf`` their leaves, ``leaf`` the leaves by bucket of ending, ``mass`` the count of each leaf's words and one more for unseen ones."""

    width: int
    own: pa.Array
    own_leaf: np.ndarray
    leaf: np.ndarray
    mass: np.ndarray

    def of(self, distinct: pa.Array) -> np.ndarray:
        """The leaf of each word."""
        if not len(distinct):
            return np.zeros(0, dtype=np.int32)
        endings = pc.utf8_slice_codeunits(distinct, start=-2).dictionary_encode()
        bucket = crc32(endings.dictionary) % np.uint32(len(self.leaf))
        out = self.leaf[bucket][endings.indices.to_numpy(zero_copy_only=False)]
        if len(self.own):
            at = pc.fill_null(pc.index_in(distinct, value_set=self.own), -1).to_numpy(zero_copy_only=False)
            out = np.where(at >= 0, self.own_leaf[at], out)
        return out


def grow_tree(own: list[tuple[str, int]], endings: list[tuple[int, str, int]], width: int, buckets: int) -> Tree:
    """From (word, count) and (bucket, ending, count); units in order of count and of ending are cut into leaves of about equal mass."""
    own, endings = sorted(own, key=lambda x: (-x[1], x[0])), sorted(endings, key=lambda x: (x[1], x[0]))
    counts = np.array([x[1] for x in own] + [x[2] for x in endings], dtype=np.float64)
    leaves = width * width
    middle = np.cumsum(counts) - counts / 2
    place = np.minimum((leaves * middle / max(counts.sum(), 1.0)).astype(np.int64), leaves - 1)
    table = np.full(buckets, leaves - 1, dtype=np.int32)
    for (bucket, _, _), x in zip(endings, place[len(own) :].tolist()):
        table[bucket] = x
    mass = np.bincount(place, weights=counts, minlength=leaves) + 1
    return Tree(width, pa.array([x[0] for x in own], pa.large_string()), place[: len(own)].astype(np.int32), table, mass)


@dataclass
class Network:
    """``embed`` has a last row for what lies beyond a text; ``out`` and ``bias`` are of the branches, ``leaf_out`` and ``leaf_bias`` of each branch's leaves."""

    embed: np.ndarray
    mix: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    leaf_out: np.ndarray
    leaf_bias: np.ndarray

    @staticmethod
    def start(mass: np.ndarray, width: int, buckets: int) -> Network:
        """At the start branches and leaves have their ``mass`` in the corpus, whatever the context."""
        r = np.random.default_rng(SEED)
        square = mass.reshape(width, width)
        normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        branch = np.log(square.sum(axis=1) / square.sum()).astype(np.float32)
        leaf = np.log(square / square.sum(axis=1, keepdims=True)).astype(np.float32)
        return Network(normal(0.3, buckets + 1, WIDTH), np.ones((len(_OFFSETS), WIDTH), np.float32), np.zeros((WIDTH, width), np.float32), branch, np.zeros((width, WIDTH, width), np.float32), leaf)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.mix, self.out, self.bias, self.leaf_out, self.leaf_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, values: np.ndarray) -> Network:
        """A network of the same shape."""
        cuts = np.cumsum([p.size for p in self.parts()])
        return Network(*(x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(values, cuts[:-1]), self.parts())))

    def hidden(self, near: np.ndarray, mixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embeddings of rows of buckets, and what the places of each row get from both sides, flat for each row; there are ``SIDE`` buckets more at either end of a row.  ``mixes`` is ``mix`` once for each place."""
        seen = self.embed.take(near, axis=0).reshape(len(near), -1)
        span = near.shape[1] - 2 * SIDE
        mixes = mixes[:, : span * WIDTH]
        h = seen[:, _shifted(_OFFSETS[0], span)] * mixes[0]
        one = np.empty_like(h)
        for o, m in zip(_OFFSETS[1:], mixes[1:]):
            h += np.multiply(seen[:, _shifted(o, span)], m, out=one)
        return seen, np.tanh(h, out=h)

    def log_probabilities(self, padded: np.ndarray, place: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each leaf given its context; ``place`` is where its word stands in ``padded``."""
        width, out = len(self.bias), np.zeros(len(leaf), dtype=np.float32)
        firsts, lasts = place[::BATCH], np.append(place[BATCH - 1 :: BATCH], place[-1:])
        mixes = np.tile(self.mix, max((b - a + 1 for a, b in zip(firsts.tolist(), lasts.tolist())), default=0))
        small, small_leaf = self.small()
        for i in range(0, len(leaf), BATCH):
            order, groups = _by_branch(leaf[i : i + BATCH] // width)
            inner, at = leaf[i : i + BATCH][order] % width, place[i : i + BATCH]
            _, h = self.hidden(padded[None, at[0] - SIDE : at[-1] + SIDE + 1], mixes)
            h = np.ascontiguousarray(h.reshape(-1, WIDTH).take(at[order] - at[0], axis=0).T)
            branches = self.out.T @ h + self.bias[:, None]
            chosen = np.concatenate([branches[b, low:high] for b, low, high in groups])
            leaves = self.leaf_values(h, groups)
            out[i + order] = chosen - _log_total(branches, small) + leaves[inner, np.arange(len(inner))] - _log_total(leaves, small_leaf)
        return out.astype(np.float64)

    def small(self) -> tuple[bool, bool]:
        """Whether exponentials of the branches' and of the leaves' values, whatever the context, are far from the ends of a float."""
        return tuple(bool((np.abs(w).sum(axis=-2) + np.abs(b)).max(initial=0) < 40) for w, b in ((self.out, self.bias), (self.leaf_out, self.leaf_bias)))

    def leaf_values(self, h: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
        """Of the leaves of each word's branch, one column a word."""
        out = np.empty((len(self.bias), h.shape[1]), dtype=np.float32)
        for b, low, high in groups:
            np.add(self.leaf_out[b].T @ h[:, low:high], self.leaf_bias[b][:, None], out=out[:, low:high])
        return out

    def train(self, near: np.ndarray, leaf: np.ndarray) -> None:
        """One step of gradient descent on the mean loss of the words of some windows.

        A bucket is read once and its steps are added once, though it is in the
        context of several words.
        """
        leaf, width = leaf.ravel(), len(self.bias)
        words = np.flatnonzero(leaf >= 0)
        order, groups = _by_branch(leaf[words] // width)
        words, n = words[order], len(words)
        mixes = np.tile(self.mix, near.shape[1] - 2 * SIDE)
        small, small_leaf = self.small()
        seen, h = self.hidden(near, mixes)
        h = np.ascontiguousarray(h.reshape(-1, WIDTH).take(words, axis=0).T)
        step = np.float32(RATE / n)
        grad = self.out.T @ h
        grad += self.bias[:, None]
        _softmax(grad, step, small)
        for b, low, high in groups:
            grad[b, low:high] -= step
        back = self.out @ grad
        self.out -= h @ grad.T
        self.bias -= grad.sum(axis=1)
        part = _softmax(self.leaf_values(h, groups), step, small_leaf)
        part.reshape(-1)[leaf[words] % width * n + np.arange(n)] -= step
        # A branch sees a share of the batch only.
        share = np.float32(min(width, 8))
        for b, low, high in groups:
            mine = part[:, low:high]
            back[:, low:high] += self.leaf_out[b] @ mine
            self.leaf_out[b] -= (h[:, low:high] @ mine.T) * share
        self.leaf_bias[[b for b, _, _ in groups]] -= np.add.reduceat(part, [low for _, low, _ in groups], axis=1).T
        back *= 1 - h * h
        into = np.zeros((leaf.size, WIDTH), dtype=np.float32)
        into[words] = back.T
        into = into.reshape(len(near), -1)
        # Rows are rare: their step is not divided by the whole batch.
        mixes *= np.float32(16)
        steps, one, span = np.zeros_like(seen), np.empty_like(into), near.shape[1] - 2 * SIDE
        for o, m, wide in zip(_OFFSETS, self.mix, mixes):
            there = _shifted(o, span)
            steps[:, there] += np.multiply(into, wide, out=one)
            m -= np.einsum("kx,kx->x", into, seen[:, there]).reshape(span, WIDTH).sum(axis=0)
        rows = near.ravel()
        by_row = np.argsort(rows.astype(np.uint16), kind="stable") if len(self.embed) <= 1 << 16 else np.argsort(rows, kind="stable")
        rows = rows[by_row]
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        # Added in pairs of numbers, as complex ones.
        sums = np.add.reduceat(steps.reshape(-1, WIDTH).take(by_row, axis=0).view(np.complex64), heads, axis=0).view(np.float32)
        self.embed[rows[heads]] = self.embed.take(rows[heads], axis=0) - sums


def _shifted(offset: int, span: int) -> slice:
    """The embeddings ``offset`` places from each of the ``span`` places of a flat row."""
    return slice((SIDE + offset) * WIDTH, (SIDE + offset + span) * WIDTH)


def _softmax(x: np.ndarray, total: np.float32, small: bool) -> np.ndarray:
    """Of each column, in place, times ``total``; ``small`` values need no shift."""
    if not small:
        x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= total / x.sum(axis=0)
    return x


def _log_total(x: np.ndarray, small: bool) -> np.ndarray:
    """The logarithm of the sum of the exponentials of each column; ``small`` values need no shift."""
    if small:
        return np.log(np.exp(x).sum(axis=0))
    most = x.max(axis=0)
    each = x - most
    return most + np.log(np.exp(each, out=each).sum(axis=0))


def _by_branch(branch: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by branch, and (branch, first, end) of those that occur."""
    order = np.argsort(branch.astype(np.uint16), kind="stable")
    there = branch[order]
    ends = [0, *(np.flatnonzero(np.diff(there)) + 1).tolist(), len(there)]
    return order, [(int(there[a]), a, b) for a, b in zip(ends, ends[1:]) if b > a]


def padded_words(bucket: np.ndarray, first: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words with ``SIDE`` times ``beyond`` around each text, and the place of each word there."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(bucket)) + SIDE * (text + 1)
    padded = np.full(len(bucket) + SIDE * (len(sizes) + 1), beyond, dtype=np.int32)
    padded[place] = bucket
    return padded, place


def windows(padded: np.ndarray, place: np.ndarray, leaf: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``WINDOW`` places that hold every word once: their buckets with ``SIDE`` more at either end, and their leaves, -1 where there is no word."""
    n = max(0, -(-(len(padded) - 2 * SIDE) // WINDOW))
    whole = np.full(n * WINDOW + 2 * SIDE, beyond, dtype=np.int32)
    whole[: len(padded)] = padded[: len(whole)]
    leaves = np.full(n * WINDOW, -1, dtype=np.int32)
    leaves[place - SIDE] = leaf
    leaves = leaves.reshape(n, WINDOW)
    some = np.flatnonzero((leaves >= 0).any(axis=1))
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW + 2 * SIDE)[::WINDOW][some], leaves[some]


def crc32(words: pa.Array) -> np.ndarray:
    """The CRC-32 of the bytes of each word, all words at a time."""
    data, limits = common.text_bytes(words)
    size, out = np.diff(limits), np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    left = np.flatnonzero(size <= LONG_WORD)
    for i in range(LONG_WORD):
        left = left[size[left] > i]
        if not len(left):
            break
        now = out[left]
        out[left] = _CRC[(now ^ data[limits[left] + i]) & 255] ^ (now >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[limits[i] : limits[i + 1]])
    return out


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first, code, distinct) of the words of all texts; case does not count."""
    # Whole texts are folded, so that words are told apart once.
    w = common.words_of(pc.ascii_lower(texts))
    return w.first, w.code, w.distinct.cast(pa.large_string())


def read(texts: pa.Array, tree: Tree, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(first, leaf, padded, place, code, distinct) of the words of all texts."""
    first, code, distinct = coded_words(texts)
    bucket = (crc32(distinct) % np.uint32(buckets)).astype(np.int32)[code] if len(code) else np.zeros(0, np.int32)
    leaf = tree.of(distinct)[code] if len(code) else np.zeros(0, np.int32)
    return first, leaf, *padded_words(bucket, first, buckets), code, distinct


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, size = TaskContext.get().partitionId() << 32, 0
    for part in common.slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(np.full(part.num_rows, block))], names=["doc_id", "text", "block"])
        size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if size >= BLOCK_BYTES:
            block, size = block + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(block: int, texts: list[pa.Array]) -> pa.RecordBatch:
        _, code, distinct = coded_words(pa.concat_arrays(texts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), block)), distinct.cast(pa.string()), pa.array(np.bincount(code, minlength=len(distinct)))], names=["block", "word", "n"])

    now, held = None, []
    for batch in batches:
        of = batch.column("block").to_numpy()
        ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        at = 0
        for end in ends if len(of) else []:
            if held and of[at] != now:
                yield counted(now, held)
                held = []
            now = int(of[at])
            held.append(batch.column("text").slice(at, end - at))
            at = end
    if held:
        yield counted(now, held)


def _train(batches: Iterator[pa.RecordBatch], network: Network, tree: Tree, buckets: int) -> Iterator[pa.RecordBatch]:
    network, words = network.filled(network.flat()), 0
    for part in common.slices(batches):
        _, leaf, padded, place, _, _ = read(part.column("text"), tree, buckets)
        near, leaves = windows(padded, place, leaf, buckets)
        # Windows of a batch come from all over the slice.
        step = -(-len(leaf) // BATCH)
        for i in range(step):
            network.train(near[i::step], leaves[i::step])
        words += len(leaf)
    if words:
        flat = np.rint(network.flat().astype(np.float64) * _FIXED).astype(np.int64) * words
        values = np.concatenate([flat, [words]])
        starts = np.arange(0, len(values), PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(starts.astype(np.int32)), pa.array([values[i : i + PIECE].tobytes() for i in starts], pa.binary())], names=["start", "piece"])


def _sum(pieces: pa.Table) -> pa.Table:
    """The sum of the pieces of a start.  Halves of the numbers are added apart, so that no sum is too large."""
    high = low = 0
    for x in pieces.column("piece"):
        values = np.frombuffer(x.as_buffer(), dtype=np.int64)
        high, low = high + (values >> 32), low + (values & 0xFFFFFFFF)
    total = high * float(1 << 32) + low
    return pa.table({"start": pieces.column("start")[:1], "piece": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Model:
    """``vocabulary`` is a table of (word, n)."""

    vocabulary: DataFrame
    tree: Tree
    buckets: int
    network: Network


def _dealt(docs: DataFrame, shared: common.Shared) -> tuple[DataFrame, DataFrame]:
    """Texts with their block, and the counted words of each block."""
    dealt = shared.put(docs.select("doc_id", "text").mapInArrow(_blocks, "doc_id long, text string, block long"))
    return dealt, shared.put(dealt.select("text", "block").mapInArrow(_count, "block long, word string, n long"))


def _fit(dealt: DataFrame, vocabulary: DataFrame, shared: common.Shared, rounds: int) -> Model | None:
    """A model of all texts; the driver gets the words that have a leaf of their own, a row for each bucket of endings and the parameters."""
    vocabulary = shared.put(vocabulary, free=True)
    size, total = vocabulary.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not size:
        return None
    width, buckets = sizes_for(size)
    least = max(2, -(-total // (width * width)))
    own = [(r[0], r[1]) for r in vocabulary.where(F.col("n") >= least).collect()]  # a leaf each at most
    ending = F.substring("word", -2, 2)
    endings = vocabulary.where(F.col("n") < least).groupBy((F.crc32(ending) % buckets).alias("bucket")).agg(F.min(ending), F.sum("n")).collect()
    tree = grow_tree(own, [(int(r[0]), r[1], r[2]) for r in endings], width, buckets)
    network = Network.start(tree.mass, width, buckets)
    for _ in range(rounds):
        sums = dealt.select("text").mapInArrow(lambda it, now=network: _train(it, now, tree, buckets), "start int, piece binary").groupBy("start").applyInArrow(_sum, "start int, piece binary")
        values = np.concatenate([np.frombuffer(r.piece) for r in sorted(sums.collect())])
        network = network.filled(values[:-1] / values[-1] / _FIXED)
    return Model(vocabulary, tree, buckets, network)


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """Trains on all of ``docs``; None if they have no words.  Without rounds the context changes nothing."""
    shared = common.Shared(docs.sparkSession, "likelihood")
    dealt, counted = _dealt(docs, shared)
    return _fit(dealt, counted.groupBy("word").agg(F.sum("n").alias("n")), shared, rounds)


def _score(docs: pa.Table, words: pa.Table, model: tuple[Tree, int, Network]) -> pa.Table:
    """Per text the log-probability of its words, from the counts of the block's words."""
    tree, buckets, network = model
    known, counts = words.column("word").combine_chunks().cast(pa.large_string()), np.append(words.column("n").to_numpy(), 1)
    parts = [(part.column("doc_id"), *read(part.column("text"), tree, buckets)) for part in common.slices(iter(docs.combine_chunks().to_batches()))]
    # One lookup for the block: its words are put into a table once.
    rows = pc.fill_null(pc.index_in(pa.chunked_array([p[-1] for p in parts], pa.large_string()), value_set=known), len(known)).to_numpy()
    out, at = [], 0
    for ids, first, leaf, padded, place, code, distinct in parts:
        n, total = np.diff(first), np.zeros(len(ids))
        if len(code):
            of, at = np.log(counts[rows[at : at + len(distinct)]]), at + len(distinct)
            each = network.log_probabilities(padded, place, leaf) + of[code] - np.log(tree.mass)[leaf]
            sums = np.concatenate([[0.0], np.cumsum(each)])
            total = sums[first[1:]] - sums[first[:-1]]
        out.append(pa.table({"doc_id": ids, "n_words": n.astype(np.int64), "log_probability": total, "per_word": np.where(n > 0, total / np.maximum(n, 1), 0.0)}))
    return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_probability": pa.array([], pa.float64()), "per_word": pa.array([], pa.float64())})


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_words, log_probability, per_word) of every row of ``docs`` under a model, or one trained on all of them."""
    shared = common.Shared(docs.sparkSession, "likelihood")
    dealt, counted = _dealt(docs, shared)
    if model:
        back = shared.put(counted.select("block", "word").join(model.vocabulary, "word"), free=True)
        shared.drop(counted)
    else:
        # The words are brought together once: each block's words get their sums, and the first of each word is the vocabulary's.
        same = Window.partitionBy("word").orderBy("block")
        everywhere = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        back = shared.put(counted.select("block", "word", F.sum("n").over(everywhere).alias("n"), (F.row_number().over(same) == 1).alias("leads")), free=True)
        shared.drop(counted)
        model = _fit(dealt, back.where("leads").select("word", "n"), shared, ROUNDS)
        back = back.drop("leads")
    if model is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_probability"), F.lit(0.0).alias("per_word"))
    both, parts = dealt.groupBy("block").cogroup(back.groupBy("block")), (model.tree, model.buckets, model.network)
    return both.applyInArrow(lambda a, b: _score(a, b, parts), "doc_id long, n_words long, log_probability double, per_word double")
