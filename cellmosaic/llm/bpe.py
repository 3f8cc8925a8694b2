"""BPE encoding and decoding with a pair occurrence index.

The distinct words of some slices of a partition are laid out as one row of
symbols.  An index maps each mergeable pair to all its positions.  Active
ranks are taken in ascending order; all positions of a rank's pair are merged
from left to right, and the lists of the pairs that this makes are extended.
Words do not touch each other, so this equals encoding each for itself.

The tokenizer file's kind: NFC, lower case, white space dropped, pieces of
letters, single numerals and others, bytes as symbols, a mark at word ends.
Null texts count as empty and have no tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cellmosaic.llm import common

#: Slices whose words are indexed together.
TOGETHER = 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file, read once on the driver and sent with the tasks; its size is fixed."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model = raw["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError("not a BPE file of the kind that is supported")
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + suffix] for s in symbols]
        width = 1 << 20
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] * width + ids[b], (rank, ids[a + b]))
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        pieces = raw["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s is Unicode white space there; the separators \x1c-\x1f are none.
        self.pattern = pieces.replace(r"\s", r"\p{White_Space}")

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Every token's string and a space behind it, as bytes one after another, and their limits."""
        parts = [(self.strings.get(i, "") + " ").encode() for i in range(max(self.strings) + 1)]
        limits = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=limits[1:])
        return np.frombuffer(b"".join(parts), dtype=np.uint8), limits


#: Characters that are neither letters, numerals nor white space and start no piece of their own behind letters.
_MARKS_TEXT = ".,!?*#$%&;:|"
_MARKS = _MARKS_TEXT.encode()


class Merges:
    """The merge table as sorted keys for lookups of many pairs at once."""

    def __init__(self, merges: dict[int, tuple[int, int]]):
        keys = np.array(sorted(merges), dtype=np.int64)
        self.keys = keys
        self.rank = np.array([merges[k][0] for k in keys.tolist()], dtype=np.int64)
        self.made = np.zeros(int(self.rank.max(initial=0)) + 1, dtype=np.int64)
        self.pair = np.zeros((len(self.made), 2), dtype=np.int64)
        for k, r in zip(keys.tolist(), self.rank.tolist()):
            self.made[r] = merges[k][1]
            self.pair[r] = divmod(k, 1 << 20)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it cannot be merged."""
        key = (left << 20) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)


def merge_all(symbols: np.ndarray, after: np.ndarray, merges: Merges) -> None:
    """Merges in place; ``after[i]`` is the next position of the same piece or -1.  Merged positions hold -1."""
    left = np.flatnonzero(after >= 0)
    before = np.full(len(symbols), -1, dtype=np.int64)
    before[after[left]] = left
    rank = merges.ranks(symbols[left], symbols[after[left]])
    found = rank >= 0
    left, rank = left[found], rank[found]
    order = np.argsort(rank, kind="stable")
    left, rank = left[order], rank[order]
    heads = np.flatnonzero(np.diff(rank, prepend=-1))
    index: dict[int, list[np.ndarray]] = {r: [x] for r, x in zip(rank[heads].tolist(), np.split(left, heads[1:]))}
    active = sorted(index)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = merges.pair[r]
        j = after[places]
        good = (symbols[places] == a) & (j >= 0) & (symbols[j] == b)  # else an earlier merge took one of the two
        places, j = places[good], j[good]
        if a == b and len(places) > 1:  # in a run of equal symbols every other pair, from the left
            taken, free = [], -1
            for i, k in zip(places.tolist(), j.tolist()):
                if i != free:
                    taken.append(i)
                    free = k
            places = np.array(taken, dtype=np.int64)
            j = after[places]
        if not len(places):
            continue
        made = merges.made[r]
        symbols[places], symbols[j] = made, -1
        k = after[j]
        after[places] = k
        right = places[k >= 0]
        k = k[k >= 0]
        before[k] = right
        p = before[places]
        p = p[p >= 0]
        starts = np.concatenate([p, right])
        if not len(starts):
            continue
        new = merges.ranks(symbols[starts], symbols[after[starts]])
        found = new >= 0
        if not found.any():
            continue
        starts, new = starts[found], new[found]
        order = np.argsort(new, kind="stable")
        starts, new = starts[order], new[order]
        heads = np.flatnonzero(np.diff(new, prepend=-1))
        for q, x in zip(new[heads].tolist(), np.split(starts, heads[1:])):
            x = np.unique(x)
            if q in index:
                index[q].append(x)
            else:
                index[q] = [x]
                heapq.heappush(active, q)


class Encoder:
    """Encodes the words of slices."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.merges = Merges(vocabulary.merges)
        self.inner, self.final = np.array(vocabulary.inner, dtype=np.int64), np.array(vocabulary.final, dtype=np.int64)
        self.find = regex.compile(vocabulary.pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else None

    def pieces(self, word: bytes) -> list[bytes | int]:
        """The pieces of a word; special tokens are given by id."""
        bare = word.rstrip(_MARKS)
        if bare.isalpha():
            return [bare.lower()] if len(bare) == len(word) else [bare.lower(), word[len(bare) :]]
        text = word.decode("utf-8", "replace")
        out: list[bytes | int] = []
        for part in self.split(text) if self.split and "<|" in text else [text]:
            if part in self.v.special:
                out.append(self.v.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            # Lower case is taken character by character: a final sigma is like any other.
            part = part.lower() if "\u03a3" not in part else "".join(c.lower() for c in part)
            bare_part = part.rstrip(_MARKS_TEXT)
            if bare_part.isalpha():
                out.append(bare_part.encode())
                if len(bare_part) < len(part):
                    out.append(part[len(bare_part) :].encode())
            else:
                out += [x.encode() for x in self.find(part)]
        return out

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the distinct ``words`` one after another and the limits of each word's."""
        numbered: dict[bytes | int, int] = {}
        used: list[int] = []
        counts: list[int] = []
        number, pieces_of, note, count = numbered.setdefault, self.pieces, used.append, counts.append
        for word in words:
            pieces = pieces_of(word)
            for piece in pieces:
                note(number(piece, len(numbered)))
            count(len(pieces))
        coded = [x if isinstance(x, bytes) else b"?" for x in numbered]
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in coded], dtype=np.int64)
        symbols = self.inner[raw]
        after = np.arange(1, len(raw) + 1)
        if len(ends):
            symbols[ends - 1] = self.final[raw[ends - 1]]
            after[ends - 1] = -1
        for i, x in enumerate(numbered):
            if isinstance(x, int):
                symbols[ends[i] - 1] = x
        merge_all(symbols, after, self.merges)
        left = symbols >= 0
        kept = np.zeros(len(symbols) + 1, dtype=np.int64)
        np.cumsum(left, out=kept[1:])
        piece_limits = np.concatenate([[0], kept[ends]]) if len(ends) else np.zeros(1, dtype=np.int64)
        use = np.array(used, dtype=np.int64)
        size = piece_limits[use + 1] - piece_limits[use]
        tokens = gather(symbols[left].astype(np.int32), piece_limits[use], size)
        total = np.concatenate([[0], np.cumsum(size)])
        limits = total[np.cumsum(counts, dtype=np.int64)]
        return tokens, np.concatenate([[0], limits])

    def encode(self, parts: list[common.Words]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each part the tokens of all its texts one after another and the limits of each text's.

        The distinct words of all parts are encoded together, each once.
        """
        together = pa.concat_arrays([w.distinct for w in parts]).dictionary_encode()
        pool, limits = self.learn(together.dictionary.to_pylist())
        number = together.indices.to_numpy(zero_copy_only=False)
        at = 0
        for w in parts:
            mine = number[at : at + len(w.distinct)]
            at += len(w.distinct)
            begin, size = limits[mine], limits[mine + 1] - limits[mine]
            size = size[w.code]
            count = np.zeros(len(w.code) + 1, dtype=np.int64)
            np.cumsum(size, out=count[1:])
            yield gather(pool, begin[w.code], size), count[w.first]


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[begin:begin + size] of all, one after another."""
    total = int(size.sum())
    limits = np.cumsum(size) - size
    return pool[np.repeat(begin - limits, size) + np.arange(total)]


def _encoded(parts: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
    while group := list(itertools.islice(parts, TOGETHER)):
        yield from zip(group, encoder.encode([common.words_of(p.column("text")) for p in group]))


def _run(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, digests: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary)
    strings, at = vocabulary.token_bytes()
    for part, (tokens, limits) in _encoded(common.slices(batches), encoder):
        sizes = pa.array(np.diff(limits))
        if not digests:
            ids = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, ids], names=["doc_id", "n_tokens", "ids"])
            continue
        raw = tokens.astype("<u4").tobytes()
        width = (at[1:] - at[:-1])[tokens]
        decoded = gather(strings, at[tokens], width).tobytes()
        ends = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.cumsum(width, out=ends[1:])
        cuts, bounds = ends[limits].tolist(), limits.tolist()
        sha = hashlib.sha256
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                sizes,
                pa.array([sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:])], pa.string()),
                pa.array([sha(decoded[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs`` with the tokenizer file ``path`` of the driver."""
    v = Vocabulary(path)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _run(it, v, False), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the token strings joined by spaces, as a file without a decoder has it."""
    v = Vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(v.strings[i] for i in ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    v = Vocabulary(path)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _run(it, v, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
