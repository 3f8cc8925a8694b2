"""Secret scans with one automaton for all rules.

The rules are compiled together into one minimal automaton that finds where a
match can end.  Texts are cut after bytes that lead every state back to the
start, so no match is cut; all parts of a slice run through the automaton side
by side, one byte each at a time.  Only parts in which some rule accepts are
resolved: each rule's own automaton gives the leftmost, longest matches that do
not overlap, and a rule's test drops those that are too short.

Null and empty texts have no spans.  Positions count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellmosaic.llm import automata, common


@dataclass(frozen=True)
class Rule:
    """``pattern`` is what is matched; ``sign`` is an expression whose matches end wherever a kept match could."""

    kind: str
    pattern: str
    sign: str
    test: Callable[[bytes], bool]


def _assigned(match: bytes) -> bool:
    """The value behind the sign, white space and quote has six characters or more."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 6


def _at_least(n: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= n


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: Only runs of hexadecimal digits are common enough to count their length in the automaton, whose size grows with it.
#: The rules in the order in which their kinds are listed; the first three are the base.
RULES = (
    Rule("assign", _ASSIGN, _ASSIGN, _assigned),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]+", _at_least(20)),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24,}", _at_least(24)),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", _at_least(1)),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]+", _at_least(24)),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]+", _at_least(15)),
)
BASE = 3


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> tuple[automata.Automaton, tuple[automata.Automaton, ...]]:
    return automata.compile_all([r.sign for r in rules], search=True), tuple(automata.compile_all([r.pattern], search=False) for r in rules)


def accepted(data: np.ndarray, limits: np.ndarray, scan: automata.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, rules) of the parts of the texts in which a rule accepts; ``rules`` has a bit for each."""
    cut = scan.resets()[data]
    if len(data):
        ends = limits[1:]
        cut[ends[ends > 0] - 1] = True
    end = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    length = end - start
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    kinds = scan.kind[data]
    states = np.zeros(len(start), dtype=np.int64)
    found = np.zeros(len(start), dtype=np.int64)
    marking = scan.accepts != 0
    running = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), side="right")
    for i, n in enumerate(running.tolist()):
        now = scan.step[states[:n] * scan.width + kinds[start[:n] + i]].astype(np.int64)
        states[:n] = now
        hit = marking[now]
        if hit.any():
            at = np.flatnonzero(hit)
            found[at] |= scan.accepts[now[at]]
    some = np.flatnonzero(found)
    return start[some], start[some] + length[some], found[some]


def _matches(part: bytes, rule: Rule, own: automata.Automaton) -> list[tuple[int, int]]:
    """The kept matches of a rule, leftmost and longest, without overlap."""
    out, at, n = [], 0, len(part)
    first = own.step[own.kind[np.arange(256)]] != own.dead
    starts = np.flatnonzero(first[np.frombuffer(part, dtype=np.uint8)]).tolist()
    for i in starts:
        if i < at or i >= n:
            continue
        end = own.longest(part, i)
        if end > i:
            if rule.test(part[i:end]):
                out.append((i, end))
            at = end
    return out


def spans(texts: pa.Array, rules: tuple[Rule, ...], scan: automata.Automaton, own: tuple[automata.Automaton, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """Of each text that has some, the spans (start, rule number, end) in code points, in order."""
    data, limits = common.text_bytes(texts)
    start, end, found = accepted(data, limits, scan)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(start):
        return out
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(common.code_points(data), out=points[1:])
    text = np.searchsorted(limits, start, side="right") - 1
    for a, b, bits, d in zip(start.tolist(), end.tolist(), found.tolist(), text.tolist()):
        part, base = data[a:b].tobytes(), points[limits[d]]
        for number, rule in enumerate(rules):
            if bits >> number & 1:
                for x, y in _matches(part, rule, own[number]):
                    out.setdefault(d, []).append((int(points[a + x] - base), number, int(points[a + y] - base)))
    for found_spans in out.values():
        found_spans.sort()
    return out


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], machines) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for part in common.slices(batches):
        n = part.num_rows
        counts = np.zeros((n, len(rules)), dtype=np.int64)
        sha, listed = [none] * n, [""] * n
        where: list[list[dict]] = [[] for _ in range(n)]
        for d, found in spans(part.column("text"), rules, *machines).items():
            for _, number, _ in found:
                counts[d, number] += 1
            named = [(f"{rules[k].kind}:{a}:{b}", k) for a, k, b in found]
            listed[d] = ",".join(x for x, _ in named)
            sha[d] = hashlib.sha256(",".join(x for x, k in named if k < BASE).encode()).hexdigest()
            where[d] = [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in found]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(counts[:, i]) for i in range(BASE)), pa.array(sha, pa.string()), pa.array(listed, pa.string()), pa.array(where, _SPANS)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
        )


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base kinds, the digest of the base spans and all spans, as text and as structs."""
    machines = compiled(rules)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scan(it, rules, machines), schema)


def _redact(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], machines, mark: str) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        at = part.schema.get_field_index("text")
        found = spans(part.column("text"), rules, *machines)
        if not found:
            yield part
            continue
        texts = part.column("text").to_pylist()
        for d, where in found.items():
            text, out, to = texts[d], [], 0
            for a, k, b in where:
                if a >= to:
                    out += [text[to:a], mark.format(rules[k].kind)]
                to = max(to, b)
            texts[d] = "".join([*out, text[to:]])
        yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<{}>") -> DataFrame:
    """``docs`` with every secret's span in ``text`` replaced by its kind; overlapping spans become one."""
    machines = compiled(rules)
    return docs.mapInArrow(lambda it: _redact(it, rules, machines, mark), docs.schema)
