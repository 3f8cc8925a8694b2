"""Regular expressions as deterministic automata over bytes.

The syntax: literals, ``\\xHH``, ``\\.``-like escapes, classes with ranges, groups, ``|``,
``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``{n,m}`` and a leading ``(?i)`` for ASCII letters.
Subset construction gives one automaton for all expressions at once, and
partition refinement the smallest one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.s = pattern[4:] if self.fold else pattern
        self.i = 0

    def parse(self):
        tree = self.either()
        if self.i != len(self.s):
            raise ValueError(f"cannot read {self.s!r} at {self.i}")
        return tree

    def either(self):
        options = [self.row()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            options.append(self.row())
        return ("or", options) if len(options) > 1 else options[0]

    def row(self):
        items = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            items.append(self.repeat(self.atom()))
        return ("row", items)

    def repeat(self, item):
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                to = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : to].partition(",")
                self.i = to + 1
                item = ("times", item, int(low), int(high) if high else None if comma else int(low))
            else:
                item = ("times", item, {"?": 0, "*": 0, "+": 1}[c], 1 if c == "?" else None)
        return item

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            inner = self.either()
            self.i += 1
            return inner
        if c == "[":
            return ("bytes", self.folded(self.char_class()))
        return ("bytes", self.folded(frozenset([self.escaped() if c == "\\" else ord(c)])))

    def escaped(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def char_class(self) -> frozenset[int]:
        negative = self.s[self.i] == "^"
        self.i += negative
        found: set[int] = set()
        while self.s[self.i] != "]":
            c = self.s[self.i]
            self.i += 1
            low = self.escaped() if c == "\\" else ord(c)
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                c = self.s[self.i]
                self.i += 1
                found.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        self.i += 1
        return frozenset(range(256)) - found if negative else frozenset(found)

    def folded(self, found: frozenset[int]) -> frozenset[int]:
        if not self.fold:
            return found
        return found | {b ^ 32 for b in found if 65 <= (b & ~32) <= 90}


@dataclass(frozen=True)
class Automaton:
    """``step[state * width + kind[byte]]`` is the next state; state 0 is the start.

    ``accepts[state]`` has a bit for each expression that a match of ends there.
    ``dead`` is the state that nothing leaves, or -1.
    """

    step: np.ndarray
    kind: np.ndarray
    accepts: np.ndarray
    width: int
    dead: int

    def resets(self) -> np.ndarray:
        """True for bytes that lead every state to the start: no match goes over them."""
        to_start = (self.step.reshape(-1, self.width) == 0).all(axis=0)
        return to_start[self.kind]

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match that starts at ``at``, or -1."""
        step, kind, accepts, width, dead = self.step, self.kind, self.accepts, self.width, self.dead
        state, end = 0, -1
        for i in range(at, len(data)):
            state = step[state * width + kind[data[i]]]
            if state == dead:
                break
            if accepts[state]:
                end = i + 1
        return end


def compile_all(patterns: list[str], search: bool) -> Automaton:
    """One automaton for all patterns; with ``search`` a match may start anywhere."""
    moves: list[list[tuple[frozenset[int], int]]] = []
    jumps: list[list[int]] = []

    def new() -> int:
        moves.append([])
        jumps.append([])
        return len(moves) - 1

    def build(tree, start: int) -> int:
        kind = tree[0]
        if kind == "bytes":
            end = new()
            moves[start].append((tree[1], end))
            return end
        if kind == "row":
            for item in tree[1]:
                start = build(item, start)
            return start
        if kind == "or":
            end = new()
            for option in tree[1]:
                head = new()
                jumps[start].append(head)
                jumps[build(option, head)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            start = build(item, start)
        if high is None:
            loop = new()
            jumps[start].append(loop)
            jumps[build(item, loop)].append(loop)
            return loop
        end = new()
        jumps[start].append(end)
        for _ in range(high - low):
            start = build(item, start)
            jumps[start].append(end)
        return end

    root = new()
    final: dict[int, int] = {}
    for number, pattern in enumerate(patterns):
        head = new()
        jumps[root].append(head)
        end = build(_Parser(pattern).parse(), head)
        final[end] = final.get(end, 0) | 1 << number

    # Bytes that no expression tells apart share a kind.
    classes = sorted({c for m in moves for c, _ in m}, key=sorted)
    signature = [tuple(b in c for c in classes) for b in range(256)]
    names: dict[tuple, int] = {}
    kind = np.array([names.setdefault(s, len(names)) for s in signature], dtype=np.int64)
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(len(names))]
    width = len(names)
    by_kind = [[[t for c, t in m if sample[k] in c] for k in range(width)] for m in moves]

    def closure(states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for x in jumps[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)

    start = closure({root})
    number = {start: 0}
    todo, table = [start], []
    while todo:
        following = []
        for states in todo:
            row = []
            for k in range(width):
                to = {t for s in states for t in by_kind[s][k]}
                after = closure(to | {root} if search else to)
                if after not in number:
                    number[after] = len(number)
                    following.append(after)
                row.append(number[after])
            table.append(row)
        todo = following
    accepts = [sum({final[s] for s in states if s in final}) for states in number]
    step, accept = _minimise(np.array(table, dtype=np.int64), np.array(accepts, dtype=np.int64))
    stuck = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accept == 0))
    return Automaton(np.ascontiguousarray(step.ravel().astype(np.int32)), kind, accept, width, int(stuck[0]) if len(stuck) and not search else -1)


def _minimise(step: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits blocks of states until equal states of a block step to equal blocks; state 0 stays first."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.full(block.max() + 1, len(block))
    np.minimum.at(first, block, np.arange(len(block)))
    order = np.argsort(first)
    renamed = np.empty_like(order)
    renamed[order] = np.arange(len(order))
    block = renamed[block]
    states = first[order]
    return block[step[states]], accepts[states]
