"""Regular expressions compiled to one deterministic automaton over bytes.

Supported: literals, escapes (``\\xHH``, ``\\.``, ``\\n``, ``\\t``, ``\\d``, ``\\w``), classes with ranges and
negation, groups, ``|``, ``? + *``, ``{m}``, ``{m,}``, ``{m,n}`` and ``(?i:...)``. Subset construction
runs over classes of bytes that no rule tells apart; Moore's partition refinement minimises the
result; transitions end as one array of states by 256 bytes.
"""

from __future__ import annotations

import string
from typing import NamedTuple

import numpy as np

_ESCAPES = {"n": {10}, "t": {9}, "r": {13}, "d": set(range(48, 58)), "w": {*range(48, 58), *range(65, 91), *range(97, 123), 95}}


class Dfa(NamedTuple):
    """``step[state, byte]`` is the next state; ``rules[state]`` has bit r where rule r accepts. State 0 starts."""

    step: np.ndarray
    rules: np.ndarray


class _Parser:
    """Recursive descent into a Thompson automaton held in two lists; of the patterns read from behind if ``backward``."""

    def __init__(self, backward: bool = False) -> None:
        self.backward = backward
        self.empty: list[list[int]] = []
        self.byte: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.byte.append([])
        return len(self.empty) - 1

    def rule(self, pattern: str) -> tuple[int, int]:
        self.s, self.i, self.fold = pattern, 0, False
        tree = self.choice()
        if self.i != len(pattern):
            raise ValueError(f"cannot parse {pattern!r} at {self.i}")
        return self.build(tree)

    def choice(self):
        arms = [self.chain()]
        while self.peek() == "|":
            self.i += 1
            arms.append(self.chain())
        return arms[0] if len(arms) == 1 else ("or", arms)

    def chain(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("and", parts)

    def repeat(self):
        atom = self.atom()
        while (c := self.peek()) and c in "?+*{":
            if c == "{":
                end = self.s.index("}", self.i)
                lo, comma, hi = self.s[self.i + 1 : end].partition(",")
                low, high = int(lo), (int(hi) if hi else None) if comma else int(lo)
                self.i = end + 1
            else:
                low, high = {"?": (0, 1), "+": (1, None), "*": (0, None)}[c]
                self.i += 1
            atom = ("times", atom, low, high)
        return atom

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            outer = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.choice()
            self.i, self.fold = self.i + 1, outer
            return tree
        if c == "[":
            return self.leaf(self.bracket())
        if c == "\\":
            return self.leaf(self.escape())
        if c == ".":
            return self.leaf(set(range(256)) - {10})
        return self.leaf({ord(c)})

    def escape(self) -> set[int]:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return {int(self.s[self.i - 2 : self.i], 16)}
        return _ESCAPES.get(c, {ord(c)})

    def bracket(self) -> set[int]:
        out, negated = set(), self.s[self.i] == "^"
        self.i += negated
        while self.s[self.i] != "]":
            c = self.s[self.i]
            self.i += 1
            low = self.escape() if c == "\\" else {ord(c)}
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                c = self.s[self.i]
                self.i += 1
                low = set(range(min(low), max(self.escape() if c == "\\" else {ord(c)}) + 1))
            out |= low
        self.i += 1
        return set(range(256)) - out if negated else out

    def leaf(self, chars: set[int]):
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if chr(c) in string.ascii_letters}
        return ("byte", frozenset(chars))

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def build(self, tree) -> tuple[int, int]:
        kind, first, last = tree[0], self.state(), self.state()
        if kind == "byte":
            self.byte[first].append((tree[1], last))
        elif kind == "or":
            for arm in tree[1]:
                a, b = self.build(arm)
                self.empty[first].append(a)
                self.empty[b].append(last)
        elif kind == "and":
            at = first
            for part in reversed(tree[1]) if self.backward else tree[1]:
                a, b = self.build(part)
                self.empty[at].append(a)
                at = b
            self.empty[at].append(last)
        else:
            _, part, low, high = tree
            at = first
            for _ in range(low):
                a, b = self.build(part)
                self.empty[at].append(a)
                at = b
            if high is None:
                a, b = self.build(part)
                self.empty[at] += [a, last]
                self.empty[b] += [a, last]
            else:
                for _ in range(high - low):
                    a, b = self.build(part)
                    self.empty[at] += [a, last]
                    at = b
                self.empty[at].append(last)
        return first, last


def compile_rules(patterns: list[str], anywhere: bool, backward: bool = False) -> Dfa:
    """One minimal automaton for all patterns: matching from the first byte only, or from any byte; bytes may come from behind."""
    p = _Parser(backward)
    ends: dict[int, int] = {}
    start = p.state()
    for r, pattern in enumerate(patterns):
        a, b = p.rule(pattern)
        p.empty[start].append(a)
        ends[b] = ends.get(b, 0) | 1 << r
    alike: dict[tuple, int] = {}
    sets = sorted({s for arcs in p.byte for s, _ in arcs}, key=sorted)
    group = np.array([alike.setdefault(tuple(b in s for s in sets), len(alike)) for b in range(256)])
    sample = [int(np.argmax(group == g)) for g in range(len(alike))]

    def closed(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in p.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(s for s in out if p.byte[s] or s in ends)

    home = closed({start})
    ids, rows, queue = {home: 0}, [], [home]
    for now in queue:
        row = []
        for b in sample:
            after = {t for s in now for chars, t in p.byte[s] if b in chars}
            nxt = closed(after | {start} if anywhere else after)
            if nxt not in ids:
                ids[nxt] = len(ids)
                queue.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    step = np.array(rows)
    rules = np.array([np.bitwise_or.reduce([ends.get(s, 0) for s in now] or [0]) for now in queue], np.int64)

    part = np.unique(rules, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    first = np.unique(part, return_index=True)[1]
    order = np.argsort(first)
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    small = name[part[step[first[order]]]]
    return Dfa(small[:, group].astype(np.int32), rules[first[order]])
