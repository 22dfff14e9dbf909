"""Secret scanning with one deterministic automaton for all rules.

One pass over the bytes, from behind, finds where matches of which rules begin: the combined automaton reads the
patterns backward and accepts at a match's first byte. Bytes that lead every state to the same one (a line feed,
for one) cut the bytes into lanes that are stepped together through the transition array; lanes never change what
is found. From the leftmost beginning that no earlier match of its rule covers, the rule's own automaton walks to
the longest end, inside the match only, so that work stays linear in the text.

Base kinds: assign, access, hex. Further kinds: github, slack, jwt, private_key. Spans are counted in code points.

Defined results: a null or empty text has no spans; a span is a span wherever it repeats; repeated rows have the
same spans; spans of several kinds that begin together come as the rules are listed; of very long texts a slice is
read at a time, and a line longer than that byte by byte; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import released
from .automaton import Dfa, compile_rules


class Rule(NamedTuple):
    """Matches of ``pattern`` count if they, or what follows ``head`` in them, have ``least`` bytes or more."""

    kind: str
    pattern: str
    least: int = 1
    head: str = ""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", 6, _ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # Runs of such bytes match whole, so that only runs of 24 and more need be seen.
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 20),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: About as many bytes in a lane; fewer lanes than FEW are walked one by one.
LANE, FEW = 256, 48


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules([r.pattern for r in rules], anywhere=True, backward=True)
        each = [compile_rules([r.pattern], anywhere=False) for r in rules]
        heads = [compile_rules([r.head], anywhere=False) if r.head else None for r in rules]
        self.resets = (self.all.step == self.all.step[0]).all(0) & (self.all.step[0] == 0)
        self.walk = self.all.step.tolist()
        self.lists = [(d.step.tolist(), d.rules.tolist(), self.dead(d).tolist()) for d in each]
        self.head_lists = [d and (d.step.tolist(), d.rules.tolist(), self.dead(d).tolist()) for d in heads]

    @staticmethod
    def dead(d: Dfa) -> np.ndarray:
        """States that lead nowhere."""
        return (d.step == np.arange(len(d.step))[:, None]).all(1) & (d.rules == 0)

    def begins(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places where matches begin, and the rules that do; ``at`` has the rows' edges, which no match crosses."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        back, edge = data[::-1], len(data) - at[::-1]
        after = np.flatnonzero(self.resets[back]) + 1
        after = after[after < len(back)]
        if len(after):  # about one in each LANE bytes
            after = after[np.concatenate([[True], np.diff(after // LANE) > 0])]
        start = np.union1d(edge[:-1][np.diff(edge) > 0], after)
        size = np.diff(np.append(start, len(back)))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        step, rules = self.all.step.ravel() << 8, self.all.rules
        state = np.zeros(len(start), np.int32)
        active = np.searchsorted(-size, -np.arange(size[0]), "left")
        places, which, t = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while t < size[0] and active[t] >= FEW:
            k = active[t]
            state[:k] = step[state[:k] + back[start[:k] + t]]
            got = rules[state[:k] >> 8]
            if got.any():
                some = np.flatnonzero(got)
                places.append(start[some] + t)
                which.append(got[some])
            t += 1
        if t < size[0]:
            accepts = rules.tolist()
            for i in range(active[t]):
                s, first, found = int(state[i]) >> 8, int(start[i]) + t, []
                for j, b in enumerate(back[first : start[i] + size[i]].tobytes(), first):
                    s = self.walk[s][b]
                    if accepts[s]:
                        found.append((j, accepts[s]))
                if found:
                    pair = np.array(found, np.int64)
                    places.append(pair[:, 0])
                    which.append(pair[:, 1])
        place, rule = len(data) - 1 - np.concatenate(places), np.concatenate(which)
        order = np.argsort(place)
        return place[order], rule[order]

    def find(self, text: bytes, places: list[int], masks: list[int]) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start and then as the rules are listed: leftmost, longest, non-overlapping per rule."""
        found, free = [], [0] * len(self.rules)
        for i, mask in zip(places, masks, strict=True):
            for r, rule in enumerate(self.rules):
                if mask >> r & 1 and i >= free[r]:
                    free[r] = _longest(text, i, *self.lists[r])
                    begin = _longest(text, i, *self.head_lists[r]) if rule.head else i
                    if free[r] - begin >= rule.least:
                        found.append((i, free[r], rule.kind))
        if not found:
            return []
        point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        return [(int(point[a]), int(point[b]), kind) for a, b, kind in found]


def _longest(text: bytes, i: int, step: list, accept: list, dead: list) -> int:
    """The end of the longest match at ``i``, or ``i``."""
    s, end = 0, i
    for j in range(i, len(text)):
        s = step[s][text[j]]
        if accept[s]:
            end = j + 1
        elif dead[s]:
            break
    return end


_scanner: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): each row's array of (start, end, kind)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rules not in _scanner:
            _scanner[rules] = Scanner(rules)
        scanner = _scanner[rules]
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                place, mask = scanner.begins(s.data, s.at)
                cuts = np.searchsorted(place, s.at).tolist()
                spans = [scanner.find(s.data[s.at[r] : s.at[r + 1]].tobytes(), (place[a:b] - s.at[r]).tolist(), mask[a:b].tolist()) if b > a else [] for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                spans = [[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)
