"""Dictionaries met in texts: against a plain search, block by block, and in linear time."""

import re
import time

import numpy as np
import pytest

from stallmark.functions import scan
from stallmark.operators import knowledge, text

WORDS = ["snapdragon", "dimensity", "7", "8", "plus", "g9", "phone", "processor", "blue", "e8", "x"]


def plain_chip(raw, chips):
    """The longest alias at its first place, by the rules as they are told."""
    hay = " " + re.sub(knowledge.GLUED, r"\1 \2", re.sub("[_/]+", " ", raw.lower())) + " "
    aliases = sorted(((a, c) for c in chips for a in c[4]), key=lambda x: -len(x[0]))
    for a, c in aliases:
        at = hay.find(a)
        if at < 0 or re.match("[a-z0-9]", hay[at - 1]) or re.match("[a-z0-9]", hay[at + len(a)]):
            continue
        if not re.search(knowledge.VENDORS, a) and not re.search(knowledge.CONTEXT, hay[max(0, at - 70) : at + len(a) + 70], re.I):
            continue
        said = next((x for x in c[4] if x in raw.lower()), None)
        return (c[1], said is None or not re.search(knowledge.VENDORS, said))
    return None


@pytest.mark.parametrize("block_chars", [4_000_000, 12])
def test_chips_by_plain_search(spark, monkeypatch, block_chars):
    monkeypatch.setattr(scan, "BLOCK_CHARS", block_chars)
    chips = [(1, "S7", 6, True, ["snapdragon 7", "sd7"]), (2, "S7+", 9, True, ["snapdragon 7 plus"]), (3, "G9", 2, False, ["g9", "helio g9"]), (4, "D8", 5, True, ["dimensity 8", "x 8"]), (5, "E8", 1, False, ["e8", "g9"])]
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice([" ", "_", "", "/"]).join(rng.choice(WORDS, rng.integers(1, 9)))) for i in range(400)] + [(400, None), (401, ""), (402, "G9 " + "far " * 40 + "processor")]
    got = knowledge.match_chips(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(chips, "ord int, soc_name string, antutu int, has5g boolean, aliases array<string>"))
    want = {i: plain_chip(t, chips) for i, t in rows if t}
    assert {r["id"]: (r["soc_name"], r["ambiguous"]) for r in got.collect()} == {i: c for i, c in want.items() if c} != {}


@pytest.mark.parametrize("block_chars", [4_000_000, 9])
def test_longest_phrases_by_plain_search(spark, monkeypatch, block_chars):
    monkeypatch.setattr(scan, "BLOCK_CHARS", block_chars)
    phrases = ["blue phone", "phone", "e8 X", "plus", "", "--"]
    rng = np.random.default_rng(2)
    rows = [(i, rng.choice([" ", ", ", "--"]).join(rng.choice(WORDS, 8))) for i in range(200)] + [(200, None), (201, ""), (202, "bluephone"), (202, "blue, PHONE")]
    got = text.longest_match(spark.createDataFrame(rows, "doc int, t string"), "doc", "t", spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    want = {}
    for i, t in rows:
        words = " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
        found = sorted((p.lower() for p in phrases if re.search(r"\w", p) and f" {p.lower()} " in words), key=lambda p: (-len(p), p))
        if found:
            want[i] = found[0]
    assert {r["id"]: r["phrase"] for r in got.collect()} == want


def test_a_long_text_takes_linear_time(spark):
    def took(n):
        df = spark.createDataFrame([(1, "the of " * n)], "doc int, t string")
        began = time.time()
        assert text.longest_match(df, "doc", "t", spark.createDataFrame([("of the of",), ("the",)], "phrase string")).collect()[0]["phrase"] == "of the of"
        return time.time() - began

    took(1000)
    assert took(50_000) < 5 and took(500_000) < 15


def test_an_empty_dictionary(spark):
    df = spark.createDataFrame([(1, "the of")], "doc int, t string")
    assert text.longest_match(df, "doc", "t", spark.createDataFrame([], "phrase string")).collect() == []
