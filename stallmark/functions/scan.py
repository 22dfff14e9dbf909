"""Dictionaries of phrases met in texts: one automaton for a block of phrases, stepped over every text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First places of phrases in a text.
Places = Callable[[str], dict[int, int]]
#: Most characters of phrases that go to a task at a time. A larger dictionary is met block by block.
BLOCK_CHARS = 4_000_000
#: Most bytes and rows of texts that a task holds at a time.
BATCH_BYTES, BATCH_ROWS = "4m", 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES at most from now on, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def blocks(dictionary: DataFrame, phrase: str) -> Iterator[DataFrame]:
    """``dictionary`` in blocks of about BLOCK_CHARS characters of phrases: whole, where its checked size allows."""
    chars = dictionary.agg(F.coalesce(F.sum(F.length(phrase) + 1), F.lit(0))).first()[0]
    n = -(-chars // BLOCK_CHARS) or 1
    for b in range(n):
        yield dictionary if n == 1 else dictionary.where(F.pmod(F.xxhash64(phrase), F.lit(n)) == b)


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """A trie of the phrases with failure links; a match gives the phrase's place in the list."""
    out = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        out.add_word(p, i)
    out.make_automaton()
    return out


def first_places(found: ahocorasick.Automaton, phrases: list[str], text: str) -> dict[int, int]:
    """Each phrase that a text holds, and where it first begins. Time is linear in the text and the occurrences."""
    out: dict[int, int] = {}
    for end, i in found.iter(text):
        if i not in out:
            out[i] = end + 1 - len(phrases[i])
    return out


def scanned(texts: DataFrame, keep: list[str], text_col: str, phrases: list[str], told: Callable[[str, Places], list[tuple]], kinds: dict[str, str]) -> DataFrame:
    """Columns ``keep`` and ``kinds`` of ``texts``: for each row what ``told`` says of its text.

    ``told`` gets the text and a function that gives the first places of the phrases (by their place in the list) in a text.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(phrases)

        def places(text: str) -> dict[int, int]:
            return first_places(found, phrases, text)

        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                if text:
                    more = told(text, places)
                    rows += [i] * len(more)
                    out += more
            if rows:
                kept = batch.take(pa.array(rows))
                yield pa.record_batch({c: kept.column(j) for j, c in enumerate(keep)} | {c: pa.array([r[j] for r in out]) for j, c in enumerate(kinds)})

    schema = ", ".join([f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {k}" for c, k in kinds.items()])
    if not phrases:
        return texts.sparkSession.createDataFrame([], schema)
    return texts.select(*keep, text_col).mapInArrow(run, schema)


def hits(texts: DataFrame, keep: list[str], text_col: str, dictionary: DataFrame, phrase: str) -> DataFrame:
    """(keep..., ``phrase``): each phrase of ``dictionary`` that stands somewhere in a text, once for each row of ``texts``."""
    out = None
    for block in blocks(dictionary.select(phrase).where(F.length(phrase) > 0).distinct(), phrase):
        words = sorted(r[0] for r in block.collect())
        part = scanned(texts, keep, text_col, words, lambda text, places, words=words: [(words[i],) for i in places(text)], {phrase: "string"})
        out = part if out is None else out.unionByName(part)
    return out
