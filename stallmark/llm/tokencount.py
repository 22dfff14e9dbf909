"""Count-only Viterbi over a unigram vocabulary.

A text is cut at spaces; each word, with the mark that stands for the space before it, is segmented on
its own. For a word, Aho-Corasick lists every vocabulary piece that ends at each byte, and dynamic
programming keeps, for each byte, the best score and the number of pieces of the best path: nothing
is traced back. Ties follow the tokenizer: the matches that end at a byte are tried from the earliest
beginning, and only a strictly better score replaces what stands. A mark in the text itself is a space,
as the tokenizer has it. A character that no piece covers is an unknown at the lowest score minus ``UNKNOWN``; runs of unknowns are one piece, as the tokenizer fuses
them, or, with byte fallback, one piece a byte.

Words repeat, so counts are kept by word digest for as long as a worker lives, at most ``KEPT`` of them.

Defined results: a null or empty text has 0 tokens; repeated rows count alike; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .shared import released

#: What an unknown character costs below the lowest score of the vocabulary.
UNKNOWN = 10.0
#: Most words whose counts a worker keeps.
KEPT = 1 << 20
MARK = "▁"

_SPACE = np.ones(256, dtype=bool)
_SPACE[0x20] = False


class Counter:
    """Token counts of words under one unigram vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]], fallback: bool):
        self.floor = min(s for _, s in vocab) - UNKNOWN
        self.trie = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.bytes_known = fallback and all(f"<0x{b:02X}>" in {p for p, _ in vocab} for b in (0, 255))

    def count(self, word: str) -> int:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for at, match in self.trie.iter(word):
            ends[at].append(match)
        best = [0.0] + [None] * n
        # pieces, and whether the last of them is an unknown
        pieces, last = [0] * (n + 1), [False] * (n + 1)
        for i in range(n):
            single = False
            for size, score in sorted(ends[i], reverse=True):
                j = i + 1 - size
                single |= size == 1
                total = best[j] + score
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], pieces[i + 1], last[i + 1] = total, pieces[j] + 1, False
            if not single:
                total = best[i] + self.floor
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1] = total
                    if self.bytes_known:
                        pieces[i + 1] = pieces[i] + len(word[i].encode())
                    else:
                        pieces[i + 1] = pieces[i] + (not last[i])
                        last[i + 1] = True
        return pieces[n]


_made: dict[str, tuple[Counter, dict[int, int]]] = {}


def sentencepiece_vocab(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores, and the unknown's id, of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())], sp.unk_id()


def _counter(path: str) -> tuple[Counter, dict[int, int]]:
    if path not in _made:
        vocab, _ = sentencepiece_vocab(path)
        _made[path] = Counter(vocab, True), {}
    return _made[path]


def count_tokens(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = _counter(vocab_path)
        for batch in batches:
            for s in tb.slices(pc.replace_substring(batch.column(1), MARK, " ")):
                w = tb.words(s.data, s.at, _SPACE)
                h = tb.hashes(s.data, w.start, w.end)
                uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
                if len(known) > KEPT:
                    known.clear()
                n = np.zeros(len(uniq), np.int64)
                for k, (key, i) in enumerate(zip(uniq.tolist(), first.tolist(), strict=True)):
                    c = known.get(key)
                    if c is None:
                        c = known[key] = counter.count(MARK + s.data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace"))
                    n[k] = c
                rows, size = s.hi - s.lo, np.diff(s.at)
                spaces = np.diff(np.concatenate([[0], np.cumsum(s.data == 0x20)])[s.at])
                words = np.bincount(w.row, minlength=rows)
                # Each space is a mark, and so is a beginning that is no space; marks without a word stand alone.
                begins = np.zeros(rows, np.int64)
                begins[size > 0] = s.data[s.at[:-1][size > 0]] != 0x20
                bare = spaces + begins - words
                tokens = np.bincount(w.row, n[back], minlength=rows).astype(np.int64) + bare * counter.count(MARK)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, rows), pa.array(words + bare), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)
