"""Token counts: a Viterbi that carries only the best score and the number of pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.model_file import MARK, Vocabulary, read_vocabulary

CACHED_CHUNKS = 300_000
"""Chunks of a generation whose counts a Python worker remembers; the last full generation stays readable."""


class PieceCounter:
    """Counts the pieces of a text as the unigram tokenizer of the vocabulary splits it.

    An Aho-Corasick automaton lists all pieces that end at each character, the longest first. For
    each end the path with the best score wins; of equal scores the one whose last piece begins first.
    A character that is no piece of its own may also be taken as unknown, after all other choices: it
    counts one piece per UTF-8 byte with byte fallback, else a run of them counts one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, _, score in vocabulary.matching:
            self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {p for p, _, _ in vocabulary.matching if len(p) == 1}
        self.unknown = vocabulary.unknown_score
        self.fallback = vocabulary.byte_fallback
        self.prefix = MARK if vocabulary.dummy_prefix else ""
        # Without byte fallback a run of unknown characters is one piece, also across chunks.
        self.chunks = re.compile(vocabulary.chunk_pattern if self.fallback else r"(?s).+").findall
        self.known: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def chunk(self, chunk: str) -> tuple[int, float]:
        size = len(chunk)
        best, count, unknown_end = [float("-inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        best[0] = 0.0
        at = 0

        def close(k: int) -> None:
            """All pieces that end behind character k are seen; weigh the character as unknown."""
            if chunk[k] not in self.single and best[k] + self.unknown > best[k + 1]:
                best[k + 1] = best[k] + self.unknown
                more = len(chunk[k].encode("utf-8", "surrogatepass")) if self.fallback else int(not unknown_end[k])
                count[k + 1], unknown_end[k + 1] = count[k] + more, True

        for last, (length, score) in self.automaton.iter(chunk) if len(self.automaton) else ():
            while at < last:
                close(at)
                at += 1
            start, end = last + 1 - length, last + 1
            if best[start] + score > best[end]:
                best[end], count[end], unknown_end[end] = best[start] + score, count[start] + 1, False
        while at < size:
            close(at)
            at += 1
        return count[size], best[size]

    def text(self, text: str | None) -> tuple[int, float]:
        """Number of pieces and score of a whole text; null and empty texts have none."""
        if not text:
            return 0, 0.0
        pieces, total = 0, 0.0
        for chunk in self.chunks(self.prefix + text.replace(" ", MARK)):
            found = self.known.get(chunk)
            if found is None:
                found = self.older.get(chunk) or self.chunk(chunk)
                if len(chunk) <= 64:
                    if len(self.known) >= CACHED_CHUNKS:
                        self.older, self.known = self.known, {}
                    self.known[chunk] = found
            pieces += found[0]
            total += found[1]
        return pieces, total


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_pieces (long) and score (double) of every row, over whole texts.

    `model` is the path of a SentencePiece model file, read on the driver; its pieces and scores are
    used as a unigram vocabulary. Ties follow the public library; scores are added in double precision,
    chunk by chunk, where the library adds in single precision. The vocabulary goes to the tasks
    (its size is that of the file). One row in, one row out, without a shuffle.

    Null and empty texts: 0 pieces, score 0. Keys may be null or repeat. Other columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    @F.pandas_udf("n_pieces bigint, score double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(vocabulary.value)
        for batch in batches:
            yield pd.DataFrame([counter.text(t) for t in batch], columns=["n_pieces", "score"])

    return docs.select(F.col(key), count(F.col(text)).alias("_count")).select(
        key, F.col("_count.n_pieces").alias("n_pieces"), F.col("_count.score").alias("score"))
