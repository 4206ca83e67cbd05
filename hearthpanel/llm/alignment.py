"""Alignment of two tokenizations of the same texts, by merge-path partitioning.

The byte offsets at which tokens of A and of B end are two sorted lists. Binary searches on diagonals of their merge
cut both into pieces of equal work that are merged independently. A piece emits the overlaps of A and B tokens (one
between each two neighbouring ends), and pieces are stitched where an end of both lists lies across a cut. Offsets
where both end close a group. How often two ids overlap in the whole corpus is counted by Spark and joined back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthpanel.llm.store import saved

WORK = 1 << 14
"""Token ends merged in one piece."""
CHUNK = 1 << 21
"""About so many bytes of text are aligned at once; a longer text is a chunk of its own."""
BROADCAST_PAIRS = 2_000_000
"""Up to so many counted pairs (three numbers each) are sent to the links; beyond that links are shuffled to them."""
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: the pattern of byte-level vocabularies of this format."""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Tokenizer A: a byte-level vocabulary in JSON; special tokens are left out."""

    def __init__(self, data: bytes):
        import tiktoken
        content = json.loads(data)
        special = {t["content"] for t in content.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.pieces[i] = token
        # Ids of such a vocabulary ascend in the order of its merges.
        self._codec = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._codec.encode_ordinary(" " + text)


class PieceTokens:
    """Tokenizer B: a piece model that adds the leading space itself."""

    def __init__(self, data: bytes):
        import sentencepiece
        self._codec = sentencepiece.SentencePieceProcessor(model_proto=data)
        count = self._codec.get_piece_size()
        self.pieces = [bytes([int(name[3:-1], 16)]) if self._codec.is_byte(i) else name.replace("▁", " ").encode()
                       for i, name in enumerate(map(self._codec.id_to_piece, range(count)))]

    def encode(self, text: str) -> list[int]:
        return self._codec.encode(text)


def cut_diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and `b` where the merge has taken 0, work, 2 * work, ... of their entries, and all of them.

    Of equal entries that of `a` is taken first. One binary search per diagonal, all side by side.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        taken = np.zeros(len(middle), dtype=bool)
        taken[open_] = a[middle[open_]] <= b[diagonals[open_] - middle[open_] - 1]
        low = np.where(open_ & taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low, diagonals - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ends of both slices in order, the entry of `a` and of `b` that covers what ends there, and whether both end."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    ends = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    i, j = np.searchsorted(a, ends), np.searchsorted(b, ends)
    common = np.zeros(len(ends), dtype=bool)
    inside = (i < len(a)) & (j < len(b))
    common[inside] = a[i[inside]] == b[j[inside]]
    return ends, i, j, common


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of `a`, entry of `b` and whether a group ends, for each overlap in order, from both lists of ends."""
    i, j = cut_diagonals(a, b, work)
    found = []
    for k in range(len(i) - 1):
        ends, left, right, common = merge_piece(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]])
        left, right = left + i[k], right + j[k]
        if found and len(ends) and found[-1][0][-1] == ends[0]:  # an end of both across the cut
            found[-1][3][-1] = True
            ends, left, right, common = ends[1:], left[1:], right[1:], common[1:]
        if len(ends):
            found.append((ends, left, right, common))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate([f[k] for f in found]) for k in (1, 2, 3))


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, first: bytes, second: bytes, work: int):
        self.a, self.b, self.work = ByteTokens(first), PieceTokens(second), work
        self._size_a = np.array([len(p) for p in self.a.pieces], dtype=np.int64)
        self._size_b = np.array([len(p) for p in self.b.pieces], dtype=np.int64)
        names_a, names_b = range(len(self.a.pieces)), range(len(self.b.pieces))
        # The ways a token can be written: not the last of its group's list, or the last.
        self._written = [f"{i}," for i in names_a] + [f"{i}|" for i in names_a] + [f"{i}," for i in names_b] + [f"{i};" for i in names_b]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and of B; none where their bytes are not those of the text after a space."""
        if not text:
            return [], []
        whole, first, second = b" " + text.encode(), self.a.encode(text), self.b.encode(text)
        if b"".join(map(self.a.pieces.__getitem__, first)) != whole or b"".join(map(self.b.pieces.__getitem__, second)) != whole:
            return [], []
        return first, second

    def align(self, texts: list[str | None]) -> list[tuple]:
        """Per text n_a, n_b, n_groups, n_links, pairs, times and groups; the texts are merged as one long list of ends."""
        coded = [self.tokens(t) for t in texts]
        a = np.array([i for first, _ in coded for i in first], dtype=np.int64)
        b = np.array([i for _, second in coded for i in second], dtype=np.int64)
        # Tokens of all texts follow each other; both lists end at the end of each text.
        left, right, closed = overlaps(np.cumsum(self._size_a[a]), np.cumsum(self._size_b[b]), self.work)
        upto_a, upto_b = (np.cumsum([len(c[k]) for c in coded]) for k in (0, 1))
        codes = (b[right] << np.int64(32)) | a[left]
        written, group_of = self._groups(a, b, left, right, closed), np.cumsum(closed)
        out, link, token, group = [], 0, 0, 0
        for k, (first, second) in enumerate(coded):
            if not first:
                out.append((0, 0, 0, 0, codes[:0], codes[:0], ""))
                continue
            end = int(np.searchsorted(left, upto_a[k], "left"))
            pairs, times = np.unique(codes[link:end], return_counts=True)
            upto = int(upto_a[k] + upto_b[k])
            groups = "".join(map(self._written.__getitem__, written[token:upto].tolist()))[:-1]
            out.append((len(first), len(second), int(group_of[end - 1]) - group, end - link, pairs, times, groups))
            link, token, group = end, upto, int(group_of[end - 1])
        return out

    def _groups(self, a, b, left, right, closed) -> np.ndarray:
        """Index in `_written` of each token, those of a group together, A before B."""
        last_a, last_b = left[closed], right[closed]  # the last tokens of each group
        group_a, group_b = (np.searchsorted(last, np.arange(n)) for last, n in ((last_a, len(a)), (last_b, len(b))))
        place_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1 if len(b) else group_b
        out = np.empty(len(a) + len(b), dtype=np.int64)
        ends_a, ends_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        out[place_a] = a + ends_a * len(self._size_a)
        out[place_b] = 2 * len(self._size_a) + b + ends_b * len(self._size_b)
        return out


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for text in texts:
        more = len(text or "")
        if chunk and size + more > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += more
    if chunk:
        yield chunk


def align(docs: DataFrame, first: str, second: str, text: str = "text", digest: bool = False, work: int = WORK) -> DataFrame:
    """`docs` without its text, with n_a, n_b, n_groups, n_links (long), pairs, times and groups of each whole text.

    `first` is the file of a byte-level vocabulary (A, applied to a space and the text), `second` that of a piece
    model (B, which adds the space). Both are read on the driver and sent to the tasks. Special tokens in texts are
    plain text. Groups are written `a1,a2|b1;a3|b2,b3`, as their sha256 where `digest` is set. pairs are the distinct
    codes b * 2^32 + a of overlapping tokens, times how often each occurs in the text. No shuffle.

    Texts that are null or empty, or that a tokenizer does not give back byte for byte (such as those that hold the
    piece model's mark for a space), have no tokens: zeros, no pairs and '' (which is not hashed). Other columns
    than the text are kept, and must not have the new names. Repeated rows give equal rows; no rows give none.
    """
    parts = []
    for path in (first, second):
        with open(path, "rb") as file:
            parts.append(file.read())
    files = docs.sparkSession.sparkContext.broadcast(parts)
    kept = [f for f in docs.schema.fields if f.name != text]
    counts = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([*kept, *counts, T.StructField("pairs", T.ArrayType(T.LongType(), False)),
                           T.StructField("times", T.ArrayType(T.IntegerType(), False)), T.StructField("groups", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value, work)
        for batch in batches:
            others = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != text]
            at = 0
            for texts in _chunks(batch.column(batch.schema.names.index(text)).to_pylist()):
                rows = aligner.align(texts)
                ends = pa.array(np.append(0, np.cumsum([len(r[4]) for r in rows])), pa.int32())
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                pairs = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[4] for r in rows])))
                times = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[5] for r in rows]).astype(np.int32)))
                groups = [hashlib.sha256(r[6].encode()).hexdigest() if digest and r[6] else r[6] for r in rows]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in others), *numbers, pairs, times, pa.array(groups)],
                                                 names=[f.name for f in schema.fields])
                at += len(texts)

    return docs.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Saved table of pair, count (links of the whole corpus) and best (is it the highest count of its B id?)."""
    counts = saved(aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).groupBy(F.col("l.pairs").alias("pair"))
                   .agg(F.sum("l.times").alias("count")), "pair_counts")
    b_id = F.shiftright("pair", 32).alias("b")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("highest"))
    return saved(counts.withColumn("b", F.shiftright("pair", 32)).join(highest, "b").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")), "best_pairs")


def judge(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text",
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row of `docs`: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The count of a pair of ids is the number of links of the whole corpus that hold it; n_best are the row's links
    whose count is the highest of their B id, count_sum is the sum of the counts of its links. Both are 0 without
    tokens. See `align` for nulls, empties and repeats.
    """
    rows = docs.select(F.col(key), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    aligned = saved(align(rows, first, second, digest=True), "aligned")
    counts = pair_counts(aligned)
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    # A text's links lie together, so that they are summed up before the shuffle.
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("bigint").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"))
