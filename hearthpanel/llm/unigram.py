"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearthpanel.llm.model_file import BYTE, CONTROL, MARK, UNKNOWN, Vocabulary, read_vocabulary

CACHED_CHUNKS = 300_000
"""Chunks of a generation whose ids a Python worker remembers. A full generation stays readable while
the next one fills, so that frequent chunks are carried over and the memory is bounded by two."""
UNKNOWN_TEXT = " ⁇ "


class DoubleArray:
    """Trie of byte strings in two integer arrays.

    The child of state s by byte b is base[s] + b + 1 if check of that cell is s. The cell base[s] + 0
    belongs to s if a key ends there; its base holds -1 - value.
    """

    def __init__(self, items: list[tuple[bytes, int]]):
        items = sorted(items)
        base, check = [0], [0]
        free = 1
        waiting = [(0, 0, len(items), 0)]
        while waiting:
            state, low, high, depth = waiting.pop()
            groups: list[tuple[int, int, int]] = []
            for i in range(low, high):
                word = items[i][0]
                code = word[depth] + 1 if len(word) > depth else 0
                if groups and groups[-1][0] == code:
                    groups[-1] = code, groups[-1][1], i + 1
                else:
                    groups.append((code, i, i + 1))
            if not groups:
                continue
            while free < len(check) and check[free] >= 0:
                free += 1
            offset = max(1, free - groups[0][0])
            while any(offset + c < len(check) and check[offset + c] >= 0 for c, _, _ in groups):
                offset += 1
            grow = offset + groups[-1][0] + 1 - len(check)
            if grow > 0:
                base.extend([0] * grow)
                check.extend([-1] * grow)
            base[state] = offset
            for code, first, last in groups:
                check[offset + code] = state
                if code == 0:
                    base[offset] = -1 - items[first][1]
                else:
                    waiting.append((offset + code, first, last, depth + 1))
        check[0] = -1
        self.base, self.check = base + [0] * 257, check + [-1] * 257

    def prefixes(self, data: bytes, start: int = 0) -> list[tuple[int, int]]:
        """(end, value) of every key that begins at `start`, the shortest first."""
        base, check, state, found = self.base, self.check, 0, []
        for at in range(start, len(data)):
            cell = base[state] + data[at] + 1
            if check[cell] != state:
                break
            state = cell
            leaf = base[state]
            if check[leaf] == state:
                found.append((at + 1, -1 - base[leaf]))
        return found


class Memory(dict):
    """Ids of chunks, as bytes of 32-bit integers; what is missing is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("i", self.encode(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self) >= CACHED_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Codec:
    """Encodes texts to piece ids and decodes ids to texts.

    Encoding takes the path with the best sum of log scores; of equal paths to a place, the one whose
    last piece begins first. A character that is no piece may be unknown; with byte fallback it becomes
    its UTF-8 bytes, else a run of unknown characters is one unknown piece. Spaces become the
    mark U+2581, and one is put in front of a text if the model asks for it. Decoding turns marks into
    spaces again, drops the first one, joins bytes, and shows broken UTF-8 as U+FFFD for each byte.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.trie = DoubleArray([(p.encode(), i) for p, i, _ in vocabulary.matching])
        self.scores = {i: s for _, i, s in vocabulary.matching}
        self.unknown_score, self.unknown_id = vocabulary.unknown_score, vocabulary.unknown_id
        self.bytes_of = vocabulary.byte_ids if vocabulary.byte_fallback else {}
        self.prefix = MARK if vocabulary.dummy_prefix else ""
        self.chunks = re.compile(vocabulary.chunk_pattern).findall
        self.types = vocabulary.types
        # What each id stands for; control pieces stand for nothing.
        self.shown = [b"" if t == CONTROL else UNKNOWN_TEXT.encode() if t == UNKNOWN
                      else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode()
                      for p, t in zip(vocabulary.pieces, vocabulary.types)]
        # Score and id of the piece that ends in a state of the trie.
        ends = {self.trie.check[leaf]: -1 - self.trie.base[leaf]
                for leaf in range(len(self.trie.check)) if self.trie.base[leaf] < 0}
        self.piece_of = [ends.get(state, -1) for state in range(len(self.trie.base))]
        self.score_of = [self.scores[i] if i >= 0 else None for i in self.piece_of]
        self.known = Memory(self.encode_chunk)

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        data = chunk.encode("utf-8", "surrogatepass")
        size = len(data)
        lowest = float("-inf")
        best, start_of, id_of = [lowest] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        base, check, score_of, piece_of = self.trie.base, self.trie.check, self.score_of, self.piece_of
        start = 0
        while start < size:
            lead = data[start]
            after = start + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, state, end, single = best[start], 0, start, False
            for byte in data[start:]:
                cell = base[state] + byte + 1
                if check[cell] != state:
                    break
                state = cell
                end += 1
                score = score_of[state]
                if score is not None:
                    if end == after:
                        single = True
                    if here + score > best[end]:
                        best[end], start_of[end], id_of[end] = here + score, start, piece_of[state]
            if not single and here + self.unknown_score > best[after]:
                best[after], start_of[after], id_of[after] = here + self.unknown_score, start, -1
            start = after
        out: list[int] = []
        end = size
        while end > 0:
            start = start_of[end]
            if id_of[end] >= 0:
                out.append(id_of[end])
            elif self.bytes_of:
                out.extend(self.bytes_of[b] for b in reversed(data[start:end]))
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
            end = start
        return tuple(reversed(out))

    def encode(self, text: str | None) -> array:
        """Ids of a whole text; null and empty texts have none."""
        out = array("i")
        if not text:
            return out
        out.frombytes(b"".join(map(self.known.__getitem__, self.chunks(self.prefix + text.replace(" ", MARK)))))
        if self.bytes_of or self.unknown_id not in out:
            return out
        # A run of unknown characters is one piece, also across chunks.
        return array("i", (i for k, i in enumerate(out) if k == 0 or i != self.unknown_id or out[k - 1] != i))

    def decode(self, ids) -> str:
        """Text of piece ids; no ids give the empty text."""
        if len(ids) == 0:
            return ""
        whole = b"".join(map(self.shown.__getitem__, ids))
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        if self.prefix and first is not None and self.types[first] not in (UNKNOWN, BYTE) and text.startswith(" "):
            text = text[1:]
        return text

    def _decode_broken(self, ids) -> str:
        """As decode, where runs of byte pieces are not all UTF-8: each stray byte gives U+FFFD."""
        out, run = [], bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at:at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.types[i] == BYTE:
                run += self.shown[i]
            else:
                close()
                out.append(self.shown[i].decode())
        close()
        return "".join(out)


def _free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def encode(docs: DataFrame, model: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """`docs` with ids (array of int), n_pieces (long) and round_trip (boolean), over whole texts.

    round_trip says whether decoding the ids gives the text again. `decoded` names a further column
    for the decoded text. The model file is read on the driver and goes to the tasks as a double-array
    trie (its size is that of the file). One row in, one row out, without a shuffle.

    Null text: null ids, 0 pieces, null round_trip and null decoded text. Empty text: no ids, true. A
    column of `docs` that has one of the new names keeps its place in front and the new column gets a
    leading underscore.
    """
    names = [_free_name(docs, n) for n in ("ids", "n_pieces", "round_trip", *([decoded] if decoded else []))]
    kinds = [T.ArrayType(T.IntegerType(), False), T.LongType(), T.BooleanType(), T.StringType()]
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(n, k) for n, k in zip(names, kinds)])
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_vocabulary(model)))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            ids, ends, counts, same, back = array("i"), array("i", [0]), [], [], []
            for value in batch.column(place):
                value = value.as_py()
                got = own.encode(value)
                ids.extend(got)
                ends.append(len(ids))
                counts.append(len(got))
                again = None if value is None else own.decode(got)
                same.append(None if value is None else again == value)
                if decoded:
                    back.append(again)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()),
                                             mask=pa.array([s is None for s in same]))
            new = [lists, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())]
            new += [pa.array(back, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`rows` with the text of each list of ids in column `into`; null ids give null text.

    Ids are those of `model`; an id outside its vocabulary is an error.
    """
    into = _free_name(rows, into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    codec = rows.sparkSession.sparkContext.broadcast(Codec(read_vocabulary(model)))
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            texts = [None if v is None else own.decode(v) for v in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
