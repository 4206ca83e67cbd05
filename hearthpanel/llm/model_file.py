"""Reads the pieces of a SentencePiece model file (protocol buffer wire format)."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from functools import cached_property

MARK = "▁"
# Piece types and the penalty of an unknown character in the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
BPE_MODEL = 2

GRID = 1024
"""Scores made from ranks are multiples of 1/GRID, so that sums of them are exact and ties are ties."""


def rank_scores(types: list[int]) -> list[float]:
    """Log scores for a vocabulary that lists its pieces by rank: -log(rank + 2), as frequencies by Zipf's law."""
    out, rank = [], 0
    for kind in types:
        counts = kind in (NORMAL, USER_DEFINED)
        out.append(-round(GRID * math.log(rank + 2)) / GRID if counts else 0.0)
        rank += counts
    return out


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a message; numbers of fixed width stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a model file")
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


@dataclass
class Vocabulary:
    """Pieces with log scores, read as a unigram vocabulary.

    Matching pieces are the normal and the user-defined ones. A user-defined piece scores as in the
    public library: its bytes times the best normal score, less 0.1.
    """

    pieces: list[str]
    scores: list[float]
    types: list[int]
    byte_fallback: bool = False
    dummy_prefix: bool = True
    trim_spaces: bool = False
    unknown_id: int = field(init=False, default=0)

    def __post_init__(self):
        if self.trim_spaces:
            raise ValueError("models that remove extra white space are not supported")
        self.unknown_id = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)

    @cached_property
    def _normal(self) -> list[float]:
        return [s for s, t in zip(self.scores, self.types) if t == NORMAL] or [0.0]

    @property
    def unknown_score(self) -> float:
        return min(self._normal) - UNKNOWN_PENALTY

    @cached_property
    def matching(self) -> list[tuple[str, int, float]]:
        """(piece, id, score) of the pieces that text can match."""
        best = max(self._normal)
        return [(p, i, s if t == NORMAL else len(p.encode()) * best - 0.1)
                for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)) if t in (NORMAL, USER_DEFINED)]

    @cached_property
    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}

    @cached_property
    def chunk_pattern(self) -> str:
        """Pattern of the chunks that a text, with marks for spaces, can be cut into.

        Where no piece has a mark behind another character, no piece crosses from a word into the next
        mark, so the best paths of the chunks make up the best path of the text. A line break that no
        piece holds is a chunk of its own.
        """
        if any(MARK in p.lstrip(MARK) for p, _, _ in self.matching):
            return r"(?s).+"
        alone = "\n" not in {c for p, _, _ in self.matching for c in p}
        rest = "[^▁\n]" if alone else "[^▁]"
        return f"▁+{rest}*|{rest}+" + ("|\n" if alone else "")


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of the model file at `path`; only the driver opens the file.

    Only models without a character map (identity normalisation) are taken. The scores of a pair-merging
    (BPE) model are merge ranks and no log scores; such a model gets `rank_scores`.
    """
    with open(path, "rb") as file:
        data = file.read()
    pieces, scores, types, options, by_rank = [], [], [], {}, False
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got.get(1, b"").decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            types.append(got.get(3, NORMAL))
        elif number == 2:
            got = dict(_fields(value))
            options["byte_fallback"] = bool(got.get(35, 0))
            by_rank = got.get(3, 1) == BPE_MODEL
        elif number == 3:
            got = dict(_fields(value))
            if got.get(2):
                raise ValueError("models with a character map are not supported")
            options |= {"dummy_prefix": bool(got.get(3, 1)), "trim_spaces": bool(got.get(4, 1))}
    return Vocabulary(pieces, rank_scores(types) if by_rank else scores, types, **options)
