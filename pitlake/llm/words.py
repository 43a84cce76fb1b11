"""Hashes of all words of a text column, made by array arithmetic on Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at once; a single longer text is one piece.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and a random code for each; A-Z and a-z share theirs."""

    member: np.ndarray
    code: np.ndarray


def alphabet(between: str | bytes) -> Alphabet:
    """Words of all bytes but ``between``."""
    member = np.ones(256, bool)
    member[np.frombuffer(between.encode() if isinstance(between, str) else between, np.uint8)] = False
    folded = np.arange(256)
    folded[65:91] += 32
    return Alphabet(member, mix((folded + 1).astype(U64) * U64(0x9E3779B97F4A7C15)) | U64(1))


@dataclass
class Piece:
    """Some whole texts: rows ``first`` to ``last`` of a column, their bytes, and where each begins."""

    first: int
    last: int
    data: np.ndarray
    begins: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """A string column cut into pieces of about ``limit`` bytes; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Piece(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def spans(piece: Piece, letters: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words in bytes, and the number of the first word of each text (one more at the end)."""
    inside = letters.member[piece.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[piece.begins] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], after[-1:] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(begins, piece.begins)


_POWERS = [np.zeros(0, U64), np.zeros(0, U64)]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, U64)
            step[0] = 1
            _POWERS[i] = np.multiply.accumulate(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def hashes(piece: Piece, letters: Alphabet, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of bytes: a polynomial in the bytes' codes, from running sums."""
    if not len(begins):
        return np.zeros(0, U64)
    up, down = _powers(len(piece.data) + 1)
    sums = np.zeros(len(piece.data) + 1, U64)
    np.cumsum(letters.code[piece.data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins])
