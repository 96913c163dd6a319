"""Byte-level text kernels in numpy over Arrow string buffers.

Texts are handled as UTF-8 bytes.  All separators of the operators here are ASCII, so splitting bytes equals
splitting characters.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 bytes: True in any of the closed ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LETTER_ASCII = byte_class((0x41, 0x5A), (0x61, 0x7A))
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 32


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), at


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES, most_rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts of about ``limit`` bytes: first row, end row, bytes, offsets from 0.

    A text is never cut; one longer than ``limit`` is a block of its own.
    """
    data, at = string_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(at, at[lo] + limit, "right")) - 1, lo + 1), n, lo + most_rows)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a block: byte starts and ends, the row of each, and per row the index of its first word."""

    __slots__ = ("starts", "ends", "first", "row")

    def __init__(self, data: np.ndarray, at: np.ndarray, is_word: np.ndarray = NOT_SPACE):
        n = len(data)
        if n == 0:
            self.starts = self.ends = self.row = np.zeros(0, np.int64)
            self.first = np.zeros(len(at), np.int64)
            return
        inside = is_word[data]
        full = np.flatnonzero(np.diff(at) > 0)
        edge = np.empty(n, bool)
        edge[0], edge[1:] = True, ~inside[:-1]
        edge[at[full]] = True
        self.starts = np.flatnonzero(inside & edge)
        edge[-1], edge[:-1] = True, ~inside[1:]
        edge[at[full + 1] - 1] = True
        self.ends = np.flatnonzero(inside & edge) + 1
        self.first = np.searchsorted(self.starts, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Polynomial hash modulo 2**64 of any slice, from prefix sums; ``seed`` picks the byte values and the base."""

    _kept: dict = {}

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.base %= 1 << 64
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = np.full(max(n, 1 << 16), self.base, np.uint64)
            grow[0] = 1
            up = np.cumprod(grow)
            grow[1:] = self.inverse
            down = np.cumprod(grow)
            if n > 4 * BLOCK_BYTES:  # a single very long text: do not keep its tables
                return up, down
            self.up, self.down = up, down
        return self.up, self.down

    def sums(self, data: np.ndarray, fold: np.ndarray = IDENTITY) -> np.ndarray:
        """Prefix sums over bytes."""
        up, _ = self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[fold][data] * up[: len(data)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(sums))
        return mix((sums[ends] - sums[starts]) * down[starts])

    def words(self, data: np.ndarray, words: Words, fold: np.ndarray = IDENTITY) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        return self.slices(self.sums(data, fold), words.starts, words.ends)

    def windows(self, hashes: np.ndarray, starts: np.ndarray, size) -> np.ndarray:
        """Hash of ``size`` consecutive word hashes from each of ``starts``."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        up, down = self.powers(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        return mix((sums[starts + size] - sums[starts]) * down[starts])


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and row of every window of ``size`` words inside one row."""
    many = np.maximum(np.diff(first) - size + 1, 0)
    return spans(first[:-1], many), np.repeat(np.arange(len(many)), many)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Boolean mask of length ``n``: inside [start, start + size) of any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal values, and the run lengths."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return first, np.diff(np.append(first, len(ordered)))


def order_of(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of 64-bit hashes, by one plain sort of their leading bits with the place in the others.

    Runs that agree in the leading bits alone are put in order apart; keys that are no hashes are better off with argsort.
    """
    n = len(keys)
    bits = U64(max(n - 1, 1).bit_length())
    if n < 1024:
        return np.argsort(keys, kind="stable")
    packed = keys >> bits << bits
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & (U64(1) << bits) - U64(1)).astype(np.int64)
    got = keys[order]
    wrong = np.flatnonzero(got[1:] < got[:-1])
    if len(wrong):
        head = packed >> bits
        run = np.cumsum(np.concatenate(([0], head[1:] != head[:-1])))
        mixed = np.zeros(int(run[-1]) + 1, bool)
        mixed[run[wrong]] = True
        some = np.flatnonzero(mixed[run])
        order[some] = order[some][np.lexsort((got[some], run[some]))]
    return order


def by_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, n)[:n] if len(row) else np.zeros(n, np.int64 if weights is None else np.float64)
