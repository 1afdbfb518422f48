"""Shared pieces: flat views of Arrow text, vectorised word hashing, and tables in the cluster's shared folder.

Everything here works on whole columns of a batch at a time. A batch is cut
into slices of bounded size at row borders; one very long text is a slice of
its own, so no text is ever truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..shared import spread, written  # noqa: F401  (for the operators)

U64 = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes inside a word: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the hash's base and of its inverse mod 2**64, as far as a slice needs them."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, U64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the len + 1 places where each begins. NULL is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    at = flat(texts)[1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield begin, min(end, len(texts))
        begin = end


def lower_bytes(body: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, in UTF-8."""
    low = _ASCII_LOWER[body]
    if len(low) > 1:
        accented = np.zeros(len(low), bool)
        accented[1:] = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
        low[accented] += 32
    return low


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each maximal run of True that stays within one row."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[at[:-1]] = True
    edge[at[-1]] = True
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def hash_spans(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    up, down = _POWERS.of(len(body) + 1)
    total = np.zeros(len(body) + 1, U64)
    np.cumsum((body.astype(U64) + U64(1)) * up[: len(body)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each lower-cased word."""
    body, at = flat(texts)
    begin, end, row = spans(WORD_BYTE[body], at)
    return hash_spans(lower_bytes(body), begin, end), row


def row_starts(row: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, for reduceat."""
    return np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)


class Runs:
    """Cuts a sorted stream of Arrow batches into chunks that never split the rows of one key."""

    def __init__(self, key: str, least: int = 200_000) -> None:
        self.key, self.least = key, least

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(self.key)
            held.append(batch)
            rows += batch.num_rows
            if rows < self.least or keys[0] == keys[-1]:
                continue
            values = keys.to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(values[1:] != values[:-1])[-1]) + 1
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held)
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield pa.Table.from_batches(held)
