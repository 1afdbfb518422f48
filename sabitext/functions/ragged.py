"""Whole Arrow columns of texts as flat NumPy arrays: characters, runs, distinct pieces and n-grams.

The models cut texts in the worker, a batch at a time, and hand on distinct
pieces with counts, so that what is shuffled is far less than one row for each
piece of text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 20
#: Rows of counts that a worker holds to add them up.
HELD_ROWS = 1 << 20


@functools.cache
def in_classes(classes: str, more: str = "") -> np.ndarray:
    """For every code point whether its category begins with one of these letters, or it is one of more."""
    table = np.fromiter((unicodedata.category(chr(c))[0] in classes for c in range(0x110000)), bool, 0x110000)
    table[[ord(c) for c in more]] = True
    return table


@functools.cache
def blanks() -> np.ndarray:
    """White space of str.split()."""
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)


def batches_of(texts: pa.Array | pa.ChunkedArray, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Row ranges of about so many bytes, or of one row."""
    before = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
    cuts = [0]
    while cuts[-1] < len(texts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(before, before[cuts[-1]] + most, "right")) - 1))
    return [(a, min(b, len(texts))) for a, b in zip(cuts, cuts[1:])]


def joined(texts: Iterable[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts end to end, their code points, and the len + 1 places where each begins. NULL is empty."""
    parts = [t or "" for t in texts]
    whole = "".join(parts)
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum([len(t) for t in parts])].astype(np.int64)


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of True within one text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def row_of(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The text that each place is in."""
    return np.searchsorted(at, place, "right") - 1


def numbered(items: Iterable[str], n: int) -> tuple[np.ndarray, list[str]]:
    """A number for each of n items, equal for equal ones, and the distinct items in the order of their numbers."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in items), np.int64, n), list(seen)


def cut(whole: str, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces whole[begin:end]; they ascend and don't overlap. No string is made in Python."""
    data = whole.encode("utf-8", "surrogatepass")
    at = np.r_[0, np.cumsum(np.int64(1) + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))]
    edges = np.empty(2 * len(begin) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = at[begin], at[end], at[end[-1]] if len(end) else 0
    both = pa.LargeStringArray.from_buffers(2 * len(begin), pa.py_buffer(edges), pa.py_buffer(data))
    return both.take(pa.array(np.arange(0, 2 * len(begin), 2)))


def coded(pieces: pa.Array) -> tuple[np.ndarray, list[str]]:
    """numbered() of an Arrow column."""
    got = pieces.dictionary_encode()
    return got.indices.to_numpy().astype(np.int64), got.dictionary.to_pylist()


def gathered(first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of all elements of the lists `which`, end to end; list k has size[k] elements from first[k] on."""
    n = size[which]
    return np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, equal for equal ones and in order of appearance, and where each number comes first. By hashing, which takes a tenth of the time of sorting."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array(key).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(key) - 1, -1, -1)
    return number, first


def tallied(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key comes first, its number of times or (whole) sum of weights, and each key's number."""
    number, first = ranked(key)
    count = np.bincount(number, minlength=len(first))
    if weight is not None:
        count = np.zeros(len(first), np.int64)
        np.add.at(count, number, weight)
    return first, count, number


def char_grams(texts: Iterable[str | None], sizes: int) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For n = 1 to sizes: the text of each n-gram, its number, and the distinct n-grams. Longer ones are numbered by pairs of numbers, so they are told apart exactly."""
    whole, codes, at = joined(texts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    one = rank = ranked(codes)[0]
    out = []
    for n in range(1, sizes + 1):
        m = max(len(one) - n + 1, 0)
        if n > 1:
            rank = ranked(rank[:m] << 31 | one[n - 1 :])[0]
        place = np.flatnonzero(row[:m] == row[n - 1 :])
        number = rank[place]
        first = np.full(int(rank.max()) + 1 if len(rank) else 0, -1)
        first[number[::-1]] = place[::-1]
        there = first >= 0  # others run from one text into the next
        out.append((row[place], (np.cumsum(there) - 1)[number], [whole[i : i + n] for i in first[there].tolist()]))
    return out


def summed(batches: Iterable[pa.RecordBatch], keys: list[str], sums: list[str], most: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of counts with those of equal keys added up, `most` rows at a time; keys can be met again in a later batch."""

    def added() -> pa.Table:
        got = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
        return got.select([*keys, *(f"{c}_sum" for c in sums)]).rename_columns([*keys, *sums])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            got = added()
            held, size = got.to_batches(), got.num_rows
            if size > most // 2:
                yield from held
                held, size = [], 0
    if held:
        yield from added().to_batches()
