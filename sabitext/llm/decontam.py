"""Benchmark decontamination by the q-gram lemma.

Texts are normalised (lower case, every run of other than letters and digits
one space). A benchmark item is cut into overlapping windows: of SHORT characters
at every STEP, so each passage of PASSAGE normalised characters or more, wherever it
begins, holds a whole one; and of WINDOW characters at every STRIDE, whose edits may
be less evenly spread. Shorter items are one window. A passage within k = BUDGET * length edits of a window shares at
least t = length - Q + 1 - k * Q character q-grams with it, on diagonals
(place in the text minus place in the window) that span at most k + 1. Shared
q-grams are counted in diagonal bands of width 2 (k + 1) that overlap by half,
so all of them fall in one band together. Bands with t or more are verified by
banded alignment; no true passage is lost before that.

Bands are only counted where they can reach t: k edits leave one of any k + 1
disjoint pieces of a window as it was. Of each window the k + 1 disjoint pieces of
SEED characters are indexed that the benchmark has least often, and a band is
counted if it holds one of them. So common phrases cost nothing, unless a window
has little else, and the work grows little with the benchmark. Windows of WINDOW
characters need no pieces: with their budget of edits one of their halves, which
are SHORT windows, is within its own.

A benchmark of up to PART_CHARS characters goes to the workers with the function; a
larger one is cut into parts of that size, and the texts are searched for each. Parts
are built one after the other; what is found for one is written before the next.

Rules. NULL and empty texts hold nothing; NULL ids are kept in the result. Items shorter than
LEAST characters after normalisation, NULL ones among them, are no evidence
and are left out. Repeated items and ties are all reported. An empty benchmark or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

Q, WINDOW, STRIDE, BUDGET, LEAST = 8, 96, 48, 0.08, 40
SHORT, STEP, SEED = 48, 16, 10
PASSAGE = SHORT + STEP - 1
PART_CHARS = 20_000_000
_LIMIT = 0x3000
_NORMAL = np.array([ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else ord(c) if c.isalnum() else 32 for c in map(chr, range(_LIMIT))] + [0], np.uint32)
_NORMAL[0] = 0
_B1 = C.U64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _B2 = _B1 * _B1
    _B4 = _B2 * _B2


class Flat(NamedTuple):
    """Normalised characters, each text after a 0; where each text begins; each character's place in its own text."""

    chars: np.ndarray
    begin: np.ndarray
    place: np.ndarray


def normalised(texts: list[str | None]) -> Flat:
    raw = "".join("\0" + (t or "").replace("\0", " ") for t in texts)
    at = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(at < _LIMIT, _NORMAL[np.minimum(at, _LIMIT)], at)
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & (c[:-1] <= 32))
    where = np.flatnonzero(keep)
    c = c[where]
    begin = np.flatnonzero(c == 0)
    row = np.cumsum(c == 0) - 1
    return Flat(c, begin, where - where[begin][row] - 1 if len(begin) else where)


def grams(c: np.ndarray, size: int = Q) -> np.ndarray:
    """Hash of the piece of Q or SEED characters at each place; those that cross a text's beginning are 0."""
    n = len(c) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = c.astype(np.uint64) + C.U64(1)
    two = h[:-1] * _B1 + h[1:]
    h = two[:-2] * _B2 + two[2:]
    h = h[:-4] * _B4 + h[4:]
    if size == SEED:
        h = h[: -SEED + Q] * _B2 + two[Q:]
    h ^= h >> C.U64(29)
    h *= C.U64(0xBF58476D1CE4E5B9)
    zero = np.cumsum(np.r_[0, c == 0])
    h[zero[size:] != zero[:-size]] = 0
    return h


def rarest(cost: np.ndarray, pieces: int) -> np.ndarray:
    """For each row the places of so many disjoint pieces of SEED characters whose costs have the least sum."""
    n, width = cost.shape
    best = np.zeros((n, width + SEED), np.int64)  # of the pieces so far, from each place on
    take = np.zeros((pieces, n, width), bool)
    for c in range(pieces):
        now = np.full((n, width + SEED), 1 << 60, np.int64)
        for j in range(width - 1, -1, -1):
            with_it = cost[:, j] + best[:, j + SEED]
            take[c, :, j] = with_it < now[:, j + 1]
            now[:, j] = np.minimum(with_it, now[:, j + 1])
        best = now
    out, at = np.empty((n, pieces), np.int64), np.zeros(n, np.int64)
    for c in range(pieces - 1, -1, -1):
        ahead = take[c] & (np.arange(width) >= at[:, None])
        out[:, c] = ahead.argmax(1)
        at = out[:, c] + SEED
    return out


class Benchmark:
    """Windows of the items, and their rarest pieces. chars: the items end to end, each after a 0; begin: where each window begins there."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        items = sorted(items)
        flat = normalised([t for _, t in items])
        self.chars = flat.chars
        item, begin, length, seeded, own = [], [], [], [], []
        self.halves: list[tuple[int, int, int]] = []  # window, its half, the half's place in it
        for (name, _), a, b in zip(items, flat.begin + 1, [*flat.begin[1:], len(flat.chars)]):
            b -= int(b > a and flat.chars[b - 1] == 32)
            n = b - a
            if n < LEAST:
                continue
            spans = set()
            for width, stride in ((WINDOW, STRIDE), (SHORT, STEP)):
                last = max(0, n - width)
                spans |= {(s, min(s + width, n)) for s in [*range(0, last, stride), last]}
            extra = {(n - WINDOW, n - WINDOW + SHORT)} - spans if n >= WINDOW else set()  # the first half of the last one
            number = {span: len(item) + k for k, span in enumerate([*sorted(spans), *extra])}
            for s, e in number:
                item.append(name)
                begin.append(a + s)
                length.append(e - s)
                seeded.append(e - s != WINDOW)
                own.append((s, e) in spans)
                if e - s == WINDOW:
                    self.halves += [(number[s, e], number[s + x, s + x + SHORT], x) for x in (0, SHORT)]
        self.item, self.begin, self.length = np.array(item, np.int64), np.array(begin, np.int64), np.array(length, np.int64)
        self.halves = np.array(self.halves, np.int64).reshape(-1, 3)
        self.halves = self.halves[np.argsort(self.halves[:, 1], kind="stable")]
        self.budget = (self.length * BUDGET).astype(np.int64)
        self.least = self.length - Q + 1 - self.budget * Q
        self.own = np.array(own, bool)  # the others only lead to the windows that they are halves of
        self._index(np.array(seeded, bool))
        self.grams = None

    def _index(self, seeded: np.ndarray) -> None:
        h = grams(self.chars, SEED)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        seed, window, place = [], [], []
        for m in np.unique(self.length[seeded]) if seeded.any() else []:
            every = np.flatnonzero(seeded & (self.length == m))
            for some in np.array_split(every, -(-len(every) // 50_000)):
                grid = self.begin[some, None] + np.arange(m - SEED + 1)
                at = rarest(count[inverse[grid]], int(m * BUDGET) + 1)
                window.append(np.repeat(some, at.shape[1]))
                place.append(at.ravel())
                seed.append(h[(self.begin[some, None] + at).ravel()])
        seed, window, place = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((seed, np.uint64), (window, np.int64), (place, np.int64)))
        order = np.argsort(seed, kind="stable")
        self.window, self.place = window[order].astype(np.int32), place[order].astype(np.int16)
        self.seed, self.first, self.count = np.unique(seed[order], return_index=True, return_counts=True)
        self.bits = min(26, max(20, len(self.seed).bit_length() + 3))
        self.seen = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": None, "grams": None}

    def _ready(self) -> None:
        """What a worker makes of the rest."""
        if self.seen is None:
            self.seen = np.zeros(1 << self.bits, bool)
            self.seen[(self.seed >> C.U64(64 - self.bits)).astype(np.int64)] = True
            self.grams = np.r_[grams(self.chars), np.zeros(Q, np.uint64)]

    def _seeds(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and diagonal of each indexed piece that the text holds, and of the whole windows of halves found."""
        h = grams(chars, SEED)
        at = np.flatnonzero(self.seen[(h >> C.U64(64 - self.bits)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.seed, h[at]), len(self.seed) - 1)
        real = (self.seed[k] == h[at]) & (h[at] != 0)
        at, k = at[real], k[real]
        n = self.count[k]
        j = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else k
        window, diagonal = self.window[j].astype(np.int64), np.repeat(at, n) - self.place[j]
        a, b = (np.searchsorted(self.halves[:, 1], window, side) for side in ("left", "right"))
        j = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum()) if len(a) else a
        return np.r_[window, self.halves[j, 0]], np.r_[diagonal, np.repeat(diagonal, b - a) - self.halves[j, 2]]

    def _bands(self, chars: np.ndarray) -> np.ndarray:
        """(window, first diagonal) of each band with enough shared q-grams that holds an indexed piece."""
        of, diagonal = self._seeds(chars)
        of, diagonal = of[self.own[of]], diagonal[self.own[of]]
        half = self.budget[of] + 1
        some = []
        for shift in (0, 1):
            low = (diagonal + shift * half) // (2 * half) * 2 * half - shift * half
            some.append(np.unique(of << 40 | (low + (1 << 20))))
        key = np.unique(np.concatenate(some))
        of, low = key >> 40, (key & ((1 << 40) - 1)) - (1 << 20)
        h, front = grams(chars), 4 * WINDOW
        h = np.r_[np.zeros(front, np.uint64), h, np.zeros(8 * WINDOW, np.uint64)]
        enough = np.zeros(len(of), bool)
        for m in np.unique(self.length[of]):
            same = np.flatnonzero(self.length[of] == m)
            size, wide = m - Q + 1, 2 * (int(m * BUDGET) + 1)
            rows, own = (np.lib.stride_tricks.sliding_window_view(x, size) for x in (h, self.grams))
            for part in np.array_split(same, -(-len(same) // 2048)):
                mine, shared = own[self.begin[of[part]]], np.zeros(len(part), np.int64)
                for d in range(wide):
                    text = rows[low[part] + d + front]
                    shared += ((text == mine) & (text != 0)).sum(1)
                enough[part] = shared >= self.least[of[part]]
        return np.stack([of[enough], low[enough]], 1)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, begin, end, edits) of each window found; begin and end are characters of the original text."""
        if not len(self.seed):
            return []
        self._ready()
        flat = normalised(texts)
        if len(flat.chars) < SEED:
            return []
        cand = self._bands(flat.chars)
        out = []
        for m in np.unique(self.length[cand[:, 0]]):
            same = cand[self.length[cand[:, 0]] == m]
            for part in np.array_split(same, -(-len(same) // 4096)):
                k = int(m * BUDGET)
                a = np.maximum(part[:, 1] - k, 0)
                b = np.minimum(part[:, 1] + 3 * k + 2 + m, len(flat.chars))
                grid = np.minimum(a[:, None] + np.arange(int((b - a).max())), len(flat.chars) - 1)
                edits, s, e = banded(self.chars[self.begin[part[:, 0], None] + np.arange(m)], flat.chars[grid], b - a, k)
                found = np.flatnonzero((edits <= k) & (e > s))
                s, e = (s + a)[found], (e + a)[found]
                row = np.searchsorted(flat.begin, s, "right") - 1
                whole = row == np.searchsorted(flat.begin, e - 1, "right") - 1
                whole &= flat.chars[s] != 0
                out += [(int(r), int(self.item[w]), int(flat.place[x]), int(flat.place[y - 1]) + 1, int(d)) for r, w, x, y, d in zip(row[whole], part[found[whole], 0], s[whole], e[whole], edits[found[whole]])]
        return out


def banded(pattern: np.ndarray, text: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of patterns: least edits against any stretch of the row's text (of so many characters), and that stretch; the first such end, then its longest stretch. Only diagonals of the band are filled, and only edits up to k are meant."""
    n, m = pattern.shape
    width, big = max(1, text.shape[1] - m + 2 * k + 1), np.int32(1 << 20)
    # cell (i, d): edits of pattern[:i] against a stretch ending at text[i + d - k]; d runs over the band
    chars = np.zeros((n, max(k + 1 + text.shape[1], m + width + 1)), text.dtype)
    chars[:, k + 1 : k + 1 + text.shape[1]] = np.where(np.arange(text.shape[1]) < length[:, None], text, 0)
    d = np.arange(width, dtype=np.int32)
    last = length.astype(np.int32)[:, None]
    cost = np.where((d - k >= 0) & (d - k <= last), np.int32(0), big)
    start = np.broadcast_to(d - np.int32(k), (n, width)).copy()
    for i in range(1, m + 1):
        end = d + np.int32(i - k)
        there = (end >= 0) & (end <= last)
        c = chars[:, i : i + width]
        step = np.where((c == pattern[:, i - 1 : i]) & (c != 0), cost, cost + np.int32(1))  # match or change
        step[:, end < 1] = big
        gap = np.full_like(cost, big)  # a pattern character without partner
        gap[:, :-1] = cost[:, 1:] + np.int32(1)
        above = gap < step
        s = start
        s[:, :-1] = np.where(above[:, :-1], start[:, 1:], start[:, :-1])
        np.minimum(step, gap, out=step)
        step -= d
        run = np.minimum.accumulate(step, axis=1)  # text characters without partner
        src = np.maximum.accumulate(np.where(step == run, d, np.int32(0)), axis=1)
        cost = np.where(there, run + d, big)
        start = np.take_along_axis(s, src, 1)
    at = cost.argmin(1)
    rows = np.arange(n)
    return cost[rows, at], start[rows, at].astype(np.int64), at + m - k


def parts(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark, in parts of about PART_CHARS characters at most, built one after the other."""
    clean = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    chars = clean.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // PART_CHARS))
    for p in range(n):
        got = clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).toArrow()
        yield Benchmark(list(zip(got.column(0).to_pylist(), got.column(1).to_pylist())))


def _searcher(bench: Benchmark) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.slices(batch.column(1)):
                found = bench.search(batch.column(1).slice(a, b - a).to_pylist())
                if found:
                    row, item, begin, end, edits = map(list, zip(*found))
                    yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int64())], ["doc_id", "item_id", "begin", "end", "edits"])

    return run


def _leaks(bench: Benchmark, text: Column) -> Column:
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for a, b in C.slices(texts):
            out[[a + f[0] for f in bench.search(texts.slice(a, b - a).to_pylist())]] = True
        return pa.array(out)

    return leaks(text)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end, windows, edits): documents with passages of a benchmark item, their extent, windows found and the fewest edits of one."""
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out, last = None, None
    for bench in parts(benchmark):
        if last is not None:
            last = C.written(last, "leaks")
            out = last if out is None else out.union(last)
        last = texts.mapInArrow(_searcher(bench), "doc_id bigint, item_id bigint, begin bigint, end bigint, edits bigint")
    out = last if out is None else out.union(last)
    return out.groupBy("doc_id", "item_id").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("windows"), F.min("edits").alias("edits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark. No shuffle: each part of the benchmark is a filter."""
    for bench in parts(benchmark):
        docs = docs.where(~_leaks(bench, docs["text"].cast("string")))
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
