"""Secrets: a battery of randomness tests for each inferred encoding, with length-aware false-discovery control.

Candidates are runs of LEAST or more of A-Z a-z 0-9 + / _ - (with trailing =), and
their parts of that length: the pieces between separators (+ / _ -, of each kind and
of several), and runs and pieces without the words at either end, as in key-<hex>,
sk_live_<base64url> and /v1/<hex>. Each has its own encoding and its own tests. Of
overlapping ones that pass, the one is reported whose encoding saves most over the text model.
From its characters a candidate's encoding is inferred (hex, base26, base32, base36, base52,
base62, base64, base64url; digits alone are numbers and no candidates). A candidate is a secret if both hold:

1. Against text: its surprisal under the corpus's own character transitions
   (case folded, digits one class, counted over all documents) is too high for text. The
   null is normal with mean n H and variance n s^2, so the evidence that is asked of a run
   depends on its length. Benjamini-Hochberg at ALPHA is applied in each length
   stratum, exactly, on p-values in steps of 10^-0.05.
2. For randomness: three tests against uniform draws from the encoding's alphabet, chi-squared
   with exact moments, Wald-Wolfowitz runs about the alphabet's middle and lag-1 serial
   correlation; p is the least of the three after Bonferroni. Among the candidates of a stratum
   that are unlike text, Benjamini-Hochberg at REJECT tells those that aren't random: of what it
   throws out, the share of truly random runs is REJECT at most.

Both cuts come from one histogram of (stratum, text level, randomness level), which has at most
STRATA * BINS * RBINS cells whatever the input; randomness is only looked at where p_text is
ALPHA or less, as no other candidate can be unlike text.

Rules. NULL and empty texts have no candidates; NULL ids are kept. A secret that
occurs again, in a row or another one, is reported each time. begin and end are
characters. Runs of under LEAST characters and of digits alone are never secrets. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST, ALPHA, REJECT, MASK = 16, 0.001, 0.001, "[SECRET]"
STRATA, BINS, RBINS = 12, 1200, 200
CELLS = 1 << 20  # characters whose randomness is tested at once
_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_SEPARATORS = list(b"+/_-")
_IN = np.zeros(256, bool)
_IN[list(_CHARS)] = True
#: Classes of the text model: 0 outside, 1-26 letters, 27 digits, 28 others.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[[43, 47, 95, 45]] = 28
_N = 29
ENCODINGS = {"hex": b"0123456789abcdef", "HEX": b"0123456789ABCDEF", "base26": b"abcdefghijklmnopqrstuvwxyz", "BASE26": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": b"0123456789abcdefghijklmnopqrstuvwxyz", "BASE36": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base52": _CHARS[:52], "base62": _CHARS[52:62] + _CHARS[:52], "base64": _CHARS[:64], "base64url": _CHARS[:62] + b"-_"}
_CODE = np.full((len(ENCODINGS), 256), -1, np.int16)
for _k, _a in enumerate(ENCODINGS.values()):
    _CODE[_k, list(_a)] = np.arange(len(_a))
_NAMES = np.array([*ENCODINGS, ""], object)
_SIZE = np.array([len(a) for a in ENCODINGS.values()])


def upper_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of a standard normal, relative error under 1e-6 (Numerical Recipes' erfcc)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    half = 0.5 * t * np.exp(-x * x + poly)
    return np.where(z >= 0, half, 1 - half)


def uniformity(codes: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """p-values (rows x 3) of chi-squared, runs and serial correlation. codes: rows padded with -1."""
    rows, width = codes.shape
    there = codes >= 0
    x = np.where(there, codes, 0)
    counts = np.zeros((rows, 64))
    np.add.at(counts, (np.nonzero(there)[0], x[there]), 1)
    chi = (counts**2).sum(1) * size / n - n
    mean, var = size - 1.0, 2.0 * (size - 1) * (n - 1) / n
    a = mean**2 / var  # a gamma with these moments, by Wilson and Hilferty's cube root
    p_chi = upper_tail((np.cbrt(chi / mean) - (1 - 1 / (9 * a))) * np.sqrt(9 * a))
    high = (2 * x >= size[:, None]) & there
    n1 = high.sum(1).astype(float)
    n2 = n - n1
    pair = there[:, 1:]
    runs = 1 + ((high[:, 1:] != high[:, :-1]) & pair).sum(1)
    both = 2 * n1 * n2
    spread = np.sqrt(np.maximum(both * (both - n) / (n * n * (n - 1)), 1e-12))
    p_runs = np.where((n1 > 0) & (n2 > 0), np.minimum(1, 2 * upper_tail(np.maximum(np.abs(runs - both / n - 1) - 0.5, 0) / spread)), 0.5 ** (n - 1.0))
    dev = np.where(there, x - (np.where(there, x, 0).sum(1) / n)[:, None], 0)
    total = (dev**2).sum(1)
    r = np.where(total > 0, (dev[:, 1:] * dev[:, :-1]).sum(1) / np.maximum(total, 1e-12), 1.0)
    p_serial = np.minimum(1, 2 * upper_tail(np.abs(r + 1 / n) * np.sqrt(n)))
    return np.stack([p_chi, p_runs, p_serial], 1)


class TextModel:
    """Transitions of character classes in the corpus."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape(_N, _N).astype(float)
        c[:, 0] = c[0] = 0  # only inside runs
        smooth = c + 0.5
        smooth[:, 0] = smooth[0] = 0
        p = np.divide(smooth, smooth.sum(1, keepdims=True), out=np.zeros_like(smooth), where=smooth.sum(1, keepdims=True) > 0)
        self.surprise = np.where(p > 0, -np.log(np.where(p > 0, p, 1)), 0)
        self.surprise[:, 27] += np.log(10)  # which digit, and which other
        self.surprise[:, 28] += np.log(4)
        share = c / max(c.sum(), 1)
        self.mean = float((share * self.surprise).sum())
        self.sd = float(np.sqrt(max((share * self.surprise**2).sum() - self.mean**2, 1e-6)))


def parts(sub: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the parts of runs that lie end to end in sub, run i from at[i] to at[i + 1]: the pieces
    between separators of each kind and of several kinds, and runs and pieces without the words at either end."""
    spans = [np.stack([at[:-1], at[1:]], 1)]
    present = [c for c in _SEPARATORS if (sub == c).any()]
    for some in range(1, 1 << len(present)):
        apart = np.isin(sub, [c for i, c in enumerate(present) if some >> i & 1])
        spans.append(np.stack(C.spans(~apart, at)[:2], 1))
    word_begin, word_end, _ = C.spans(~np.isin(sub, _SEPARATORS), at)
    digits, upper = (np.concatenate([[0], np.cumsum(m)]) for m in ((sub >= 48) & (sub <= 57), (sub >= 65) & (sub <= 90)))
    n, d, u = word_end - word_begin, digits[word_end] - digits[word_begin], upper[word_end] - upper[word_begin]
    first = sub[word_begin]
    word = (d == 0) & ((u == 0) | (u == n) | ((u == 1) & (first >= 65) & (first <= 90))) & (n < LEAST) | (d == n - 1) & (n <= 3) & np.isin(first, list(b"vV"))
    begins, ends = word_begin[~word], word_end[~word]
    every = np.unique(np.concatenate(spans), axis=0)
    every = every[every[:, 1] - every[:, 0] >= LEAST]
    if len(begins) and len(every):
        begin, end = every.T
        later = begins[np.minimum(np.searchsorted(begins, begin), len(begins) - 1)]
        sooner = ends[np.maximum(np.searchsorted(ends, end, "right") - 1, 0)]
        later = np.where((later >= begin) & (later < end), later, begin)
        sooner = np.where((sooner <= end) & (sooner > later), sooner, end)
        every = np.unique(np.concatenate([every, np.stack([later, end], 1), np.stack([begin, sooner], 1), np.stack([later, sooner], 1)]), axis=0)
    return every[:, 0], every[:, 1]


def candidates(texts: pa.Array, model: TextModel) -> dict[str, np.ndarray]:
    """row, begin and end (bytes in the slice), length, encoding, p_text and gain of each run or part that has letters; the lengths of the others in numbers. gain: nats saved by the encoding over the text model."""
    body, at = C.flat(texts)
    begin, end, row = C.spans(_IN[body], at)
    long = end - begin >= LEAST
    begin, end, row = begin[long], end[long], row[long]
    kind = _CLASS[body].astype(np.int64)
    digits, letters, others = (np.concatenate([[0], np.cumsum(m)]) for m in (kind == 27, (kind > 0) & (kind < 27), kind == 28))
    parted = others[end] > others[begin]
    if parted.any():
        of, n = np.flatnonzero(parted), (end - begin)[parted]
        inner = np.concatenate([[0], np.cumsum(n)])
        move = begin[of] - inner[:-1]
        b, e = parts(body[np.arange(inner[-1]) + np.repeat(move, n)], inner)
        run = np.searchsorted(inner, b, "right") - 1
        fine = e - b >= LEAST
        b, e, run = b[fine], e[fine], run[fine]
        begin, end, row = (np.concatenate(x) for x in ((begin[~parted], b + move[run]), (end[~parted], e + move[run]), (row[~parted], row[of[run]])))
        order = np.lexsort((end, begin))
        begin, end, row = begin[order], end[order], row[order]
    lettered = letters[end] > letters[begin]
    numbers = (end - begin)[~lettered]  # candidates too: they count among the tests, with p = 1
    begin, end, row = begin[lettered], end[lettered], row[lettered]
    bad = [np.concatenate([[0], np.cumsum((code < 0)[body] & (body != 45) if k < 2 else (code < 0)[body])]) for k, code in enumerate(_CODE)] if len(begin) else []
    encoding = np.full(len(begin), len(ENCODINGS))
    for k in reversed(range(len(bad))):
        encoding[bad[k][end] == bad[k][begin]] = k
    step = np.concatenate([[0], np.cumsum(np.r_[0, model.surprise[kind[:-1], kind[1:]]])]) if len(kind) else np.zeros(1)
    n = end - begin
    surprise = step[end] - step[begin + 1]
    z = (surprise - (n - 1) * model.mean) / (model.sd * np.sqrt(n - 1))
    gain = surprise - n * np.log(np.append(_SIZE, 1 << 20))[encoding]
    return {"row": row, "begin": begin, "end": end, "length": n, "encoding": encoding, "p_text": upper_tail(z), "gain": gain, "numbers": numbers}


def randomness(body: np.ndarray, begin: np.ndarray, end: np.ndarray, encoding: np.ndarray) -> np.ndarray:
    """The least of the three p-values of each span in its encoding, after Bonferroni."""
    p_random = np.zeros(len(begin))
    n = end - begin
    order = np.argsort(n, kind="stable")
    cut = np.flatnonzero(np.diff(np.cumsum(n[order]) // CELLS)) + 1
    for part in np.split(order, cut):
        if not len(part):
            continue
        grid = begin[part, None] + np.arange(int(n[part].max()))
        use = grid < end[part, None]
        codes = np.where(use, _CODE[encoding[part, None], body[np.minimum(grid, len(body) - 1)]], -1)
        dash = use & (codes < 0)  # hyphens inside hex
        if dash.any():
            shift = np.argsort(codes < 0, axis=1, kind="stable")
            codes = np.take_along_axis(codes, shift, 1)
        k = (codes >= 0).sum(1).astype(float)
        ok = k >= 8
        p = np.zeros(len(part))
        if ok.any():
            p[ok] = np.minimum(1, 3 * uniformity(codes[ok], k[ok], _SIZE[encoding[part[ok]]]).min(1))
        p_random[part] = p
    return p_random


def apart(begin: np.ndarray, end: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Places, in order, of spans that don't overlap: of those that do, the one that gains most. begin ascends."""
    if not len(begin):
        return np.zeros(0, np.int64)
    fresh = np.r_[True, begin[1:] >= np.maximum.accumulate(end)[:-1]]
    first = np.flatnonzero(fresh)
    kept: list[int] = []
    for i, j in zip(first, [*first[1:], len(begin)]):
        left = np.arange(i, j)
        left = left[np.lexsort((begin[left] - end[left], -gain[left]))]
        while len(left):
            best = left[0]
            kept.append(int(best))
            left = left[(end[left] <= begin[best]) | (begin[left] >= end[best])]
    return np.sort(np.array(kept, np.int64))


def stratum(n: np.ndarray) -> np.ndarray:
    """Half octaves of length above LEAST."""
    return np.minimum((2 * np.log2(np.maximum(n, LEAST) / LEAST)).astype(np.int64), STRATA - 1)


def level(p: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """Steps of 10^-0.05; the level's p-value is its upper end, so none gets smaller."""
    return np.minimum((-20 * np.log10(np.maximum(p, 1e-300))).astype(np.int64), most)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_N * _N, np.int64)
    for batch in batches:
        for a, b in C.slices(batch.column(0)):
            body, at = C.flat(batch.column(0).slice(a, b - a))
            kind = _CLASS[body].astype(np.int64)
            pair = kind[:-1] * _N + kind[1:]
            edge = at[1:-1]
            pair[edge[(edge > 0) & (edge < len(kind))] - 1] = 0
            total += np.bincount(pair, minlength=_N * _N)
    yield pa.record_batch([pa.array(np.arange(_N * _N)), pa.array(total)], ["cell", "n"])


def text_model(docs: DataFrame) -> TextModel:
    """Transitions counted over all texts; 841 numbers reach the driver."""
    rows = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_N * _N, np.int64)
    for r in rows:
        counts[r["cell"]] = r["n"]
    return TextModel(counts)


def cutoffs(docs: DataFrame, model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """For each stratum the least text level at which Benjamini-Hochberg discovers, and the least randomness level at which it rejects; BINS or RBINS if none. Counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []
        for batch in batches:
            for a, b in C.slices(batch.column(0)):
                part = batch.column(0).slice(a, b - a)
                got = candidates(part, model)
                s, k, r = stratum(got["length"]), level(got["p_text"]), np.zeros(len(got["length"]), np.int64)
                far = (got["p_text"] <= ALPHA) & (got["encoding"] < len(ENCODINGS))
                r[far] = level(randomness(C.flat(part)[0], got["begin"][far], got["end"][far], got["encoding"][far]), RBINS - 1) + 1
                cells += [(s * BINS + k) * (RBINS + 1) + r, stratum(got["numbers"]) * BINS * (RBINS + 1)]
        cell, n = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
        yield pa.record_batch([pa.array(cell), pa.array(n)], ["cell", "n"])

    table = np.zeros(STRATA * BINS * (RBINS + 1), np.int64)
    got = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return cuts_of(table.reshape(STRATA, BINS, RBINS + 1))


def cuts_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """table: candidates by stratum, text level, and randomness level + 1, 0 where it wasn't looked at."""
    text = benjamini_hochberg(table.sum(2), ALPHA)
    unlike = np.stack([t[cut:, 1:].sum(0) for t, cut in zip(table, text)])
    return text, benjamini_hochberg(unlike, REJECT)


def benjamini_hochberg(table: np.ndarray, alpha: float) -> np.ndarray:
    """Of tests by stratum and level: the least level that is discovered in each stratum, the number of levels if none."""
    found = table[:, ::-1].cumsum(1)[:, ::-1]  # tests at this level or beyond
    p = 10.0 ** (-np.arange(table.shape[1]) / 20)
    passes = p * table.sum(1, keepdims=True) <= alpha * found
    passes &= found > 0
    return np.where(passes.any(1), passes.argmax(1), table.shape[1])


class Scanner:
    """What a worker needs to find secrets in a batch."""

    def __init__(self, model: TextModel, cutoff: np.ndarray, reject: np.ndarray) -> None:
        self.model, self.cutoff, self.reject = model, cutoff, reject

    def find(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """row, begin and end (bytes in the row), encoding, p_text and p_random of each secret, in order."""
        body, at = C.flat(texts)
        got = candidates(texts, self.model)
        got.pop("numbers")
        unlike = (level(got["p_text"]) >= self.cutoff[stratum(got["length"])]) & (got["encoding"] < len(ENCODINGS))
        got = {k: v[unlike] for k, v in got.items()}
        got["p_random"] = randomness(body, got["begin"], got["end"], got["encoding"])
        random = level(got["p_random"], RBINS - 1) < self.reject[stratum(got["length"])]
        got = {k: v[random] for k, v in got.items()}
        kept = apart(got["begin"], got["end"], got["gain"])
        got = {k: v[kept] for k, v in got.items()}
        return got | {"begin": got["begin"] - at[got["row"]], "end": got["end"] - at[got["row"]]}

    def redact(self, texts: pa.Array) -> list[str | None]:
        """The text without its secrets where it has any, else None."""
        out: list[str | None] = [None] * len(texts)
        for a, b in C.slices(texts):
            part = texts.slice(a, b - a)
            got = self.find(part)
            rows, first = np.unique(got["row"], return_index=True)
            for r, i, j in zip(rows, first, [*first[1:], len(got["row"])]):
                raw, pieces, last = part[int(r)].as_py().encode(), [], 0
                for s, e in zip(got["begin"][i:j], got["end"][i:j]):
                    pieces += [raw[last:s], MASK.encode()]
                    last = e + len(raw[e : e + 2]) - len(raw[e : e + 2].lstrip(b"="))
                out[a + int(r)] = b"".join([*pieces, raw[last:]]).decode()
        return out


def scanner(docs: DataFrame) -> Scanner:
    model = text_model(docs)
    return Scanner(model, *cutoffs(docs, model))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end, secret, encoding, p_text, p_random) of each secret."""
    find = scanner(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                got = find.find(part.column(1))
                if not len(got["row"]):
                    continue
                body, at = C.flat(part.column(1))
                inner = np.r_[0, np.cumsum(body & 0xC0 == 0x80)]  # bytes that begin no character
                first = at[got["row"]]
                begin, end = first + got["begin"], first + got["end"]
                chars = got["begin"] - (inner[begin] - inner[first])
                found = pa.array([body[s:e].tobytes().decode() for s, e in zip(begin.tolist(), end.tolist())], pa.string())
                yield pa.record_batch([part.column(0).take(pa.array(got["row"])), pa.array(chars), pa.array(chars + end - begin), found, pa.array(_NAMES[got["encoding"]], pa.string()), pa.array(got["p_text"]), pa.array(got["p_random"])], ["doc_id", "begin", "end", "secret", "encoding", "p_text", "p_random"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, begin bigint, end bigint, secret string, encoding string, p_text double, p_random double")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each secret replaced by MASK; n_chars, if there, is the new length of changed texts."""
    find = scanner(docs)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(find.redact(texts), pa.string())

    fresh: Column = clean(docs["text"].cast("string"))
    columns = {"text": F.coalesce(fresh, docs["text"])}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(fresh.isNotNull(), F.length(fresh).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return docs.withColumns(columns)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
