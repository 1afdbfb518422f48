"""Quality: a generalised additive model with pairwise interactions.

    logit P(good | text) = b + sum_f T_f[bin of f] + sum_(f,g) T_fg[bin of f, bin of g]

FEATURES are shares and averages of a text's bytes, words and lines, none of
which knows a language. Each is cut into at most BINS bins at quantiles of the
sample. Boosting goes round the features: a tree of at most LEAVES leaves on one
feature is fitted to the gradients and added to that feature's table, with a
small step, ROUNDS times. Then the PAIRS pairs whose coarse grid explains the
rest best get tables of their own from trees of depth two. Scoring is one
lookup for each table and a sum, whole columns at a time, whatever the number
of trees.

The sample: about SAMPLE labelled rows of either class by a hash of their ids,
the only bound; everything else covers all rows. The intercept is set back to
the classes' true shares.

Rules. NULL texts have NULL scores, texts without a word score 0; neither is
good. With labels of one class only, or none, every text scores 1. Labels that
are NULL are ignored; of repeated labels of a document the largest counts.
Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .toxicity import sampled

SAMPLE, BINS, LEAVES, ROUNDS, RATE, PAIRS, PAIR_ROUNDS, COARSE, RIDGE, LEAST_ROWS, THRESHOLD = 6000, 48, 4, 120, 0.1, 8, 40, 12, 1.0, 10, 0.5
FEATURES = ("log_words", "word_bytes", "letters", "digits", "blanks", "symbols", "stops", "capitals", "bars", "distinct_words", "top_word", "short_words", "long_words", "line_bytes", "repeated_lines", "ended_lines")
_CLASS = np.zeros((256, 7), bool)
for _k, _chars in enumerate((b"0123456789", b" \t\r\n", b"#$%&*@<>{}[]=+~^\\_", b".,;:!?", bytes(range(65, 91)), b"|")):
    _CLASS[list(_chars), _k + 1] = True
_CLASS[:, 0] = C.WORD_BYTE & ~_CLASS[:, 1]
#: One class for each byte, so that one bincount counts them all.
_ONE = np.where(_CLASS[:, 5], 5, np.where(_CLASS.any(1), _CLASS.argmax(1), 7)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows x FEATURES, and which rows have words."""
    body, at = C.flat(texts)
    n = len(texts)
    size = np.maximum(np.diff(at), 1).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(at))
    count = np.bincount(row_of * 8 + _ONE[body], minlength=8 * n).reshape(n, 8).astype(float)
    begin, end, row = C.spans(C.WORD_BYTE[body], at)
    h = C.hash_spans(C.lower_bytes(body), begin, end)
    words = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (end - begin).astype(float)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])]) if len(hs) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(hs)])
    distinct = np.bincount(rs[first], minlength=n)
    top = np.zeros(n)
    if len(first):
        starts = C.row_starts(rs[first])
        top[rs[first][starts]] = np.maximum.reduceat(times, starts)
    line_begin, line_end, line_row = C.spans(body != 10, at)
    line_h = C.hash_spans(body, line_begin, line_end)
    lines = np.maximum(np.bincount(line_row, minlength=n), 1).astype(float)
    lo = np.lexsort((line_h, line_row))
    lh, lr = line_h[lo], line_row[lo]
    new = np.r_[True, (lh[1:] != lh[:-1]) | (lr[1:] != lr[:-1])] if len(lh) else np.zeros(0, bool)
    different = np.bincount(lr[new], minlength=n)
    ended = np.bincount(line_row, _CLASS[body[line_end - 1], 4], n) if len(line_end) else np.zeros(n)
    x = np.stack(
        [
            np.log1p(words),
            np.bincount(row, length, n) / some,
            (count[:, 0] + count[:, 5]) / size,
            count[:, 1] / size,
            count[:, 2] / size,
            count[:, 3] / size,
            count[:, 4] / size,
            count[:, 5] / size,
            count[:, 6] / size,
            distinct / some,
            top / some,
            np.bincount(row, length <= 3, n) / some,
            np.bincount(row, length >= 12, n) / some,
            np.log1p(size / lines),
            1 - np.maximum(different, 1) / lines,
            ended / lines,
        ],
        1,
    )
    return x, words > 0


class AdditiveModel:
    """Edges of each feature's bins, a table for each feature and for each pair."""

    def __init__(self, edges: list[np.ndarray]) -> None:
        self.edges = edges
        self.bias = 0.0
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.bias)
        for f, t in enumerate(self.tables):
            z += t[bins[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            z += t[bins[:, f], bins[:, g]]
        return z


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((nl >= LEAST_ROWS) & (n.sum() - nl >= LEAST_ROWS), gain, 0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values of a greedy tree, by bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_split(g[a:b], h[a:b], n[a:b]), k) for k, (a, b) in enumerate(parts)]
        gain, cut, k = max(found, key=lambda t: t[0])
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree of depth two on a grid: a cut of the rows, then a cut of the columns in either half."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b, c = (x.T if flip else x for x in (g, h, n))
        ga, ha, na = (x.cumsum(0).cumsum(1) for x in (a, b, c))
        top_g, top_h, top_n = ga[:-1], ha[:-1], na[:-1]
        low_g, low_h, low_n = ga[-1] - top_g, ha[-1] - top_h, na[-1] - top_n
        halves = []
        for sg, sh, sn in ((top_g, top_h, top_n), (low_g, low_h, low_n)):
            rg, rh, rn = sg[:, -1:] - sg[:, :-1], sh[:, -1:] - sh[:, :-1], sn[:, -1:] - sn[:, :-1]
            gain = np.where((sn[:, :-1] >= LEAST_ROWS) & (rn >= LEAST_ROWS), _gain(sg[:, :-1], sh[:, :-1]) + _gain(rg, rh), -1)
            k = gain.argmax(1) if gain.shape[1] else np.zeros(len(sg), int)
            halves.append((np.maximum(gain[np.arange(len(sg)), k] if gain.shape[1] else 0, _gain(sg[:, -1], sh[:, -1])), k))
        if not len(top_g):
            continue
        total = halves[0][0] + halves[1][0] - _gain(ga[-1, -1], ha[-1, -1])
        total = np.where((top_n[:, -1] >= LEAST_ROWS) & (low_n[:, -1] >= LEAST_ROWS), total, 0)
        r = int(total.argmax())
        if total[r] > best:
            best, value = float(total[r]), np.zeros_like(a)
            for rows, (_, k) in ((slice(0, r + 1), halves[0]), (slice(r + 1, None), halves[1])):
                for cols in (slice(0, int(k[r]) + 1), slice(int(k[r]) + 1, None)):
                    value[rows, cols] = a[rows, cols].sum() / (b[rows, cols].sum() + RIDGE)
            out = value.T if flip else value
    return best, out


def fit(x: np.ndarray, label: np.ndarray, share: float) -> AdditiveModel | None:
    """share: of class 1 among all that are labelled."""
    label = np.asarray(label, float)
    if not 0 < label.sum() < len(label):
        return None
    model = AdditiveModel([np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])])
    bins = model.bins(x)
    p0 = label.mean()
    model.bias = float(np.log(p0 / (1 - p0)))
    z = np.full(len(x), model.bias)
    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            b = bins[:, f]
            step = RATE * tree(np.bincount(b, label - p, len(table)), np.bincount(b, p * (1 - p), len(table)), np.bincount(b, minlength=len(table)))
            table += step
            z += step[b]
    p = 1 / (1 + np.exp(-z))
    coarse = np.stack([bins[:, f] * min(COARSE, len(t)) // len(t) for f, t in enumerate(model.tables)], 1)
    gains = []
    for f in range(x.shape[1]):
        for g in range(f + 1, x.shape[1]):
            at = coarse[:, f] * COARSE + coarse[:, g]
            grid = [np.bincount(at, w, COARSE * COARSE).reshape(COARSE, COARSE) for w in (label - p, p * (1 - p), np.ones(len(at)))]
            gains.append((pair_tree(*grid)[0], f, g))
    model.pairs = [(f, g) for _, f, g in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.tables[f]), len(model.tables[g]))) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), table in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-z))
            at = bins[:, f] * table.shape[1] + bins[:, g]
            grid = [np.bincount(at, w, table.size).reshape(table.shape) for w in (label - p, p * (1 - p), np.ones(len(at)))]
            step = RATE * pair_tree(*grid)[1]
            table += step
            z += step[bins[:, f], bins[:, g]]
    share = min(max(share, 1e-6), 1 - 1e-6)
    model.bias += float(np.log(share / (1 - share)) - np.log(p0 / (1 - p0)))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in C.slices(batch.column("text")):
            x, some = features(batch.column("text").slice(a, b - a))
            keep = pa.array(np.flatnonzero(some))
            yield pa.record_batch([batch.column(c).slice(a, b - a).take(keep) for c in ("label_id", "quality")] + [pa.array(list(x[some]), pa.list_(pa.float64()))], ["label_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel | None:
    """A model fitted on labelled rows of docs; None if they don't hold both classes."""
    picked, share = sampled(labels, "quality", sample)
    rows = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("bigint").alias("label_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(picked), "label_id").select("label_id", "text", "quality")
    got = sorted(rows.mapInArrow(_features, "label_id bigint, quality int, x array<double>").collect(), key=lambda r: (r["label_id"], r["x"]))
    return fit(np.array([r["x"] for r in got], float), np.array([r["quality"] for r in got]), share) if got else None


def quality_score(model: AdditiveModel | None, text: Column) -> Column:
    """Probability that a text is good."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts))
        if model is not None:
            for a, b in C.slices(texts):
                x, some = features(texts.slice(a, b - a))
                out[a:b] = np.where(some, 1 / (1 + np.exp(-np.clip(model.logits(model.bins(x)), -50, 50))), 0.0)
        return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))

    return score(text.cast("string"))


def scored(docs: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """(doc_id, quality_score, is_good) of every row of docs."""
    return docs.select("doc_id", quality_score(model, docs["text"]).alias("quality_score")).withColumn("is_good", F.coalesce(F.col("quality_score") >= THRESHOLD, F.lit(False)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
