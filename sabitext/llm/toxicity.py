"""Toxicity: a factorization machine over hashed terms.

A text's features are the distinct lower-cased words it holds and the stems (first
STEMS bytes, to the end of a character) of longer ones, so that inflected forms share weights, hashed to
BUCKETS. The score is the logistic of w0 + sum w_i + sum_{i<j} <v_i, v_j>, so a
pair such as an insult with a group mention has a weight of its own that no sum
of single weights can give. Whole texts are scored, in one pass and without a
shuffle; only terms that the model knows are ever looked at.

Training: of the labelled documents about SAMPLE of either class are taken by
a hash of their ids (the only bound; counts, scores and decisions cover all
rows). Near copies in the sample are thinned by shared minima. All terms are kept
that LEAST_DF texts of the sample have and whose share of toxic texts is more than
LEAST_Z standard errors from that of all; all weights are
fitted together by Adam on the logistic loss. The intercept is set back to the
classes' true shares.

Rules. NULL and empty texts score 0 and aren't toxic. With labels of one class
only, or none, nothing is toxic. Labels that are NULL are ignored; of repeated
labels of a document the largest counts. A term repeated in a text counts once.
Every row is scored, whatever its id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

STEMS = (5, 7)
BUCKETS, RANK, SAMPLE, LEAST_DF, LEAST_Z, THRESHOLD = 1 << 20, 8, 4000, 5, 4.0, 0.5
_MINIMA = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and stem, in no order."""
    body, at = C.flat(texts)
    begin, end, row = C.spans(C.WORD_BYTE[body], at)
    low = C.lower_bytes(body)
    hashes, rows = [C.hash_spans(low, begin, end)], [row]
    for size in STEMS:
        longer = end - begin > size
        stop = begin[longer] + size
        for _ in range(3):  # not inside a character
            stop += (stop < end[longer]) & (low[np.minimum(stop, len(low) - 1)] & 0xC0 == 0x80)
        hashes.append(C.mix(C.hash_spans(low, begin[longer], stop) + C.U64(size)))
        rows.append(row[longer])
    return (np.concatenate(hashes) & C.U64(BUCKETS - 1)).astype(np.int64), np.concatenate(rows)


class FactorizationMachine:
    """Weights of the terms kept, by bucket."""

    def __init__(self, buckets: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.buckets, self.w0, self.w, self.v = buckets, w0, w, v
        self._place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self._place is None:
            self._place = np.full(BUCKETS, -1, np.int32)
            self._place[self.buckets] = np.arange(len(self.buckets))
        out = np.zeros(len(texts))
        for a, b in C.slices(texts):
            part = texts.slice(a, b - a)
            bucket, row = terms_of(part)
            term = self._place[bucket]
            known = term >= 0
            pair = np.unique(row[known] * np.int64(len(self.w) + 1) + term[known])
            row, term = pair // (len(self.w) + 1), pair % (len(self.w) + 1)
            n = b - a
            z = self.w0 + np.bincount(row, self.w[term], n)
            for f in range(self.v.shape[1]):
                x = self.v[term, f]
                z += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
            out[a:b] = np.where(np.bincount(row, minlength=n) > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
        return out


def fit(terms: list[np.ndarray], label: np.ndarray, share: float, rank: int = RANK, seed: int = 7, steps: int = 800) -> FactorizationMachine | None:
    """terms: distinct buckets of each text. share: of toxic documents among all that are labelled."""
    label = np.asarray(label, np.float64)
    n, pos = len(label), label.sum()
    if not 0 < pos < n:
        return None
    row = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
    col = np.concatenate(terms).astype(np.int32)
    df = np.bincount(col, minlength=BUCKETS)
    names = np.flatnonzero(df)
    df, df_pos = df[names], np.bincount(col[label[row] > 0], minlength=BUCKETS)[names]
    p = pos / n
    z = (df_pos - df * p) / np.sqrt(np.maximum(df * p * (1 - p) * (1 - df / (n + 1)), 1e-9))
    keep = np.flatnonzero((df >= min(LEAST_DF, max(1, n // 50))) & (np.abs(z) > LEAST_Z))
    if not len(keep):
        return None
    place = np.full(BUCKETS, -1, np.int32)
    place[names[keep]] = np.arange(len(keep))
    x = np.zeros((n, len(keep)), np.float32)
    at = place[col] >= 0
    x[row[at], place[col[at]]] = 1
    rng = np.random.default_rng(seed)
    w0, w, v = np.log(p / (1 - p)), np.zeros(len(keep), np.float32), rng.normal(0, 0.05, (len(keep), rank)).astype(np.float32)
    moment = [[0.0, 0.0] for _ in range(3)]
    for t in range(1, steps + 1):
        s = x @ v
        y = w0 + x @ w + 0.5 * (s * s - x @ (v * v)).sum(1)
        g = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - label) / n).astype(np.float32)
        gx = x.T @ g
        grads = [g.sum(), gx + 2e-5 * w, x.T @ (g[:, None] * s) - v * gx[:, None] + 2e-5 * v]
        steps_ = []
        for m, grad in zip(moment, grads):
            m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.999 * m[1] + 0.001 * grad * grad
            steps_.append(0.05 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8))
        w0, w, v = w0 - steps_[0], w - steps_[1], v - steps_[2]
    share = min(max(share, 1e-6), 1 - 1e-6)
    w0 += np.log(share / (1 - share)) - np.log(p / (1 - p))
    return FactorizationMachine(names[keep].astype(np.int64), float(w0), w.astype(np.float64), v.astype(np.float64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in C.slices(batch.column("text")):
            part = batch.slice(a, b - a)
            bucket, of = terms_of(part.column("text"))
            bucket = bucket[np.argsort(of, kind="stable")]
            first = np.r_[0, np.cumsum(np.bincount(of, minlength=b - a))]
            h, row = C.words(part.column("text"))
            starts = C.row_starts(row)
            s = h.copy()
            s[:-2] = s[:-2] * C.U64(3) + s[1:-1] * C.U64(5) + s[2:]
            minima = np.stack([np.minimum.reduceat(C.mix(s * m), starts) for m in _MINIMA], 1).view(np.int64) if len(starts) else np.zeros((0, 4), np.int64)
            yield pa.record_batch(
                [
                    part.column("toxic").take(pa.array(row[starts])),
                    pa.array([np.unique(bucket[first[i] : first[i + 1]]).astype(np.int32) for i in row[starts]], pa.list_(pa.int32())),
                    pa.array(list(minima), pa.list_(pa.int64())),
                ],
                ["toxic", "terms", "minima"],
            )


def sampled(labels: DataFrame, of: str, sample: int) -> tuple[DataFrame, float]:
    """About `sample` ids of either class by a hash of the id, and the share of class 1 among all."""
    clean = labels.where(f"doc_id is not null and {of} in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.max(of).cast("int").alias(of))
    counts = {r[of]: r["n"] for r in clean.groupBy(of).agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0)
    for k, n in counts.items():
        limit = F.when(F.col(of) == k, F.lit(min(1.0, sample / n) * 1e6)).otherwise(limit)
    picked = clean.where(F.pmod(F.xxhash64(F.col("label_id"), F.lit(11)), F.lit(1_000_000)) < limit)
    return picked, counts.get(1, 0) / max(1, sum(counts.values()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine | None:
    """A machine fitted on labelled rows of docs; None if they don't hold both classes."""
    picked, share = sampled(labels, "toxic", sample)
    rows = docs.where("text is not null").select(docs["doc_id"].cast("bigint").alias("label_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(picked), "label_id").select("label_id", "text", "toxic")
    got = rows.mapInArrow(_features, "toxic int, terms array<int>, minima array<bigint>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    label = got.column("toxic").to_numpy()
    minima = got.column("minima").combine_chunks().flatten().to_numpy().reshape(-1, len(_MINIMA))
    lists = got.column("terms").combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    seen: set[tuple[int, int]] = set()
    use = []
    for r in np.lexsort((label, *minima.T[::-1])):
        own = set(enumerate(minima[r].tolist()))
        if not own & seen:
            use.append(r)
        seen |= own
    return fit([values[at[r] : at[r + 1]] for r in use], label[use], share)


def toxic_score(model: FactorizationMachine | None, text: Column) -> Column:
    """Probability that a text is toxic."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return score(text.cast("string"))


def scored(docs: DataFrame, model: FactorizationMachine | None) -> DataFrame:
    """(doc_id, toxic_score, is_toxic) of every row of docs."""
    return docs.select("doc_id", toxic_score(model, docs["text"]).alias("toxic_score")).withColumn("is_toxic", F.col("toxic_score") >= THRESHOLD)


def accepted(docs: DataFrame, model: FactorizationMachine | None) -> DataFrame:
    """The rows of docs that aren't toxic."""
    return docs.where(toxic_score(model, docs["text"]) < THRESHOLD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
