"""Stupid-backoff scores of every document under the n-grams of the whole corpus.

    S(w | u v) = c(u v w) / c(u v)  if the corpus has u v w at least LEAST times,
                 BACKOFF * S(w | v) otherwise,     S(w) = c(w) / N

The relations are n-gram counts and exploded n-grams. Both are partitioned by
the n-gram's hash, joined there, and the logarithms are summed for each
document. Rows travel packed, many in one binary column, sorted hashes as gaps:

1. Words are hashed once. A slice (some MB of whole documents) is written with
   its distinct words and, for each token, which of them it is.
2. A slice's distinct n-grams with their counts go to the bucket of their
   hash. A frequent n-gram is one entry for each slice, however often it
   occurs there, so no bucket is hot.
3. A bucket adds counts up over all slices and answers each slice with the
   corpus's counts of its n-grams, in their order.
4. Slices and answers meet by slice; there each token has its counts, and
   each document its sum.

Hashes are told apart by BITS bits, those of the bucket among them.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in
lower case (ASCII and Latin-1). No n-gram crosses a document's borders; the
first words of a document have shorter contexts. N-grams that the corpus has
fewer than LEAST times are treated as unseen, single words never.

Rules. NULL and empty texts have no tokens: n_tokens 0, NULL scores. Each row
is scored on its own, also if it repeats a doc_id or has none, and each counts
in the corpus. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER, LEAST, BACKOFF = 3, 2, 0.4
PACK_BYTES, BITS, SPREAD, BUCKET_TOKENS = 8 << 20, 56, 4, 250_000
_STEP = C.U64(0x9E3779B97F4A7C15)
_SCHEMA = "slice bigint, ids binary, sizes binary, words binary, tokens binary, n_tokens bigint"
_NO_ID = np.iinfo(np.int64).min


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as many bytes each as the largest needs, plane by plane, compressed."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return (len(a) << 8 | width).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    """What packed() was given, as uint64."""
    head = int.from_bytes(raw[:8], "little")
    n, width = head >> 8, head & 255
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0

    def slice_of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, hashes = (np.concatenate(x) for x in zip(*held))
        words, tokens, times = np.unique(hashes, return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")  # frequent words get small numbers
        rank = np.empty_like(often)
        rank[often] = np.arange(len(often))
        return pa.record_batch([pa.array([part << 32 | n]), _binary([ids.tobytes()]), _binary([packed(sizes)]), _binary([words[often].tobytes()]), _binary([packed(rank[tokens])]), pa.array([len(tokens)])], ["slice", "ids", "sizes", "words", "tokens", "n_tokens"])

    held, bytes_ = [], 0
    for batch in batches:
        for a, b in C.slices(batch.column(1)):
            texts = batch.column(1).slice(a, b - a)
            h, row = C.words(texts)
            held.append((batch.column(0).slice(a, b - a).fill_null(_NO_ID).to_numpy(), np.bincount(row, minlength=b - a), h))
            bytes_ += int(C.flat(texts)[1][-1])
            if bytes_ >= PACK_BYTES:
                yield slice_of(held)
                held, bytes_, n = [], 0, n + 1
    if held:
        yield slice_of(held)


class _Slice:
    """One slice, unpacked. grams[k - 1] has the hash of the n-gram of order k that ends at each token."""

    def __init__(self, sizes: bytes, words: bytes, tokens: bytes, order: int) -> None:
        self.sizes = unpacked(sizes).astype(np.int64)
        h = np.frombuffer(words, np.uint64)[unpacked(tokens).astype(np.int64)]
        self.place = np.arange(len(h)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.ends, grams = [], []
        code = h
        for k in range(1, order + 1):
            if k > 1:
                code = np.r_[np.zeros(min(1, len(code)), np.uint64), code[:-1]] * _STEP + h
            at = np.flatnonzero(self.place >= k - 1)
            self.ends.append(at)
            grams.append(C.mix(code[at] ^ C.mix(np.full(1, k, np.uint64))))
        self.grams = np.concatenate(grams)


def _asker(buckets: int, order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    first = np.array([-(-(k << 64) // buckets) for k in range(buckets)], np.uint64)
    shift = C.U64(max(0, 64 - BITS + buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, words, tokens = (batch.column(c)[row].as_py() for c in ("sizes", "words", "tokens"))
                gram, count = np.unique(_Slice(sizes, words, tokens, order).grams, return_counts=True)
                if not len(gram):
                    continue
                # bucket k has the hashes from k / buckets of their range on; the bits behind that quotient tell them apart
                ends = np.r_[np.searchsorted(gram, first), len(gram)]
                some = np.flatnonzero(ends[1:] > ends[:-1])
                grams, counts = [], []
                for a, b in zip(ends[some], ends[some + 1]):
                    grams.append(packed(np.diff((gram[a:b] * C.U64(buckets)) >> shift, prepend=C.U64(0))))
                    counts.append(packed(count[a:b]))
                yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([batch.column("slice")[row].as_py()] * len(some)), _binary(grams), _binary(counts)], ["bucket", "slice", "grams", "counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in C.Runs("bucket", 1).of(batches):
        bucket = table.column("bucket").to_numpy()
        starts = C.row_starts(bucket)
        for a, b in zip(starts, np.r_[starts[1:], len(bucket)]):
            part = table.slice(a, b - a)
            grams = [np.cumsum(unpacked(x)) for x in part.column("grams").to_pylist()]
            cuts = np.cumsum([0, *map(len, grams)])
            gram = np.concatenate(grams)
            count = np.concatenate([unpacked(x) for x in part.column("counts").to_pylist()])
            del grams
            order = np.argsort(gram)
            sorted_ = gram[order]
            first = C.row_starts(sorted_)
            total = np.add.reduceat(count[order].astype(np.int64), first)
            answer = np.empty(len(gram), np.int64)
            answer[order] = np.repeat(total, np.diff(np.r_[first, len(gram)]))
            yield pa.record_batch([part.column("slice").combine_chunks(), pa.array([int(bucket[a])] * (b - a), pa.int32()), _binary([packed(answer[s:e]) for s, e in zip(cuts[:-1], cuts[1:])])], ["slice", "bucket", "counts"])


def log_scores(counts: list[np.ndarray], place: np.ndarray, total: int, least: int = LEAST, backoff: float = BACKOFF) -> np.ndarray:
    """Log score of each token. counts[k - 1]: the corpus's count of the n-gram of order k that ends there (0 where the document has fewer words before)."""
    score = np.log(counts[0] / total) if len(place) else np.zeros(0)
    for k in range(2, len(counts) + 1):
        whole, context = counts[k - 1], np.r_[np.zeros(min(1, len(place)), np.int64), counts[k - 2][:-1]]
        seen = (whole >= least) & (place >= k - 1)
        score = np.where(place < k - 1, score, np.where(seen, np.log(np.maximum(whole, 1)) - np.log(np.maximum(context, 1)), score + np.log(backoff)))
    return score


def _scorer(total: int, order: int, least: int, backoff: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.Runs("slice", 1).of(batches):
            name = table.column("slice").to_numpy()
            starts = C.row_starts(name)
            for a, b in zip(starts, np.r_[starts[1:], len(name)]):
                head = table.slice(a, 1).to_pylist()[0]
                sl = _Slice(head["sizes"], head["words"], head["tokens"], order)
                answers = np.concatenate([np.zeros(0, np.int64), *(unpacked(x).astype(np.int64) for x in table.column("counts").slice(a + 1, b - a - 1).to_pylist())])
                order_ = np.argsort(sl.grams)
                sl.grams = sl.grams[order_]
                which = np.cumsum(np.r_[False, sl.grams[1:] != sl.grams[:-1]]) if len(order_) else order_
                each, counts, begin = np.empty(len(order_), np.int64), [], 0
                each[order_] = answers[which]
                del order_, which, answers
                for at in sl.ends:
                    full = np.zeros(len(sl.place), np.int64)
                    full[at] = each[begin : begin + len(at)]
                    counts.append(full)
                    begin += len(at)
                score = log_scores(counts, sl.place, total, least, backoff)
                row = np.repeat(np.arange(len(sl.sizes)), sl.sizes)
                sums = np.bincount(row, score, len(sl.sizes)).astype(float)
                ids, empty = np.frombuffer(head["ids"], np.int64), sl.sizes == 0
                with np.errstate(invalid="ignore"):
                    mean = sums / sl.sizes
                yield pa.record_batch([pa.array(ids, mask=ids == _NO_ID), pa.array(sl.sizes), pa.array(sums, mask=empty), pa.array(mean, mask=empty)], ["doc_id", "n_tokens", "log_score", "mean_log_score"])

    return run


def scored(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    slices = C.written(texts.mapInArrow(_pack, _SCHEMA), "slices")
    total = slices.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket is held in memory as a whole: its size doesn't grow with the corpus
    buckets = max(SPREAD * tasks, -(-total // BUCKET_TOKENS))
    tasks = max(2 * tasks, buckets // SPREAD)
    asked = slices.select("slice", "sizes", "words", "tokens").mapInArrow(_asker(buckets, order), "bucket int, slice bigint, grams binary, counts binary")
    answered = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "slice bigint, bucket int, counts binary")
    none = F.lit(None).cast("binary")
    both = slices.select("slice", F.lit(-1).alias("bucket"), "ids", "sizes", "words", "tokens", none.alias("counts")).union(answered.select("slice", "bucket", none, none, none, none, "counts"))
    met = both.repartition(tasks, "slice").sortWithinPartitions("slice", "bucket")
    return met.mapInArrow(_scorer(total, order, least, backoff), "doc_id bigint, n_tokens bigint, log_score double, mean_log_score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_LOWER = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"

OP9_SQL = rf"""
WITH lists AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-zA-Z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents
), tokens AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM lists
), placed AS (
  SELECT r, i, w, lag(w, 1) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM tokens
), c1 AS (SELECT w, count(*) AS n FROM placed GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM placed WHERE i > 1 GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM placed WHERE i > 2 GROUP BY u, v, w),
every AS (SELECT count(*) AS n FROM placed),
scores AS (
  SELECT p.r, CASE
      WHEN p.i > 2 AND t.n >= {LEAST} THEN ln(t.n) - ln(tc.n)
      WHEN p.i > 1 AND b.n >= {LEAST} THEN ln(b.n) - ln(bc.n) + CASE WHEN p.i > 2 THEN ln({BACKOFF}) ELSE 0 END
      ELSE ln(a.n / every.n) + CASE WHEN p.i > 2 THEN 2 * ln({BACKOFF}) WHEN p.i > 1 THEN ln({BACKOFF}) ELSE 0 END END AS s
  FROM placed p CROSS JOIN every JOIN c1 a ON a.w = p.w
  LEFT JOIN c2 b ON b.v = p.v AND b.w = p.w LEFT JOIN c1 bc ON bc.w = p.v
  LEFT JOIN c3 t ON t.u = p.u AND t.v = p.v AND t.w = p.w LEFT JOIN c2 tc ON tc.v = p.u AND tc.w = p.v
), sums AS (SELECT r, sum(s) AS s FROM scores GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_tokens, round(s, 4) AS log_score, round(s / len(words), 6) AS mean_log_score
FROM lists LEFT JOIN sums USING (r)
"""
