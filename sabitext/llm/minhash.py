"""Near duplicates: MinHash signatures of b bits a place, found by a multi-index Hamming join.

A signature has PLACES minima, each reduced to 16 bits. Two documents are near
duplicates if at most ERRORS places differ. The places are cut into CHUNKS
chunks; by the pigeonhole principle a pair within ERRORS has a chunk with at
most ERRORS // CHUNKS = 1 wrong place, so one key is made for each way to leave
one place of a chunk out (which also covers no wrong place), and every such
pair shares a key. Keys are exact (48 bits of signature, 6 of position), so a
bucket holds no other rows, and no bucket is cut or skipped.

Equal signatures are collapsed first. In a bucket, pairs are compared until its
connected components are known: each pivot is compared with all, and members
that are already joined to the first pivot need no pivot of their own. This
leaves the components the same as with all pairs, in space linear in the rows.

Rules. NULL text or id, and texts without a word, match nothing. Texts of one or
two words have one shingle. Rows that repeat a doc_id are one document. Of a
group the smallest doc_id stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

PLACES, CHUNKS, ERRORS, SHINGLE = 64, 16, 31, 3
BROADCAST_ROWS = 2_000_000
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 2**32, PLACES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, PLACES, dtype=np.uint32)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash and row of each run of three words."""
    h, row = C.words(texts)
    if not len(h):
        return np.zeros(0, np.uint32), row
    count = np.bincount(row, minlength=len(texts))
    s = h.copy()
    for k in range(1, SHINGLE):
        same = np.zeros(len(h), bool)
        same[:-k] = row[k:] == row[:-k]
        s[:-k] = np.where(same[:-k], s[:-k] * C.U64(0x9E3779B97F4A7C15) + h[k:], s[:-k])
    first = np.zeros(len(h), bool)
    first[C.row_starts(row)] = True
    whole = np.zeros(len(h), bool)
    whole[: len(h) - SHINGLE + 1] = row[SHINGLE - 1 :] == row[: len(h) - SHINGLE + 1]
    use = whole | (first & (count[row] < SHINGLE))
    return (C.mix(s[use]) >> C.U64(32)).astype(np.uint32), row[use]


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and their signatures (n x PLACES of uint16)."""
    s, row = shingles(texts)
    starts = C.row_starts(row)
    out = np.empty((len(starts), PLACES), np.uint16)
    if len(starts):
        for j in range(PLACES):
            least = np.minimum.reduceat(s * _MULTIPLY[j] + _ADD[j], starts)
            out[:, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return row[starts], out


def _binary(rows: np.ndarray) -> pa.Array:
    """Equal-length byte rows as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows.tobytes())])


def _unbinary(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    body, _ = C.flat(col)
    return body.view(np.uint16).reshape(-1, PLACES)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in C.slices(batch.column(1)):
            row, sig = signatures(batch.column(1).slice(a, b - a))
            if len(row):
                yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(row)), _binary(sig)], ["id", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = PLACES // CHUNKS
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            sig = _unbinary(part.column(1)).astype(np.int64).reshape(-1, CHUNKS, width)
            keys = np.empty((len(sig), CHUNKS, width), np.int64)
            for out in range(width):
                rest = [p for p in range(width) if p != out]
                keys[:, :, out] = (sig[:, :, rest[0]] << 32) | (sig[:, :, rest[1]] << 16) | sig[:, :, rest[2]]
            keys |= np.arange(CHUNKS * width, dtype=np.int64).reshape(1, CHUNKS, width) << 48
            ids = np.repeat(part.column(0).to_numpy(), CHUNKS * width)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each key that has more than one. Equal sets of members get equal names, so that they merge."""
    for table in C.Runs("key").of(batches):
        key, ids = (table.column(n).to_numpy() for n in ("key", "id"))
        starts = C.row_starts(key)
        size = np.diff(np.r_[starts, len(key)])
        of = np.repeat(np.arange(len(starts)), size)
        many = size[of] > 1
        if not many.any():
            continue
        h = C.mix(ids.astype(np.uint64))
        name = C.mix(np.add.reduceat(h, starts) ^ C.mix(np.bitwise_xor.reduceat(h * C.U64(3), starts)) ^ size.astype(np.uint64))
        yield pa.record_batch([pa.array(name.view(np.int64)[of[many]]), pa.array(ids[many])], ["bucket", "id"])


def joined(sig: np.ndarray, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same connected components as all pairs of one bucket within ERRORS."""
    n = len(sig)
    if n <= small:
        i, j = np.triu_indices(n, 1)
        near = np.count_nonzero(sig[i] != sig[j], axis=1) <= ERRORS
        return i[near], j[near]
    left, right, done = [], [], np.zeros(n, bool)
    for pivot in range(n):
        if done[pivot]:
            continue
        near = np.count_nonzero(sig != sig[pivot], axis=1) <= ERRORS
        if pivot == 0:
            done = near.copy()  # members of the first pivot's star are joined through it
        done[pivot] = True
        near[pivot] = False
        to = np.flatnonzero(near)
        left.append(np.full(len(to), pivot))
        right.append(to)
    return np.concatenate(left), np.concatenate(right)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in C.Runs("bucket", 50_000).of(batches):
        bucket, ids, sig = table.column("bucket").to_numpy(), table.column("id").to_numpy(), _unbinary(table.column("sig"))
        starts = C.row_starts(bucket)
        size = np.diff(np.r_[starts, len(bucket)])
        left, right = [], []
        pairs = starts[size == 2]
        near = np.count_nonzero(sig[pairs] != sig[pairs + 1], axis=1) <= ERRORS
        left.append(pairs[near])
        right.append(pairs[near] + 1)
        for s, n in zip(starts[size > 2], size[size > 2]):
            i, j = joined(sig[s : s + n])
            left.append(i + s)
            right.append(j + s)
        a, b = ids[np.concatenate(left)], ids[np.concatenate(right)]
        if len(a):
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig) of every document that has words, written once."""
    have = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null and text is not null")
    return C.written(have.mapInArrow(_sign, "id bigint, sig binary"), "signatures")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id) for every document that has a near duplicate with a smaller id in its group; kept_doc_id is the group's smallest."""
    sigs = signed(docs, id_col, text_col)
    reps = C.written(sigs.groupBy("sig").agg(F.min("id").alias("id")).select("id", "sig"), "representatives")
    keys = reps.mapInArrow(_keys, "key bigint, id bigint").repartition("key").sortWithinPartitions("key")
    buckets = keys.mapInArrow(_buckets, "bucket bigint, id bigint").distinct()
    edges = buckets.join(reps, "id").select("bucket", "id", "sig").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify, "a bigint, b bigint").distinct()
    root = components(edges)
    by_sig = reps.join(root, "id", "left").select("sig", F.coalesce("root", "id").alias("kept_doc_id"))
    return sigs.join(by_sig, "sig").where("id <> kept_doc_id").select(F.col("id").alias("doc_id"), "kept_doc_id").distinct()


def without(docs: DataFrame, ids: DataFrame, on: Column) -> DataFrame:
    """docs without those whose condition matches ids; ids are broadcast only if counted to be few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, "left_anti")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates. One row stays of rows that repeat a doc_id; NULL ids and texts stay."""
    gone = C.written(near_duplicates(docs).select(F.col("doc_id").alias("gone_id")), "gone")
    kept = without(docs, gone, docs["doc_id"] == gone["gone_id"])
    again = C.written(docs.where(docs["doc_id"].isNotNull()).groupBy(docs["doc_id"].alias("again_id")).count().where("count > 1").select("again_id"), "again")
    if not again.take(1):
        return kept
    twice = kept.join(again, kept["doc_id"] == again["again_id"], "left_semi").dropDuplicates(["doc_id"])
    return without(kept, again, kept["doc_id"] == again["again_id"]).unionByName(twice)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
