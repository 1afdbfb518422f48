"""Mixing sources to target weights, in blocks of a fixed number of tokens.

1. Every text is tokenised once; the ids (with an end-of-text id) are written
   as a table in the shared folder, so that later steps never tokenise again.
2. Packing. A source's stream is its documents in table order, so that which ones share a block
   follows from how the table is laid out and split. Running sums
   in the tasks and over the (task, source) sums give each document its place,
   and it is cut at block borders. The last block of a source is padded.
3. For each output shard, source counts are drawn from a multinomial with the
   target weights, seeded by the shard. Running sums turn them into slots.
4. Slot q of a source is block p_e(q mod n) of its n blocks, where e = q div n
   is the epoch and p_e a keyed Feistel permutation: each block comes once in every epoch.
5. Pieces of blocks are joined to slots by (source, block). This is the only
   step that moves token ids between executors.

Weights not given are proportional to (a source's tokens) ** TEMPERATURE.

Rules. NULL sources are one source, NULL in the result. NULL texts give no
tokens, empty ones an end-of-text only. NULL doc_ids stay as NULLs in
doc_ids. Repeated rows are packed each time. An empty table gives an empty
result. Sources with weight 0, and those not named in the weights, aren't drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import TOKENIZER, encoder, free_id, ids_of

BLOCK, SHARD_BLOCKS, TEMPERATURE, SEED = 2048, 256, 0.5, 42
BROADCAST_ROWS = 200_000
CHUNK = 16  # shards whose counts are summed together


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n) at the places i: four Feistel rounds, walking the cycle while outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = C.U64((1 << half) - 1)
    x = np.asarray(i, np.uint64).copy()
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> C.U64(half), x[todo] & mask
        for r in range(4):
            f = C.mix(right ^ C.mix(np.full(1, (key * 4 + r) & (2**64 - 1), np.uint64)))
            left, right = right, left ^ (f & mask)
        x[todo] = (left << C.U64(half)) | right
        todo = x >= C.U64(n)
    return x.astype(np.int64)


def key_of(*parts: object) -> int:
    """A 63-bit key of any values."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") >> 1


def tokenised(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(part, source, off, n, doc_id, ids): ids are little-endian uint32, uint16 if the vocabulary allows; off counts the tokens of the source before, in the task."""
    end = free_id(path)
    kind = np.uint16 if end < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), {}, encoder(path)
        for batch in batches:
            for a, b in C.slices(batch.column("text"), 4 * C.SLICE_BYTES):
                piece = batch.slice(a, b - a)
                ids = [np.array([*ids_of(enc, t), end], kind) for t in piece.column("text").to_pylist()]
                off = []
                for s, x in zip(piece.column("source").to_pylist(), ids):
                    off.append(seen.get(s, 0))
                    seen[s] = off[-1] + len(x)
                n = [len(x) for x in ids]
                yield pa.record_batch([pa.array([part] * len(n), pa.int32()), piece.column("source"), pa.array(off, pa.int64()), pa.array(n, pa.int32()), piece.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "source", "off", "n", "doc_id", "ids"])

    rows = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return C.written(rows.mapInArrow(run, "part int, source string, off bigint, n int, doc_id bigint, ids binary"), "tokens")


def shares(totals: dict[str | None, int], weights: dict[str | None, float] | None) -> dict[str | None, float]:
    """Normalised target weight of each source that has tokens."""
    raw = {s: float(n) ** TEMPERATURE if weights is None else float(weights.get(s, 0)) for s, n in totals.items()}
    if any(w < 0 for w in raw.values()):
        raise ValueError("weights can't be negative")
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items() if w > 0} if total else {}


def drawn(shard: int, p: np.ndarray, blocks: int, seed: int) -> np.ndarray:
    """Source counts of one shard."""
    return np.random.default_rng([seed, shard]).multinomial(blocks, p)


def slots(spark: SparkSession, blocks: dict[str | None, int], share: dict[str | None, float], shards: int, per_shard: int, seed: int) -> DataFrame:
    """(shard, position, source, block, epoch) of each slot."""
    names = sorted(share, key=lambda s: (s is not None, s or ""))
    p = np.array([share[s] for s in names])
    count = [blocks[s] for s in names]

    def counts(chunk: int) -> np.ndarray:
        """Source counts of the shards of a chunk; drawn again wherever they are needed."""
        return np.stack([drawn(s, p, per_shard, seed) for s in range(chunk * CHUNK, min((chunk + 1) * CHUNK, shards))])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            n = np.stack([counts(int(c)).sum(0) for c in ids]) if len(ids) else np.zeros((0, len(p)), np.int64)
            yield pa.record_batch([pa.array(np.repeat(ids, len(p))), pa.array(np.tile(np.arange(len(p)), len(ids))), pa.array(n.ravel())], ["chunk", "k", "count"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, begin in zip(batch.column("chunk").to_pylist(), batch.column("starts").to_pylist()):
                by_shard = counts(c)
                first = np.array([x["start"] for x in sorted(begin, key=lambda x: x["k"])])
                start = (first + by_shard.cumsum(0) - by_shard).ravel()
                base = (by_shard.cumsum(1) - by_shard).ravel()
                shard, k, n = np.repeat(c * CHUNK + np.arange(len(by_shard)), len(p)), np.tile(np.arange(len(p)), len(by_shard)), by_shard.ravel()
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shard_, k_, at, q = np.repeat(shard, n), np.repeat(k, n), np.repeat(base, n) + i, np.repeat(start, n) + i
                position, block, epoch = np.empty_like(at), np.empty_like(at), np.empty_like(at)
                for s in np.unique(shard_):
                    own = shard_ == s
                    position[own] = permuted(at[own], per_shard, key_of(seed, "shard", int(s)))
                for s in np.unique(k_):
                    own = k_ == s
                    epoch[own] = q[own] // count[s]
                    for e in np.unique(epoch[own]):
                        here = own & (epoch == e)
                        block[here] = permuted(q[here] % count[s], count[s], key_of(seed, names[s], int(e)))
                yield pa.record_batch([pa.array(shard_), pa.array(position), pa.array([names[s] for s in k_], pa.string()), pa.array(block), pa.array(epoch)], ["shard", "position", "source", "block", "epoch"])

    # running sums over the chunks of shards, then, in each chunk's task, over its shards
    chunks = -(-shards // CHUNK)
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = spark.range(chunks).mapInArrow(totals, "chunk bigint, k bigint, count bigint")
    starts = sums.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).groupBy("chunk").agg(F.collect_list(F.struct("k", "start")).alias("starts"))
    tasks = min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return starts.repartition(tasks, "chunk").mapInArrow(expand, "shard bigint, position bigint, source string, block bigint, epoch bigint")


def _assembler(kind: type, length: int, pad: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.Runs("slot", 2000).of(batches):
            slot = table.column("slot").to_numpy()
            starts = C.row_starts(slot)
            ends = np.r_[starts[1:], len(slot)]
            body, at = C.flat(table.column("piece"))
            tokens, real = np.full((len(starts), length), pad, np.int32), []
            for r, (i, j) in enumerate(zip(starts, ends)):
                x = body[at[i] : at[j]].view(kind)
                tokens[r, : len(x)] = x
                real.append(len(x))
            first = table.take(pa.array(starts))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(slot)].astype(np.int32)), table.column("doc_id").combine_chunks())
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * np.int32(length)), pa.array(tokens.ravel()))
            yield pa.record_batch([*(first.column(c).combine_chunks() for c in ("shard", "position", "source", "block", "epoch")), pa.array(real, pa.int32()), lists, whole], ["shard", "position", "source", "block", "epoch", "n_tokens", "doc_ids", "tokens"])

    return run


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, path: str = TOKENIZER, length: int = BLOCK, per_shard: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(shard, position, source, block, epoch, n_tokens, doc_ids, tokens): blocks of all shards, as many in all as the sources have, rounded up to whole shards. doc_ids name the documents in a block, in order."""
    spark = docs.sparkSession
    table = tokenised(docs, path)
    sums = C.written(table.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    blocks = {s: -(-n // length) for s, n in totals.items()}
    share = shares(totals, weights)
    shards = -(-sum(blocks[s] for s in share) // per_shard) if share else 0
    kind = np.uint16 if free_id(path) < 1 << 16 else np.uint32
    schema = "shard bigint, position bigint, source string, block bigint, epoch bigint, n_tokens int, doc_ids array<bigint>, tokens array<int>"
    if not shards:
        return spark.createDataFrame([], schema)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("of"), F.col("part").alias("in_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if sums.count() <= BROADCAST_ROWS else starts
    placed = table.join(starts, table["source"].eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    placed = placed.select("source", "doc_id", "ids", "n", (F.col("start") + F.col("off")).alias("at"))
    size, width = F.lit(length), np.dtype(kind).itemsize
    cut = placed.select("source", "doc_id", "ids", "n", "at", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))).alias("block"))
    pieces = cut.select("source", "block", "doc_id", F.greatest("at", F.col("block") * length).alias("at"), F.expr(f"substring(ids, cast(greatest(0, block * {length} - at) * {width} + 1 as int), cast(least(at + n, (block + 1) * {length}) - greatest(at, block * {length}) as int) * {width})").alias("piece"))
    slot = slots(spark, blocks, share, shards, per_shard, seed)
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    # a block's pieces must meet in one task; the slots, which grow with the input, are never broadcast
    left = pieces.withColumn("name", name).repartition("name", "block")
    right = slot.select("shard", "position", "epoch", name.alias("name"), "block")
    both = left.join(right.hint("merge"), ["name", "block"]).withColumn("slot", F.col("shard") * per_shard + F.col("position"))
    ordered = both.sortWithinPartitions("name", "block", "slot", "at").select("slot", "shard", "position", "source", "block", "epoch", "doc_id", "piece")
    return ordered.mapInArrow(_assembler(kind, length, free_id(path)), schema)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
