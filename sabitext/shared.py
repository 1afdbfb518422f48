"""Tables in the folder that all executors share: where lineage ends and sizes become known to the optimizer."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructType

SLICE_BYTES = 8 << 20
SPREAD_BYTES = 4 << 20
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one is made only where it is unset and Spark runs in one JVM."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sabitext-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing. released() deletes it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if spark.sparkContext.applicationId not in _WRITTEN:
        atexit.register(_at_exit, spark)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(at)
    return spark.read.schema(df.schema).parquet(at)


def mark(spark: SparkSession) -> int:
    """How many tables written() has made so far, for released()."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def released(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Deletes the tables that written() has made since a mark(), but for the last ones, when nothing that reads them is needed any more; how many."""
    made = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = made[since : len(made) - but]
    for at in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    made[since : len(made) - but] = []
    return len(gone)


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else Spark has ended before
        released(spark)


def dealt(df: DataFrame, size: int) -> DataFrame:
    """df, dealt out to so many tasks that each gets about `size` bytes of its files, and to all cores: for small rows that become many, where a file that is one task's would fill its memory."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-found // size)))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if its files are so small (SPREAD_BYTES for each core) that a few row groups, which can't be split, would leave most cores idle. Large inputs have enough of them and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def in_slices(rows: DataFrame, text_col: str, name: str, size: int = SLICE_BYTES) -> DataFrame:
    """rows with _slice, a number for each run of rows with about so many bytes of text; written, so that the numbers stay as they are.

    Models of any size are applied by slices: a slice's distinct pieces are joined
    to the model's tables, and its texts meet only the rows of the model they need.
    """
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if batch.num_rows:
                n = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = before + np.cumsum(n)
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part + (ends - n) // size)], [*batch.schema.names, "_slice"])

    return written(rows.mapInArrow(run, StructType([*rows.schema.fields]).add("_slice", LongType())), name)
