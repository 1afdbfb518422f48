"""A Parquet cache of datasets: <root>/cache/<dataset>[_<lang>]_<split>."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ENV = "SABITEXT_HOME"


def get_cache_dir() -> str:
    """The folder in the environment, else one in the home folder. On a cluster it has to be shared."""
    return os.environ.get(ENV) or os.path.expanduser("~/.sabitext")


def path_of(root: str, name: str, lang: str | None, split: str) -> str:
    return f"{root}/cache/{name}{f'_{lang}' if lang else ''}_{split}"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_cached(spark: SparkSession, root: str, name: str, lang: str | None, split: str) -> bool:
    """Whether a write there has ended."""
    fs, at = _fs(spark, path_of(root, name, lang, split) + "/_SUCCESS")
    return fs.exists(at)


def save_to_cache(rows: DataFrame, root: str, name: str, lang: str | None, split: str) -> str:
    """D13."""
    path = path_of(root, name, lang, split)
    rows.write.mode("overwrite").parquet(path)
    return path


def export_json(rows: DataFrame, path: str) -> None:
    """The rows as JSON lines, characters as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_from_cache(spark: SparkSession, root: str, name: str, lang: str | None, split: str) -> DataFrame:
    """D14."""
    if not is_cached(spark, root, name, lang, split):
        raise FileNotFoundError(path_of(root, name, lang, split))
    return spark.read.parquet(path_of(root, name, lang, split))


def clear_cache(spark: SparkSession, root: str, name: str | None = None) -> int:
    """Of one dataset, or all; how many entries went. Models are kept elsewhere and stay."""
    fs, at = _fs(spark, f"{root}/cache")
    if not fs.exists(at):
        return 0
    gone = [s.getPath() for s in fs.listStatus(at) if name is None or s.getPath().getName().startswith(f"{name}_")]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def model_path(root: str, filename: str) -> str:
    """Where a model is kept; models are never fetched from a network."""
    return f"{root}/models/{filename}"
