"""Readers for the file formats of the datasets, from local or shared folders, and load_dataset() over them.

Files are <root>/<dataset>/<lang>/<split>.<ending>. Every reader gives lang and
split as columns; without them it has the columns the format itself has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import WS
from . import cache, registry

#: Splits whose files have another name.
FILE_SPLITS = {"validation": "dev"}


def stripped(c: Column) -> Column:
    """str.strip()."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def read_tsv(spark: SparkSession, path: str | list[str], columns: dict[str, str], required: tuple[str, ...]) -> DataFrame:
    """Tab-separated files with a header: columns renamed and stripped; rows in which a required one is empty or missing are dropped."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    rows = raw.select(*[stripped(F.col(f"`{a}`")).alias(b) if a in raw.columns else F.lit(None).cast("string").alias(b) for a, b in columns.items()])
    for c in required:
        rows = rows.where(F.coalesce(F.col(c), F.lit("")) != "")
    return rows


def read_sentiment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """D3: (text, label)."""
    return read_tsv(spark, path, {"tweet": "text", "label": "label"}, ("text", "label"))


def read_news(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text, label, headline, url)."""
    return read_tsv(spark, path, {"text": "text", "category": "label", "headline": "headline", "url": "url"}, ("text", "label"))


def read_conll(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(tokens, ner_tags) of each sentence. Blank lines end sentences, lines of one piece are dropped, the last sentence needs no blank line."""
    lines = F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: stripped(x))
    empty = F.struct(F.expr("cast(array() as array<array<struct<t: string, g: string>>>)").alias("done"), F.expr("cast(array() as array<struct<t: string, g: string>>)").alias("now"))

    def step(a: Column, line: Column) -> Column:
        parts = F.split(line, " ")
        ended = F.struct(F.when(F.size(a.now) > 0, F.array_append(a.done, a.now)).otherwise(a.done).alias("done"), F.expr("cast(array() as array<struct<t: string, g: string>>)").alias("now"))
        more = F.struct(a.done.alias("done"), F.array_append(a.now, F.struct(parts[0].alias("t"), F.get(parts, 1).alias("g"))).alias("now"))
        return F.when(line == "", ended).when(F.size(parts) >= 2, more).otherwise(a)

    files = spark.read.text(path, wholetext=True).select(F.aggregate(F.concat(lines, F.array(F.lit(""))), empty, step, lambda a: a.done).alias("s"))
    each = files.select(F.explode("s").alias("s"))
    return each.select(F.transform("s", lambda x: x.t).alias("tokens"), F.transform("s", lambda x: x.g).alias("ner_tags"))


def read_parallel(spark: SparkSession, path: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Two sides of parallel text; rows with an empty side are dropped."""
    return read_tsv(spark, path, columns, tuple(columns.values()))


#: D2. Dataset: (reader, ending). Others are listed but have no reader.
READERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {"naijasenti": (read_sentiment, "tsv"), "masakhaner": (read_conll, "txt"), "masakhanews": (read_news, "tsv")}


def load_dataset(spark: SparkSession, name: str, lang: str | None = None, split: str = "train", root: str | None = None, keep_lang: bool = False) -> DataFrame:
    """D1. Split, then language are checked. lang=None takes all languages in their declared order. With a cache, what is there is read, else read from files and put there."""
    registry.validate_split(name, split)
    registry.validate_lang(name, lang)
    if name not in READERS:
        raise ValueError(f"{name} has no reader; there are readers for: {', '.join(sorted(READERS))}")
    root = root or cache.get_cache_dir()
    if cache.is_cached(spark, root, name, lang, split):
        rows = cache.load_from_cache(spark, root, name, lang, split)
    else:
        reader, ending = READERS[name]
        parts = [reader(spark, f"{root}/{name}/{x}/{FILE_SPLITS.get(split, split)}.{ending}").withColumn("lang", F.lit(x)) for x in ([lang] if lang else registry.dataset_info(name)["languages"])]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        cache.save_to_cache(rows, root, name, lang, split)
        rows = cache.load_from_cache(spark, root, name, lang, split)
    return rows if keep_lang else rows.drop("lang")
