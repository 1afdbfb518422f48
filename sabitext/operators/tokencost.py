"""Token-cost analytics: token counts by language and tokenizer, ratios to English, cost estimates, worst cases."""

from __future__ import annotations

import argparse
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokenizer import DEFAULT_PATH, Tokenizer

LANGUAGES = {"eng": "English", "yor": "Yorùbá", "hau": "Hausa", "ibo": "Igbo", "pcm": "Nigerian Pidgin"}
USD_PER_MILLION, NGN_PER_USD = 2.50, 1350.0


def load_entries(spark: SparkSession, path: str, quick: bool = False) -> DataFrame:
    """Entries of a JSON file, or the ten with the smallest ids."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    return rows.orderBy("id").limit(10) if quick else rows


def get_tokenizers(paths: dict[str, str]) -> dict[str, Callable[[Column], Column]]:
    """B1: what cuts a text into tokens, by name, for each vocabulary file (JSON of the tokenizers library) that can be read; the others are skipped with a warning."""
    out = {}
    for name, path in paths.items():
        try:
            tokenizer = Tokenizer("naija", {"naija": path})
            assert tokenizer.vocab_size
        except Exception as e:  # the library's own kind of error
            warnings.warn(f"{name}: {e}", stacklevel=2)
            continue
        out[name] = tokenizer.tokens
    return out


def run_benchmark(entries: DataFrame, tokenizers: dict[str, Callable[[Column], Column]], languages: dict[str, str] | None = None, baseline: str = "eng") -> DataFrame:
    """B1, B2: a row for each entry, language and tokenizer. A tokenizer turns a text into an array of tokens. Ratios to the baseline are rounded to 3 places, infinite where it has no tokens."""
    languages = languages or LANGUAGES
    long = entries.select("id", "category", F.col(baseline).alias("english_equivalent"), *languages).unpivot(["id", "category", "english_equivalent"], list(languages), "language", "text")
    split = long.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), f(F.col("text")).alias("token_splits"), F.size(f(F.col("english_equivalent"))).alias("english_tokens")) for t, f in tokenizers.items()])).alias("t"))
    n = F.size("t.token_splits")
    names = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    ratio = F.when(F.col("t.english_tokens") > 0, F.round(n / F.col("t.english_tokens"), 3)).otherwise(F.lit(float("inf")))
    return split.select(F.col("id").alias("entry_id"), "category", "language", names[F.col("language")].alias("language_name"), "text", "t.tokenizer", n.alias("n_tokens"), "t.token_splits", "english_equivalent", "t.english_tokens", ratio.alias("token_ratio_vs_english"))


def aggregate_stats(results: DataFrame, baseline: str = "eng") -> DataFrame:
    """By language and tokenizer. The worst text is that with the highest ratio, the first by entry_id among equals."""
    worst = F.max_by(F.struct("text", "n_tokens", "token_ratio_vs_english"), F.struct("token_ratio_vs_english", (-F.col("entry_id")).alias("first")))
    groups = results.groupBy("language", "tokenizer").agg(F.avg("n_tokens").alias("mean"), F.avg("token_ratio_vs_english").alias("ratio"), worst.alias("worst"))
    base = groups.where(F.col("language") == baseline).select(F.col("tokenizer").alias("base_tokenizer"), F.col("mean").alias("base_mean"))
    met = groups.join(base, F.col("tokenizer") == F.col("base_tokenizer"), "left")
    multiplier = F.when(F.col("base_mean").isNull(), F.col("ratio")).when(F.col("base_mean") > 0, F.col("mean") / F.col("base_mean")).otherwise(1.0)
    return met.select("language", "tokenizer", F.round("mean", 2).alias("mean_tokens_per_entry"), F.round("ratio", 3).alias("mean_token_ratio_vs_english"), F.round(multiplier, 3).alias("cost_multiplier_vs_english"), F.round(multiplier * USD_PER_MILLION * NGN_PER_USD, 0).alias("estimated_naira_per_1m_equiv"), F.col("worst.text").alias("worst_word"), F.col("worst.n_tokens").alias("worst_word_tokens"), F.col("worst.token_ratio_vs_english").alias("worst_word_ratio"))


def top_worst(results: DataFrame, top_n: int = 10, baseline: str = "eng") -> DataFrame:
    """The highest ratios outside the baseline, each text once for a tokenizer."""
    order = [F.col("token_ratio_vs_english").desc(), "entry_id", "language"]
    first = results.where(F.col("language") != baseline).withColumn("_n", F.row_number().over(Window.partitionBy("text", "tokenizer").orderBy(*order))).where("_n = 1").drop("_n")
    return first.orderBy(*order, "tokenizer").limit(top_n)


def most_expensive(stats: DataFrame, baseline: str = "eng") -> DataFrame:
    """The language with the highest mean multiplier."""
    return stats.where(F.col("language") != baseline).groupBy("language").agg(F.avg("cost_multiplier_vs_english").alias("mean_multiplier")).orderBy(F.col("mean_multiplier").desc(), "language").limit(1)


def save_results(results: DataFrame, stats: DataFrame, path: str) -> None:
    """Results as JSON, the summary as CSV."""
    results.write.mode("overwrite").json(f"{path}/results")
    stats.write.mode("overwrite").csv(f"{path}/summary", header=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Spark-submit sabitext/operators/tokencost.py --data FILE --output FOLDER [--quick] [--tokenizer NAME=PATH]...; the statistics, which are also saved."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--quick", action="store_true", help="the ten entries with the smallest ids")
    parser.add_argument("--tokenizer", action="append", default=[], help="NAME=PATH of a vocabulary")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    paths = dict(x.split("=", 1) for x in args.tokenizer) or {"byte_bpe": DEFAULT_PATH}
    entries = load_entries(spark, args.data, args.quick)
    results = run_benchmark(entries, get_tokenizers(paths), {k: v for k, v in LANGUAGES.items() if k in entries.columns})
    stats = aggregate_stats(results)
    save_results(results, stats, args.output)
    stats.show(truncate=False)
    return stats


if __name__ == "__main__":
    main()
