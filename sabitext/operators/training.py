"""Training sets and the models made of them: unions of sources, row filters, caps; saved models found again, or trained from the seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chars import BLANKS, WS
from ..sources.cache import model_path
from ..sources.seeds import seed_texts
from . import knn, metrics, naive_bayes, sentiment, words

MOST_PER_LANGUAGE, HEADLINE_CHARS, SENTENCE_CHARS, PIDGIN_MARKS = 5000, 20, (30, 300), 2


def stripped(text: Column) -> Column:
    """str.strip(). No regular expression, which would try its end at each blank of the text."""
    return F.btrim(text, F.lit(BLANKS))


def headlines(rows: DataFrame, text_col: str) -> DataFrame:
    """Headlines long enough to tell a language."""
    return rows.where(F.length(stripped(F.col(text_col))) > HEADLINE_CHARS)


def sentences(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with one sentence each in text_col, split behind . ! ? and white space, of a length between the limits."""
    each = rows.withColumn(text_col, F.explode(F.split(F.col(text_col), rf"(?<=[.!?])[{WS}]+")))
    n = F.length(stripped(F.col(text_col)))
    return each.where((n > SENTENCE_CHARS[0]) & (n < SENTENCE_CHARS[1]))


def pidgin(rows: DataFrame, text_col: str) -> DataFrame:
    """Texts with PIDGIN_MARKS Pidgin words or phrases at least."""
    return rows.where(_is_pidgin(text_col))


def _is_pidgin(text_col: str) -> Column:
    marks = F.aggregate(F.filter(naive_bayes.script_features(F.col(text_col)), lambda x: x.f.startswith("__FEAT_PCM")), F.lit(0), lambda s, x: s + x.w)
    return marks >= 5 * PIDGIN_MARKS


def order_of(id_: Column, seed: int = 42) -> Column:
    """A text to order rows by as if at random, the same in any engine."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")))


def distinct_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of texts that are equal but for white space at their ends the first by id_col, those that are NULL or blank not at all."""
    keyed = rows.where(F.coalesce(stripped(F.col(text_col)), F.lit("")) != "").withColumn("_key", F.md5(stripped(F.col(text_col))))
    first = keyed.groupBy("_key").agg(F.min(id_col).alias("_first"))
    return keyed.join(first.withColumnRenamed("_key", "_key2"), (F.col("_key") == F.col("_key2")) & (F.col(id_col) == F.col("_first"))).drop("_key", "_key2", "_first")


def capped(rows: DataFrame, id_col: str, group_col: str, most: int = MOST_PER_LANGUAGE, seed: int = 42) -> DataFrame:
    """At most so many rows of each group, those first by order_of(). Counts of its first four digits tell how far a group's rows can matter, so that no task has to order a whole large group."""
    order = order_of(F.col(id_col), seed)
    rows = rows.withColumns({"_order": order, "_bin": F.conv(F.substring(order, 1, 4), 16, 10).cast("int")})
    bins = rows.groupBy(F.col(group_col).alias("_group"), F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy("_b"))  # at most 65,536 rows of a group
    last = bins.withColumn("_upto", upto - F.col("_n")).where(F.col("_upto") < most).groupBy("_group").agg(F.max("_b").alias("_last"))
    few = rows.join(last, F.col(group_col).eqNullSafe(F.col("_group")) & (F.col("_bin") <= F.col("_last")))
    place = F.row_number().over(Window.partitionBy(group_col).orderBy("_order", id_col))
    return few.withColumn("_place", place).where(F.col("_place") <= most).drop("_order", "_bin", "_group", "_last", "_place")


def language_texts(sources: list[DataFrame], most: int = MOST_PER_LANGUAGE) -> DataFrame:
    """(ord, lang, text) of all sources, distinct and capped by language. pcm texts need Pidgin marks."""
    rows = sources[0].select("ord", "lang", "text")
    for s in sources[1:]:
        rows = rows.unionByName(s.select("ord", "lang", "text"))
    rows = rows.where((F.col("lang") != "pcm") | ((F.col("lang") == "pcm") & _is_pidgin("text")))
    return capped(distinct_texts(rows, "ord", "text"), "ord", "lang", most)


# --- models


def train_and_save_language_model(spark: SparkSession, path: str, texts: DataFrame | None = None) -> naive_bayes.NaiveBayes:
    """Of (lang, text) rows, or the seed."""
    model = naive_bayes.fit(seed_texts(spark) if texts is None else texts, "text", "lang", list(naive_bayes.LANGUAGES))
    model.save(path)
    return naive_bayes.NaiveBayes.load(spark, path)


def train_and_save_syllable_model(spark: SparkSession, path: str, lang: str = "yor", texts: DataFrame | None = None, tones_only: bool = False) -> knn.SyllableModel:
    """Of (ord, text, weight) rows, or the seed; Igbo with lang='ibo', the dot-below model with tones_only."""
    rows = seed_texts(spark).where(F.col("lang") == lang) if texts is None else texts
    knn.fit(rows, "ord", "text", lang, "weight" if "weight" in rows.columns else None, tones_only).save(path)
    return knn.SyllableModel.load(spark, path)


def train_and_save_word_model(spark: SparkSession, path: str, texts: DataFrame | None = None, fallback: knn.SyllableModel | None = None) -> words.WordModel:
    """Of (ord, text) rows, or the seed."""
    words.fit(seed_texts(spark).where("lang = 'yor'") if texts is None else texts, "ord", "text").save(path)
    return words.WordModel.load(spark, path, fallback)


def resolved(spark: SparkSession, root: str, name: str):  # noqa: ANN201
    """The model of this name under root: as saved there, else trained from the seed and saved. Sentiment has no seed: without a saved model it is an error, as there is nothing to train it on."""
    path = model_path(root, name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    saved = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if name == "sentiment":
        if not saved:
            raise RuntimeError(f"no sentiment model in {path}")
        return sentiment.SentimentModel.load(spark, path)
    kinds: dict[str, tuple[Callable, Callable]] = {
        "language": (lambda: naive_bayes.NaiveBayes.load(spark, path), lambda: train_and_save_language_model(spark, path)),
        "yoruba_syllables": (lambda: knn.SyllableModel.load(spark, path), lambda: train_and_save_syllable_model(spark, path)),
        "yoruba_dots": (lambda: knn.SyllableModel.load(spark, path), lambda: train_and_save_syllable_model(spark, path, tones_only=True)),
        "igbo_syllables": (lambda: knn.SyllableModel.load(spark, path), lambda: train_and_save_syllable_model(spark, path, "ibo")),
        "yoruba_words": (lambda: words.WordModel.load(spark, path, resolved(spark, root, "yoruba_syllables")), lambda: train_and_save_word_model(spark, path, None, resolved(spark, root, "yoruba_syllables"))),
    }
    if name not in kinds:
        raise ValueError(f"no model {name!r}; there are: {', '.join([*kinds, 'sentiment'])}")
    load, train = kinds[name]
    return load() if saved else train()


def detect_language(spark: SparkSession, root: str, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """L11 to L13 with the resolved model."""
    return resolved(spark, root, "language").detect(docs, id_col, text_col)


def run_all_evaluations(tests: dict[str, tuple[DataFrame, Callable[[DataFrame, str, str], DataFrame]]], path: str | None = None, test_size: int = 500, version: str = "1", date: str = "") -> DataFrame:
    """V5: evaluate()'s row for each language: tests give (ord, text) rows and what restores them as (id, restored). test_size texts are drawn by hash; with path the rows are appended there as JSON."""
    out = None
    for language, (docs, restore) in tests.items():
        pairs = metrics.stripped_pairs(metrics.sampled(docs.where("text is not null"), "ord", test_size), "text").select("ord", "input", "expected")
        found = restore(pairs, "ord", "input").select(F.col("ord").alias("_ord"), F.col("restored").alias("predicted"))
        row = metrics.evaluate(pairs.join(found, F.col("ord") == F.col("_ord")), language)
        out = row if out is None else out.unionByName(row)
    out = out.withColumns({"model_version": F.lit(version), "date": F.lit(date)})
    if path:
        out.write.mode("append").json(path)
    return out


def char_vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """(char, id): four reserved ids, then the characters of all texts in their order."""
    chars = naive_bayes.gram_counts(docs, text_col, nfc=False, sizes=1, raw=True).select(F.col("gram").alias("char"))
    numbered = chars.select("char", (F.row_number().over(Window.orderBy("char")) + 3).alias("id"))  # distinct characters: under 1.2 million rows
    return docs.sparkSession.createDataFrame([("<PAD>", 0), ("<UNK>", 1), ("<SOS>", 2), ("<EOS>", 3)], "char string, id int").union(numbered)
