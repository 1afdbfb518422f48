"""Sentiment: TF-IDF of word n-grams and softmax regression.

Texts are cut in the worker. A slice's distinct terms are joined to the vocabulary,
whatever its size, and meet the slice's texts there; texts are never regrouped
by id, so ids may repeat or be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import ragged
from ..functions.chars import WORD
from ..functions.normalize import normalize_unicode
from ..functions.text import let
from ..shared import in_slices, written

LABELS = ("positive", "neutral", "negative")
BLANK = (0.33, 0.34, 0.33)
MOST_TERMS, LEAST_DF, MOST_DF, SIZES = 50_000, 3, 0.95, 2


def word_ngrams(low: Column, sizes: int = SIZES, least_chars: int = 1) -> Column:
    """All words, then all pairs, and so on, of a text in lower case. Combining marks end a word."""

    def all_sizes(words: Column) -> Column:
        def of_size(n: int) -> Column:
            joined = F.transform(words, lambda w, i: F.concat(w, *[F.concat(F.lit(" "), F.get(words, i + k)) for k in range(1, n)]))
            return F.filter(joined, lambda g: g.isNotNull())

        return F.concat(words, *map(of_size, range(2, sizes + 1)))

    return let(F.regexp_extract_all(low, F.lit(f"[{WORD}]{{{least_chars},}}" if least_chars > 1 else f"[{WORD}]+"), 0), all_sizes)


def _terms(texts: list[str | None], least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """E1 of each text, distinct: its text, its number, its count; and the distinct terms."""
    whole, codes, at = ragged.joined(texts)
    begin, end = ragged.runs(ragged.in_classes("LN", "_")[codes] if len(codes) else np.zeros(0, bool), at)
    long = end - begin >= least_chars
    begin, end = begin[long], end[long]
    row = ragged.row_of(at, begin)
    word, names = ragged.coded(ragged.cut(whole, codes, begin, end))
    rows, numbers, terms = [row], [word], list(names)
    for n in range(2, SIZES + 1):
        m = max(len(word) - n + 1, 0)
        inside = np.flatnonzero(row[:m] == row[n - 1 :])
        key = numbers[0][inside]
        for k in range(1, n):
            key = ragged.ranked(key << 31 | word[inside + k])[0]
        number, first = ragged.ranked(key)
        rows.append(row[inside])
        numbers.append(number + len(terms))
        terms += [" ".join(names[word[i + k]] for k in range(n)) for i in inside[first].tolist()]
    row, number = np.concatenate(rows), np.concatenate(numbers)
    first, times, _ = ragged.tallied(row << 31 | number)
    return row[first], number[first], times, terms


def _distinct_terms(texts: pa.Array, least_chars: int) -> pa.Array:
    """Of a slice's texts, which are cut some at a time."""
    parts = [pa.array(_terms(texts.slice(a, b - a).to_pylist(), least_chars)[3], pa.string()) for a, b in ragged.batches_of(texts)]
    return pc.unique(pa.chunked_array(parts, pa.string()))


def _asked(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_slice").to_numpy()
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else [0]
            for a, b in zip(cuts, cuts[1:]):
                terms = _distinct_terms(batch.column("_low").slice(a, b - a), least_chars)
                yield pa.record_batch([pa.array(np.full(len(terms), number[a])), terms], ["_slice", "term"])

    return run


def _weighed(texts: pa.Table, vocab: pa.Table, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """E2 of a slice: row, row of vocab and weight of each term that vocab knows: (1 + ln tf) * idf, each text's weights of length 1."""
    terms, idf = vocab.column("term").combine_chunks(), vocab.column("idf").to_numpy()
    rows, ats, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in ragged.batches_of(texts.column("_low")):
        row, at, weight = _weighed_piece(texts.column("_low").slice(a, b - a).to_pylist(), terms, idf, least_chars)
        rows.append(row + a)
        ats.append(at)
        weights.append(weight)
    return np.concatenate(rows), np.concatenate(ats), np.concatenate(weights)


def _weighed_piece(texts: list[str | None], vocab: pa.Array, idf: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, number, times, terms = _terms(texts, least_chars)
    known = pc.index_in(pa.array(terms, pa.string()), vocab).fill_null(-1).to_numpy() if terms else np.zeros(0, np.int64)
    at = known[number] if len(number) else number
    row, at, times = row[at >= 0], at[at >= 0].astype(np.int64), times[at >= 0]
    weight = (1 + np.log(times)) * idf[at] if len(at) else np.zeros(0)
    norm = np.sqrt(np.bincount(row, weight * weight, len(texts)))
    return row, at, weight / norm[row]


def _in_slices(docs: DataFrame, text_col: str, nfc: bool, *columns: Column) -> DataFrame:
    low = F.lower(docs[text_col])
    return in_slices(docs.select(*columns, (normalize_unicode(low) if nfc else low).alias("_low")), "_low", "sentiment-slices")


def tfidf(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, nfc: bool = True, least_chars: int = 1) -> DataFrame:
    """(id, term, weight) of every row and term of vocab(term, idf, ...) that it has."""
    texts = _in_slices(docs, text_col, nfc, docs[id_col].alias("_id"))

    def weigh(texts: pa.Table, vocab: pa.Table) -> pa.Table:
        row, at, weight = _weighed(texts, vocab, least_chars)
        return pa.table([texts.column("_id").take(pa.array(row)), vocab.column("term").take(pa.array(at)), pa.array(weight)], ["_id", "term", "weight"])

    met = texts.mapInArrow(_asked(least_chars), "_slice bigint, term string").join(vocab.select("term", "idf"), "term")
    schema = texts.select("_id").schema.add("term", StringType()).add("weight", DoubleType())
    return texts.groupBy("_slice").cogroup(met.groupBy("_slice")).applyInArrow(weigh, schema).withColumnRenamed("_id", id_col)


@dataclass
class SentimentModel:
    """vocab(term, idf, w0, w1, w2) and an intercept for each label."""

    vocab: DataFrame
    intercepts: tuple[float, ...]
    labels: tuple[str, ...] = LABELS
    nfc: bool = True

    def analyze(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, label, confidence, one column for each label) of every row, rounded to 4 places. Blank texts are neutral by rule, NULL ones NULL; the first of equal labels wins."""
        k, bias = len(self.labels), np.array(self.intercepts, float)
        vocab = written(self.vocab, "sentiment-terms")  # its size is known then: a small one meets the slices' terms without a shuffle of those
        texts = _in_slices(docs, text_col, self.nfc, docs[id_col].alias("_id"))

        def score(texts: pa.Table, vocab: pa.Table) -> pa.Table:
            row, at, weight = _weighed(texts, vocab, 1)
            z = np.stack([bias[i] + np.bincount(row, weight * vocab.column(f"w{i}").to_numpy()[at], texts.num_rows) if len(at) else np.full(texts.num_rows, bias[i]) for i in range(k)], 1)
            lows = texts.column("_low").to_pylist()
            state = ["null" if t is None else "text" if t.strip() else "blank" for t in lows]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lows) + 1, dtype=np.int32) * k), pa.array(z.ravel()))
            return pa.table([texts.column("_id"), pa.array(state, pa.string()), lists], ["_id", "_state", "z"])

        met = texts.mapInArrow(_asked(1), "_slice bigint, term string").join(vocab.select("term", "idf", *[f"w{i}" for i in range(k)]), "term")
        schema = texts.select("_id").schema.add("_state", StringType()).add("z", ArrayType(DoubleType()))
        x = texts.groupBy("_slice").cogroup(met.groupBy("_slice")).applyInArrow(score, schema)
        top = F.array_max("z")
        p = F.transform("z", lambda z: F.exp(z - top))
        x = x.select("_id", "_state", "z", F.transform(p, lambda e: e / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)).alias("p"))
        best = F.array_position("z", F.array_max("z")).cast("int")
        real, blank = F.col("_state") == "text", F.col("_state") == "blank"
        out = [F.when(real, F.round(F.element_at("p", i + 1), 4)).when(blank, F.lit(BLANK[i] if k == 3 else 1 / k)).alias(name) for i, name in enumerate(self.labels)]
        label = F.when(real, F.element_at(F.array(*map(F.lit, self.labels)), best)).when(blank, F.lit("neutral" if "neutral" in self.labels else self.labels[0]))
        return x.select(F.col("_id").alias(id_col), label.alias("label"), F.when(real, F.round(F.array_max("p"), 4)).when(blank, 0.33).alias("confidence"), *out)

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.vocab.sparkSession.createDataFrame([(list(self.intercepts), list(self.labels), self.nfc)], "intercepts array<double>, labels array<string>, nfc boolean").write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SentimentModel:
        head = spark.read.parquet(f"{path}/head").first()
        return SentimentModel(spark.read.parquet(f"{path}/vocab"), tuple(head["intercepts"]), tuple(head["labels"]), head["nfc"])


def is_available(spark: SparkSession, path: str) -> bool:
    """Whether a model is saved there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/vocab")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fit_vocabulary(docs: DataFrame, text_col: str, most_terms: int = MOST_TERMS, least_df: int = LEAST_DF, most_df: float = MOST_DF, nfc: bool = True) -> DataFrame:
    """(term, df, idf): words of two characters at least and their pairs; the most frequent ones by count, then by term. Each row is a document."""
    n = docs.count()
    low = F.lower(docs[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ragged.batches_of(batch.column(0)):
                _, number, times, terms = _terms(batch.column(0).slice(a, b - a).to_pylist(), 2)
                total = np.zeros(len(terms), np.int64)
                np.add.at(total, number, times)
                yield pa.record_batch([pa.array(terms, pa.string()), pa.array(np.bincount(number, minlength=len(terms)), pa.int64()), pa.array(total)], ["term", "df", "cnt"])

    counts = docs.select((normalize_unicode(low) if nfc else low).alias("_low")).mapInArrow(run, "term string, df bigint, cnt bigint")
    df = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))
    kept = df.where((F.col("df") >= least_df) & (F.col("df") <= most_df * n)).orderBy(F.col("cnt").desc(), "term").limit(most_terms)
    return kept.select("term", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def fit(docs: DataFrame, text_col: str, label_col: str, labels: tuple[str, ...] = LABELS, max_iter: int = 1000, nfc: bool = True, **vocabulary: float) -> SentimentModel:
    """Multinomial logistic regression by MLlib on the weights; the penalty is 1 / n, as with C = 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    spark = docs.sparkSession
    docs = docs.where(docs[text_col].isNotNull() & docs[label_col].isin(*labels))
    vocab = written(fit_vocabulary(docs, text_col, nfc=nfc, **vocabulary), "sentiment-vocab")
    terms = [r["term"] for r in vocab.select("term").orderBy("term").collect()]  # at most most_terms
    size = len(terms)
    numbers = spark.createDataFrame(pa.table([pa.array(terms, pa.string()), pa.array(range(size), pa.int32())], ["t", "i"]))
    number = F.array_position(F.array(*map(F.lit, labels)), docs[label_col]).cast("double") - 1
    texts = _in_slices(docs, text_col, nfc, number.alias("label"))
    met = texts.mapInArrow(_asked(2), "_slice bigint, term string").join(vocab.select("term", "idf"), "term").join(numbers, F.col("term") == F.col("t")).drop("t")
    vector = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"

    def weigh(texts: pa.Table, vocab: pa.Table) -> pa.Table:
        row, at, weight = _weighed(texts, vocab, 2)
        place = vocab.column("i").to_numpy()[at] if len(at) else at.astype(np.int32)
        order = np.lexsort((place, row))
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=texts.num_rows))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (place.astype(np.int32), weight)]
        n = texts.num_rows
        features = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], ["type", "size", "indices", "values"])
        return pa.table([texts.column("label"), features], ["label", "features"])

    # Parquet holds a vector as this struct: written as one, the table is read again with vectors
    raw = written(texts.groupBy("_slice").cogroup(met.groupBy("_slice")).applyInArrow(weigh, f"label double, features {vector}"), "sentiment-rows")
    table = spark.read.schema(StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])).parquet(raw.inputFiles()[0].rsplit("/", 1)[0])
    n = table.count()
    model = LogisticRegression(family="multinomial", regParam=1 / max(n, 1), standardization=False, maxIter=max_iter).fit(table)
    coef = model.coefficientMatrix.toArray()
    w = spark.createDataFrame(pa.table([pa.array(terms, pa.string()), *map(pa.array, coef)], ["t", *(f"w{k}" for k in range(len(coef)))]))
    return SentimentModel(written(vocab.join(w, F.col("term") == F.col("t")).select("term", "idf", *[f"w{k}" for k in range(len(coef))]), "sentiment-model"), tuple(float(b) for b in model.interceptVector), labels[: len(coef)], nfc)
