"""Evaluation of restored diacritics: counts of each batch of pairs in the worker, or of each row by array functions, then one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ragged
from ..functions.text import strip_diacritics, strip_yoruba_diacritics, words_of

#: V1. The Yoruba set takes the two combining tones in.
MARKED = {"yoruba": "ọẹṣáàéèíìóòúù́̀ỌẸṢÁÀÉÈÍÌÓÒÚÙ", "igbo": "ịọụáàóòúùỊỌỤÁÀÓÒÚÙ"}
DOTTED = "ọẹṣỌẸṢ"
MOST_ERRORS = 20


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def same_places(a: Column, b: Column, equal: Callable[[Column, Column], Column] = lambda x, y: x == y) -> tuple[Column, Column]:
    """How many places two arrays share, up to the shorter, and at how many of them they agree."""
    n = F.least(F.size(a), F.size(b))
    agree = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: equal(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    return n, agree


def diacritic_positions(text: Column, language: str) -> Column:
    """V1: array of (i, c)."""
    found = F.transform(chars(text), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    marked = MARKED.get(language, "")
    return F.filter(found, lambda p: F.lit(marked).contains(p.c) if marked else F.lit(False))


def diacritic_counts(predicted: Column, expected: Column, language: str) -> tuple[Column, Column, Column]:
    """V2: true positives, false positives, false negatives."""
    p, e = diacritic_positions(predicted, language), diacritic_positions(expected, language)
    return F.size(F.array_intersect(p, e)), F.size(F.array_except(p, e)), F.size(F.array_except(e, p))


def _aligned(at: np.ndarray, begin: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists end to end, where each begins in two columns: the elements at places that both lists have."""
    n = np.minimum(np.diff(begin), np.diff(other))[at]
    return ragged.gathered(begin[:-1][at], n, np.arange(len(at))), ragged.gathered(other[:-1][at], n, np.arange(len(at)))


def pair_counts(p: list[str], e: list[str], lp: list[str], le: list[str], language: str) -> dict[str, int]:
    """V2 and V3 of pairs, as they stand and in lower case: the same sums as diacritic_counts(), same_places() and words_of() give."""
    every = np.arange(len(p))
    (wp, cp, ap), (we, ce, ae) = ragged.joined(lp), ragged.joined(le)
    i, j = _aligned(every, ap, ae)
    out = {"n": len(p), "s": sum(a == b for a, b in zip(lp, le)), "c": len(i), "rc": int((cp[i] == ce[j]).sum())}
    sides = []
    for whole, codes, at in ((wp, cp, ap), (we, ce, ae)):
        begin, end = ragged.runs(~ragged.blanks()[codes] if len(codes) else np.zeros(0, bool), at)
        sides.append((ragged.cut(whole, codes, begin, end), np.searchsorted(ragged.row_of(at, begin), np.arange(len(p) + 1))))
    number, _ = ragged.coded(pa.concat_arrays([sides[0][0], sides[1][0]]))
    i, j = _aligned(every, sides[0][1], sides[1][1])
    out |= {"w": len(i), "rw": int((number[i] == number[j + len(sides[0][0])]).sum())}
    (_, cp, ap), (_, ce, ae) = ragged.joined(p), ragged.joined(e)
    marks = [*map(ord, MARKED[language])]
    mp, me = np.isin(cp, marks), np.isin(ce, marks)
    i, j = _aligned(every, ap, ae)
    tp = int((mp[i] & (cp[i] == ce[j])).sum())
    return out | {"tp": tp, "fp": int(mp.sum()) - tp, "fn": int(me.sum()) - tp}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def evaluate(pairs: DataFrame, language: str, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """V3: one row of accuracies and counts over all pairs; rows with a NULL are left out."""
    if language not in MARKED:
        raise ValueError(f"unknown language {language!r}")
    p, e = F.col(predicted), F.col(expected)
    lp, le = F.lower(p), F.lower(e)
    rows = pairs.where(p.isNotNull() & e.isNotNull()).select(p.alias("p"), e.alias("e"), lp.alias("lp"), le.alias("le"))
    names = ("n", "w", "rw", "c", "rc", "s", "tp", "fp", "fn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ragged.batches_of(batch.column("e"), ragged.BATCH_BYTES // 2):
                got = pair_counts(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("p", "e", "lp", "le")), language)
                yield pa.record_batch([pa.array([got[c]], pa.int64()) for c in names], [*names])

    rows = rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_sentences"), *[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("s", "correct_sentences"), ("w", "total_words"), ("rw", "correct_words"), ("c", "total_chars"), ("rc", "correct_chars"), ("tp", "tp"), ("fp", "fp"), ("fn", "fn"))])
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.select(
        F.lit(language).alias("language"),
        "total_sentences",
        "correct_sentences",
        "total_words",
        "correct_words",
        _ratio(F.col("correct_words"), F.col("total_words")).alias("word_accuracy"),
        _ratio(F.col("correct_sentences"), F.col("total_sentences")).alias("sentence_accuracy"),
        _ratio(F.col("correct_chars"), F.col("total_chars")).alias("character_accuracy"),
        precision.alias("diacritic_precision"),
        recall.alias("diacritic_recall"),
        _f1(precision, recall).alias("diacritic_f1"),
    )


def sample_errors(pairs: DataFrame, ord_col: str) -> DataFrame:
    """The first MOST_ERRORS wrong rows by order: (ord, input, predicted, expected)."""
    return pairs.where(F.lower("predicted") != F.lower("expected")).orderBy(ord_col).limit(MOST_ERRORS).select(ord_col, "input", "predicted", "expected")


@dataclass
class DiacritizerMetrics:
    """V4: evaluate()'s row with where it comes from."""

    language: str
    model_version: str
    evaluation_date: str
    values: dict

    @classmethod
    def of(cls, row: DataFrame, model_version: str, evaluation_date: str) -> DiacritizerMetrics:
        values = row.first().asDict()
        return cls(values.pop("language"), model_version, evaluation_date, values)

    def to_dict(self) -> dict:
        return {"language": self.language, "model_version": self.model_version, "date": self.evaluation_date, **self.values}

    def summary(self) -> str:
        rates = "\n".join(f"  {k.replace('_', ' ')}: {v:.1%}" for k, v in self.values.items() if isinstance(v, float))
        return f"{self.language}, model {self.model_version}, {self.evaluation_date}: {self.values['total_sentences']} sentences\n{rates}"

    def save(self, row: DataFrame, path: str) -> None:
        """Appended as JSON."""
        row.withColumns({"model_version": F.lit(self.model_version), "date": F.lit(self.evaluation_date)}).write.mode("append").json(path)


def sampled(docs: DataFrame, ord_col: str, size: int = 500, seed: int = 42) -> DataFrame:
    """A sample without replacement, by hash of the order column: the same on every run and any partitioning."""
    return docs.orderBy(F.xxhash64(F.col(ord_col), F.lit(seed)), ord_col).limit(size)


def _simple(pairs: DataFrame) -> list[Column]:
    letters, right = same_places(chars(F.col("expected")), chars(F.col("predicted")))
    words, right_words = same_places(words_of(F.col("expected")), words_of(F.col("predicted")))
    return [letters.alias("c"), right.alias("rc"), words.alias("w"), right_words.alias("rw")]


def dot_below_accuracy(pairs: DataFrame) -> DataFrame:
    """V6, on (predicted, expected) with tones stripped: accuracies, and precision, recall and F1 of dotted letters by place."""
    dotted = lambda c: F.lit(DOTTED).contains(c)
    e, p = chars(F.col("expected")), chars(F.col("predicted"))
    _, tp = same_places(e, p, lambda x, y: dotted(x) & dotted(y) & (F.lower(x) == F.lower(y)))
    _, fp = same_places(e, p, lambda x, y: ~dotted(x) & dotted(y))
    _, fn = same_places(e, p, lambda x, y: dotted(x) & ~dotted(y))
    rows = pairs.where("expected is not null and predicted is not null").select(*_simple(pairs), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    t = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c", "rc", "w", "rw", "tp", "fp", "fn")])
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select(_ratio(F.col("rc"), F.col("c")).alias("char_accuracy"), _ratio(F.col("rw"), F.col("w")).alias("word_accuracy"), precision.alias("dot_below_precision"), recall.alias("dot_below_recall"), _f1(precision, recall).alias("dot_below_f1"), F.col("c").alias("total_chars"), F.col("w").alias("total_words"))


def full_accuracy(pairs: DataFrame) -> DataFrame:
    """V7: accuracies by character and word, case kept."""
    rows = pairs.where("expected is not null and predicted is not null").select(*_simple(pairs))
    t = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c", "rc", "w", "rw")])
    return t.select(_ratio(F.col("rc"), F.col("c")).alias("char_accuracy"), _ratio(F.col("rw"), F.col("w")).alias("word_accuracy"), F.col("c").alias("total_chars"), F.col("w").alias("total_words"))


def compare(dot_below: DataFrame, full: DataFrame) -> DataFrame:
    """V8: both results side by side."""
    return dot_below.select(F.lit("dot_below").alias("method"), "char_accuracy", "word_accuracy").union(full.select(F.lit("full"), "char_accuracy", "word_accuracy"))


def stripped_pairs(docs: DataFrame, text_col: str, tones_only: bool = False) -> DataFrame:
    """Rows with input (bare) and expected (as written, or with the dots only)."""
    expected = strip_yoruba_diacritics(docs[text_col], tones_only=True) if tones_only else docs[text_col]
    return docs.withColumns({"input": strip_diacritics(docs[text_col]), "expected": expected})
