"""Steps that grew with the input: their new forms give what the old ones gave."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sabitext.functions.text import words_of
from sabitext.operators import metrics, tokenizer, training
from sabitext.shared import dealt


def test_pair_counts_are_those_of_the_columns(spark):
    r = random.Random(3)
    bag = ["ọ́", "a", "Ẹ", " ", "　", "b́", "à", "x", "\n", "😀"]
    texts = ["".join(r.choices(bag, k=r.randint(0, 12))) for _ in range(80)]
    pairs = [*zip(texts, texts[1:]), ("", ""), ("à à", "à à"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "predicted string, expected string")
    p, e = F.col("predicted"), F.col("expected")
    words, letters = metrics.same_places(words_of(F.lower(p)), words_of(F.lower(e))), metrics.same_places(metrics.chars(F.lower(p)), metrics.chars(F.lower(e)))
    marks = metrics.diacritic_counts(p, e, "yoruba")
    want = df.where(p.isNotNull() & e.isNotNull()).select(*[c.alias(n) for c, n in zip((*words, *letters, *marks), ("w", "rw", "c", "rc", "tp", "fp", "fn"))]).groupBy().sum().first()
    whole = [x for x in pairs if None not in x]
    a, b = [x for x, _ in whole], [x for _, x in whole]
    got = metrics.pair_counts(a, b, [x.lower() for x in a], [x.lower() for x in b], "yoruba")
    assert [got[n] for n in ("w", "rw", "c", "rc", "tp", "fp", "fn")] == list(want)
    assert (got["n"], got["s"]) == (len(whole), sum(x.lower() == y.lower() for x, y in whole))
    assert metrics.evaluate(df.limit(0), "yoruba").first()["total_sentences"] == 0
    assert "MapInArrow" in metrics.evaluate(df, "yoruba")._jdf.queryExecution().toString()


def test_tokens_by_pieces(monkeypatch):
    texts = pa.array(["a few words", None, "", "more of them, and longer"] * 5)
    whole = tokenizer._encoded(tokenizer.DEFAULT_PATH, texts, lambda e: e.ids, pa.list_(pa.int32()))
    monkeypatch.setattr(tokenizer, "PIECE_BYTES", 20)
    assert tokenizer._encoded(tokenizer.DEFAULT_PATH, texts, lambda e: e.ids, pa.list_(pa.int32())) == whole
    assert tokenizer._encoded(tokenizer.DEFAULT_PATH, texts[:0], len, pa.int32()) == pa.array([], pa.int32())


def test_stripping_without_a_regular_expression(spark):
    texts = ["　 a b \t\n", "", "  ", None, "​x​", "\x1cq\x85", "a" + " " * 1000 + "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(training.stripped(F.col("t")).alias("s"))
    assert [x["s"] for x in df.collect()] == [t if t is None else t.strip() for t in texts]
    assert "regexp" not in df._jdf.queryExecution().toString()


def test_small_rows_are_dealt_out(spark, tmp_path):
    spark.range(50_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = dealt(spark.read.parquet(str(tmp_path / "t")), 20_000)
    assert df.rdd.getNumPartitions() >= 10 and df.count() == 50_000
