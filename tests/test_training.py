"""Training sets, seeds, saved models, evaluations of all languages, and the token benchmark end to end."""

from __future__ import annotations

import hashlib
import json
import warnings

import pytest
from pyspark.sql import functions as F

from sabitext.operators import knn, metrics, naive_bayes, tokencost, tokenizer, training
from sabitext.sources import cache, readers
from sabitext.sources.seeds import seed_texts


def test_training_set(spark):
    rows = [(k, "pcm" if k % 4 == 0 else "eng", f"text number {k % 30}" + (" wetin dey happen" if k % 8 == 0 else "") + " " * (k % 3)) for k in range(200)]
    rows += [(500, "eng", None), (501, "eng", "  "), (None, "eng", "without an id"), (502, None, "without a language")]
    df = spark.createDataFrame(rows, "ord int, lang string, text string").withColumn("_n", F.lit(1))
    real = [r for r in rows if (r[2] or "").strip() and r[1] and (r[1] != "pcm" or "wetin" in r[2])]
    first = {}
    for o, lang, t in sorted(real, key=lambda r: (r[0] is None, r[0] or 0)):
        if o is not None:
            first.setdefault(t.strip(), (o, lang))
    want = set()
    for lang in ("pcm", "eng"):
        own = sorted((hashlib.md5(f"{o}:42".encode()).hexdigest(), o) for o, x in first.values() if x == lang)
        want |= {(o, lang) for _, o in own[:10]}
    got = [(r["ord"], r["lang"]) for r in training.language_texts([df, df.limit(0)], 10).collect() if r["ord"] is not None]
    assert set(got) == want and len(got) == len(want)


def test_cap_orders_no_large_group(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    got = training.capped(rows, "id", "g", 40)
    want = {}
    for r in rows.collect():
        want.setdefault(r["g"], []).append((hashlib.md5(f"{r['id']}:42".encode()).hexdigest(), r["id"]))
    assert {r["id"] for r in got.collect()} == {i for x in want.values() for _, i in sorted(x)[:40]} and got.columns == rows.columns
    assert training.capped(rows.limit(0), "id", "g", 40).count() == 0


def test_row_filters(spark):
    text = "Short. This sentence is long enough to be kept, it is. " + "x" * 400 + ". And here is another one that is long enough!"
    got = [r["t"] for r in training.sentences(spark.createDataFrame([(1, text), (2, None)], "i int, t string"), "t").collect()]
    assert got == ["This sentence is long enough to be kept, it is.", "And here is another one that is long enough!"]
    heads = spark.createDataFrame([("  exactly twenty char ",), ("more than twenty chars",), (None,)], "t string")
    assert [r["t"] for r in training.headlines(heads, "t").collect()] == ["more than twenty chars"]


def test_models_are_trained_once_and_found_again(spark, tmp_path):
    root = str(tmp_path)
    asked = spark.createDataFrame([(1, "Ẹ káàárọ̀, mo fẹ́ ra omi."), (2, "I wan chop, wetin dey happen?"), (3, "the children are reading"), (4, None)], "id int, t string")
    got = {r["id"]: r["lang"] for r in training.detect_language(spark, root, asked, "id", "t").collect()}
    assert got == {1: "yor", 2: "pcm", 3: "eng", 4: None}
    assert training.resolved(spark, root, "language").labels == list(naive_bayes.LANGUAGES)
    igbo = training.resolved(spark, root, "igbo_syllables")
    again = training.resolved(spark, root, "igbo_syllables")
    assert (igbo.lang, again.lang) == ("ibo", "ibo")
    rows = spark.createDataFrame([(1, "Oma di na ulo"), (2, "oru, ututu!"), (None, "")], "id int, t string")
    out = {r["id"]: r["restored"] for r in again.diacritize(rows, "id", "t").collect()}
    assert out[1].startswith("Ọma dị na ụlọ") and out[2] == "ọrụ, ụtụtụ!" and out[None] == ""
    dots = training.resolved(spark, root, "yoruba_dots").diacritize(spark.createDataFrame([(1, "mo fe ra eja")], "id int, t string"), "id", "t").first()["restored"]
    assert "ẹ" in dots and not set(dots) & set("áàéèíìóòúù")
    assert training.resolved(spark, root, "yoruba_words").viterbi(rows.where("id = 1"), "id", "t").count() == 1
    for name, error in (("sentiment", RuntimeError), ("french", ValueError)):
        with pytest.raises(error):
            training.resolved(spark, root, name)
    weights = {r["text"]: r["weight"] for r in seed_texts(spark).where("lang = 'ibo' and weight > 1").collect()}
    counts = {r["form"]: r["cnt"] for r in again.counts.where("undiac = 'di'").collect()}
    assert counts["dị"] >= weights["dị"] == 200


def test_json_layouts(spark):
    docs = seed_texts(spark)
    model = naive_bayes.fit(docs, "text", "lang")
    again = naive_bayes.NaiveBayes.from_json(spark, model.to_json())
    asked = spark.createDataFrame([(1, "omi tútù"), (2, "")], "id int, t string")
    a, b = ({r["id"]: dict(zip(m.labels, r["scores"])) for r in m.scores(asked, "id", "t").collect()} for m in (model, again))
    assert a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])
    old = json.loads(model.to_json())
    del old["default_log_likelihood"]
    assert naive_bayes.NaiveBayes.from_json(spark, json.dumps(old)).defaults == [naive_bayes.NO_DEFAULT] * 5
    syllables = knn.fit(spark.createDataFrame([(1, "ọjọ́ | dára"), (2, "|ilé| ojó")], "ord int, t string"), "ord", "t")
    back = knn.SyllableModel.from_json(spark, syllables.to_json())
    key = ("undiac", "prev", "next", "form", "cnt")
    assert sorted(tuple(r[c] for c in key) for r in back.counts.collect()) == sorted(tuple(r[c] for c in key) for r in syllables.counts.collect())
    assert json.loads(syllables.to_json())["total_syllables"] == sum(r["cnt"] for r in syllables.counts.collect())


def test_all_evaluations(spark, tmp_path):
    docs = spark.createDataFrame([(k, "ọjọ́ dára púpọ̀" if k % 2 else "ilé wa") for k in range(30)] + [(99, None)], "ord int, text string")
    model = knn.fit(docs, "ord", "text")
    igbo = knn.fit_igbo(docs, "ord", "text")
    got = training.run_all_evaluations({"yoruba": (docs, model.diacritize), "igbo": (docs, igbo.diacritize)}, str(tmp_path / "out"), 10, "v2", "2026-01-01")
    rows = {r["language"]: r for r in got.collect()}
    assert rows["yoruba"]["total_sentences"] == 10 and rows["yoruba"]["total_words"] >= 20 and rows["igbo"]["model_version"] == "v2"
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    m = metrics.DiacritizerMetrics.of(got.where("language = 'igbo'").drop("model_version", "date"), "v2", "2026-01-01")
    m.save(got.limit(1), str(tmp_path / "more"))
    m.save(got.limit(1), str(tmp_path / "more"))
    assert spark.read.json(str(tmp_path / "more")).count() == 2


def test_token_benchmark_end_to_end(spark, tmp_path):
    entries = [{"id": k, "category": "c", "eng": "good day", "yor": "ẹ káàsán", "hau": "barka", "ibo": "ehihie ọma", "pcm": "how far"} for k in range(12)]
    (tmp_path / "words.json").write_text(json.dumps({"metadata": {"n": 12}, "entries": entries}), encoding="utf-8")
    stats = tokencost.main(["--data", str(tmp_path / "words.json"), "--output", str(tmp_path / "out"), "--quick"], spark)
    assert {r["language"] for r in stats.collect()} == set(tokencost.LANGUAGES)
    assert spark.read.json(str(tmp_path / "out/results")).select("entry_id").distinct().count() == 10
    assert spark.read.csv(str(tmp_path / "out/summary"), header=True).count() == 5
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert list(tokencost.get_tokenizers({"bad": str(tmp_path / "none.json"), "good": tokenizer.DEFAULT_PATH})) == ["good"]
    assert any("bad" in str(w.message) for w in said)


def test_token_counts_match_another_library(spark):
    """The same vocabulary read by tiktoken gives as many tokens."""
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = tokenizer.DEFAULT_PATH.replace(".json", ".tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", tokenizer.count_tokens(F.col("text")).alias("n"))
    assert all(r["n"] == len(own.encode_ordinary(r["text"])) for r in docs.collect())


def test_json_export(spark, tmp_path):
    cache.export_json(spark.createDataFrame([("ọjọ́", None)], "text string, label string"), str(tmp_path / "x"))
    line = next(p for p in (tmp_path / "x").iterdir() if p.suffix == ".json" and p.stat().st_size).read_text(encoding="utf-8")
    assert json.loads(line) == {"text": "ọjọ́", "label": None} and "ọjọ́" in line
    (tmp_path / "p.tsv").write_text("en\tyo\nhi\tẹ n lẹ\n\tx\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_parallel(spark, str(tmp_path / "p.tsv"), {"en": "en", "yo": "yo"}).collect()] == [("hi", "ẹ n lẹ")]
