"""The pipeline's stages on the small tables, each against its own rule."""

from __future__ import annotations

import pytest

import corpus_pipeline
from sabitext.llm import common, decontam, entries, minhash, secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == first.columns
        kept[name] = docs
    model = toxicity.train(first, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scored(first, model).collect() if r["is_toxic"]}
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    every = {r["doc_id"] for r in first.select("doc_id").collect()}
    assert ids["toxicity"] == every - toxic
    gone = {r["doc_id"] for r in minhash.near_duplicates(kept["toxicity"]).collect()}
    assert ids["near_duplicates"] == ids["toxicity"] - gone and gone
    leaks = {r["doc_id"] for r in decontam.contaminated(kept["near_duplicates"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids["decontamination"] == ids["near_duplicates"] - leaks and leaks
    assert ids["secrets"] == ids["decontamination"]
    found = {r["secret"] for r in secret_scan.secrets(kept["decontamination"]).collect()}
    assert not any(s in r["text"] for r in kept["secrets"].collect() for s in found)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() and {x for r in mixed.select("doc_ids").collect() for x in r["doc_ids"]} <= ids["secrets"]


def awkward(spark):
    long = " ".join(f"word{k % 977} of{k % 31}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text without an id", None, None, None), (3, long, "en", "a", len(long)), (4, "ok", "en", None, 2), (4, "ok", "en", None, 2), (5, "\0 \n ***", "en", "b", 7), (6, "é" * 50, "fr", "b", 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({c: common_lit(c) for c in ("id", "sig", "toxic", "label_id", "gone_id", "item_id", "part", "block")})


def common_lit(c):
    from pyspark.sql import functions as F

    return F.lit(c)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_awkward_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = awkward(spark)
    got = stage(spark, docs, SF)
    rows = got.collect()
    assert stage(spark, docs.limit(0), SF).collect() == []
    if name == "mixing":
        assert {d for r in rows for d in r["doc_ids"]} >= {None, 3} and sum(r["n_tokens"] for r in rows) > 30_000
        return
    assert got.columns == docs.columns
    ids = sorted((str(r["doc_id"]), r["text"]) for r in rows if r["text"] != "ok" and r["text"] is not None)
    assert ids == sorted((str(r["doc_id"]), r["text"]) for r in docs.collect() if r["text"] != "ok" and r["text"] is not None)
    assert sum(r["text"] == "ok" for r in rows) == (1 if name == "near_duplicates" else 2)
    assert sum(r["text"] is None for r in rows) == 1


def test_run_leaves_only_its_result(spark):
    from sabitext import shared

    since = shared.mark(spark)
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and shared.mark(spark) == since + 1


def test_registered():
    import __spark_entry__ as entry

    assert set(entries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op5_url_filters", "op9_lm_scoring"])
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = entries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(str, ([r[c] for c in columns] for r in got.collect())))
    want = con.execute(f"select {', '.join(columns)} from ({entries.ORACLES[name]})").fetchall()
    assert rows == sorted(str(list(r)) for r in want)
