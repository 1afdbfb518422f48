"""Catalog, readers, cache, and the functions on streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sabitext import streaming
from sabitext.functions.text import mask_pii
from sabitext.sources import cache, readers, registry


def test_registry(spark):
    assert len(registry.list_datasets()) == 7 and registry.registry(spark).count() == 7
    assert registry.get_hf_id("afriqa") == "masakhane/afriqa"
    registry.validate_lang("naijasenti", None)
    for bad in (lambda: registry.dataset_info("x"), lambda: registry.validate_lang("afriqa", "ibo"), lambda: registry.validate_split("afriqa", "all"), lambda: readers.load_dataset(None, "afriqa"), lambda: readers.load_dataset(None, "naijasenti", "xx", "nosplit")):
        with pytest.raises(ValueError):
            bad()


def put(root, name, lang, file, content):
    folder = root / name / lang
    folder.mkdir(parents=True)
    (folder / file).write_text(content, encoding="utf-8")


def test_sentiment_files_and_cache(spark, tmp_path):
    put(tmp_path, "naijasenti", "yor", "dev.tsv", 'tweet\tlabel\n ọjọ́ dára \tpositive\n"a ""quoted""\ttab\nline"\tneutral\n\tnegative\nshort\nx\t\n')
    root = str(tmp_path)
    rows = readers.load_dataset(spark, "naijasenti", "yor", "validation", root).collect()
    assert sorted(tuple(r) for r in rows) == [('a "quoted"\ttab\nline', "neutral"), ("ọjọ́ dára", "positive")]
    assert cache.is_cached(spark, root, "naijasenti", "yor", "validation")
    (tmp_path / "naijasenti/yor/dev.tsv").unlink()
    assert readers.load_dataset(spark, "naijasenti", "yor", "validation", root).count() == 2
    assert cache.clear_cache(spark, root, "masakhaner") == 0 and cache.clear_cache(spark, root) == 1
    with pytest.raises(FileNotFoundError):
        cache.load_from_cache(spark, root, "naijasenti", "yor", "validation")


def test_conll(spark, tmp_path):
    for lang, content in (("yor", "\n\nA B-PER X\nb O\nalone\n\n\n c O\r\n"), ("hau", ""), ("ibo", "z O")):
        put(tmp_path, "masakhaner", lang, "train.txt", content)
    rows = readers.load_dataset(spark, "masakhaner", None, "train", str(tmp_path), keep_lang=True).collect()
    assert sorted((r["lang"], r["tokens"], r["ner_tags"]) for r in rows) == [("ibo", ["z"], ["O"]), ("yor", ["A", "b"], ["B-PER", "O"]), ("yor", ["c"], ["O"])]


def test_news(spark, tmp_path):
    put(tmp_path, "masakhanews", "pcm", "train.tsv", "headline\tcategory\ttext\turl\nh\tsports\tball\tu\nh\t\tno topic\tu\n")
    rows = readers.load_dataset(spark, "masakhanews", "pcm", "train", str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("ball", "sports", "h", "u")]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"call 080312345{i:02d} @me #x") for i in range(20)]
    batch = spark.createDataFrame(rows, "id int, text string")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.cleaned(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = sorted((r["id"], r["clean"]) for r in streaming.cleaned(batch).collect())
    assert sorted((r["id"], r["clean"]) for r in spark.table("cleaned").collect()) == want
    timed = batch.withColumn("t", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60))
    counts = streaming.masked_counts(timed, "t").collect()
    assert sum(r["texts"] for r in counts) == 20 and sum(r["phones"] for r in counts) == 20


def test_pushdown_and_pruning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.where("lang = 'en'").select(mask_pii(F.col("text")))._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<text:string,lang:string>" in plan
