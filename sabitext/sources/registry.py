"""The catalog of datasets: one row each, and checks of names, languages and splits on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPLITS = ("train", "validation", "test")
_FOUR, _THREE = ("yor", "hau", "ibo", "pcm"), ("yor", "hau", "ibo")
#: Name: (task, languages, hub id, what it is, source).
DATASETS = {
    "afriqa": ("qa", ("yor", "hau"), "masakhane/afriqa", "Questions in one language, answers from another", "Ogundepo and others, 2023"),
    "masakhaner": ("ner", _THREE, "masakhane/masakhaner2", "Named entities, second version", "Adelani and others, 2022"),
    "masakhanews": ("classification", _FOUR, "masakhane/masakhanews", "News articles by topic", "Adelani and others, 2023"),
    "masakhapos": ("pos", _THREE, "masakhane/masakhapos", "Parts of speech", "Dione and others, 2023"),
    "menyo20k": ("translation", ("yor", "eng"), "masakhane/menyo20k_mt", "Parallel sentences", "Adelani and others, 2021"),
    "naijasenti": ("sentiment", _FOUR, "HausaNLP/NaijaSenti-Twitter", "Tweets by sentiment", "Muhammad and others, 2022"),
    "nollysenti": ("sentiment", (*_FOUR, "eng"), "HausaNLP/NollySenti", "Film reviews by sentiment", "Shode and others, 2023"),
}
SCHEMA = "name string, task string, languages array<string>, splits array<string>, hf_id string, description string, citation string"


def list_datasets() -> list[str]:
    """D6."""
    return sorted(DATASETS)


def dataset_info(name: str) -> dict:
    """D7."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; there are: {', '.join(list_datasets())}")
    task, languages, hub, what, source = DATASETS[name]
    return {"name": name, "task": task, "languages": list(languages), "splits": list(SPLITS), "hf_id": hub, "description": what, "citation": source}


def get_hf_id(name: str) -> str:
    """D8."""
    return dataset_info(name)["hf_id"]


def validate_lang(name: str, lang: str | None) -> None:
    """None passes."""
    known = dataset_info(name)["languages"]
    if lang is not None and lang not in known:
        raise ValueError(f"{name} has no language {lang!r}; it has: {', '.join(known)}")


def validate_split(name: str, split: str) -> None:
    """D10."""
    known = dataset_info(name)["splits"]
    if split not in known:
        raise ValueError(f"{name} has no split {split!r}; it has: {', '.join(known)}")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(dataset_info(n)[c.split()[0]] for c in SCHEMA.split(", ")) for n in list_datasets()], SCHEMA)
