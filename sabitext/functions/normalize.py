"""Unicode normal forms. Spark has no expression for them, so this is the one Arrow UDF among the text functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ragged

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def changed(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """A function of every text, some of them at a time; NULL stays NULL. Texts that it gives back as they are aren't copied."""
    out, same = [], True
    for a, b in ragged.batches_of(texts):
        part = texts.slice(a, b - a)
        old = part.to_pylist()
        new = [None if t is None else change(t) for t in old]
        if any(x is not y for x, y in zip(old, new)):
            part, same = pa.array(new, pa.string()), False
        out.append(part)
    return texts if same else pa.concat_arrays(out)


def arrow_text(change: Callable[[str], str], text: Column) -> Column:
    """Applies a function to every text of a batch."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return changed(texts, change)

    return run(text)


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    """T1. ASCII texts and those already normal are passed on as they are."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {', '.join(FORMS)}")
    return arrow_text(lambda t: t if t.isascii() or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t), text)


def normalize_yoruba(text: Column) -> Column:
    return normalize_unicode(text)


def normalize_igbo(text: Column) -> Column:
    return normalize_unicode(text)
