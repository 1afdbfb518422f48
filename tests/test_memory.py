"""What a worker holds at once doesn't grow with the batch or the slice that it gets."""

from __future__ import annotations

import random
import tracemalloc
from collections.abc import Callable

import pyarrow as pa
import pytest

from sabitext.functions import normalize, ragged
from sabitext.operators import knn, naive_bayes, sentiment

LETTERS = "abcdefghijklmnopqrstuvwxyzọẹṣáìgb"


def prose(mb: float) -> list[str]:
    """Texts of about 10,000 characters, of 20,000 words."""
    r = random.Random(7)
    words = ["".join(r.choices(LETTERS, k=r.randint(1, 9))) for _ in range(20_000)]
    return [" ".join(r.choices(words, k=1700)) for _ in range(round(mb * 100))]


def peak(run: Callable[[], object]) -> float:
    """MB of Python's and NumPy's memory at most."""
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_ngrams_by_pieces():
    texts = pa.array(prose(3))
    batch = pa.record_batch([pa.array([0] * len(texts)), texts, texts, texts], ["_slice", "_text", "_low", "_norm"])
    assert peak(lambda: list(naive_bayes._asked(iter([batch])))) < 350


def test_normalizing_by_pieces():
    texts = pa.array(prose(12))
    assert peak(lambda: normalize.changed(texts, lambda t: t)) < 15
    assert normalize.changed(texts, lambda t: t) is texts
    got = normalize.changed(pa.array(["a", None, "e\u0301" * 600_000, "x"]), lambda t: t.replace("e\u0301", "é"))
    assert got.to_pylist() == ["a", None, "é" * 600_000, "x"]


@pytest.mark.parametrize("most", [2, 5, 1000])
def test_summed(most):
    batches = [pa.record_batch([pa.array(["a", None, "b"]), pa.array(["x", "y", None]), pa.array([1, 2, 3])], ["k", "l", "n"])] * 4
    total: dict = {}
    for b in ragged.summed(batches, ["k", "l"], ["n"], most):
        for r in b.to_pylist():
            total[r["k"], r["l"]] = total.get((r["k"], r["l"]), 0) + r["n"]
    assert total == {("a", "x"): 4, (None, "y"): 8, ("b", None): 12}
    assert list(ragged.summed([], ["k"], ["n"])) == []


def test_contexts_by_pieces():
    texts = pa.array(prose(1.3))
    assert len(ragged.batches_of(texts)) > 1
    got = [r for b in knn._distinct_contexts(texts, "yor") for r in zip(*(c.to_pylist() for c in b.columns))]
    assert len(got) == len(set(got)) and set(got) == set(knn._contexts(texts.to_pylist(), "yor")[2])


def test_terms_by_pieces():
    texts = pa.array([*prose(1.3), None, ""])
    got = sentiment._distinct_terms(texts, 1).to_pylist()
    assert sorted(got) == sorted(sentiment._terms(texts.to_pylist(), 1)[3])
    vocab = pa.table([pa.array(got[::7]), pa.array([1.5] * len(got[::7]))], ["term", "idf"])
    row, at, weight = sentiment._weighed(pa.table([texts], ["_low"]), vocab, 1)
    whole = sentiment._weighed_piece(texts.to_pylist(), pa.array(got[::7]), vocab.column("idf").to_numpy(), 1)
    key = lambda r, a, w: sorted(zip(r.tolist(), a.tolist(), w.round(9).tolist()))
    assert key(row, at, weight) == key(*whole)
