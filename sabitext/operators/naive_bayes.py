"""Language detection: naive Bayes on character n-grams, script features and Pidgin markers.

A fitted model is a table with one row for each feature and a column for each
label. Texts are cut in the worker, PIECE_BYTES at a time, which bounds its
memory: training hands on distinct features with counts by label; for scores a
slice's distinct features are joined to the model, whatever its size, and meet
the slice's texts there. Texts are never regrouped by id, so ids may repeat or be NULL.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..functions import ragged
from ..functions.normalize import normalize_unicode
from ..functions.text import let, squeeze, words_of
from ..shared import in_slices, written

LANGUAGES = ("yor", "hau", "ibo", "pcm", "eng")
SIZES, LEAST, ALPHA, NO_DEFAULT = 4, 2, 1.0, -15.0
#: Text that is cut into n-grams at once; a byte of it takes some 400 of memory.
PIECE_BYTES = 1 << 19
#: Labels whose counts stand side by side.
MOST_AT_ONCE = 16
#: Feature, characters, weight of each.
SCRIPTS = (("__FEAT_YOR_DOTBELOW__", "ẹọṣẸỌṢ", 5), ("__FEAT_YOR_TONE__", "áàéèíìóòúùÁÀÉÈÍÌÓÒÚÙ", 3), ("__FEAT_IBO_DOTBELOW__", "ịụỊỤ", 5), ("__FEAT_HAU_HOOK__", "ɓɗƙƁƊƘ", 5))
PCM_WORDS = tuple("abeg abi anyhow boda bros chop comot dem dey dodo ehen ehn gist jare jeje joor kain kasala madam na naim oga omo oya palava pikin sabi sef sha shaa shey sista suya una vex wahala waka wetin wey yarn".split())
_VERBS, _STATES = "bring buy carry chop cook do get give kill leave put see sell take tell", "cold fine hard hot hungry sweet tire"
PCM_PHRASES = tuple(
    sorted(
        [f"{v} am" for v in _VERBS.split()]
        + [f"{a} die" for a in _STATES.split()]
        + [f"{w} dey" for w in "dem e go i no we wetin you".split()]
        + [f"dey {w}" for w in "come do go".split()]
        + [f"no {w}" for w in "be easy fit go good sweet".split()]
        + [f"make {w}" for w in "dem i we".split()]
        + [f"na {w}" for w in "im so wa".split()]
        + ["e don", "dem don", "wetin be", "abeg no", "for here", "for there"]
    )
)


def normalized(text: Column) -> Column:
    """L1, of a text in NFC: lower case, single blanks."""
    return squeeze(F.lower(text))


def char_ngrams(text: Column, sizes: int = SIZES) -> Column:
    """L2: every n-gram of 1 to `sizes` characters, as often as it occurs."""

    def all_sizes(chars: Column) -> Column:
        def of_size(n: int) -> Column:
            joined = F.transform(chars, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))
            return F.filter(joined, lambda g: g.isNotNull())

        return F.concat(chars, *map(of_size, range(2, sizes + 1)))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), all_sizes)


def script_features(text: Column) -> Column:
    """Array of (feature, weight) with weights above 0."""

    def of(low: Column) -> Column:
        words = F.array_distinct(F.transform(F.array_distinct(words_of(low)), lambda w: F.regexp_replace(w, r"""^[.,!?;:'"()\-]+|[.,!?;:'"()\-]+$""", "")))
        weights = [(name, F.regexp_count(text, F.lit(f"[{chars}]")) * weight) for name, chars, weight in SCRIPTS]
        weights.append(("__FEAT_PCM_VOCAB__", F.size(F.array_intersect(words, F.array(*map(F.lit, PCM_WORDS)))) * 5))
        weights.append(("__FEAT_PCM_BIGRAM__", sum((low.contains(p).cast("int") for p in PCM_PHRASES), F.lit(0)) * 5))
        return F.filter(F.array(*[F.struct(F.lit(n).alias("f"), w.cast("int").alias("w")) for n, w in weights]), lambda x: x.w > 0)

    return let(F.lower(text), of)


def has_pidgin(text: Column) -> Column:
    """Whether a text has a Pidgin word or phrase."""
    return F.exists(script_features(text), lambda x: x.f.startswith("__FEAT_PCM"))


def features(text: Column) -> Column:
    """L6, of a text in NFC: array of (feature, weight); n-grams weigh 1 each time."""
    grams = F.transform(char_ngrams(normalized(text)), lambda g: F.struct(g.alias("f"), F.lit(1).alias("w")))
    return F.concat(grams, script_features(text))


def prepared(docs: DataFrame, text_col: str, nfc: bool, *columns: Column) -> DataFrame:
    """The columns, then _low (NFC, in lower case) of each row. The scripts' letters are the same letters in lower case, so L1 and L3 to L5 need no more."""
    return docs.select(*columns, F.lower(normalize_unicode(docs[text_col]) if nfc else docs[text_col]).alias("_low"))


def squeezed(lows: list[str | None]) -> list[str | None]:
    """L1 of texts in lower case."""
    return [t if t is None else " ".join(t.split()) for t in lows]


class Features:
    """L6 of a batch of texts in lower case: n-grams, each with its text and number, for each length; (text, number, weight) of the other features; names by number."""

    def __init__(self, lows: list[str | None]) -> None:
        self.grams, self.names = [], []
        norms = squeezed(lows)
        self.blank = np.array([t == "" for t in norms], bool)
        for row, number, names in ragged.char_grams(norms, SIZES):
            self.grams.append((row, number + len(self.names)))
            self.names += names
        _, codes, at = ragged.joined(lows)
        beyond = np.flatnonzero(codes > 0x7F)  # no script has an ASCII letter
        codes, of = codes[beyond], ragged.row_of(at, beyond)
        weights = [np.bincount(of[np.isin(codes, [*map(ord, chars)])], minlength=len(lows)) * weight for _, chars, weight in SCRIPTS]
        known = [{w.strip(".,!?;:'\"()-") for w in set((t or "").split())} for t in norms]
        weights.append(np.array([5 * len(_PCM & ws) for ws in known], np.int64))
        weights.append(np.array([5 * sum(p in (t or "") for p in PCM_PHRASES) for t in lows], np.int64))
        self.pidgin = (weights[-1] + weights[-2]) > 0
        rows = [np.flatnonzero(w) for w in weights]
        self.others = np.concatenate(rows), np.repeat(np.arange(len(rows)) + len(self.names), [len(r) for r in rows]), np.concatenate([w[r] for w, r in zip(weights, rows)])
        self.names += OTHERS

    def tallied(self, group: np.ndarray, groups: int) -> np.ndarray:
        """The weight of each feature in each group of texts, as one array by group, then number."""
        n, (row, number, weight) = len(self.names), self.others
        total = np.bincount(group[row] * n + number, weight, groups * n).astype(np.int64)
        for row, number in self.grams:
            total += np.bincount(group[row] * n + number, minlength=groups * n)
        return total

    def weighed(self, gain: np.ndarray) -> np.ndarray:
        """The sum of gain, by number, over each text's features."""
        out = np.zeros(len(self.blank))
        for row, number in self.grams:
            out += np.bincount(row, gain[number], len(out))
        row, number, weight = self.others
        return out + np.bincount(row, weight * gain[number], len(out))


OTHERS = [*(name for name, _, _ in SCRIPTS), "__FEAT_PCM_VOCAB__", "__FEAT_PCM_BIGRAM__"]
_PCM = frozenset(PCM_WORDS)


def _pieces(lows: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, list[str | None]]]:
    """Begin, end and texts of each piece."""
    for a, b in ragged.batches_of(lows, PIECE_BYTES):
        yield a, b, lows.slice(a, b - a).to_pylist()


def gram_counts(docs: DataFrame, text_col: str, nfc: bool = True, sizes: int = SIZES, raw: bool = False) -> DataFrame:
    """(gram, n): how often each n-gram of 1 to sizes characters occurs in all texts, in L1 form or, if raw, as they stand."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _pieces(batch.column(0)):
                for _, number, names in ragged.char_grams(texts if raw else squeezed(texts), sizes):
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.bincount(number, minlength=len(names)).astype(np.int64))], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return ragged.summed(counted(batches), ["gram"], ["n"])

    texts = docs.select(docs[text_col].alias("_low")) if raw else prepared(docs, text_col, nfc)
    return texts.mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number = batch.column("_slice").to_numpy()
        cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else [0]
        for a, b in zip(cuts, cuts[1:]):
            every = [pa.array(OTHERS, pa.string())]
            every += [pa.array(names, pa.string()) for _, _, lows in _pieces(batch.column("_low").slice(a, b - a)) for _, _, names in ragged.char_grams(squeezed(lows), SIZES)]
            names = pc.unique(pa.chunked_array(every))
            yield pa.record_batch([pa.array(np.full(len(names), number[a])), names], ["_slice", "feature"])


@dataclass
class NaiveBayes:
    """labels in the order that decides ties; prior and default for each; table (feature, d0, d1, ...): log likelihoods above the default."""

    labels: list[str]
    priors: list[float]
    defaults: list[float]
    table: DataFrame
    nfc: bool = True

    def _scored(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, scores, _mark) of every row."""
        texts = in_slices(prepared(docs, text_col, self.nfc, docs[id_col].alias("_id")), "_low", "nb-slices")
        met = texts.mapInArrow(_asked, "_slice bigint, feature string").join(self.table, "feature")
        priors, defaults = np.array(self.priors), np.array(self.defaults)
        kind = texts.schema["_id"].dataType
        schema = texts.select("_id").schema.add("scores", ArrayType(DoubleType())).add("_mark", StringType())

        def score(texts: pa.Table, model: pa.Table) -> pa.Table:
            k = len(priors)
            known = model.column("feature").combine_chunks()
            gains = [np.append(model.column(f"d{i}").to_numpy(), 0.0) for i in range(k)]
            scores, marks = [], []
            for _, _, lows in _pieces(texts.column("_low")):
                got = Features(lows)
                at = pc.index_in(pa.array(got.names, pa.string()), known).fill_null(-1).to_numpy()
                sums = got.weighed(np.ones(len(at)))[:, None] * defaults + priors
                for i in range(k):
                    sums[:, i] += got.weighed(gains[i][at])
                scores.append(sums.ravel())
                marks.append(np.where(got.blank, "blank", np.where(got.pidgin, "pidgin", "none")))
            n, null = texts.num_rows, texts.column("_low").is_null().to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.concatenate([np.zeros(0), *scores])), mask=pa.array(null))
            mark = np.where(null, None, np.concatenate([np.zeros(0, "U7"), *marks]))
            return pa.table([texts.column("_id"), lists, pa.array(mark, pa.string())], ["_id", "scores", "_mark"])

        found = texts.groupBy("_slice").cogroup(met.groupBy("_slice")).applyInArrow(score, schema)
        return found.select(F.col("_id").cast(kind).alias(id_col), "scores", "_mark")

    def scores(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, scores) of every row: log posteriors in the order of labels. NULL texts have NULL, blank ones their priors."""
        return self._scored(docs, id_col, text_col).select(id_col, "scores")

    def _ranked(self) -> Column:
        """Labels by score, ties in their order."""
        pairs = F.arrays_zip(F.col("scores").alias("s"), F.array(*map(F.lit, self.labels)).alias("l"))
        return F.transform(F.array_sort(F.transform(pairs, lambda p, i: F.struct((-p.s).alias("s"), i.alias("i"), p.l.alias("l")))), lambda p: p.l)

    def probabilities(self) -> Column:
        """L10, of the column scores: map from label to probability."""
        top = F.array_max("scores")
        total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - top))
        return F.map_from_arrays(F.array(*map(F.lit, self.labels)), F.transform("scores", lambda s: F.exp(s - top) / total))

    def predict(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, label, scores)."""
        return self.scores(docs, id_col, text_col).select(id_col, self._ranked()[0].alias("label"), "scores")

    def detect(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, lang, confidence, scores). Blank texts have no lang and confidence 0; pcm without a Pidgin marker gives way to the second best."""
        found = self._scored(docs, id_col, text_col)
        ranked, prob = self._ranked(), self.probabilities()
        lang = F.when(F.col("_mark") == "blank", None).when((ranked[0] == "pcm") & (F.col("_mark") == "none"), ranked[1]).otherwise(ranked[0])
        even = F.map_from_arrays(F.array(*map(F.lit, self.labels)), F.array(*[F.lit(1 / len(self.labels))] * len(self.labels)))
        return found.select(id_col, lang.alias("lang"), F.coalesce(F.element_at(prob, lang), F.lit(0.0)).alias("confidence"), F.when(F.col("_mark") == "blank", even).otherwise(prob).alias("scores"))

    def save(self, path: str) -> None:
        """The table as Parquet, the rest as one row beside it."""
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        spark = self.table.sparkSession
        spark.createDataFrame([(self.labels, self.priors, self.defaults, self.nfc)], "labels array<string>, priors array<double>, defaults array<double>, nfc boolean").write.mode("overwrite").parquet(f"{path}/head")

    def to_json(self) -> str:
        """One JSON text with log_priors, log_likelihoods (by label and feature), vocab and default_log_likelihood. For models that fit on the driver."""
        rows = self.table.collect()
        ll = {x: {r["feature"]: self.defaults[k] + r[f"d{k}"] for r in rows} for k, x in enumerate(self.labels)}
        return json.dumps({"log_priors": dict(zip(self.labels, self.priors)), "log_likelihoods": ll, "vocab": [r["feature"] for r in rows], "default_log_likelihood": dict(zip(self.labels, self.defaults))}, ensure_ascii=False)

    @staticmethod
    def from_json(spark: SparkSession, text: str, nfc: bool = True) -> NaiveBayes:
        """Of to_json()'s layout; without defaults NO_DEFAULT."""
        data = json.loads(text)
        labels = list(data["log_priors"])
        defaults = [data.get("default_log_likelihood", {}).get(x, NO_DEFAULT) for x in labels]
        features = sorted({f for x in labels for f in data["log_likelihoods"][x]})
        gains = [[data["log_likelihoods"][x].get(f, d) - d for f in features] for x, d in zip(labels, defaults)]
        table = spark.createDataFrame(pa.table([pa.array(features, pa.string()), *map(pa.array, gains)], ["feature", *(f"d{k}" for k in range(len(labels)))]))
        return NaiveBayes(labels, list(data["log_priors"].values()), defaults, table, nfc)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NaiveBayes:
        """Models saved without defaults use NO_DEFAULT."""
        head = spark.read.parquet(f"{path}/head").first()
        return NaiveBayes(list(head["labels"]), list(head["priors"]), list(head["defaults"] or [NO_DEFAULT] * len(head["labels"])), spark.read.parquet(f"{path}/table"), head["nfc"])


def fit(docs: DataFrame, text_col: str, label_col: str, labels: list[str] | None = None, uniform: bool = True, alpha: float = ALPHA, nfc: bool = True) -> NaiveBayes:
    """L7. Denominators count all features, also those pruned for being seen fewer than LEAST times; labels default to sorted order."""
    known = prepared(docs.where(docs[text_col].isNotNull() & docs[label_col].isNotNull()), text_col, nfc, docs[label_col].cast("string").alias("label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lows in _pieces(batch.column("_low")):
                got = Features(lows)
                label, names = ragged.numbered(batch.column("label").slice(a, b - a).to_pylist(), b - a)
                for some in range(0, len(names), MOST_AT_ONCE):  # so many labels' counts side by side
                    of = np.flatnonzero((label >= some) & (label < some + MOST_AT_ONCE))
                    part = got if len(names) <= MOST_AT_ONCE else Features([lows[k] for k in of])
                    n = part.tallied(label[of] - some, min(MOST_AT_ONCE, len(names) - some))
                    there = np.flatnonzero(n)
                    yield pa.record_batch([pa.array(names[some : some + MOST_AT_ONCE], pa.string()).take(pa.array(there // len(part.names))), pa.array(part.names, pa.string()).take(pa.array(there % len(part.names))), pa.array(n[there])], ["label", "feature", "n"])
                yield pa.record_batch([pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(np.bincount(label))], ["label", "feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return ragged.summed(counted(batches), ["label", "feature"], ["n"])

    every = written(known.mapInArrow(run, "label string, feature string, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n")), "nb-counts")
    seen = {r["label"]: r["n"] for r in every.where("feature is null").collect()}  # texts of each label
    counts = every.where("feature is not null")
    labels = [x for x in labels if x in seen] if labels else sorted(seen)
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    wide = counts.groupBy("feature").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(labels)])
    kept = written(wide.where((F.col("total") >= LEAST) | F.col("feature").startswith("__FEAT_")), "nb-kept")
    size = kept.count()
    down = [totals.get(x, 0) + alpha * size for x in labels]
    table = kept.select("feature", *[(F.log(F.col(f"n{k}") + alpha) - F.lit(math.log(alpha))).alias(f"d{k}") for k in range(len(labels))])
    rows_ = sum(seen.values())
    return NaiveBayes(labels, [math.log(1 / len(labels) if uniform else seen[x] / rows_) for x in labels], [math.log(alpha / d) if d else NO_DEFAULT for d in down], table, nfc)
