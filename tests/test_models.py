"""Models against plain restatements of their rules on small corpora."""

from __future__ import annotations

import collections
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sabitext.functions.syllables import PATTERNS
from sabitext.operators import knn, metrics, naive_bayes, sentiment, tokencost, tokenizer, words

TEXTS = [("de dey wetin dey happen abeg", "pcm"), ("the weather is fine today my friend", "eng"), ("ẹ káàárọ̀ ọjọ́ dára púpọ̀", "yor"), ("ina kwana yaya gida ɓangare", "hau"), ("kedụ ka ị mere ụtụtụ ọma", "ibo"), ("no wahala my people una well done", "pcm"), ("we went to the market yesterday", "eng")]


def plain_features(t):
    t = unicodedata.normalize("NFC", t)
    low = " ".join(t.lower().split())
    out = collections.Counter(low[i : i + n] for n in (1, 2, 3, 4) for i in range(len(low) - n + 1))
    for name, chars, weight in naive_bayes.SCRIPTS:
        out[name] += weight * sum(c in chars for c in t)
    ws = {w.strip(".,!?;:'\"()-") for w in t.lower().split()}
    out["__FEAT_PCM_VOCAB__"] += 5 * len(ws & set(naive_bayes.PCM_WORDS))
    out["__FEAT_PCM_BIGRAM__"] += 5 * sum(p in t.lower() for p in naive_bayes.PCM_PHRASES)
    return +out


def test_naive_bayes(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "text string, label string")
    model = naive_bayes.fit(docs, "text", "label", list(naive_bayes.LANGUAGES))
    counts = {x: collections.Counter() for x in naive_bayes.LANGUAGES}
    for t, x in TEXTS:
        counts[x].update(plain_features(t))
    every = sum(counts.values(), collections.Counter())
    vocab = {f for f, n in every.items() if n >= 2 or f.startswith("__FEAT_")}
    asked = ["abeg wetin dey", "the fine day", "ọjọ́", "zzz qqq", "kedụ", "", "  ", None, "x" * 20_000]

    def score(t, x):
        down = sum(counts[x].values()) + len(vocab)
        return math.log(0.2) + sum(n * math.log(((counts[x][f] if f in vocab else 0) + 1) / down) for f, n in plain_features(t).items())

    rows = spark.createDataFrame(list(enumerate(asked)), "id int, t string")
    got = {r["id"]: r["scores"] for r in model.scores(rows, "id", "t").collect()}
    for i, t in enumerate(asked):
        if t is None:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx([score(t, x) for x in naive_bayes.LANGUAGES])
    found = {r["id"]: r for r in model.detect(rows, "id", "t").collect()}
    assert (found[0]["lang"], found[2]["lang"], found[4]["lang"]) == ("pcm", "yor", "ibo")
    assert (found[5]["lang"], found[5]["confidence"], found[6]["lang"]) == (None, 0.0, None)
    assert sum(found[1]["scores"].values()) == pytest.approx(1) and found[6]["scores"]["yor"] == 0.2
    grams = collections.Counter()
    for _, names, times in [(0, *zip(*[(g, n) for g, n in plain_features(t).items() if not g.startswith("__")])) for t, _ in TEXTS]:
        grams.update(dict(zip(names, times)))
    assert {r["gram"]: r["n"] for r in naive_bayes.gram_counts(docs, "text").collect()} == grams
    column = collections.Counter(g for r in docs.select(naive_bayes.char_ngrams(naive_bayes.normalized(F.col("text"))).alias("g")).collect() for g in r["g"])
    assert column == grams
    again = spark.createDataFrame([(1, "abeg wetin dey"), (1, "the fine day"), (None, "ọjọ́"), (None, None), (1, "abeg wetin dey")], "id int, t string")
    rows_ = sorted((str(r["id"]), str(r["lang"])) for r in model.detect(again, "id", "t").collect())
    assert rows_ == [("1", "eng"), ("1", "pcm"), ("1", "pcm"), ("None", "None"), ("None", "yor")]
    assert model.scores(again.limit(0), "id", "t").count() == 0
    model.save(str(tmp_path / "nb"))
    again = naive_bayes.NaiveBayes.load(spark, str(tmp_path / "nb"))
    assert {r["id"]: r["scores"] for r in again.scores(rows, "id", "t").collect()} == got
    assert len(naive_bayes.PCM_PHRASES) == 51 and len(naive_bayes.PCM_WORDS) == 40


SYL = [(1, "Ọjọ́ dára púpọ̀. Ilé wa dára!"), (2, "orí ilẹ̀ dára, ọjọ́ ilé 12"), (3, "ọ̀rẹ́ mi wá sí ilé"), (4, None), (5, "")]


def plain_knn(rows):
    """Counts in insertion order, and prediction with four tiers."""
    low = lambda s: knn.bare(s)
    db, freq = collections.defaultdict(dict), collections.defaultdict(collections.Counter)
    seg = lambda t: re.findall(r"(?s)[^\W\d_']*(?:[^\W\d_]|')+[^\W\d_']*|.", t)
    for _, t in rows:
        seq = []
        for token in seg(unicodedata.normalize("NFC", t or "")):
            if token[0].isalpha() or token[0] == "'":
                seq += [(s, any(c.isalpha() for c in s)) for s in re.findall(PATTERNS["yor"], token)]
            elif token.strip():
                seq.append((token, False))
        for i, (s, target) in enumerate(seq):
            if target:
                key = (low(seq[i - 1][0]) if i else knn.START, low(seq[i + 1][0]) if i + 1 < len(seq) else knn.END)
                db[low(s)].setdefault(key, collections.Counter())[s.lower()] += 1
                freq[low(s)][s.lower()] += 1

    def predict(u, p, n):
        for ok in (lambda k: k == (p, n), lambda k: k[0] == p, lambda k: k[1] == n):
            for k, c in db.get(u, {}).items():
                if ok(k):
                    return c.most_common(1)[0][0]
        return freq[u].most_common(1)[0][0] if u in freq else None

    def restore(t):
        out, ws = [], []
        for token in seg(unicodedata.normalize("NFC", t)):
            word = token[0].isalpha() or token[0] == "'"
            for s in re.findall(PATTERNS["yor"], token) if word else [token]:
                if word:
                    ws.append(len(out))
                out.append(s)
        done = list(out)
        for k, i in enumerate(ws):
            p = low(out[ws[k - 1]]) if k else knn.START.lower()
            n = low(out[ws[k + 1]]) if k + 1 < len(ws) else knn.END.lower()
            form = predict(low(out[i]), p, n)
            if form is not None:
                done[i] = form.capitalize() if out[i][0].isupper() else form
        return "".join(done)

    return restore


@pytest.mark.parametrize("parts", [1, 5])
def test_syllable_model(spark, tmp_path, parts):
    docs = spark.createDataFrame(SYL, "ord int, text string").repartition(parts)
    model = knn.fit(docs, "ord", "text")
    plain = plain_knn(SYL)
    r = random.Random(1)
    bag = "Ojo dara pupo ile ori wa mi si ore Ore xyz 12 . , ! kan".split()
    asked = [" ".join(r.choice(bag) for _ in range(r.randint(1, 9))) for _ in range(40)] + ["", "  ", None, "ojo-ile"]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, t string")
    got = {x["id"]: x["restored"] for x in model.diacritize(rows, "id", "t").collect()}
    assert got == {i: t if not (t or "").strip() else plain(t) for i, t in enumerate(asked)}
    model.save(str(tmp_path / "knn"))
    again = knn.SyllableModel.load(spark, str(tmp_path / "knn"))
    assert again.lang == "yor"
    twice = spark.createDataFrame([(1, "ojo"), (1, "dara"), (None, "ojo"), (None, None)], "id int, t string")
    assert sorted((str(x["id"]), str(x["restored"])) for x in again.diacritize(twice, "id", "t").collect()) == [("1", plain("dara")), ("1", plain("ojo")), ("None", "None"), ("None", plain("ojo"))]
    dots = knn.fit_dot_below(docs, "ord", "text").diacritize(rows.where("id = 0"), "id", "t").first()["restored"]
    assert not re.search("[̀́áàéèíìóòúù]", dots)


PHRASES = [("kọ́ ilé", 15), ("orí ilẹ̀", 10), ("ra ilé", 15), ("omi tútù", 10)]


def phrases(spark):
    rows = [t for t, n in PHRASES for _ in range(n)]
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)] + [(999, None, None)], "ord int, diac string, undiac string")


def test_word_model_and_viterbi(spark, tmp_path):
    model = words.fit(phrases(spark), "ord", "diac")
    assert {r["undiac"]: r["form"] for r in model.words.collect()}["ile"] == "ilé"
    assert [tuple(r) for r in model.pairs.collect()] == [("ori", "ile", "ilẹ̀")]
    logs = {r["form"]: r["logp"] for r in model.candidates.where("undiac = 'ile'").collect()}
    assert logs == pytest.approx({"ilé": math.log(0.75), "ilẹ̀": math.log(0.25)})
    assert words.log_odds(model, "ilé") == pytest.approx(math.log(0.3)) and words.log_odds(model, "nothing") == -10
    moves = {(r["prev_form"], r["form"]): r["logp"] for r in model.transitions.collect()}
    assert moves["orí", "ilẹ̀"] == pytest.approx(0.0)
    rows = spark.createDataFrame([(1, "Ori ile"), (2, "ori. ile"), (3, "xyz ile"), (4, None), (5, " "), (6, "Ori. Ile!"), (7, "ori ile")], "id int, t string")
    want = {1: "Orí ilẹ̀", 2: "orí. ilé", 3: "xyz ilé", 4: None, 5: " ", 6: "Orí. Ilé!", 7: "orí ilẹ̀"}
    assert {r["id"]: r["restored"] for r in model.viterbi(rows, "id", "t").collect()} == want
    assert {r["id"]: r["restored"] for r in model.greedy(rows, "id", "t").collect()} == want
    again = spark.createDataFrame([(1, "Ori ile"), (1, "omi"), (None, "ile"), (None, None), (1, "omi")], "id int, t string")
    for restored in (model.viterbi, model.greedy):
        assert sorted((str(r["id"]), str(r["restored"])) for r in restored(again, "id", "t").collect()) == [("1", "Orí ilẹ̀"), ("1", "omi"), ("1", "omi"), ("None", "None"), ("None", "ilé")]
        assert restored(again.limit(0), "id", "t").count() == 0
    stats = {r["id"]: (r["total"], r["known"], r["pair_hits"]) for r in model.statistics(rows.where("id < 4"), "id", "t").collect()}
    assert stats == {1: (2, 2, 1), 2: (2, 2, 0), 3: (2, 1, 0)}
    model.save(str(tmp_path / "w"))
    again = words.WordModel.load(spark, str(tmp_path / "w"))
    assert again.viterbi(rows.where("id = 7"), "id", "t").first()["restored"] == "orí ilẹ̀"
    old = words.WordModel(model.words, model.pairs)
    assert old.greedy(rows.where("id = 7"), "id", "t").first()["restored"] == "orí ilẹ̀"
    with pytest.raises(ValueError):
        old.viterbi(rows, "id", "t")


def test_viterbi_is_the_best_sequence():
    r = random.Random(3)
    forms = {w: [(f"{w}{k}", -r.random() * 3) for k in range(3)] for w in "abcd"}
    every = [f for fs in forms.values() for f, _ in fs]
    moves = {f: {g: -r.random() * 4 for g in r.sample(every, 6)} for f in every[:9]}
    d = words.Decoder({}, {("a", "b"): "b2"}, forms, moves, {f: -r.random() * 6 for f in every[:8]}, {})
    import itertools

    forms["s"] = [("s", 0.0)]  # a word with one form cuts the sentence
    for _ in range(60):
        seq = [r.choice("abcds") for _ in range(6)]

        def score(path):
            total = path[0][1]
            for t in range(1, len(path)):
                (old, _), (new, e) = path[t - 1], path[t]
                total += e + (5 if d.pairs.get((seq[t - 1], seq[t])) == new else 0) + moves.get(old, {}).get(new, d.unigrams.get(new, -10.0))
            return total

        best = max(score(p) for p in itertools.product(*(forms[w] for w in seq)))
        got = d.decode(seq)
        assert score([next(x for x in forms[w] if x[0] == f) for w, f in zip(seq, got)]) == pytest.approx(best)


def test_unknown_words_go_to_the_syllable_model(spark):
    fallback = knn.fit(spark.createDataFrame(SYL, "ord int, text string"), "ord", "text")
    model = words.fit(phrases(spark), "ord", "diac", fallback=fallback)
    rows = spark.createDataFrame([(1, "Ojo ori ile")], "id int, t string")
    assert model.viterbi(rows, "id", "t").first()["restored"].startswith("Ọjọ")
    assert model.greedy(rows, "id", "t").first()["restored"].startswith("Ọjọ")


def test_sentiment(spark, tmp_path):
    good, bad = "film sweet well well", "film bad no good"
    rows = [(i, good if i % 2 else bad, "positive" if i % 2 else "negative") for i in range(40)] + [(98, None, "positive"), (99, "film", "neutral")]
    docs = spark.createDataFrame(rows, "id int, t string, label string")
    model = sentiment.fit(docs, "t", "label", max_iter=50, most_df=1.0)
    asked = spark.createDataFrame([(1, "sweet film"), (2, "bad film"), (3, ""), (4, None), (5, "zzz qqq"), (6, "sweet " * 20_000)], "id int, t string")
    got = {r["id"]: r for r in model.analyze(asked, "id", "t").collect()}
    assert (got[1]["label"], got[2]["label"], got[6]["label"]) == ("positive", "negative", "positive")
    assert tuple(got[3])[1:] == ("neutral", 0.33, 0.33, 0.34, 0.33) and got[4]["label"] is None
    z = [math.exp(b) for b in model.intercepts]
    assert got[5]["positive"] == pytest.approx(z[0] / sum(z), abs=1e-4)
    twice = spark.createDataFrame([(1, "sweet"), (1, "bad"), (None, "bad"), (None, None)], "id int, t string")
    assert sorted((str(r["id"]), str(r["label"])) for r in model.analyze(twice, "id", "t").collect()) == [("1", "negative"), ("1", "positive"), ("None", "None"), ("None", "negative")]
    weights = {(r["id"], r["term"]): r["weight"] for r in sentiment.tfidf(asked, "id", "t", model.vocab).collect()}
    assert sum(w * w for (i, _), w in weights.items() if i == 1) == pytest.approx(1) and {t for i, t in weights if i == 6} <= {"sweet", "sweet sweet"}
    column = asked.where("id = 2").select(sentiment.word_ngrams(F.lower("t"))).first()[0]
    assert sorted(column) == ["bad", "bad film", "film"]
    assert not sentiment.is_available(spark, str(tmp_path / "s"))
    model.save(str(tmp_path / "s"))
    assert sentiment.is_available(spark, str(tmp_path / "s"))
    assert sorted(sentiment.SentimentModel.load(spark, str(tmp_path / "s")).analyze(asked, "id", "t").collect()) == sorted(got.values())


def test_tokenizer_round_trip(spark):
    t = tokenizer.Tokenizer(" Yoruba ")
    rows = spark.createDataFrame([("Ẹ kú àbọ̀ <|endoftext|>",), ("",), (None,), ("x " * 5000,)], "t string")
    got = rows.select("t", t.decode(t.encode(F.col("t"))).alias("d"), t.count(F.col("t")).alias("n"), F.size(t.tokens(F.col("t"))).alias("m")).collect()
    assert all(r["t"] == r["d"] for r in got) and all(r["n"] == r["m"] for r in got if r["t"] is not None)
    assert t.vocab_size > 50_000 and "yoruba" in repr(t)
    assert tokenizer.get_supported_languages() == ["yoruba", "igbo", "hausa", "pidgin", "naija"] and len(tokenizer.LANGUAGES) == 15
    with pytest.raises(ValueError):
        tokenizer.Tokenizer("french")


def test_metrics(spark):
    rows = [("ojo dara", "ọjọ́ dára", "ọjọ́ dára"), ("ile", "ilé", "ilẹ̀"), ("a b", "a", "a b"), ("", "", ""), ("x", None, "x")]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, input string, predicted string, expected string")
    got = metrics.evaluate(pairs, "yoruba").first()
    real = [r for r in rows if r[1] is not None]
    marks = lambda t: {(i, c) for i, c in enumerate(t) if c in metrics.MARKED["yoruba"]}
    tp, fp, fn = (sum(len(f(marks(p), marks(e))) for _, p, e in real) for f in (set.__and__, set.__sub__, lambda a, b: b - a))
    pairs_ = [list(zip(p.split(), e.split())) for _, p, e in real]
    assert got["total_words"] == sum(map(len, pairs_)) and got["correct_words"] == sum(a == b for x in pairs_ for a, b in x)
    assert got["diacritic_precision"] == pytest.approx(tp / (tp + fp)) and got["diacritic_recall"] == pytest.approx(tp / (tp + fn))
    assert (got["total_sentences"], got["correct_sentences"]) == (4, 2)
    assert [r["ord"] for r in metrics.sample_errors(pairs, "ord").collect()] == [1, 2]
    m = metrics.DiacritizerMetrics.of(metrics.evaluate(pairs, "yoruba"), "v1", "2026-01-01")
    assert m.to_dict()["date"] == "2026-01-01" and "word accuracy" in m.summary()
    dots = metrics.dot_below_accuracy(pairs).first()
    assert dots["dot_below_recall"] == pytest.approx(2 / 3) and metrics.compare(metrics.dot_below_accuracy(pairs), metrics.full_accuracy(pairs)).count() == 2
    zero = metrics.evaluate(pairs.limit(0), "igbo").first()
    assert zero["word_accuracy"] == 0 and zero["diacritic_f1"] == 0
    assert {r["ord"] for r in metrics.sampled(pairs, "ord", 3).collect()} == {r["ord"] for r in metrics.sampled(pairs.repartition(4), "ord", 3).collect()}
    with pytest.raises(ValueError):
        metrics.evaluate(pairs, "latin")


def test_token_costs(spark):
    entries = spark.createDataFrame([(1, "g", "good day", "ẹ káàsán o", "x"), (2, "g", "", "rárá", "y")], "id int, category string, eng string, yor string, hau string")
    kinds = {"word": lambda t: F.filter(F.split(t, " "), lambda w: w != ""), "char": metrics.chars}
    results = tokencost.run_benchmark(entries, kinds, {"eng": "English", "yor": "Yorùbá", "hau": "Hausa"})
    rows = {(r["entry_id"], r["language"], r["tokenizer"]): r for r in results.collect()}
    assert len(rows) == 12 and rows[1, "yor", "word"]["token_ratio_vs_english"] == 1.5 and rows[2, "yor", "word"]["token_ratio_vs_english"] == math.inf
    stats = {(r["language"], r["tokenizer"]): r for r in tokencost.aggregate_stats(results).collect()}
    assert stats["yor", "word"]["cost_multiplier_vs_english"] == 2.0 and stats["yor", "word"]["estimated_naira_per_1m_equiv"] == 6750
    assert stats["yor", "word"]["worst_word"] == "rárá" and tokencost.most_expensive(tokencost.aggregate_stats(results)).first()["language"] == "yor"
    assert tokencost.top_worst(results, 3).count() == 3
