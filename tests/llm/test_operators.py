"""The ten operators against brute force, round trips and held-out rows, and on awkward rows."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sabitext.llm import chat, decontam, lm_score, media, minhash, mixing, mpeg_synth, quality, secret_scan, tokens, toxicity, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghijklmnoprstuvwz") for _ in range(R.randint(2, 9))) for _ in range(3000)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def awkward(spark):
    """NULLs everywhere, empty and long texts, repeated rows."""
    long = prose(60_000, 1)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text without an id", None, None, None), (3, long, "en", "a", len(long)), (4, "ok", "en", None, 2), (4, "ok", "en", None, 2), (5, "\0 \n ***", "en", "b", 7), (6, "é" * 50, "fr", "b", 50)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "sig": F.lit("x"), "toxic": F.lit("t"), "key": F.lit(2), "label_id": F.lit("z")})


# --- 1


def test_near_duplicates_match_brute_force(spark):
    rows = []
    for k in range(60):
        t = prose(120, k)
        rows.append((k, t))
        if k % 3 == 0:
            w = t.split()
            w[5], w[70] = "changed", "too"
            rows += [(1000 + k, " ".join(w)), (2000 + k, t)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_doc_id"] for r in minhash.near_duplicates(docs).collect()}
    ids = [r[0] for r in rows]
    _, sig = minhash.signatures(pa.array([r[1] for r in rows]))
    root = dict(zip(ids, ids))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (sig[i] != sig[j]).sum() <= minhash.ERRORS:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    assert got == {i: find(i) for i in ids if find(i) != i}
    assert len(got) == 40
    kept = {r["doc_id"] for r in minhash.deduplicated(docs).collect()}
    assert kept == set(range(60))


def test_every_pair_within_the_errors_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (200, minhash.PLACES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.PLACES, minhash.ERRORS, replace=False)
        row[at] ^= 1
    keys = [set(next(minhash._keys(iter([pa.record_batch([pa.array([0]), minhash._binary(s[None])], ["id", "sig"])]))).column("key").to_pylist()) for s in (*a, *b)]
    assert all(keys[k] & keys[200 + k] for k in range(200))


# --- 2


def test_secrets_are_found_and_words_left_alone(spark):
    r = random.Random(3)
    secret = {k: "".join(r.choice("0123456789abcdef") for _ in range(40)) for k in range(0, 200, 10)}
    rows = [(k, prose(200, k) + (f' token = "{secret[k]}" end' if k in secret else ""), "en", "a", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(x["doc_id"], x["secret"]): (x["begin"], x["end"]) for x in secret_scan.secrets(docs).collect()}
    assert set(got) == set(secret.items())
    assert all(rows[k][1][b:e] == s for (k, s), (b, e) in got.items())
    clean = {x["doc_id"]: x for x in secret_scan.redacted(docs).collect()}
    assert all(secret[k] not in clean[k]["text"] and secret_scan.MASK in clean[k]["text"] and clean[k]["n_chars"] == len(clean[k]["text"]) for k in secret)
    assert all(clean[k]["text"] == rows[k][1] for k in range(200) if k not in secret)


def test_secrets_joined_to_words_are_found(spark):
    r = random.Random(4)
    draw = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    hexa, plain = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = [("key-", 32, hexa), ("token_", 40, hexa), ("/v1/", 40, hexa), ("/api_v2/my-app/", 40, hexa), ("ghp_", 36, plain), ("my-app_", 64, hexa)]
    rows, want = [], {}
    for k in range(240):
        prefix, n, letters = forms[k % len(forms)]
        want[k] = draw(n, letters)
        rows += [(k, f"{prose(100, k)} {prefix}{want[k]} {prose(100, 900 + k)} some-long_word/and-a_path/of-words", "en", "a", 1), (1000 + k, f"{prose(200, k)} {want[k]} end", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(x["doc_id"], x["secret"]) for x in secret_scan.secrets(docs).collect()}
    alone = {k for k in want if (1000 + k, want[k]) in got}
    joined = {k for k, s in got if k < 1000 and want[k] in s}
    assert len(alone) >= 0.8 * len(want) and alone <= joined
    assert all(s in forms[k % len(forms)][0] + want[k] for k, s in got if k < 1000)
    assert sum((k, want[k]) in got for k in alone if k % len(forms) != 4) >= 0.95 * len(alone) * 5 / 6  # GitHub's prefix may be told with its key
    clean = {x["doc_id"]: x["text"] for x in secret_scan.redacted(docs).collect()}
    assert not any(want[k] in clean[k] for k in alone)
    assert all("some-long_word/and-a_path/of-words" in clean[k] for k in want)


def test_uniformity_rejects_what_is_not_random():
    rng = np.random.default_rng(0)
    n, size = np.full(400, 40.0), np.full(400, 16)
    p = secret_scan.uniformity(rng.integers(0, 16, (400, 40)), n, size)
    assert (p.min(1) * 3 < 0.001).mean() < 0.02
    constant, ramp = np.full((1, 40), 3), np.repeat(np.arange(16), 3)[None, :40]
    assert secret_scan.uniformity(constant, n[:1], size[:1]).min() < 1e-4
    assert secret_scan.uniformity(ramp, n[:1], size[:1]).min() < 1e-4


def test_benjamini_hochberg_is_exact_on_levels():
    rng = np.random.default_rng(2)
    table = np.zeros((secret_scan.STRATA, secret_scan.BINS), np.int64)
    table[0, :40] = rng.integers(0, 50, 40)
    table[0, 300] = 7
    cut = secret_scan.benjamini_hochberg(table, secret_scan.ALPHA)[0]
    p = sorted(10 ** (-k / 20) for k in range(secret_scan.BINS) for _ in range(table[0, k]))
    largest = max((x for i, x in enumerate(p, 1) if x <= secret_scan.ALPHA * i / len(p)), default=None)
    assert largest is not None and table[0, cut:].sum() == sum(x <= largest for x in p) == 7


def test_both_cuts_match_brute_force():
    """The whole procedure on a table of candidates: discoveries against text, then rejections among them, each by sorting."""
    rng = np.random.default_rng(5)
    s, k, r = rng.integers(0, 2, 3000), np.minimum(rng.geometric(0.05, 3000), 80), rng.integers(0, 30, 3000)
    k[:300] = rng.integers(150, 400, 300)
    r[:60] = rng.integers(90, 199, 60)
    table = np.zeros((secret_scan.STRATA, secret_scan.BINS, secret_scan.RBINS + 1), np.int64)
    np.add.at(table, (s, k, r + 1), 1)
    text, reject = secret_scan.cuts_of(table)

    def discovered(p, alpha):
        order = sorted(p)
        best = max((x for i, x in enumerate(order, 1) if x <= alpha * i / len(order)), default=-1)
        return [x <= best for x in p]

    for stratum in (0, 1):
        own = np.flatnonzero(s == stratum)
        unlike = own[discovered([10 ** (-k[i] / 20) for i in own], secret_scan.ALPHA)]
        thrown = set(unlike[discovered([10 ** (-r[i] / 20) for i in unlike], secret_scan.REJECT)].tolist())
        assert 150 > len(thrown) > 10 and set(unlike.tolist()) == {i for i in own.tolist() if k[i] >= text[stratum]}
        assert thrown == {i for i in unlike.tolist() if r[i] >= reject[stratum]}


def test_secrets_of_letters_alone_and_many_in_one_text(spark):
    r = random.Random(8)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = {k: "".join(r.choice(lower + upper if k % 2 else upper) for _ in range(40)) for k in range(0, 100, 5)}
    rows = [(k, prose(300, k) + (f" é {keys[k]} end" if k in keys else " 1234567890123456789 thequickbrownfoxjumps"), "en", "a", 1) for k in range(100)]
    many = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows.append((1000, "ü " + " ".join(many), "en", "a", 1))
    got = secret_scan.secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {row[0]: row[1] for row in rows}
    assert all(text[x["doc_id"]][x["begin"] : x["end"]] == x["secret"] for x in got)
    assert {x["doc_id"] for x in got} <= set(keys) | {1000}
    assert sum(keys.get(x["doc_id"]) == x["secret"] for x in got) >= 18
    assert len({x["secret"] for x in got if x["doc_id"] == 1000} & set(many)) >= 55


# --- 3


def test_chat_round_trip(spark):
    nasty = "<|end|> and <\\|start|> and <|im_end|> " + prose(50, 1)
    rows = [(1, 2, "assistant", nasty), (1, 1, "user", "Hi <|assistant|>"), (1, 3, "wizard", "ok"), (2, 1, "assistant", None), (2, None, "USER", ""), (2, 1, "assistant", None), (None, 1, "user", "lost"), (3, 1, None, prose(40_000, 2))]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {1, 2, 3} and [got[k]["n_turns"] for k in (1, 2, 3)] == [3, 3, 1]
    enc, base = tokens.encoder(), tokens.free_id()
    for k, r in got.items():
        ids, mask = r["input_ids"], list(r["loss_mask"])
        assert r["n_tokens"] == len(ids) == len(mask) and sum(mask) == r["n_targets"]
        turns, i = [], 1
        assert ids[0] == base + chat.BEGIN
        while i < len(ids):
            assert ids[i] == base + chat.START
            sep, end = ids.index(base + chat.SEP, i), ids.index(base + chat.END, i)
            role = ids[i + 1 : sep]
            name = chat.ROLES[role[0] - base - 4] if role and role[0] >= base else chat.unescaped(enc.decode(role))
            turns.append((name, chat.unescaped(enc.decode(ids[sep + 1 : end]))))
            assert mask[i : end + 1] == [0] * (sep + 1 - i) + [int(name == "assistant")] * (end - sep)
            i = end + 1
        want = sorted([x for x in rows if x[0] == k], key=lambda x: (x[1] is None, x[1]))
        assert turns == [((x[2] or "").lower(), x[3] or "") for x in want]


def test_escaping_is_exact():
    for t in ("<|end|>", "<\\|end|>", "<\\\\|END|>", "a<|user|>b<|x|>", "", "|>"):
        assert chat.unescaped(chat.escaped(t)) == t
        assert not re.search(r"<\|(end|user)\|>", chat.escaped(t), re.I)


def test_long_blanks_give_the_librarys_ids(monkeypatch):
    enc, r = tokens.encoder(), random.Random(1)
    texts = ["a" + " " * n + tail for n in (9_999, 10_000, 12_345) for tail in ("b", "", "\n", " \t!")]
    assert all(tokens.ids_of(enc, t) == enc.encode_ordinary(t) for t in texts)
    assert enc.decode(tokens.ids_of(enc, "x" + " \n" * 500_000 + "y")) == "x" + " \n" * 500_000 + "y"
    monkeypatch.setattr(tokens, "_SPACE", re.compile(tokens._SPACE.pattern.replace("10000", "3")))
    for _ in range(300):  # the same cuts on short runs
        t = "pad " * 3000 + "".join(r.choice(["ab", " ", "\n", "\t", "  ", "\u00a0", "x1", "é", "'s", "   ", "!", "\x1c"]) for _ in range(r.randint(1, 14)))
        assert tokens.ids_of(enc, t) == enc.encode_ordinary(t)


# --- 4


def edits(pattern, text):
    """Least edits of pattern against any stretch of text."""
    row = [0] * (len(text) + 1)
    for c in pattern:
        new = [row[0] + 1]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_what_brute_force_finds():
    r = random.Random(9)
    items = [(k, prose(40, 500 + k)) for k in range(8)]
    bench = decontam.Benchmark(items)
    texts = []
    for k in range(40):
        t = prose(80, k)
        if k % 2:
            passage = list(items[k % 8][1][:150])
            for _ in range(k % 12):
                at = r.randrange(len(passage))
                passage[at] = r.choice(["", "x", passage[at] + "y"])
            t = t[:200] + " " + "".join(passage) + " " + t[200:]
        texts.append(t)
    got = {(row, item) for row, item, *_ in bench.search([*texts, None, ""])}
    want = set()
    for row, t in enumerate(texts):
        c = [int(x) for x in decontam.normalised([t]).chars[1:]]
        for item, begin, length, budget, own in zip(bench.item.tolist(), bench.begin, bench.length, bench.budget, bench.own):
            if own and (row, item) not in want and edits(bench.chars[begin : begin + length].tolist(), c) <= budget:
                want.add((row, item))
    assert got == want and len(want) >= 12


def test_every_passage_of_the_least_length_is_found():
    r = random.Random(21)
    items = [(k, prose(n, 700 + k)) for k, n in enumerate((10, 16, 40))]
    bench = decontam.Benchmark(items)
    texts, want = [], []
    for item, text in items:
        c = "".join(map(chr, decontam.normalised([text]).chars[1:])).rstrip()
        for n in (decontam.PASSAGE, 100):
            for s in range(0, len(c) - n + 1, 1 if n < 100 else 5):
                want.append((len(texts), item))
                texts.append(f"{prose(12, s)} {c[s : s + n]} {prose(r.randint(0, 12), s + 1)}")
    assert decontam.PASSAGE <= 70 and len(want) > 200
    got = {(row, item) for row, item, *_ in bench.search(texts)}
    assert not set(want) - got
    assert bench.search([prose(300, 3000 + k) for k in range(10)]) == []


COMMON_FIRST = sorted({"".join(random.Random(k).choices("etaoinshrdlucmfw", k=2 + k % 9)) for k in range(20_000)}, key=len)


def zipf(n: int, seed: int) -> str:
    """Words as uneven as real ones: the k-th of 20,000, shorter ones first, has 1 / k of the first's share."""
    return " ".join(random.Random(seed).choices(COMMON_FIRST, [1 / k for k in range(1, len(COMMON_FIRST) + 1)], k=n))


def test_search_grows_little_with_the_benchmark():
    """Common phrases are pruned: candidates for a text without passages, of words as uneven as real ones, stay far below its characters."""
    texts = [zipf(4000, 50_000 + k) for k in range(4)]
    chars = decontam.normalised(texts).chars
    seen = []
    for n in (300, 3000):
        bench = decontam.Benchmark([(k, zipf(60, k)) for k in range(n)])
        bench._ready()
        assert bench.search(texts) == []
        seen.append(len(bench._seeds(chars)[0]) / len(chars))
    assert seen[0] < 0.05 and seen[1] < 0.2, seen
    planted = bench.chars[bench.begin[70] : bench.begin[70] + 48].tolist()
    assert bench.item[70] in {item for _, item, *_ in bench.search([texts[0] + " " + "".join(map(chr, planted)) + " " + texts[1]])}


def test_rarest_pieces_are_disjoint_and_least():
    import itertools

    rng = np.random.default_rng(4)
    cost = rng.integers(1, 50, (20, 24))
    for row, at in zip(cost, decontam.rarest(cost, 2)):
        best = min(row[a] + row[b] for a, b in itertools.combinations(range(24), 2) if b - a >= decontam.SEED)
        assert row[at].sum() == best and abs(at[1] - at[0]) >= decontam.SEED


# --- 5


def test_url_rules_match_brute_force(spark):
    r = random.Random(4)
    hosts = ["example.com", "a.example.com", "b.a.example.com", "example.org", "xexample.com", "example.co"]
    paths = ["", "/", "/a", "/a/b", "/ab", "/a/../c", "/a//b?x=1", "/%61/b", "/a/./b/"]
    urls = [(k, f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'u@'])}{r.choice(hosts).upper() if k % 5 == 0 else r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(paths)}{r.choice(['', '#f'])}") for k in range(300)]
    urls += [(500, None), (501, "no url"), (502, ""), (503, "http://"), (None, "http://example.com/a"), (1, urls[1][1])]
    rules = [(1, "example.com", "block"), (2, "a.example.com", "allow"), (3, "example.com/a", "allow"), (4, "example.com/a/b", "block"), (5, "com", "allow"), (6, "example.com", "block"), (7, None, "block"), (8, "example.org/", "odd"), (9, "example.com/a", "block")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("key", F.lit(1))
    table = spark.createDataFrame(rules, "rule_id bigint, pattern string, action string")
    keys = pages.select("page_id", url_filter.key_of(F.col("url")).alias("k")).collect()
    prefixes = [(x["rule_id"], x["k"], x["action"]) for x in table.select("rule_id", "action", url_filter.key_of(F.col("pattern"), True).alias("k")).collect() if x["k"] and x["action"] in ("block", "allow")]
    want = []
    for x in keys:
        met = [p for p in prefixes if x["k"] and x["k"].startswith(p[1])]
        best = min(met, key=lambda p: (-len(p[1]), p[2] != "block", p[0])) if met else (None, None, None)
        want.append((x["page_id"], best[0], best[2], len(met)))
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(x) for x in url_filter.decided(pages, table).collect()) == order(want)
    assert url_filter.decided(pages.limit(0), table).count() == 0
    none = url_filter.decided(pages, table.limit(0)).collect()
    assert len(none) == len(urls) and all(x["rule_id"] is None for x in none)
    # by row: a page_id may be repeated or NULL, and every column stays
    allowed = [u for u, w in zip(urls, want) if w[2] != "block"]
    left = url_filter.filtered(pages, table)
    assert left.columns == pages.columns and order((x["page_id"], x["url"]) for x in left.collect()) == order(allowed)
    mixed = spark.createDataFrame([(1, "http://bad.com"), (1, "http://good.com"), (None, "http://bad.com"), (None, None)], "page_id bigint, url string")
    bad = spark.createDataFrame([(1, "bad.com", "block")], "rule_id bigint, pattern string, action string")
    assert order(tuple(x) for x in url_filter.filtered(mixed, bad).collect()) == order([(1, "http://good.com"), (None, None)])


def test_a_hot_url_is_dealt_out(spark):
    hot = spark.createDataFrame([(k, "http://example.com/a" if k % 3 else f"http://h{k}.org/") for k in range(3000)], "page_id bigint, url string")
    rules = spark.createDataFrame([(1, "example.com", "block"), (2, "example.com/a", "allow")], "rule_id bigint, pattern string, action string")
    got = url_filter.decided(hot, rules)
    assert {(x["page_id"], x["rule_id"], x["n_rules"]) for x in got.collect()} == {(k, 2 if k % 3 else None, 2 if k % 3 else 0) for k in range(3000)}
    sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1500


@pytest.mark.parametrize(("url", "key"), [("http://www.Example.com", "com.example./"), ("https://a.b.c/x/../y?q=1#z", "c.b.a./y?q=1"), ("//h./%7Eu", "h./~u"), ("http://h/a%zz", "h./a%zz"), ("http://h?x", "h./?x"), ("http://h/a/..", "h./"), ("mailto:x", None), ("http://h/a%3Fb/../c", "h./c"), ("http://h/a%2F..%2fb", "h./a%2F..%2Fb"), ("http://h/x/%2E%2e/y?z=%2F%41", "h./y?z=%2FA"), ("http://h/100%25?a%3f", "h./100%25?a%3F"), ("http://h/" + "a/" * 5000 + "../b", "h./" + "a/" * 4999 + "b")])
def test_url_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(url_filter.key_of(F.col("u"))).first()[0] == key


# --- 6, 8


def test_factorization_machine_learns_pairs():
    r = random.Random(2)
    texts, label = [], []
    for k in range(1600):
        words = r.sample(WORDS[:200], 12)
        a, b = r.random() < 0.5, r.random() < 0.5
        words += ["insultword"] * a + ["groupword"] * b
        r.shuffle(words)
        texts.append(" ".join(words))
        label.append(int(a and b))
    terms = [np.unique(toxicity.terms_of(pa.array([t]))[0]) for t in texts]
    model = toxicity.fit(terms[:1200], np.array(label[:1200]), float(np.mean(label)))
    found = model.scores(pa.array(texts[1200:])) >= 0.5
    assert (found == np.array(label[1200:], bool)).mean() > 0.97
    assert not (model.scores(pa.array(["", None, "insultword alone here", "groupword alone here"], pa.string())) >= 0.5).any()
    assert toxicity.fit(terms[:5], np.zeros(5), 0.0) is None


def test_additive_model_holds_out():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5) | (x[:, 2] > 0.9)).astype(int)
    model = quality.fit(x[:3000], y[:3000], y.mean())
    right = ((model.logits(model.bins(x[3000:])) > 0) == (y[3000:] == 1)).mean()
    assert right > 0.95 and (0, 1) in model.pairs
    assert quality.fit(x[:10], np.ones(10), 1.0) is None


def test_quality_features_match_brute_force():
    texts = ["The cat. The dog!\nThe cat.\n12 | x", "", "héllo WORLD worlds $$$", prose(300, 1)]
    x, some = quality.features(pa.array(texts))
    assert some.tolist() == [True, False, True, True]
    for t, row in zip(texts, x):
        raw, words = t.encode(), [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", t)]
        lines = [z for z in t.split("\n") if z]
        want = {"log_words": math.log1p(len(words)), "digits": sum(c.isdigit() for c in t) / max(1, len(raw)), "distinct_words": len(set(words)) / max(1, len(words)), "top_word": max(collections.Counter(words).values(), default=0) / max(1, len(words)), "repeated_lines": 1 - max(1, len(set(lines))) / max(1, len(lines)), "ended_lines": sum(z[-1] in ".,;:!?" for z in lines) / max(1, len(lines)), "bars": t.count("|") / max(1, len(raw))}
        for name, value in want.items():
            assert math.isclose(row[quality.FEATURES.index(name)], value, abs_tol=1e-12), name


def labelled(n: int):
    rows, labels = [], []
    for k in range(n):
        bad, toxic = k % 4 == 0, k % 5 == 0
        t = prose(80, k)
        t = " | ".join(t.split()) + " ###" if bad else t
        rows.append((k, t + (" you vile idiot scum" if toxic else ""), "en", "a", 1))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


@pytest.mark.parametrize(("module", "name", "hit"), [(toxicity, "is_toxic", lambda k: k % 5 == 0), (quality, "is_good", lambda k: k % 4 != 0)])
def test_classifiers_on_tables(spark, module, name, hit):
    rows, labels = labelled(400)
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([*labels[:300], (None, 1, 1), (7, None, None), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = module.train(docs, table)
    got = {r["doc_id"]: r[name] for r in module.scored(docs, model).collect()}
    assert np.mean([got[k] == hit(k) for k in range(300, 400)]) > 0.95
    assert module.train(docs, table.limit(0)) is None
    assert module.scored(awkward(spark), model).count() == 8
    assert module.scored(docs.limit(0), model).count() == 0
    assert module.scored(awkward(spark), None).count() == 8


# --- 7


def brute_frames(data: bytes) -> list[int]:
    """Frame places by a plain walk with the operator's rules."""

    def length(i):
        if i + 3 >= len(data) or data[i] != 0xFF:
            return 0
        code = data[i + 1] << 8 | data[i + 2]
        return int(media._LENGTH[code]) if media._KIND[code] >= 0 else 0

    def linked(i, end):
        n = length(i)
        j = i + n
        return n and (j == end or (j < end - 3 and length(j) and media._KIND[data[j + 1] << 8 | data[j + 2]] == media._KIND[data[i + 1] << 8 | data[i + 2]]))

    i, end, _, _ = media.tags(data)
    out, confirmed = [], False
    while i < end:
        if linked(i, end):
            out.append(i)
            i, confirmed = i + length(i), True
            continue
        j = next((c for c in range(i + 1, end - 3) if linked(c, end)), end)
        n = length(i)
        if n and confirmed and i + n <= j:
            out.append(i)
        i, confirmed = j, False
    return out


def test_audio_matches_brute_force():
    r = random.Random(8)
    files = []
    for k in range(60):
        payload = bytes(r.randrange(256) for _ in range(r.randrange(1, 9000)))
        sound = mpeg_synth.frames(payload, [0x90] if k % 3 else [0x90, 0x80, 0xA0], k % 2 == 0)
        parts = ([mpeg_synth.id3v2("Tïtle", "x")] if k % 2 else []) + ([mpeg_synth.xing(sound, b"Xing")] if k % 4 == 0 else []) + sound
        if k % 5 == 0:
            parts.insert(r.randrange(len(parts) + 1), bytes(r.randrange(256) for _ in range(r.randrange(1, 900))))
        data = b"".join(parts) + (b"TAG" + bytes(125) if k % 7 == 0 else b"")
        if k % 6 == 0:
            cut = r.randrange(len(data))
            data = data[:cut] + data[cut + r.randrange(50) :]
        files.append(data)
    for data, got in zip(files, media.parsed(pa.array(files))):
        want = brute_frames(data)
        table = bool(want) and media.vbr_table(data[want[0] : want[0] + 417]) is not None
        assert list(got["seek"]) == want[table:] if want else got["n_frames"] == 0
        if want:
            assert got["duration_ticks"] == 1152 * len(want[table:]) * 320 and got["duration_s"] == got["duration_ticks"] / media.TICKS


def test_audio_checksums_and_tags():
    sound = mpeg_synth.frames(bytes(3000), [0x90], True)
    bad = bytearray(b"".join(sound))
    bad[417 + 20] ^= 1
    good, broken, none, empty, mono = media.parsed(pa.array([mpeg_synth.id3v2("T", "A") + b"".join(sound), bytes(bad), None, b"", b"junk" * 100], pa.binary()))
    assert (good["crc_frames"], good["crc_failed"], broken["crc_failed"]) == (len(sound), 0, 1)
    assert (good["title"], good["artist"], good["tag_version"]) == ("T", "A", "2.3")
    assert none["n_frames"] == empty["n_frames"] == mono["n_frames"] == 0 and none["duration_ticks"] is None
    head = bytearray(mpeg_synth.xing(sound, b"Info"))
    at = 4 + 32 + 8 + 4 + 4 + 100 - 0
    head[36 + 4 + 3] = 7
    head[at : at + 9] = b"LAME3.100"
    head[at + 21 : at + 24] = (576 << 12 | 1000).to_bytes(3, "big")
    head[at + 34 : at + 36] = media.crc_lsb(bytes(head[: at + 34])).to_bytes(2, "big")
    (got,) = media.parsed(pa.array([bytes(head) + b"".join(sound)]))
    assert (got["vbr_table"], got["encoder_delay"], got["encoder_padding"], got["vbr_crc_ok"]) == ("Info", 576, 1000, True)
    assert got["n_samples"] == 1152 * len(sound) - 1576 and got["vbr_frames"] == len(sound)


def layer2_frame(r: random.Random, bitrate: int, rate: int, mode: int, ext: int, version: int = 3) -> bytes:
    """A layer II frame of random bits with its checksum, bit by bit from the standard's tables, which are written out again here."""
    kbps = [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384][bitrate] if version == 3 else [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160][bitrate]
    hz = [[44100, 48000, 32000], [22050, 24000, 16000]][version != 3][rate]
    each = kbps if mode == 3 else kbps // 2
    if version != 3:
        nbal = "444433333332222222222222222222"
    elif each in (32, 48):
        nbal = "443333333333" if hz == 32000 else "44333333"
    elif hz == 48000 or each <= 80:
        nbal = "444444444443333333333332222"
    else:
        nbal = "444444444443333333333332222222"
    size = 144 * kbps * 1000 // hz
    head = [0xFF, 0xE0 | version << 3 | 2 << 1 | 0, bitrate << 4 | rate << 2, mode << 6 | ext << 4]
    body = [r.randrange(256) if r.random() < 0.7 else 0 for _ in range(size - 6)]
    bits = [b >> k & 1 for x in (head[2:], body) for b in x for k in range(7, -1, -1)]
    p, chosen = 16, 0
    bound = 4 * (ext + 1) if mode == 1 else 32
    for sb, w in enumerate(map(int, nbal)):
        for _ in range(1 if mode == 3 or sb >= bound else 2):
            chosen += any(bits[p : p + w]) * (2 if mode != 3 and sb >= bound else 1)
            p += w
    crc = 0xFFFF
    for bit in bits[: p + 2 * chosen]:
        top = crc >> 15 ^ bit
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return bytes([*head, crc >> 8, crc & 255, *body])


def test_layer_two_checksums():
    r = random.Random(6)
    kinds = [(3, 14, 0, 0, 0), (3, 10, 0, 1, 1), (3, 2, 1, 3, 0), (3, 1, 2, 3, 0), (3, 8, 1, 1, 3), (3, 8, 2, 0, 0), (3, 12, 2, 1, 0), (2, 8, 0, 1, 2), (2, 4, 2, 3, 0)]
    files, broken = [], []
    for version, bitrate, rate, mode, ext in kinds:
        frames = [layer2_frame(r, bitrate, rate, mode, ext, version) for _ in range(6)]
        files.append(b"".join(frames))
        bad = bytearray(files[-1])
        bad[len(frames[0]) + 7] ^= 0x10
        broken.append(bytes(bad))
    for got, worse in zip(media.parsed(pa.array(files)), media.parsed(pa.array(broken))):
        assert (got["layer"], got["n_frames"], got["crc_frames"], got["crc_failed"], got["crc_unverified"]) == (2, 6, 6, 0, 0)
        assert worse["crc_failed"] == 1


def test_a_very_long_file_is_parsed_whole():
    sound = mpeg_synth.frames(bytes(R.randrange(256) for _ in range(3_000_000)), [0x90], True)
    (got,) = media.parsed(pa.array([b"junk" * 5000 + b"".join(sound)]))
    assert got["n_frames"] == len(sound) and got["skipped_bytes"] == 20_000 and got["crc_failed"] == 0


def test_audio_of_awkward_documents(spark):
    docs = awkward(spark)
    got = media.audio_columns(docs.select(F.col("doc_id").alias("media_id"), mpeg_synth.as_audio(docs["text"], docs["doc_id"], docs["source"]).alias("content"))).collect()
    assert len(got) == 8 and sum(r["n_frames"] == 0 for r in got) == 1
    assert media.audio_columns(spark.createDataFrame([], "media_id bigint, content binary")).count() == 0


# --- 9


def test_lm_scores_match_brute_force(spark):
    rows = [(k, prose(30, k % 7) + (" extra" if k % 2 else "")) for k in range(30)] + [(3, "a b c a b c"), (None, "a b"), (40, None), (41, ""), (42, "ÉTÉ été")]
    texts = [re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (t or "").lower()) for _, t in rows]
    counts = collections.Counter(tuple(w[i : i + k]) for w in texts for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = sum(map(len, texts))

    def score(w, i, k):
        if k == 1:
            return math.log(counts[(w[i],)] / total)
        g = tuple(w[i - k + 1 : i + 1])
        return math.log(counts[g] / counts[g[:-1]]) if counts[g] >= lm_score.LEAST else math.log(lm_score.BACKOFF) + score(w, i, k - 1)

    want = sorted((str(k), len(w), round(sum(score(w, i, min(3, i + 1)) for i in range(len(w))), 6) if w else None) for (k, _), w in zip(rows, texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_tokens"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in lm_score.scored(docs).collect())
    assert got == want


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.uint64), np.array([5], np.uint64), rng.integers(0, 2**60, 1000).astype(np.uint64), np.ones(70_000, np.uint64)):
        assert (lm_score.unpacked(lm_score.packed(a)) == a).all()


# --- 10


def test_mixing_packs_every_token_and_draws_by_weight(spark):
    rows = [(k, prose(R.randint(1, 300), k), "en", "abc"[k % 3], 1) for k in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mixed(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, length=64, per_shard=32, seed=1).collect()
    shards = len(got) // 32
    assert len(got) == shards * 32 and {(r["shard"], r["position"]) for r in got} == {(s, p) for s in range(shards) for p in range(32)}
    p = np.array([0.5, 0.3, 0.2])
    for s in range(shards):
        assert [sum(r["shard"] == s and r["source"] == x for r in got) for x in "abc"] == mixing.drawn(s, p, 32, 1).tolist()
    enc, end = tokens.encoder(), tokens.free_id()
    blocks = {(r["source"], r["block"]): r for r in got}
    for r in got:
        assert blocks[r["source"], r["block"]]["tokens"] == r["tokens"] and len(r["tokens"]) == 64
    for x in "abc":  # a source drawn for a whole epoch gives each block, and its stream holds every document once
        own = [r for r in got if r["source"] == x and r["epoch"] == 0]
        assert len({r["block"] for r in own}) == len(own)
        of = {r["block"]: r for r in own}
        if len(of) == max(of) + 1:
            stream = [t for b in range(len(of)) for t in of[b]["tokens"][: of[b]["n_tokens"]]]
            texts, at = set(), 0
            while at < len(stream) and end in stream[at:]:
                stop = stream.index(end, at)
                texts.add(enc.decode(stream[at:stop]))
                at = stop + 1
            assert texts <= {t for _, t, _, s, _ in rows if s == x}


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


# --- all of them on awkward rows


@pytest.mark.parametrize("run", [minhash.near_duplicates, minhash.deduplicated, secret_scan.secrets, secret_scan.redacted, lm_score.scored, mixing.mixed], ids=lambda f: f"{f.__module__.split('.')[-1]}.{f.__name__}")
def test_awkward_and_empty_tables(spark, run):
    docs = awkward(spark)
    rows = run(docs).collect()
    assert run(docs.limit(0)).collect() == []
    if run is minhash.deduplicated:
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 2, 3, 4, 5, 6]
    if run in (secret_scan.redacted, lm_score.scored):
        assert len(rows) == 8


def test_awkward_contamination(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, prose(60_000, 1)[5000:5300]), (2, None), (None, "x" * 80), (3, "short"), (1, prose(60_000, 1)[5000:5300])], "item_id bigint, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(3, 1)]
    assert decontam.decontaminated(docs, bench).count() == 7 and decontam.decontaminated(docs, bench).columns == docs.columns
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.decontaminated(docs, bench.limit(0)).count() == 8
