"""Text functions: single values, and a plain restatement of each rule on generated strings."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sabitext import functions
from sabitext.functions import normalize, syllables, text
from sabitext.sources import dims

R = random.Random(11)
PARTS = ["ọjọ́", "Dára", "ẹ̀kọ́", "é", "İ", " ", "\t", " ", "\n", "\x1f", " ", "aaaa", "!!!!!", "@me", "#tag", "http://x.y/z?q", "www.a.b", "me@example.com", "08031234567", "+234 803 123 4567", "22123456789", "12345678901", "N5,000", "NGN 20", "₦1.50", "AMEN, ", "sha", "the", "ß", "Å", "ñ", "'", "-", "١٢٣", "", "́", "a_b"]
SAMPLES = ["".join(R.choice(PARTS) for _ in range(R.randint(0, 12))) for _ in range(400)] + ["", " ", "́"]


def applied(spark, column, values=SAMPLES):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(rows.select("i", column(F.col("x"))).collect())]


PHONE = re.compile(r"(?:0|\+?234)[\s-]?[789][01]\d[\s-]?\d{3}[\s-]?\d{4}")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
MONEY = re.compile(r"(?:₦|NGN|N)\s?[\d,]+(?:\.\d\d)?")


def mask(t):
    t = MAIL.sub("[EMAIL]", PHONE.sub("[PHONE]", t))
    t = re.sub(r"\b22\d{9}\b", "[BVN]", t)
    return re.sub(r"(?<!\d)\d{11}(?!\d)", "[NIN]", t)


def social(t):
    t = re.sub(r"https?://\S+|www\.\S+", "", t)
    t = re.sub(r"(.)\1{3,}", r"\1\1", re.sub("@[A-Za-z0-9_]+", "", t))
    return re.sub(r"\s+", " ", t).strip()


def bare(t):
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def kept(t):
    gone = {"the"}
    return " ".join(w for w in t.split() if w.lower().strip(".,!?;:'\"") not in gone)


@pytest.mark.parametrize(
    ("column", "rule"),
    [
        (text.mask_pii, mask),
        (text.clean_social_media, social),
        (text.strip_diacritics, bare),
        (text.find_phones, PHONE.findall),
        (text.find_naira_amounts, MONEY.findall),
        (text.extract_hashtags, re.compile("#([A-Za-z0-9_]+)").findall),
        (text.extract_mentions, re.compile("@([A-Za-z0-9_]+)").findall),
        (normalize.normalize_unicode, lambda t: unicodedata.normalize("NFC", t)),
        (lambda c: normalize.normalize_unicode(c, "NFKD"), lambda t: unicodedata.normalize("NFKD", t)),
        (lambda c: text.preserve_pidgin_particles(c, ["the", "sha"]), kept),
        (text.words_of, str.split),
        (lambda c: text.clean_text(c, mask_pii_data=True), lambda t: mask(social(unicodedata.normalize("NFC", t)))),
        (text.normalize_naira_symbol, lambda t: re.sub(r"(?<![A-Za-z])N(?=\d)", "₦", re.sub(r"NGN\s?(?=\d)", "₦", t))),
    ],
)
def test_like_the_rule(spark, column, rule):
    assert applied(spark, column) == [rule(t) for t in SAMPLES]
    assert applied(spark, column, [None]) == [None]


def test_tones_only(spark):
    assert applied(spark, lambda c: text.strip_yoruba_diacritics(c, tones_only=True), ["Ọjọ́ dára ẹ̀ ṣé ñ"]) == ["Ọjọ dara ẹ ṣe ñ"]
    assert applied(spark, lambda c: text.strip_yoruba_diacritics(c, tones_only=True, exact=True), [unicodedata.normalize("NFD", "Ọjọ́ dára")]) == ["Ọjọ dara"]


@pytest.mark.parametrize(
    ("lang", "word", "want"),
    [("yor", "nkan", "n ka n"), ("yor", "ilé", "i lé"), ("yor", "dára", "dá ra"), ("yor", "gbogbo", "g bo g bo"), ("yor", "", ""), ("yor", "12a", "12 a"), ("yor", "ọjọ́", "ọ jọ́"), ("ibo", "nwanne", "nwa n ne"), ("ibo", "chukwu", "chu kwu"), ("ibo", "ṅụ", "ṅụ"), ("ibo", "gh", "gh"), ("ibo", "a-b", "a- b")],
)
def test_syllables(spark, lang, word, want):
    got = applied(spark, lambda c: syllables.syllabify(c, lang), [word])[0]
    assert " ".join(got) == want and "".join(got) == word


def test_segments(spark):
    got = applied(spark, syllables.segment, ["Ọjọ́ dára!"])[0]
    assert [(t["token"], t["is_word"]) for t in got] == [("Ọjọ", True), ("́", False), (" ", False), ("dára", True), ("!", False)]
    with pytest.raises(ValueError):
        syllables.syllabify(F.lit("x"), "eng")


@pytest.mark.parametrize(("phone", "valid", "whole", "telco"), [("08031234567", True, "+2348031234567", "MTN"), ("234-802-123-4567", True, "+2348021234567", "Airtel"), ("+234 805 123 4567", True, "+2348051234567", "Glo"), ("0803", False, None, "MTN"), ("05031234567", False, None, None), ("", False, None, None), (None, None, None, None)])
def test_phones(spark, phone, valid, whole, telco):
    row = spark.createDataFrame([(phone,)], "x string").select(text.is_valid_phone(F.col("x")), text.normalize_phone(F.col("x")), text.get_telco(F.col("x"))).first()
    assert tuple(row) == (valid, whole, telco)


@pytest.mark.parametrize(("given", "want"), [("₦1,500,000.00", 1500000.0), ("NGN 50,000", 50000.0), ("1e3", 1000.0), ("x", None), ("", None), (".5", 0.5), ("1d", None)])
def test_parse_naira(spark, given, want):
    assert applied(spark, text.parse_naira, [given]) == [want]


def test_format_and_numbers(spark):
    row = spark.sql("select 1500000.0D as a, -0.5D as b, '22123456789' as c, '1234567890' as d, 'ụnụ' as e, 'bia' as f").select(text.format_naira(F.col("a")), text.format_naira(F.col("a"), False), text.format_naira(F.col("b")), text.is_valid_bvn(F.col("c")), text.is_valid_nin(F.col("c")), text.is_nuban(F.col("d")), text.vowel_harmony(F.col("e")), text.vowel_harmony(F.col("f")), text.diacritization_ratio(F.col("e"))).first()
    assert tuple(row) == ("₦1,500,000.00", "₦1,500,000", "₦-0.50", True, True, True, "RTR", None, 1.0)


def test_masks_with_special_characters(spark):
    assert applied(spark, lambda c: text.mask_pii(c, phone_mask="$1\\"), ["08031234567"]) == ["$1\\"]


def test_sql_functions(spark):
    assert len(functions.register(spark)) == len(functions.SQL_FUNCTIONS)
    assert spark.sql("select mask_pii('mail me@example.com') m, syllabify_yoruba('dara') s, strip_diacritics('é') d").first() == ("mail [EMAIL]", ["da", "ra"], "e")


def test_dimensions(spark):
    assert (len(dims.STATES), sum(map(len, dims.LGAS.values())), len(dims.BANKS), len(dims.TELCO_PREFIXES), len(dims.get_pidgin_particles())) == (37, 73, 29, 33, 55)
    assert dims.STATES["Lagos"] == "Ikeja" and dims.BANKS["Access Bank"] == "044" and dims.TELCO_PREFIXES["0809"] == "9mobile"
    assert dims.states(spark).count() == 37 and dims.lgas(spark).count() == 73
