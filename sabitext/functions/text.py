"""Text functions as Column expressions: stripping, cleaning, masking, money, telephones, Pidgin.

All of them run inside the JVM, give NULL for NULL, and work the same on batch
and streaming DataFrames. They can be called from SQL after register(spark).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import PIDGIN, TELCO_PREFIXES
from .chars import TONES, WORD, WS, strip_table
from .normalize import normalize_unicode

URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"
MENTION = r"@([A-Za-z0-9_]+)"
HASHTAG = r"#([A-Za-z0-9_]+)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_LOOSE = rf"(?:0|\+?234)[{WS}\-]?[789][01]\p{{Nd}}[{WS}\-]?\p{{Nd}}{{3}}[{WS}\-]?\p{{Nd}}{{4}}"
PHONE = r"^(?:0|\+?234)[789][01]\p{Nd}\p{Nd}{7}\n?$"
NAIRA = rf"(?:₦|NGN|N)[{WS}]?[\p{{Nd}},]+(?:\.\p{{Nd}}{{2}})?"
BVN, NIN, NUBAN = r"^22\p{Nd}{9}\n?$", r"^\p{Nd}{11}\n?$", r"^\p{Nd}{10}\n?$"


def _literal(mask: str) -> str:
    """A mask as a Java replacement."""
    return re.sub(r"([\\$])", r"\\\1", mask)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body's lambda functions use it."""
    return F.transform(F.array(value), body)[0]


# --- diacritics


def strip_diacritics(text: Column) -> Column:
    """Without nonspacing marks, recomposed."""
    return F.regexp_replace(F.translate(text, *strip_table()), r"\p{Mn}", "")


def strip_yoruba_diacritics(text: Column, tones_only: bool = False, exact: bool = False) -> Column:
    """T3. With tones_only the dot below stays. exact: texts that aren't in NFC are first brought to it (an Arrow UDF)."""
    if not tones_only:
        return strip_diacritics(text)
    if exact:
        text = normalize_unicode(text)
    return F.regexp_replace(F.translate(text, *strip_table(tones_only=True)), f"[{TONES}]", "")


def vowel_harmony(word: Column) -> Column:
    """ATR, RTR or NULL; a counts as RTR."""
    w = F.lower(word)
    light, heavy = w.rlike("[eiou]"), w.rlike("[aịọụ]")
    return F.when(heavy & ~light, F.lit("RTR")).when(light & ~heavy, F.lit("ATR"))


def diacritization_ratio(text: Column) -> Column:
    """Dotted of all vowels that can have a dot; 0 if there are none."""
    dotted, plain = F.regexp_count(F.lower(text), F.lit("[ịọụ]")), F.regexp_count(F.lower(text), F.lit("[iou]"))
    return F.when(text.isNull(), None).when(dotted + plain == 0, 0.0).otherwise(dotted / (dotted + plain))


# --- cleaning


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, none at either end."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def reduce_repeated(text: Column) -> Column:
    """C4: four or more of a character become two."""
    return F.regexp_replace(text, r"(?d)(.)\1{3,}", "$1$1")


def clean_social_media(text: Column, remove_urls: bool = True, remove_mentions: bool = True, remove_hashtags: bool = False, lowercase: bool = False, reduce_repeats: bool = True) -> Column:
    """C7."""
    for wanted, pattern in ((remove_urls, URL), (remove_mentions, MENTION), (remove_hashtags, HASHTAG)):
        text = F.regexp_replace(text, pattern, "") if wanted else text
    text = reduce_repeated(text) if reduce_repeats else text
    return squeeze(F.lower(text) if lowercase else text)


def extract_hashtags(text: Column) -> Column:
    """Array of tags without #."""
    return F.regexp_extract_all(text, F.lit(HASHTAG), 1)


def extract_mentions(text: Column) -> Column:
    """Array of names without @."""
    return F.regexp_extract_all(text, F.lit(MENTION), 1)


def clean_text(text: Column, normalize: bool = True, clean_social: bool = True, mask_pii_data: bool = False, lowercase: bool = False) -> Column:
    """NFC, then C7, masking and lower case. Mentions go before masking, so me@example.com becomes me.com."""
    text = normalize_unicode(text) if normalize else text
    text = clean_social_media(text) if clean_social else text
    text = mask_pii(text) if mask_pii_data else text
    return F.lower(text) if lowercase else text


# --- personal data


def mask_pii(text: Column, phones: bool = True, emails: bool = True, bvn: bool = True, nin: bool = True, naira: bool = False, phone_mask: str = "[PHONE]", email_mask: str = "[EMAIL]", bvn_mask: str = "[BVN]", nin_mask: str = "[NIN]", naira_mask: str = "[AMOUNT]") -> Column:
    """P1 to P6, in this order."""
    steps = (
        (phones, PHONE_LOOSE, phone_mask),
        (emails, EMAIL, email_mask),
        (bvn, rf"(?<![{WORD}])22\p{{Nd}}{{9}}(?![{WORD}])", bvn_mask),
        (nin, r"(?<!\p{Nd})\p{Nd}{11}(?!\p{Nd})", nin_mask),
        (naira, NAIRA, naira_mask),
    )
    for wanted, pattern, mask in steps:
        text = F.regexp_replace(text, pattern, _literal(mask)) if wanted else text
    return text


def find_phones(text: Column) -> Column:
    """P7."""
    return F.regexp_extract_all(text, F.lit(PHONE_LOOSE), 0)


def find_naira_amounts(text: Column) -> Column:
    """P8."""
    return F.regexp_extract_all(text, F.lit(NAIRA), 0)


# --- money


def format_naira(amount: Column, include_kobo: bool = True) -> Column:
    """Half-even kobo, or whole naira cut towards zero."""
    number = F.format_number(amount, 2) if include_kobo else F.format_number(amount.cast("bigint"), 0)
    return F.concat(F.lit("₦"), number)


def parse_naira(text: Column) -> Column:
    """NULL where what is left isn't a number."""
    bare = F.regexp_replace(text, f"[₦NG{WS},]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare).try_cast("double")


def normalize_naira_symbol(text: Column) -> Column:
    """N3."""
    return F.regexp_replace(F.regexp_replace(text, rf"NGN[{WS}]?(?=\p{{Nd}})", "₦"), r"(?<![A-Za-z])N(?=\p{Nd})", "₦")


# --- telephones and numbers


def _digits(phone: Column) -> Column:
    return F.regexp_replace(phone, rf"[{WS}\-]", "")


def is_valid_phone(phone: Column) -> Column:
    """N4."""
    return _digits(phone).rlike(PHONE)


def normalize_phone(phone: Column) -> Column:
    """+234 and ten digits, or NULL."""
    p = _digits(phone)
    whole = F.when(p.startswith("+234"), p).when(p.startswith("234"), F.concat(F.lit("+"), p)).otherwise(F.concat(F.lit("+234"), F.substring(p, 2, 99)))
    return F.when(p.rlike(PHONE), whole)


def telco_prefix(phone: Column) -> Column:
    """The four digits that tell the operator."""
    p = _digits(phone)
    local = F.when(p.startswith("+234"), F.concat(F.lit("0"), F.substring(p, 5, 99))).when(p.startswith("234"), F.concat(F.lit("0"), F.substring(p, 4, 99))).otherwise(p)
    return F.substring(local, 1, 4)


def get_telco(phone: Column) -> Column:
    """The operator by prefix, whether or not the number is valid; NULL if unknown."""
    table = F.create_map(*[F.lit(x) for pair in TELCO_PREFIXES.items() for x in pair])
    return F.try_element_at(table, telco_prefix(phone))


def is_valid_bvn(bvn: Column) -> Column:
    """N7."""
    return bvn.rlike(BVN)


def is_valid_nin(nin: Column) -> Column:
    """N8."""
    return nin.rlike(NIN)


def is_nuban(account: Column) -> Column:
    """N9."""
    return account.rlike(NUBAN)


# --- Pidgin


def is_pidgin_particle(word: Column) -> Column:
    """G1."""
    return F.lower(word).isin(*PIDGIN)


def words_of(text: Column) -> Column:
    """str.split(): pieces between white space, none empty."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def bare_word(word: Column) -> Column:
    """Lower case without punctuation at either end."""
    return F.regexp_replace(F.lower(word), "^[.,!?;:'\"]+|[.,!?;:'\"]+$", "")


def preserve_pidgin_particles(text: Column, words_to_remove: Sequence[str]) -> Column:
    """Without these words, but Pidgin particles stay; single blanks between words."""
    gone = sorted(set(words_to_remove) - set(PIDGIN))
    if not gone:
        return F.array_join(words_of(text), " ")
    return F.array_join(F.filter(words_of(text), lambda w: ~bare_word(w).isin(*gone)), " ")
