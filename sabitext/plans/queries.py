"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB's SQL.

Each takes (spark, sf_dir) and runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import syllables as S
from ..functions import text as T
from ..functions.chars import WORD, WS
from ..functions.normalize import normalize_unicode
from ..operators import knn, metrics, naive_bayes, sentiment, tokencost, tokenizer, training, words
from ..shared import dealt, spread
from ..sources import dims, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


# --- SQL fragments


def _sub(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def _whole(t: str, inside: str, full: str, by: str) -> str:
    """Replaces maximal runs of a class that match as a whole: what look-around does."""
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({t}, '[{inside}]+|[^{inside}]+'), lambda x: CASE WHEN regexp_full_match(x, '{full}') THEN '{by}' ELSE x END), ''), '')"


def _mask(t: str) -> str:
    t = _sub(_sub(t, T.PHONE_LOOSE, "[PHONE]"), T.EMAIL, "[EMAIL]")
    return _whole(_whole(t, WORD, r"22\p{Nd}{9}", "[BVN]"), r"\p{Nd}", r"\p{Nd}{11}", "[NIN]")


def _squeeze(t: str) -> str:
    return f"trim({_sub(t, f'[{WS}]+', ' ')})"


def _words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '[{WS}]+'), lambda w: w <> '')"


def _reduce(t: str) -> str:
    """Four or more equal characters become two."""
    return f"(SELECT coalesce(array_to_string(list_filter(l, lambda x, i: NOT (x <> chr(10) AND i > 2 AND x = l[i-1] AND x = l[i-2] AND (x = coalesce(l[i-3], '') OR x = coalesce(l[i+1], '')))), ''), '') FROM (SELECT string_split({t}, '') AS l))"


#: Strings made of keys, the same in both engines.
PHONE = "concat(CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '+234 ' WHEN 2 THEN '234-' ELSE '05' END, '8', cast(c_custkey % 2 AS STRING), cast(c_custkey % 10 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END, lpad(cast(c_custkey AS STRING), 7, '0'))"
NOTE = "concat('Call 0803', lpad(cast(o_custkey AS STRING), 7, '0'), ' or +234 803 ', lpad(cast(o_custkey % 1000 AS STRING), 3, '0'), ' ', lpad(cast(o_orderkey % 10000 AS STRING), 4, '0'), ', mail c', cast(o_custkey AS STRING), '@shop.example.com; BVN 22', lpad(cast(o_orderkey AS STRING), 9, '0'), ' NIN ', lpad(cast(o_orderkey AS STRING), 11, '9'), ' paid ₦', cast(o_orderkey AS STRING), ',000.50 or NGN ', cast(o_custkey AS STRING), ' ref ', lpad(cast(o_orderkey AS STRING), 13, '3'))"
POST = "concat('@user_', cast(conv_id AS STRING), ' ', text, ' sooooo goooood!!!! https://t.example.com/', cast(conv_id AS STRING), '?x=1 #Tag', cast(turn AS STRING), ' #', role, '  www.example.com/a cc @m', cast(turn AS STRING))"


# --- personal data, cleaning


@query(f"SELECT doc_id, md5(m) AS masked, CAST(length(m) AS BIGINT) AS n FROM (SELECT doc_id, {_mask('text')} AS m FROM documents)")
def mask_pii_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.mask_pii(F.col("text")).alias("m")).select("doc_id", F.md5("m").alias("masked"), F.length("m").cast("bigint").alias("n"))


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(CASE WHEN m <> text THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(length(m) - length(replace(m, '[PHONE]', '______'))) AS BIGINT) AS phones, CAST(sum(length(m) - length(replace(m, '[EMAIL]', '______'))) AS BIGINT) AS emails FROM (SELECT lang, text, {_mask('text')} AS m FROM documents) GROUP BY lang")
def mask_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: how many texts of each language hold personal data, and masks set."""
    rows = documents(spark, sf_dir).select("lang", "text", T.mask_pii(F.col("text")).alias("m"))
    count = lambda mask: F.sum(F.length("m") - F.length(F.replace(F.col("m"), F.lit(mask), F.lit("______"))))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum((F.col("m") != F.col("text")).cast("bigint")).alias("changed"), count("[PHONE]").alias("phones"), count("[EMAIL]").alias("emails"))


@query(f"SELECT o_orderkey, {_sub(_mask('t'), T.NAIRA, '[AMOUNT]')} AS masked FROM (SELECT o_orderkey, {NOTE} AS t FROM orders)")
def mask_pii_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.mask_pii(F.expr(NOTE), naira=True).alias("masked"))


@query(f"SELECT o_orderkey, array_to_string(regexp_extract_all(t, '{T.PHONE_LOOSE}'), '|') AS phones, array_to_string(regexp_extract_all(t, '{T.NAIRA}'), '|') AS amounts FROM (SELECT o_orderkey, {NOTE} AS t FROM orders)")
def find_phones_and_naira(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(NOTE).alias("t"))
    return rows.select("o_orderkey", F.array_join(T.find_phones(F.col("t")), "|").alias("phones"), F.array_join(T.find_naira_amounts(F.col("t")), "|").alias("amounts"))


_CLEAN = _squeeze(_reduce(_sub(_sub("p", T.URL, ""), T.MENTION, "")))


@query(f"SELECT conv_id, turn, md5({_CLEAN}) AS clean, md5(lower({_squeeze(_sub(_sub(_sub('p', T.URL, ''), T.MENTION, ''), T.HASHTAG, ''))})) AS bare FROM (SELECT conv_id, turn, {POST} AS p FROM conversations)")
def clean_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(POST)
    bare = T.clean_social_media(p, remove_hashtags=True, lowercase=True, reduce_repeats=False)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.clean_social_media(p)).alias("clean"), F.md5(bare).alias("bare"))


@query(f"SELECT doc_id, md5({_mask(_squeeze(_reduce(_sub(_sub('nfc_normalize(text)', T.URL, ''), T.MENTION, ''))))}) AS clean FROM documents")
def clean_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.clean_text(F.col("text"), mask_pii_data=True)).alias("clean"))


@query(f"SELECT conv_id, turn, array_to_string(regexp_extract_all(p, '{T.HASHTAG}', 1), ' ') AS tags, array_to_string(regexp_extract_all(p, '{T.MENTION}', 1), ' ') AS mentions FROM (SELECT conv_id, turn, {POST} AS p FROM conversations)")
def extract_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(POST)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.extract_hashtags(p), " ").alias("tags"), F.array_join(T.extract_mentions(p), " ").alias("mentions"))


# --- Unicode


@query("SELECT doc_id, md5(strip_accents(text)) AS bare FROM documents")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.strip_diacritics(F.col("text"))).alias("bare"))


_INJECTED = "concat(text, ' o', chr(803), chr(769), 'jo', chr(803), chr(769), ' e', chr(769), ' A', chr(778))"


@query(f"SELECT doc_id, md5(nfc_normalize({_INJECTED})) AS nfc FROM documents")
def normalize_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" ọ́jọ́ é Å"))
    return documents(spark, sf_dir).select("doc_id", F.md5(normalize_unicode(text)).alias("nfc"))


@query("SELECT doc_id, md5(translate(text, 'áàéèíìóòúùÁÀÉÈÍÌÓÒÚÙēūǹńḿ', 'aaeeiioouuAAEEIIOOUUeunnm')) AS toneless FROM documents")
def strip_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.strip_yoruba_diacritics(F.col("text"), tones_only=True)).alias("toneless"))


@query(r"SELECT doc_id, CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\p{L}'']'))) AS BIGINT) AS words, CAST(len(list_filter(l, lambda x: NOT regexp_matches(x, '^[\p{L}'']'))) AS BIGINT) AS others FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[\p{L}'']+|.') AS l FROM documents)")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", S.segment(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size(F.filter("l", lambda t: t.is_word)).cast("bigint").alias("words"), F.size(F.filter("l", lambda t: ~t.is_word)).cast("bigint").alias("others"))


@query(r"SELECT w AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}'']+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 100")
def word_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{S.WORD_YOR}]+"), 0)).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(100)


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(f"[{S.WORD_IBO}]+"), 0)).alias("word")).distinct()


_DISTINCT = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}''\-]+')) AS word FROM documents)"


@query(f"SELECT word, array_to_string(regexp_extract_all(word, '{S.YORUBA}'), '.') AS syllables FROM {_DISTINCT}")
def syllabify_yoruba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_words(spark, sf_dir).select("word", F.array_join(S.syllabify_yoruba(F.col("word")), ".").alias("syllables"))


@query(f"SELECT word, array_to_string(regexp_extract_all(word, '{S.IGBO}'), '.') AS syllables, CASE WHEN h AND NOT l THEN 'RTR' WHEN l AND NOT h THEN 'ATR' ELSE 'none' END AS harmony FROM (SELECT word, regexp_matches(lower(word), '[eiou]') AS l, regexp_matches(lower(word), '[aịọụ]') AS h FROM {_DISTINCT})")
def syllabify_igbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_words(spark, sf_dir).select("word", F.array_join(S.syllabify_igbo(F.col("word")), ".").alias("syllables"), F.coalesce(T.vowel_harmony(F.col("word")), F.lit("none")).alias("harmony"))


@query("SELECT doc_id, CASE WHEN d + p = 0 THEN 0.0 ELSE round(d / (d + p), 6) END AS ratio FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[ịọụ]')) AS d, len(regexp_extract_all(lower(text), '[iou]')) AS p FROM documents)")
def diacritization_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(T.diacritization_ratio(F.col("text")), 6).alias("ratio"))


# --- money, telephones, numbers


@query("SELECT o_orderkey, '₦' || format('{:,.2f}', o_totalprice) AS kobo, '₦' || format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)) AS whole FROM orders")
def format_naira(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_naira(p).alias("kobo"), T.format_naira(p, False).alias("whole"))


_AMOUNT = "CASE o_orderkey % 5 WHEN 0 THEN concat('₦', cast(o_custkey AS STRING), ',000.50') WHEN 1 THEN concat('NGN ', cast(o_orderkey AS STRING)) WHEN 2 THEN concat('N', cast(o_custkey AS STRING), ' in AN5 or NGN5') WHEN 3 THEN '' ELSE concat(cast(o_custkey AS STRING), 'e2') END"


@query(rf"SELECT o_orderkey, coalesce(CASE WHEN regexp_full_match(b, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(b AS DOUBLE) END, -1.0) AS amount FROM (SELECT o_orderkey, regexp_replace({_AMOUNT}, '[₦NG{WS},]', '', 'g') AS b FROM orders)")
def parse_naira(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(T.parse_naira(F.expr(_AMOUNT)), F.lit(-1.0)).alias("amount"))


@query(rf"SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace({_AMOUNT}, 'NGN[{WS}]?(\p{{Nd}})', '₦\1', 'g'), '^N(\p{{Nd}})', '₦\1'), '([^A-Za-z])N(\p{{Nd}})', '\1₦\2', 'g') AS symbol FROM orders")
def normalize_naira_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_naira_symbol(F.expr(_AMOUNT)).alias("symbol"))


_P = f"regexp_replace({PHONE}, '[{WS}\\-]', '', 'g')"
_VALID = r"regexp_full_match(p, '(0|\+?234)[789][01][0-9]{8}')"


@query(f"SELECT c_custkey, {_VALID} AS valid, CASE WHEN NOT {_VALID} THEN 'none' WHEN starts_with(p, '+234') THEN p WHEN starts_with(p, '234') THEN '+' || p ELSE '+234' || substr(p, 2) END AS phone FROM (SELECT c_custkey, {_P} AS p FROM customer)")
def phone_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(PHONE)
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_valid_phone(p).alias("valid"), F.coalesce(T.normalize_phone(p), F.lit("none")).alias("phone"))


_TELCO_VALUES = ", ".join(f"('{p}', '{t}')" for p, t in dims.TELCO_PREFIXES.items())


@query(f"SELECT coalesce(telco, 'unknown') AS telco, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM (SELECT c_acctbal, substr(CASE WHEN starts_with(p, '+234') THEN '0' || substr(p, 5) WHEN starts_with(p, '234') THEN '0' || substr(p, 4) ELSE p END, 1, 4) AS pre FROM (SELECT c_acctbal, {_P} AS p FROM customer)) LEFT JOIN (VALUES {_TELCO_VALUES}) AS t(prefix, telco) ON pre = prefix GROUP BY 1")
def telco_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.coalesce(T.get_telco(F.expr(PHONE)), F.lit("unknown")).alias("telco"), "c_acctbal")
    return rows.groupBy("telco").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT CAST(sum(CASE WHEN regexp_full_match(b, '22[0-9]{9}') THEN 1 ELSE 0 END) AS BIGINT) AS bvn, CAST(sum(CASE WHEN regexp_full_match(b, '[0-9]{11}') THEN 1 ELSE 0 END) AS BIGINT) AS nin, CAST(sum(CASE WHEN regexp_full_match(b, '[0-9]{10}') THEN 1 ELSE 0 END) AS BIGINT) AS nuban FROM (SELECT concat(CASE o_orderkey % 3 WHEN 0 THEN '22' WHEN 1 THEN '11' ELSE '1' END, lpad(cast(o_orderkey AS STRING), 9, '0')) AS b FROM orders)")
def bvn_nin_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.expr("concat(CASE o_orderkey % 3 WHEN 0 THEN '22' WHEN 1 THEN '11' ELSE '1' END, lpad(cast(o_orderkey AS STRING), 9, '0'))")
    count = lambda c: F.sum(c.cast("bigint"))
    return table(spark, sf_dir, "orders").select(b.alias("b")).agg(count(T.is_valid_bvn(F.col("b"))).alias("bvn"), count(T.is_valid_nin(F.col("b"))).alias("nin"), count(T.is_nuban(F.col("b"))).alias("nuban"))


_STOP = ["the", "and", "of", "sha", "no", "der", "die", "und", "la", "el", "et"]
_GONE = ", ".join(f"'{w}'" for w in sorted(set(_STOP) - set(dims.PIDGIN)))


@query(f"""SELECT doc_id, md5(array_to_string(list_filter({_words('text')}, lambda w: NOT list_contains([{_GONE}], regexp_replace(lower(w), '^[.,!?;:''"]+|[.,!?;:''"]+$', '', 'g'))), ' ')) AS kept FROM documents""")
def pidgin_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.preserve_pidgin_particles(F.col("text"), _STOP)).alias("kept"))


# --- catalog and dimensions

_REGISTRY = """
('afriqa', 'qa', 2, 'masakhane/afriqa'), ('masakhaner', 'ner', 3, 'masakhane/masakhaner2'), ('masakhanews', 'classification', 4, 'masakhane/masakhanews'), ('masakhapos', 'pos', 3, 'masakhane/masakhapos'),
('menyo20k', 'translation', 2, 'masakhane/menyo20k_mt'), ('naijasenti', 'sentiment', 4, 'HausaNLP/NaijaSenti-Twitter'), ('nollysenti', 'sentiment', 5, 'HausaNLP/NollySenti')"""


@query(f"SELECT name, task, CAST(langs AS INTEGER) AS langs, hf_id FROM (VALUES {_REGISTRY}) AS r(name, task, langs, hf_id)")
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry(spark).select("name", "task", F.size("languages").alias("langs"), "hf_id")


@query("SELECT dim, CAST(n AS BIGINT) AS n FROM (VALUES ('states', 37), ('lgas', 73), ('banks', 29), ('prefixes', 33), ('MTN', 12), ('Airtel', 9), ('Glo', 7), ('9mobile', 5), ('pidgin', 70)) AS v(dim, n)")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, df in (("states", dims.states(spark)), ("lgas", dims.lgas(spark)), ("banks", dims.banks(spark)), ("prefixes", dims.telcos(spark)), ("pidgin", dims.pidgin(spark))):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("dim"), "n")
        out = one if out is None else out.union(one)
    return out.union(dims.telcos(spark).groupBy("telco").agg(F.count("*").alias("n")))


# --- language detection

_NORM = _squeeze("lower(text)")
_CHARS = f"(SELECT doc_id, lang, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, lang, string_split({_NORM}, '') AS l FROM documents WHERE length({_NORM}) > 0))"
_GRAMS = f"""
chars AS {_CHARS},
lagged AS (SELECT doc_id, lang, i, c, lead(c, 1) OVER w AS c2, lead(c, 2) OVER w AS c3, lead(c, 3) OVER w AS c4 FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, lang, c AS f, 1 AS w FROM lagged UNION ALL SELECT doc_id, lang, c || c2, 1 FROM lagged WHERE c2 IS NOT NULL UNION ALL SELECT doc_id, lang, c || c2 || c3, 1 FROM lagged WHERE c3 IS NOT NULL UNION ALL SELECT doc_id, lang, c || c2 || c3 || c4, 1 FROM lagged WHERE c4 IS NOT NULL)"""


@query(f"WITH {_GRAMS} SELECT f AS gram, CAST(count(*) AS BIGINT) AS n FROM grams GROUP BY f ORDER BY n DESC, gram LIMIT 200")
def char_ngrams_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = naive_bayes.gram_counts(documents(spark, sf_dir), "text")
    return grams.orderBy(F.col("n").desc(), "gram").limit(200)


def _script_sql(text: str) -> list[tuple[str, str]]:
    out = [(name, f"len(regexp_extract_all({text}, '[{chars}]')) * {weight}") for name, chars, weight in naive_bayes.SCRIPTS]
    words_ = ", ".join(f"'{w}'" for w in naive_bayes.PCM_WORDS)
    trim = r"""'^[.,!?;:''"()\-]+|[.,!?;:''"()\-]+$'"""
    out.append(("__FEAT_PCM_VOCAB__", f"len(list_intersect(list_distinct(list_transform({_words(f'lower({text})')}, lambda w: regexp_replace(w, {trim}, '', 'g'))), [{words_}])) * 5"))
    out.append(("__FEAT_PCM_BIGRAM__", "(" + " + ".join(f"CAST(contains(lower({text}), '{p}') AS INTEGER)" for p in naive_bayes.PCM_PHRASES) + ") * 5"))
    return out


@query("SELECT doc_id, " + ", ".join(f"CAST({sql} AS BIGINT) AS {name.strip('_').lower()}" for name, sql in _script_sql("text")) + " FROM documents")
def script_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.map_from_entries(naive_bayes.script_features(F.col("text"))).alias("m"))
    return rows.select("doc_id", *[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0)).cast("bigint").alias(n.strip("_").lower()) for n, _ in _script_sql("text")])


_LANGS = ["de", "en", "es", "fr"]
_NB = f"""
WITH {_GRAMS},
feats AS (SELECT * FROM grams UNION ALL {" UNION ALL ".join(f"SELECT doc_id, lang, '{n}', w FROM (SELECT doc_id, lang, {sql} AS w FROM documents) WHERE w > 0" for n, sql in _script_sql("text"))}),
one AS (SELECT doc_id, lang, f, sum(w) AS n FROM feats GROUP BY ALL),
counts AS (SELECT lang, f, sum(n) AS n FROM one GROUP BY lang, f),
vocab AS (SELECT f FROM counts GROUP BY f HAVING sum(n) >= {naive_bayes.LEAST} OR starts_with(f, '__FEAT_')),
size AS (SELECT count(*) AS v FROM vocab),
down AS (SELECT lang, sum(n) + any_value(v) AS d FROM counts, size GROUP BY lang),
gain AS (SELECT l.lang, v.f, ln(coalesce(c.n, 0) + 1) AS g FROM vocab v CROSS JOIN down l LEFT JOIN counts c ON c.lang = l.lang AND c.f = v.f),
scores AS (SELECT o.doc_id, g.lang, sum(o.n * g.g) AS s FROM one o JOIN gain g ON g.f = o.f GROUP BY o.doc_id, g.lang),
sizes AS (SELECT doc_id, sum(n) AS n FROM one GROUP BY doc_id),
total AS (SELECT z.doc_id, d.lang AS label, ln(1.0 / (SELECT count(*) FROM down)) - z.n * ln(d.d) + coalesce(s.s, 0) AS score FROM sizes z CROSS JOIN down d LEFT JOIN scores s ON s.doc_id = z.doc_id AND s.lang = d.lang),
best AS (SELECT doc_id, label, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place FROM total)
"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = naive_bayes.fit(docs, "text", "lang", _LANGS)
    return model.predict(docs, "doc_id", "text")


@query(_NB + "SELECT doc_id, label, round(score, 3) AS score FROM best WHERE place = 1")
def nb_predict_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select("doc_id", "label", F.round(F.array_max("scores"), 3).alias("score"))


@query(_NB + "SELECT d.lang, b.label, CAST(count(*) AS BIGINT) AS n FROM best b JOIN documents d USING (doc_id) WHERE place = 1 GROUP BY d.lang, b.label")
def nb_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    return _predicted(spark, sf_dir).join(docs, F.col("doc_id") == F.col("id")).groupBy("lang", "label").agg(F.count("*").alias("n"))


@query(_NB + f"""
, top AS (SELECT doc_id, max(score) AS m FROM total GROUP BY doc_id), z AS (SELECT t.doc_id, sum(exp(t.score - m)) AS z FROM total t JOIN top USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, CASE WHEN {_squeeze('d.text')} <> '' THEN b.label END AS lang, CASE WHEN {_squeeze('d.text')} <> '' THEN round(1 / z.z, 6) ELSE 0.0 END AS confidence FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.place = 1 LEFT JOIN z ON z.doc_id = d.doc_id
""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = naive_bayes.fit(docs, "text", "lang", _LANGS).detect(docs, "doc_id", "text")
    return found.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"))


# --- syllables


def _knn(text: str = "text", letters: str = r"\p{L}''", syllable: str = S.YORUBA) -> str:
    """Contexts counted over documents."""
    return rf"""
WITH words AS (
  SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all({text}, '(?s)[{letters}]+|.') AS t FROM documents)
), parts AS (
  SELECT doc_id, i, is_word, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, i, regexp_matches(token, '^[{letters}]') AS is_word, CASE WHEN regexp_matches(token, '^[{letters}]') THEN regexp_extract_all(token, '{syllable}') ELSE [token] END AS s FROM words WHERE regexp_matches(token, '[^{WS}]'))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS pos FROM (SELECT doc_id, i, k, is_word AND regexp_matches(s, '\p{{L}}') AS target, lower(strip_accents(s)) AS undiac, lower(s) AS form FROM parts)
), context AS (
  SELECT doc_id, pos, target, undiac, form, coalesce(lag(undiac) OVER w, '<START>') AS prev, coalesce(lead(undiac) OVER w, '<END>') AS nxt FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), counts AS (SELECT undiac, prev, nxt, form, count(*) AS cnt, min(struct_pack(d := doc_id, p := pos)) AS seen FROM context WHERE target GROUP BY undiac, prev, nxt, form)
"""


_KNN = _knn()
_CONTEXTS = "SELECT undiac, prev, nxt AS next, form, CAST(cnt AS BIGINT) AS cnt FROM counts"


@query(_KNN + "SELECT undiac, prev, nxt AS next, form, CAST(cnt AS BIGINT) AS cnt FROM counts")
def knn_train_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.count_contexts(documents(spark, sf_dir), "doc_id", "text").select("undiac", "prev", "next", "form", "cnt")


def _restored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stripped and restored by a model of all texts: (doc_id, input, predicted, expected)."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    bare = docs.select("doc_id", T.strip_diacritics(F.col("text")).alias("input"))
    restored = knn.fit(docs, "doc_id", "text").diacritize(bare, "doc_id", "input").select(F.col("doc_id").alias("id"), F.col("restored").alias("predicted"))
    return bare.join(docs.select(F.col("doc_id").alias("d"), F.col("text").alias("expected")), F.col("doc_id") == F.col("d")).join(restored, F.col("doc_id") == F.col("id")).select("doc_id", "input", "predicted", "expected")


@query(_knn(letters=r"\p{L}''\-", syllable=S.IGBO) + _CONTEXTS)
def igbo_train_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.count_contexts(documents(spark, sf_dir), "doc_id", "text", "ibo").select("undiac", "prev", "next", "form", "cnt")


@query(_knn("translate(text, 'áàéèíìóòúùÁÀÉÈÍÌÓÒÚÙēūǹńḿ', 'aaeeiioouuAAEEIIOOUUeunnm')") + _CONTEXTS)
def dot_below_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.count_contexts(documents(spark, sf_dir), "doc_id", "text", tones_only=True).select("undiac", "prev", "next", "form", "cnt")


def _restored(letters: str, syllable: str) -> str:
    """Every text stripped and restored by four tables of all texts: out(doc_id, restored)."""
    return _knn(letters=letters, syllable=syllable) + rf"""
, bothk AS (SELECT *, row_number() OVER (PARTITION BY undiac, prev, nxt ORDER BY cnt DESC, seen) AS place, min(seen) OVER (PARTITION BY undiac, prev, nxt) AS least FROM counts),
both_ AS (SELECT undiac, prev, nxt, form, least FROM bothk WHERE place = 1),
bef AS (SELECT undiac, prev, form FROM (SELECT *, row_number() OVER (PARTITION BY undiac, prev ORDER BY least) AS place FROM both_ WHERE prev <> '<START>') WHERE place = 1),
aft AS (SELECT undiac, nxt, form FROM (SELECT *, row_number() OVER (PARTITION BY undiac, nxt ORDER BY least) AS place FROM both_ WHERE nxt <> '<END>') WHERE place = 1),
tot AS (SELECT undiac, form, sum(cnt) AS cnt, min(seen) AS seen FROM counts GROUP BY undiac, form),
alone AS (SELECT undiac, form FROM (SELECT *, row_number() OVER (PARTITION BY undiac ORDER BY cnt DESC, seen) AS place FROM tot) WHERE place = 1),
bw AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(strip_accents(text), '(?s)[{letters}]+|.') AS t FROM documents)),
bp AS (SELECT doc_id, i, is_word, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, i, regexp_matches(token, '^[{letters}]') AS is_word, CASE WHEN regexp_matches(token, '^[{letters}]') THEN regexp_extract_all(token, '{syllable}') ELSE [token] END AS s FROM bw)),
bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS pos, lower(strip_accents(s)) AS u FROM bp),
bx AS (SELECT doc_id, pos, u, coalesce(lag(u) OVER w, '<start>') AS p, coalesce(lead(u) OVER w, '<end>') AS n FROM bs WHERE is_word WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
fx AS (SELECT x.doc_id, x.pos, coalesce(a.form, b.form, c.form, d.form) AS form FROM bx x LEFT JOIN (SELECT * FROM both_ WHERE prev <> '<START>' AND nxt <> '<END>') a ON a.undiac = x.u AND a.prev = x.p AND a.nxt = x.n LEFT JOIN bef b ON b.undiac = x.u AND b.prev = x.p LEFT JOIN aft c ON c.undiac = x.u AND c.nxt = x.n LEFT JOIN alone d ON d.undiac = x.u),
made AS (SELECT s.doc_id, string_agg(CASE WHEN f.form IS NULL THEN s.s WHEN regexp_matches(s.s, '^\p{{Lu}}') THEN upper(f.form[1]) || lower(substr(f.form, 2)) ELSE f.form END, '' ORDER BY s.pos) AS restored FROM bs s LEFT JOIN fx f ON f.doc_id = s.doc_id AND f.pos = s.pos GROUP BY s.doc_id),
outs AS (SELECT d.doc_id, d.text, coalesce(m.restored, strip_accents(d.text)) AS restored FROM documents d LEFT JOIN made m USING (doc_id))
"""


_YOR_RESTORED = _restored(r"\p{L}''", S.YORUBA)


@query(_YOR_RESTORED + "SELECT doc_id, md5(restored) AS restored, restored = text AS exact FROM outs")
def knn_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored_pairs(spark, sf_dir).select("doc_id", F.md5("predicted").alias("restored"), (F.col("predicted") == F.col("expected")).alias("exact"))


@query(_restored(r"\p{L}''\-", S.IGBO) + "SELECT doc_id, md5(restored) AS restored FROM outs")
def igbo_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    bare = docs.select("doc_id", T.strip_diacritics(F.col("text")).alias("bare"))
    return knn.fit_igbo(docs, "doc_id", "text").diacritize(bare, "doc_id", "bare").select("doc_id", F.md5("restored").alias("restored"))


_EVAL_PAIRS = "(SELECT doc_id, lower(text) AS e, lower(strip_accents(text)) AS p, text AS e0, strip_accents(text) AS p0 FROM documents)"
_MARKS = metrics.MARKED["yoruba"]


def _agree(a: str, b: str) -> str:
    return f"len(list_filter(list_zip({a}[:least(len({a}), len({b}))], {b}[:least(len({a}), len({b}))]), lambda z: z[1] = z[2]))"


def _letters(t: str) -> str:
    return f"list_filter(string_split({t}, ''), lambda c: c <> '')"


def _marked(t: str) -> str:
    return f"list_filter(list_zip(range(length({t})), {_letters(t)}), lambda z: contains('{_MARKS}', z[2]))"


@query(_YOR_RESTORED + f"""
, x AS (SELECT {_words('lower(text)')} AS we, {_words('lower(restored)')} AS wp, {_letters('lower(text)')} AS ce, {_letters('lower(restored)')} AS cp, lower(text) = lower(restored) AS same, {_marked('text')} AS de, {_marked('restored')} AS dp FROM outs),
s AS (SELECT count(*) AS n, sum(CAST(same AS INTEGER)) AS cs, sum(least(len(we), len(wp))) AS tw, sum({_agree('we', 'wp')}) AS cw, sum(least(len(ce), len(cp))) AS tc, sum({_agree('ce', 'cp')}) AS cc, sum(len(list_intersect(de, dp))) AS tp, sum(len(de)) AS e, sum(len(dp)) AS p FROM x),
r AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS pr, CASE WHEN e > 0 THEN tp / e ELSE 0.0 END AS re FROM s)
SELECT 'yoruba' AS language, CAST(n AS BIGINT) AS total_sentences, CAST(cs AS BIGINT) AS correct_sentences, CAST(tw AS BIGINT) AS total_words, CAST(cw AS BIGINT) AS correct_words, round(cw / tw, 6) AS word_accuracy, round(cs / n, 6) AS sentence_accuracy, round(cc / tc, 6) AS character_accuracy, round(pr, 6) AS diacritic_precision, round(re, 6) AS diacritic_recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS diacritic_f1 FROM r
""")
def restore_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = metrics.evaluate(_restored_pairs(spark, sf_dir), "yoruba")
    return row.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes])


@query(f"""
WITH x AS (SELECT {_words('e')} AS we, {_words('p')} AS wp, string_split(e, '') AS ce, string_split(p, '') AS cp, e = p AS same,
  list_filter(list_zip(range(length(e0)), string_split(e0, '')), lambda z: contains('{_MARKS}', z[2])) AS de, list_filter(list_zip(range(length(p0)), string_split(p0, '')), lambda z: contains('{_MARKS}', z[2])) AS dp FROM {_EVAL_PAIRS} WHERE length(e) > 0),
s AS (SELECT sum(CAST(same AS INTEGER)) AS sentences, count(*) AS n, sum(least(len(we), len(wp))) AS tw, sum({_agree('we', 'wp')}) AS cw, sum(least(len(ce), len(cp))) AS tc, sum({_agree('ce', 'cp')}) AS cc, sum(len(list_intersect(de, dp))) AS tp, sum(len(de)) AS e, sum(len(dp)) AS p FROM x)
SELECT CAST(n AS BIGINT) AS total_sentences, CAST(sentences AS BIGINT) AS correct_sentences, CAST(tw AS BIGINT) AS total_words, CAST(cw AS BIGINT) AS correct_words, round(cc / tc, 6) AS character_accuracy, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 6) AS diacritic_precision, round(CASE WHEN e > 0 THEN tp / e ELSE 0 END, 6) AS diacritic_recall FROM s
""")
def strip_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stripping alone loses: metrics of bare texts against the texts."""
    pairs = documents(spark, sf_dir).where(F.length("text") > 0).select(T.strip_diacritics(F.col("text")).alias("predicted"), F.col("text").alias("expected"))
    return metrics.evaluate(pairs, "yoruba").select("total_sentences", "correct_sentences", "total_words", "correct_words", *[F.round(c, 6).alias(c) for c in ("character_accuracy", "diacritic_precision", "diacritic_recall")])


# --- words

_WORDS = f"""
WITH sides AS (SELECT doc_id, {_words('lower(strip_accents(text))')} AS u, {_words('lower(text)')} AS d FROM documents),
al AS (SELECT doc_id, i, u[i] AS undiac, d[i] AS form, CASE WHEN i > 1 THEN u[i-1] END AS prev, CASE WHEN i > 1 THEN d[i-1] END AS prev_form FROM (SELECT doc_id, u, d, unnest(range(1, least(len(u), len(d)) + 1)) AS i FROM sides)),
forms AS (SELECT undiac, form, count(*) AS cnt, min(struct_pack(d := doc_id, p := i)) AS seen FROM al GROUP BY undiac, form),
ranked AS (SELECT *, sum(cnt) OVER (PARTITION BY undiac) AS total, count(*) OVER (PARTITION BY undiac) AS kinds, row_number() OVER (PARTITION BY undiac ORDER BY cnt DESC, seen) AS rank FROM forms),
known AS (SELECT * FROM ranked WHERE total >= {words.LEAST_WORD}),
map AS (SELECT undiac, form FROM known WHERE rank = 1),
cand AS (SELECT undiac, rank, form, ln(cnt / total) AS logp FROM known WHERE kinds > 1 AND rank <= {words.CANDIDATES}),
duo AS (SELECT prev, undiac, form, count(*) AS cnt, min(struct_pack(d := doc_id, p := i)) AS seen FROM al WHERE prev IS NOT NULL GROUP BY prev, undiac, form),
best AS (SELECT *, sum(cnt) OVER (PARTITION BY prev, undiac) AS total, row_number() OVER (PARTITION BY prev, undiac ORDER BY cnt DESC, seen) AS rank FROM duo),
pairs AS (SELECT b.prev, b.undiac, b.form FROM best b JOIN map m USING (undiac) WHERE b.rank = 1 AND b.total >= {words.LEAST_PAIR} AND b.form <> m.form),
can AS (SELECT form FROM cand UNION SELECT form FROM map),
unsure AS (SELECT DISTINCT form FROM cand),
flw AS (SELECT prev_form, form, count(*) AS cnt, min(struct_pack(d := doc_id, p := i)) AS seen FROM al WHERE prev_form IS NOT NULL GROUP BY prev_form, form),
tot AS (SELECT *, sum(cnt) OVER (PARTITION BY prev_form) AS total FROM flw),
rel AS (SELECT *, row_number() OVER (PARTITION BY prev_form ORDER BY cnt DESC, seen) AS rank FROM tot WHERE prev_form IN (SELECT form FROM can) AND form IN (SELECT form FROM can) AND (prev_form IN (SELECT form FROM unsure) OR form IN (SELECT form FROM unsure)))
"""


def _word_model(spark: SparkSession, sf_dir: str) -> words.WordModel:
    return words.fit(documents(spark, sf_dir), "doc_id", "text")


@query(_WORDS + "SELECT undiac, CAST(rank AS INTEGER) AS rank, form, round(logp, 6) AS logp FROM cand")
def word_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_model(spark, sf_dir).candidates.select("undiac", "rank", "form", F.round("logp", 6).alias("logp"))


@query(_WORDS + "SELECT prev, undiac, form FROM pairs")
def word_bigram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_model(spark, sf_dir).pairs.select("prev", "undiac", "form")


@query(_WORDS + f"SELECT prev_form, form, round(ln(cnt / total), 6) AS logp FROM rel WHERE rank <= {words.SUCCESSORS}")
def word_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_model(spark, sf_dir).transitions.select("prev_form", "form", F.round("logp", 6).alias("logp"))


@query()
def viterbi_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = _word_model(spark, sf_dir).viterbi(docs.select("doc_id", T.strip_diacritics(F.col("text")).alias("bare")), "doc_id", "bare")
    text = docs.select(F.col("doc_id").alias("d"), "text")
    return out.join(text, F.col("doc_id") == F.col("d")).select("doc_id", F.md5("restored").alias("restored"), (F.col("restored") == F.col("text")).alias("exact"))


@query(_WORDS + r"""
, gt AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(strip_accents(text), '(?s)[\p{L}'']+|.') AS t FROM documents)),
gs AS (SELECT *, regexp_matches(token, '^[\p{L}'']') AS is_word, sum(CASE WHEN token IN ('.', '!', '?', ';') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sent FROM gt),
gw AS (SELECT doc_id, i, lower(token) AS w, lag(lower(token)) OVER (PARTITION BY doc_id, sent ORDER BY i) AS pw FROM gs WHERE is_word),
gf AS (SELECT g.doc_id, g.i, coalesce(b.form, u.form) AS form FROM gw g LEFT JOIN pairs b ON b.prev = g.pw AND b.undiac = g.w LEFT JOIN map u ON u.undiac = g.w),
gm AS (SELECT s.doc_id, string_agg(CASE WHEN form IS NULL THEN token WHEN regexp_matches(token, '^\p{Lu}') THEN upper(form[1]) || substr(form, 2) ELSE form END, '' ORDER BY s.i) AS restored FROM gs s LEFT JOIN gf f ON f.doc_id = s.doc_id AND f.i = s.i GROUP BY s.doc_id)
SELECT d.doc_id, md5(coalesce(m.restored, strip_accents(d.text))) AS restored FROM documents d LEFT JOIN gm m USING (doc_id)""")
def greedy_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = documents(spark, sf_dir).select("doc_id", T.strip_diacritics(F.col("text")).alias("bare"))
    return _word_model(spark, sf_dir).greedy(bare, "doc_id", "bare").select("doc_id", F.md5("restored").alias("restored"))


@query(_WORDS + r"""
, toks AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)[\p{L}'']+|.')) AS t FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN m.undiac IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS known FROM toks LEFT JOIN map m ON m.undiac = lower(t) WHERE regexp_matches(t, '^[\p{L}'']') GROUP BY doc_id""")
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _word_model(spark, sf_dir).statistics(docs, "doc_id", "text").where("total > 0").select("doc_id", "total", "known")


# --- sentiment

_TERMS = f"""
ws AS (SELECT doc_id, regexp_extract_all(lower(text), '[{WORD}]+') AS l FROM documents),
terms AS (SELECT doc_id, unnest(l) AS term FROM ws UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i+1])) FROM ws WHERE len(l) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term)
"""
_LEXICON = {"the": (1.2, 0.3, 0.1, -0.4), "and": (1.1, -0.2, 0.2, 0.3), "of": (1.3, 0.5, -0.1, 0.0), "der": (2.0, -0.6, 0.1, 0.5), "la": (1.9, 0.1, 0.4, -0.3), "et": (2.2, -0.1, -0.2, 0.6), "idiot": (4.0, -1.5, -0.5, 2.5), "of the": (2.5, 0.4, 0.0, -0.2), "in the": (2.6, 0.2, 0.1, -0.1), "de la": (3.1, 0.3, 0.2, -0.5)}
_BIAS = (0.1, 0.05, -0.15)
_LEX_SQL = ", ".join(f"('{t}', {', '.join(map(str, w))})" for t, w in _LEXICON.items())
_LOGIT = [f"{b} + CASE WHEN norm > 0 THEN s{i} / norm ELSE 0 END" for i, b in enumerate(_BIAS)]


@query(f"""
WITH {_TERMS}, met AS (SELECT doc_id, (1 + ln(tf)) * idf AS w, w0, w1, w2 FROM tf JOIN (VALUES {_LEX_SQL}) AS v(term, idf, w0, w1, w2) USING (term)),
sums AS (SELECT d.doc_id, any_value(d.text) AS text, coalesce(sqrt(sum(w * w)), 0) AS norm, coalesce(sum(w * w0), 0) AS s0, coalesce(sum(w * w1), 0) AS s1, coalesce(sum(w * w2), 0) AS s2 FROM documents d LEFT JOIN met USING (doc_id) GROUP BY d.doc_id),
z AS (SELECT doc_id, {_squeeze('text')} = '' AS blank, exp({_LOGIT[0]}) AS a, exp({_LOGIT[1]}) AS b, exp({_LOGIT[2]}) AS c FROM sums)
SELECT doc_id, CASE WHEN blank THEN 'neutral' WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'neutral' ELSE 'negative' END AS label, CASE WHEN blank THEN 0.33 ELSE round(a / (a + b + c), 4) END AS positive, CASE WHEN blank THEN 0.33 ELSE round(c / (a + b + c), 4) END AS negative FROM z
""")
def sentiment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = spark.createDataFrame([(t, *w) for t, w in _LEXICON.items()], "term string, idf double, w0 double, w1 double, w2 double")
    return sentiment.SentimentModel(vocab, _BIAS).analyze(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "label", "positive", "negative")


@query(f"WITH {_TERMS.replace(']+', ']{2,}')}, n AS (SELECT count(*) AS n FROM documents) SELECT term, CAST(count(*) AS BIGINT) AS df, round(ln((1 + any_value(n)) / (1 + count(*))) + 1, 6) AS idf FROM tf, n GROUP BY term HAVING count(*) >= {sentiment.LEAST_DF} AND count(*) <= {sentiment.MOST_DF} * any_value(n) ORDER BY sum(tf) DESC, term LIMIT 1000")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.fit_vocabulary(documents(spark, sf_dir), "text", most_terms=1000).select("term", "df", F.round("idf", 6).alias("idf"))


@query()
def sentiment_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of labels.quality, applied to every document."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    rows = docs.join(labels, F.col("doc_id") == F.col("id")).select("doc_id", "text", F.when(F.col("q") == 1, "positive").otherwise("negative").alias("label"))
    model = sentiment.fit(rows, "text", "label", labels=("positive", "negative"))
    return model.analyze(docs, "doc_id", "text").select("doc_id", "label", "confidence")


# --- tokenizers and token costs


@query()
def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tokenizer.count_tokens(F.col("text")).alias("tokens"))


_TOKENS = {"char": "len(string_split({t}, ''))", "word": r"len(regexp_extract_all({t}, '[\p{{L}}'']+'))", "syllable": f"len(regexp_extract_all({{t}}, '{S.YORUBA.replace('{', '{{').replace('}', '}}')}'))"}
_COST = f"""
WITH e AS (SELECT p_partkey AS id, p_brand AS category, p_name AS eng, upper(p_type) || ' ' || p_name AS yor, p_type AS hau FROM part),
long AS (SELECT id, eng, unnest(['eng', 'yor', 'hau']) AS language, unnest([eng, yor, hau]) AS text FROM e),
r AS ({" UNION ALL ".join(f"SELECT id, language, text, '{k}' AS tokenizer, {v.format(t='text')} AS n, {v.format(t='eng')} AS base FROM long" for k, v in _TOKENS.items())}),
q AS (SELECT *, CASE WHEN base > 0 THEN round(n / base, 3) ELSE CAST('inf' AS DOUBLE) END AS ratio FROM r)
"""


def _token_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an entry becomes nine rows with their tokens, which sorts and windows keep in memory
    entries = dealt(table(spark, sf_dir, "part"), 1 << 20).selectExpr("p_partkey AS id", "p_brand AS category", "p_name AS eng", "concat(upper(p_type), ' ', p_name) AS yor", "p_type AS hau")
    kinds = {"char": metrics.chars, "word": lambda t: F.regexp_extract_all(t, F.lit(f"[{S.WORD_YOR}]+"), 0), "syllable": S.syllabify_yoruba}
    return tokencost.run_benchmark(entries, kinds, {"eng": "English", "yor": "Yorùbá", "hau": "Hausa"})


@query(_COST + ", g AS (SELECT language, tokenizer, avg(n) AS mean, avg(ratio) AS mr, max(ratio) AS worst FROM q GROUP BY ALL) SELECT a.language, a.tokenizer, round(a.mean, 2) AS mean_tokens_per_entry, round(a.mr, 3) AS mean_token_ratio_vs_english, round(a.mean / b.mean, 3) AS cost_multiplier_vs_english, round(a.mean / b.mean * 3375.0, 0) AS estimated_naira_per_1m_equiv, a.worst AS worst_word_ratio FROM g a JOIN g b ON b.tokenizer = a.tokenizer AND b.language = 'eng'")
def token_cost_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencost.aggregate_stats(_token_results(spark, sf_dir)).select("language", "tokenizer", "mean_tokens_per_entry", "mean_token_ratio_vs_english", "cost_multiplier_vs_english", "estimated_naira_per_1m_equiv", "worst_word_ratio")


@query(_COST + ", f AS (SELECT *, row_number() OVER (PARTITION BY text, tokenizer ORDER BY ratio DESC, id, language) AS k FROM q WHERE language <> 'eng') SELECT CAST(id AS BIGINT) AS entry_id, language, tokenizer, text, CAST(n AS INTEGER) AS n_tokens, ratio FROM f WHERE k = 1 ORDER BY ratio DESC, id, language, tokenizer LIMIT 10")
def top_worst_tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencost.top_worst(_token_results(spark, sf_dir)).select("entry_id", "language", "tokenizer", "text", "n_tokens", F.col("token_ratio_vs_english").alias("ratio"))


# --- training sets


@query(f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS t FROM documents) GROUP BY md5(t)")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of texts that are equal but for white space at their ends."""
    rows = documents(spark, sf_dir).select("doc_id", F.md5(training.stripped(F.col("text"))).alias("k"))
    return rows.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS n FROM documents) WHERE n <= 5000")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5000 texts of each language, as if drawn at random."""
    return training.capped(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", "lang")


_STRIPPED = f"regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')"


@query(f"""
WITH s AS (SELECT doc_id AS ord, lang, text FROM documents UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, 'conv', text FROM conversations WHERE length({_STRIPPED}) > {training.HEADLINE_CHARS}),
k AS (SELECT ord, lang, row_number() OVER (PARTITION BY md5({_STRIPPED}) ORDER BY ord) AS p FROM s WHERE {_STRIPPED} <> ''),
c AS (SELECT ord, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(ord || ':42'), ord) AS n FROM k WHERE p = 1)
SELECT CAST(ord AS BIGINT) AS ord, lang FROM c WHERE n <= 100""")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two tables, distinct, at most 100 of each language: the cap is the feature."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), "lang", "text")
    turns = training.headlines(table(spark, sf_dir, "conversations"), "text").select((F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.lit("conv").alias("lang"), "text")
    return training.language_texts([docs, turns], 100).select("ord", "lang")


@query("""
WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents)
SELECT char, CAST(row_number() OVER (ORDER BY char) + 3 AS INTEGER) AS id FROM c WHERE char <> '' UNION ALL SELECT * FROM (VALUES ('<PAD>', 0), ('<UNK>', 1), ('<SOS>', 2), ('<EOS>', 3)) AS v(char, id)""")
def char_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.char_vocabulary(documents(spark, sf_dir), "text")
