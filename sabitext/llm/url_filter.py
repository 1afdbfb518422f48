"""URL filters: a sort-merge range join of URLs with prefix rules.

A URL becomes a key: the labels of its host reversed, each with a dot behind it,
then path and query, as com.example.blog./a/b?c. A rule is a prefix of keys, so it
is an interval of the sorted keys, and two intervals are nested or apart. URLs and
rules are put in ranges of keys and sorted; a sweep keeps the stack of rules that
hold at the present key. Its top is the innermost rule, which decides.

    example.com          the host and all hosts below it
    example.com/docs     that host only (www. aside), paths beginning so

Splitting points of the ranges come from a sample of the keys by hash; they only
balance the work, the result is the same for any. A key that is several splitting
points, as of a URL that makes up much of the table, has its rows dealt out to all
ranges between them by page_id. A rule goes to every range
that it meets, so a range needs no other. The sample has about PER_RANGE keys for
each range, and of URLs only their keys and ids are moved.

Keys: scheme, user, port, fragment and a leading www. are dropped, hosts are in
lower case without trailing dots. Path and query are told apart first; in each,
percent-escapes are decoded (all kept if one is broken) but those of / ? # and %, which stay
as escapes in upper case; then empty, . and .. segments of the path are resolved, written
out or escaped; an empty path is /.

Rules for data. NULL URLs and those without a host match no rule: rule_id NULL,
action NULL, n_rules 0, as for any URL without a rule. Of rules with equal keys
block wins over allow, then the smallest rule_id. Rules that are NULL, have no
host, or another action than block or allow are left out. Repeated URLs are rows
of their own. Empty pages give an empty result, without rules nothing matches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PER_RANGE = 100
#: (rule_id, pattern, action): spam hosts, with nested exceptions.
RULES = [
    (1, "cheap-pills.example.com", "block"),
    (2, "cheap-pills.example.com/en/", "allow"),
    (3, "cheap-pills.example.com/en/4", "block"),
    (4, "spam-farm.example.org", "block"),
    (5, "example.net", "allow"),
    (6, "m.ththth.example.net", "block"),
    (7, "blog.ththan.example.net/en/9", "block"),
    (8, "example.org", "allow"),
    (9, "example.org/", "block"),
    (10, "therti.example.org/en", "block"),
    (11, "THERTI.example.org./en/./618", "allow"),
    (12, "casino.example.com", "block"),
]
_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_HOST = _SCHEME + r"(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:]*)"
_REST = _SCHEME + r"[^/?#]*([^#]*)"


def _resolved(path: Column) -> Column:
    """Without empty, . and .. segments."""

    def step(done: Column, s: Column) -> Column:
        return F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    parts = F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step)
    tail = F.when(path.rlike(r"(/|/\.|/\.\.)$") & (F.size(parts) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(parts, "/"), tail)


def _decoded(part: Column) -> Column:
    """Without percent-escapes but those of / ? # and %."""
    kept = part
    for code in ("25", "2F", "3F", "23"):
        kept = F.regexp_replace(kept, f"(?i)%{code}", f"%25{code}")
    return F.when(part.contains("%"), F.coalesce(F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B"))), part)).otherwise(part)


def key_of(url: Column, rule: bool = False) -> Column:
    """The key of a URL or, with rule, of a rule's pattern; NULL without a host."""
    url = F.trim(url)
    if rule:
        url = F.when(url.rlike(_SCHEME), url).otherwise(F.concat(F.lit("//"), url))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.|\.+$", "")
    rest = F.regexp_extract(url, _REST, 1)
    path, query = _decoded(F.substring_index(rest, "?", 1)), F.when(rest.contains("?"), _decoded(F.substring(rest, F.instr(rest, "?"), F.length(rest)))).otherwise("")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    path = F.concat(F.when(path.rlike(r"//|/\.\.?(/|$)"), _resolved(path)).otherwise(path), query)
    labels = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    whole = F.concat(labels, F.when(rest == "", F.lit("")).otherwise(path) if rule else path)
    return F.when(host != "", whole)


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id bigint, pattern string, action string")


def _place_urls(cuts: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            n = len(keys)
            salt = C.mix(batch.column("page_id").fill_null(0).to_numpy().astype(np.uint64)).tolist()
            places = [bisect_left(cuts, k) + h % (bisect_right(cuts, k) - bisect_left(cuts, k) + 1) for k, h in zip(keys, salt)]
            yield pa.record_batch([pa.array(places, pa.int32()), batch.column("key"), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int64()), batch.column("page_id"), pa.nulls(n, pa.string())], ["range", "key", "kind", "rank", "id", "action"])

    return run


def _place_rules(cuts: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, id_, action in zip(*(batch.column(c).to_pylist() for c in ("key", "rule_id", "action"))):
                for r in range(bisect_left(cuts, key), bisect_left(cuts, after(key)) + 1):
                    rows.append((r, key, 0, -id_ if action == "allow" else 2**62 - id_, id_, action))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["range", "key", "kind", "rank", "id", "action"])

    return run


def after(prefix: bytes) -> bytes:
    """The first key behind all that begin with prefix."""
    return prefix[:-1] + bytes([prefix[-1] + 1])


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key, kind (rules first) and rank; the stack is carried over from batch to batch."""
    stack: list[tuple[bytes, int, str]] = []
    current = None
    for batch in batches:
        range_, keys, kind, ids, action = (batch.column(c).to_pylist() for c in ("range", "key", "kind", "id", "action"))
        rules = [k for k, x in enumerate(kind) if not x or range_[k] != (range_[k - 1] if k else current)]
        page, url, rule, act, depth = [], [], [], [], []
        starts = rules if rules[:1] == [0] else [0, *rules]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            begin = a
            if a < len(keys) and range_[a] != current:
                stack, current = [], range_[a]
            if a < len(keys) and not kind[a]:
                while stack and stack[-1][0] <= keys[a]:
                    stack.pop()
                stack.append((after(keys[a]), ids[a], action[a]))
                begin = a + 1
            while begin < b:
                while stack and stack[-1][0] <= keys[begin]:
                    stack.pop()
                end = bisect_left(keys, stack[-1][0], begin, b) if stack else b
                n = end - begin
                page += ids[begin:end]
                url += keys[begin:end]
                rule += [stack[-1][1] if stack else None] * n
                act += [stack[-1][2] if stack else None] * n
                depth += [len(stack)] * n
                begin = end
        if page:
            yield pa.record_batch([pa.array(page, pa.int64()), pa.array(url, pa.binary()), pa.array(rule, pa.int64()), pa.array(act, pa.string()), pa.array(depth, pa.int32())], ["page_id", "key", "rule_id", "action", "n_rules"])


def _keyed(pages: DataFrame) -> Column:
    return F.coalesce(key_of(pages["url"].cast("string")), F.lit("")).cast("binary")


def decided(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, rule_id, action, n_rules) of every row of pages: the innermost rule and how many hold."""
    keyed = pages.select(pages["page_id"].cast("bigint").alias("page_id"), _keyed(pages).alias("key"))
    return _swept(keyed, rules).select("page_id", "rule_id", "action", "n_rules")


def _swept(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """decided() of (page_id, key), with the key."""
    spark = keyed.sparkSession
    prefixes = rules.where(rules["rule_id"].isNotNull() & rules["action"].isin("block", "allow")).select(rules["rule_id"].cast("bigint").alias("rule_id"), key_of(rules["pattern"], rule=True).cast("binary").alias("key"), rules["action"].alias("action")).where("key is not null")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, keyed.count() // (ranges * PER_RANGE))
    sample = sorted(bytes(r[0]) for r in keyed.where((F.pmod(F.xxhash64("key", "page_id"), F.lit(step)) == 0) & (F.length("key") > 0)).select("key").collect())
    cuts = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    schema = "range int, key binary, kind int, rank bigint, id bigint, action string"
    both = keyed.mapInArrow(_place_urls(cuts), schema).union(prefixes.mapInArrow(_place_rules(cuts), schema))
    met = both.repartitionById(ranges, "range").sortWithinPartitions("range", "key", "kind", "rank")
    return met.mapInArrow(sweep, "page_id bigint, key binary, rule_id bigint, action string, n_rules int")


def filtered(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of pages whose URL isn't blocked, each by its own URL: distinct keys are decided, and rows go by their key."""
    keys = pages.select(F.lit(None).cast("bigint").alias("page_id"), _keyed(pages).alias("key")).distinct()
    gone = _swept(keys, rules).where("action = 'block'").select(F.col("key").alias("blocked_key"))
    return pages.join(gone, _keyed(pages) == gone["blocked_key"], "left_anti")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decided(), with -1 and none where no rule holds."""
    found = decided(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_rules(spark))
    return found.select("page_id", F.coalesce("rule_id", F.lit(-1)).alias("rule_id"), F.coalesce("action", F.lit("none")).alias("action"), "n_rules")


def _sql_key(url: str, rule: bool) -> str:
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({url}, '{_HOST}', 1)), '^www\\.', ''), '\\.+$', '')"
    rest = f"regexp_replace(url_decode(replace(regexp_extract({url}, '{_REST}', 1), '+', '%2B')), '/\\./', '/')"
    path = f"CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END"
    path = f"CASE WHEN {rest} = '' THEN '' ELSE {path} END" if rule else path
    return f"CASE WHEN {host} <> '' THEN array_to_string(list_reverse(string_split({host}, '.')), '.') || '.' || {path} END"


#: The tables have no .. segments; those are left to the tests.
OP5_SQL = f"""
WITH keyed AS (SELECT page_id, {_sql_key("trim(url)", False)} AS key FROM pages),
rules AS (SELECT rule_id, action, {_sql_key("'//' || pattern", True)} AS prefix FROM (VALUES {", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)}) AS r(rule_id, pattern, action)),
met AS (SELECT k.page_id, r.rule_id, r.action, row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.prefix) DESC NULLS LAST, r.action DESC, r.rule_id) AS place, count(r.rule_id) OVER (PARTITION BY k.page_id) AS n FROM keyed k LEFT JOIN rules r ON starts_with(k.key, r.prefix))
SELECT page_id, CAST(coalesce(rule_id, -1) AS BIGINT) AS rule_id, coalesce(action, 'none') AS action, CAST(n AS INTEGER) AS n_rules FROM met WHERE place = 1
"""
