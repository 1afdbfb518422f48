"""Column expressions, and register(spark) for those that SQL should know by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import normalize, syllables, text

#: SQL name, DDL result and the Column function of one string.
SQL_FUNCTIONS = {
    "strip_diacritics": ("STRING", text.strip_diacritics),
    "clean_social_media": ("STRING", text.clean_social_media),
    "mask_pii": ("STRING", text.mask_pii),
    "find_phones": ("ARRAY<STRING>", text.find_phones),
    "find_naira_amounts": ("ARRAY<STRING>", text.find_naira_amounts),
    "extract_hashtags": ("ARRAY<STRING>", text.extract_hashtags),
    "extract_mentions": ("ARRAY<STRING>", text.extract_mentions),
    "parse_naira": ("DOUBLE", text.parse_naira),
    "normalize_naira_symbol": ("STRING", text.normalize_naira_symbol),
    "is_valid_phone": ("BOOLEAN", text.is_valid_phone),
    "normalize_phone": ("STRING", text.normalize_phone),
    "is_valid_bvn": ("BOOLEAN", text.is_valid_bvn),
    "is_valid_nin": ("BOOLEAN", text.is_valid_nin),
    "syllabify_yoruba": ("ARRAY<STRING>", syllables.syllabify_yoruba),
    "syllabify_igbo": ("ARRAY<STRING>", syllables.syllabify_igbo),
}


def register(spark: SparkSession) -> list[str]:
    """Makes SQL functions of the expressions above: SQL bodies, not Python UDFs, so Catalyst sees through them."""
    empty = spark.createDataFrame([], "x string")
    for name, (kind, function) in SQL_FUNCTIONS.items():
        plan = empty.select(function(F.col("x")).alias("y"))._jdf.queryExecution().analyzed()
        body = plan.expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)


__all__ = ["SQL_FUNCTIONS", "normalize", "register", "syllables", "text"]
