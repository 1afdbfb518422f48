"""The Column expressions on streams: they keep no state, so a stream gives what a batch of the same rows gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, find_phones, mask_pii


def cleaned(rows: DataFrame, text_col: str = "text", mask: bool = True) -> DataFrame:
    """Adds clean: the text cleaned and, with mask, free of personal data."""
    return rows.withColumn("clean", clean_text(F.col(text_col), mask_pii_data=mask))


def masked_counts(rows: DataFrame, time_col: str, text_col: str = "text", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """How many texts of each window hold telephone numbers; rows later than `late` are dropped, so state stays bounded."""
    text = F.col(text_col)
    marked = rows.withWatermark(time_col, late).withColumns({"phones": F.size(find_phones(text)), "changed": (mask_pii(text) != text).cast("int")})
    return marked.groupBy(F.window(time_col, window)).agg(F.count("*").alias("texts"), F.sum("phones").alias("phones"), F.sum("changed").alias("changed"))
