"""Queries of this subpackage for the driver, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op3_chat_formatting
from .decontam import op4_benchmark_decontamination
from .lm_score import OP9_SQL, op9_lm_scoring
from .media import op7_media_columns
from .minhash import op1_near_duplicates
from .mixing import op10_mixing
from .quality import op8_quality_classifier
from .secret_scan import op2_secret_scans
from .toxicity import op6_toxicity
from .url_filter import OP5_SQL, op5_url_filters

_ALL = (op1_near_duplicates, op2_secret_scans, op3_chat_formatting, op4_benchmark_decontamination, op5_url_filters, op6_toxicity, op7_media_columns, op8_quality_classifier, op9_lm_scoring, op10_mixing)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op5_url_filters": OP5_SQL, "op9_lm_scoring": OP9_SQL}
