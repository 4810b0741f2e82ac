"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op3_byte_bpe
from .centroids import op11_centroids
from .chat_format import op8_chat_format
from .doc_fingerprint import op4_doc_fingerprint
from .ngram_join import op1_ngram_join
from .quality_rules import op9_quality_rules
from .secret_scan import op10_secret_scan
from .source_mix import op6_source_mix
from .sql import SQL
from .token_align import op12_token_align
from .token_files import op5_token_files
from .toxicity import op2_toxicity
from .url_filter import op13_url_filter
from .warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator."""
    return {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_byte_bpe, op4_doc_fingerprint, op5_token_files, op6_source_mix, op7_warc, op8_chat_format, op9_quality_rules, op10_secret_scan, op11_centroids, op12_token_align, op13_url_filter)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return dict(SQL)
