"""Queries and SQL of this subpackage's operators, added to the driver's entry module when it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP8_SQL, op8_decontaminate
from .importance import op7_importance
from .language_id import op5_language_id
from .near_dup import op9_near_dup
from .packing import op2_packing
from .phrases import OP12_SQL, op12_phrases
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_rules import op10_quality_rules
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .token_files import op1_token_files
from .toxicity import op13_toxicity
from .url_filter import op4_url_filter
from .warc import OP6_SQL, op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator over its whole table, with production parameters."""
    return {f.__name__: f for f in (op1_token_files, op2_packing, op3_suffix_dedup, op4_url_filter, op5_language_id, op6_warc, op7_importance, op8_decontaminate, op9_near_dup, op10_quality_rules, op11_prefix_trie, op12_phrases, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB's SQL, where that can express them."""
    return {"op3_suffix_dedup": OP3_SQL, "op6_warc": OP6_SQL, "op8_decontaminate": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_phrases": OP12_SQL}
