"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm.filter_audit import OP11_SQL, op11_filter_audit
from reelframe.llm.language_id import op5_language_id
from reelframe.llm.media_columns import op4_media_columns
from reelframe.llm.mixing import op6_mixing
from reelframe.llm.packing import op1_best_fit_packing
from reelframe.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from reelframe.llm.quality_rules import OP7_SQL, op7_quality_rules
from reelframe.llm.secret_scan import op12_secret_scan
from reelframe.llm.simhash import op8_simhash
from reelframe.llm.suffix_dedup import op3_suffix_dedup
from reelframe.llm.token_store import op9_token_store
from reelframe.llm.toxicity import op2_toxicity
from reelframe.llm.url_filters import op10_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_token_store": op9_token_store,
    "op10_url_filters": op10_url_filters,
    "op11_filter_audit": op11_filter_audit,
    "op12_secret_scan": op12_secret_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op7_quality_rules": OP7_SQL, "op11_filter_audit": OP11_SQL, "op13_prefix_trie": OP13_SQL}
