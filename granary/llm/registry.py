"""Queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import exact_dedup, mixing, ngram_join, substring_dedup, suffix_dedup, topk
from granary.llm.exact_dedup import op1_exact_dedup
from granary.llm.html_text import op7_main_text
from granary.llm.kneser_ney import op4_quality
from granary.llm.mixing import op3_mixing
from granary.llm.ngram_join import op5_ngram_join
from granary.llm.packing import op9_packing
from granary.llm.substring_dedup import op10_substring_dedup
from granary.llm.suffix_dedup import op2_suffix_dedup
from granary.llm.topk import op8_topk
from granary.llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_suffix_dedup, op3_mixing, op4_quality, op5_ngram_join, op6_toxicity, op7_main_text, op8_topk, op9_packing, op10_substring_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op2_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op3_mixing": mixing.oracle_sql(),
        "op5_ngram_join": ngram_join.ORACLE_SQL,
        "op8_topk": topk.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    }
