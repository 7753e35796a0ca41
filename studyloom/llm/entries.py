"""Queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op8_byte_bpe
from .curve_shards import op7_curve_shards
from .decontaminate import op3_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .katz import op5_katz_scores
from .lexical_search import OP13_SQL, op13_lexical_search
from .links import reach_sql
from .near_dedup import op10_near_dedup
from .ngram_join import op11_ngram_join
from .periodic_runs import op12_periodic_runs
from .pii import op9_pii
from .token_counts import op2_token_counts
from .token_files import op1_token_files
from .toxicity import op6_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [op1_token_files, op2_token_counts, op3_decontaminate, op4_exact_dedup, op5_katz_scores, op6_toxicity, op7_curve_shards, op8_byte_bpe, op9_pii, op10_near_dedup, op11_ngram_join, op12_periodic_runs, op13_lexical_search]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op10_near_dedup": reach_sql(3, 85, 100, kept=True), "op11_ngram_join": reach_sql(5, 80, 100, kept=False), "op13_lexical_search": OP13_SQL}
