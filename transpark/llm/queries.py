"""The registered queries of this subpackage: one per operator, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transpark.llm.byte_bpe import op2_byte_bpe
from transpark.llm.fingerprint import op3_document_fingerprints
from transpark.llm.importance import op13_importance_resampling
from transpark.llm.katz_lm import op8_katz_lm
from transpark.llm.lexical_search import op12_ranked_search
from transpark.llm.line_dedup import op9_line_dedup
from transpark.llm.ngram_join import op1_ngram_jaccard_join
from transpark.llm.packing import op10_best_fit_packing
from transpark.llm.quality import op7_quality_classifier
from transpark.llm.robust_rules import op11_robust_quality_rules
from transpark.llm.secret_scan import op4_secret_scan
from transpark.llm.toxicity import op5_toxicity
from transpark.llm.twins import ORACLE
from transpark.llm.vector_dedup import op6_vector_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_vector_near_dedup": op6_vector_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_katz_lm": op8_katz_lm,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_robust_quality_rules": op11_robust_quality_rules,
    "op12_ranked_search": op12_ranked_search,
    "op13_importance_resampling": op13_importance_resampling,
}

__all__ = ["ORACLE", "QUERIES"]
