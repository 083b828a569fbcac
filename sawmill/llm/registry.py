"""The queries of this subpackage and of the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import urls
from .collocations import op13_dynamic_phrases
from .fingerprints import op1_invertible_sketch
from .languages import op12_ftrl_languages
from .ngram_join import op3_ngram_jaccard_join
from .outliers import op7_robust_outliers
from .packing import op9_best_fit_packing
from .pieces import op10_sentencepiece_tokenizers
from .pii import op4_information_theoretic
from .quality import op5_quadratic_discriminant
from .spelling import op11_spelling_variants
from .token_counts import op6_digest_cache
from .wavelet import op2_wavelet_shards

OPERATORS = (
    op1_invertible_sketch, op2_wavelet_shards, op3_ngram_jaccard_join, op4_information_theoretic, op5_quadratic_discriminant,
    op6_digest_cache, op7_robust_outliers, urls.op8_url_trie, op9_best_fit_packing, op10_sentencepiece_tokenizers,
    op11_spelling_variants, op12_ftrl_languages, op13_dynamic_phrases,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{q.__name__: q for q in OPERATORS}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Of the rest, SQL can't express a fitted model, a fixed tokenizer, a sketch or a packing; tests/llm holds them against brute force."""
    return {"op8_url_trie": urls.ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
