"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import codes, divergence, fingerprints, language, licences, mixing, neardup, neighbours, pieces, quality, spans, toxicity, vectordups

    return {
        "op1_sentencepiece_dropout": pieces.query,
        "op2_sentence_spans": spans.query,
        "op3_neighbours_additive": neighbours.query,
        "op4_language_centroids": language.query,
        "op5_toxicity_factorization": toxicity.query,
        "op6_mixing_pareto": mixing.query,
        "op7_fingerprints_piecewise": fingerprints.query,
        "op8_near_duplicates_minhash": neardup.query,
        "op9_licence_paragraphs": licences.query,
        "op10_quality_compression": quality.query,
        "op11_source_divergence": divergence.query,
        "op12_vector_codes_va": codes.query,
        "op13_vector_duplicates_hnsw": vectordups.query,
    }


def oracle_sql() -> dict[str, str]:
    from . import codes, divergence, mixing_sql, vectordups

    return {
        "op6_mixing_pareto": mixing_sql.SQL,
        "op11_source_divergence": divergence.SQL,
        "op12_vector_codes_va": codes.SQL,
        "op13_vector_duplicates_hnsw": vectordups.SQL,
    }
