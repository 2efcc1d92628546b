"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from siftline.llm import exact_dedup, filter_audit, importance_resampling, language_mixture, metric_tree, minhash, pii_surrogates, quality, sentence_spans, separator_scan, simhash, temperature_mix, unigram


def queries() -> dict:
    return {
        "op1_pii_surrogates": pii_surrogates.op1_pii_surrogates,
        "op2_simhash": simhash.op2_simhash,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_quality_attention": quality.op4_quality_attention,
        "op5_sentence_spans": sentence_spans.op5_sentence_spans,
        "op6_separator_scan": separator_scan.op6_separator_scan,
        "op7_unigram": unigram.op7_unigram,
        "op8_metric_tree": metric_tree.op8_metric_tree,
        "op9_temperature_mix": temperature_mix.op9_temperature_mix,
        "op10_language_mixture": language_mixture.op10_language_mixture,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_minhash": minhash.op12_minhash,
        "op13_importance_resampling": importance_resampling.op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.OP3_SQL,
        "op8_metric_tree": metric_tree.OP8_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op13_importance_resampling": importance_resampling.OP13_SQL,
    }
