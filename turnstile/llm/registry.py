"""Queries of the training-data operators, the pipeline, and their oracles."""

from __future__ import annotations

import corpus_pipeline
from turnstile.llm import op1_quality_rules as quality
from turnstile.llm import op2_license_scan, op3_url_filter
from turnstile.llm.op1_quality_rules import op1_quality_rules
from turnstile.llm.op2_license_scan import op2_license_scan as license_scan
from turnstile.llm.op3_url_filter import op3_url_filter as url_filter
from turnstile.llm.op4_line_dedup import op4_line_dedup
from turnstile.llm.op5_toxicity import op5_toxicity
from turnstile.llm.op6_bpe_automaton import op6_bpe_automaton
from turnstile.llm.op7_ctph import op7_ctph
from turnstile.llm.op8_packing import op8_packing
from turnstile.llm.op9_ngram_join import op9_ngram_join
from turnstile.llm.op10_token_counts import op10_token_counts

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": license_scan,
    "op3_url_filter": url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_automaton": op6_bpe_automaton,
    "op7_ctph": op7_ctph,
    "op8_packing": op8_packing,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_counts": op10_token_counts,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_quality_rules": quality.oracle(), "op2_license_scan": op2_license_scan.oracle(), "op3_url_filter": op3_url_filter.oracle()}
