"""Queries and SQL of the subpackage, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, hard_negatives, html_text, importance_resampling, langid, license_scan, media, mixing, ngram_join, sqltext, substring_dedup, suffix_tree_lm, token_files, toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_media": media.op2_media,
    "op3_langid": langid.op3_langid,
    "op4_suffix_tree_lm": suffix_tree_lm.op4_suffix_tree_lm,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_files": token_files.op7_token_files,
    "op8_html_text": html_text.op8_html_text,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_ngram_join": ngram_join.sql(),
    "op5_substring_dedup": sqltext.SUBSTRING_DEDUP,
    "op6_mixing": mixing.sql(),
    "op9_decontaminate": sqltext.DECONTAMINATE,
    "op12_hard_negatives": hard_negatives.sql(),
    "op13_importance_resampling": importance_resampling.sql(),
}
