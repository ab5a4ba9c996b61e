"""The operators' queries and, where SQL can express one, the DuckDB text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fingerprint, jaccard, packing, sharding, suffix, token_files, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_suffix_array_dedup": suffix.op3_suffix_array_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_nearest_neighbours": ann.op5_nearest_neighbours,
    "op6_sharding": sharding.op6_sharding,
    "op7_token_files": token_files.op7_token_files,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_fingerprints": fingerprint.op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter.oracle()}
