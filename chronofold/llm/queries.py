"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import ann, jaccard_join, line_dedup, media, merkle, mixing, packing, prefix_trie, sharding, token_counts, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, and the pipeline."""
    return {
        "op1_ann_search": ann.query,
        "op2_media_columns": media.query,
        "op3_packing": packing.query,
        "op4_mixing": mixing.query,
        "op5_line_dedup": line_dedup.query,
        "op6_token_counts": token_counts.query,
        "op7_token_files": token_files.query,
        "op8_sharding": sharding.query,
        "op9_toxicity": toxicity.query,
        "op10_ngram_jaccard": jaccard_join.query,
        "op11_merkle_manifest": merkle.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_warc": warc.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op4_mixing": mixing.SQL, "op5_line_dedup": line_dedup.SQL, "op10_ngram_jaccard": jaccard_join.SQL, "op11_merkle_manifest": merkle.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_warc": warc.SQL}
