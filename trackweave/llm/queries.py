"""The queries opN_<name> of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import bpe, decontam, jaccard, lm_score, neardup, oracle, quality, secrets, token_counts, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": lm_score.op1,
        "op2_quality": quality.op2,
        "op3_secret_scan": secrets.op3,
        "op4_bpe": bpe.op4,
        "op5_jaccard_join": jaccard.op5,
        "op6_toxicity": toxicity.op6,
        "op7_decontamination": decontam.op7,
        "op8_token_counts": token_counts.op8,
        "op9_embedding_near_dedup": neardup.op9,
        "op10_url_filter": urlfilter.op10,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
