"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Quality: rejected documents go. Near duplicates: one document of each group stays (the least id). Decontamination: passages of
the benchmark are cut out, with the text around them kept, and a document of which they are half the words or more goes. Secrets: masked
in the text. Encoding: the last stage returns, for each document, ids and digests.

n_chars is counted anew where a stage changes a text. Stages keep null and empty texts unless the quality classifier rejects them (a null text stays null), take
repeated rows for near duplicates, ties as their operators do, and texts of any length whole; an empty table passes as one. Columns besides the five of
documents go in the first stage, whatever their names. Each stage's table stays in the shared folder until the next is written; the last one is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import bpe, decontam, jaccard, quality, secrets
from trackweave.llm.common import Workspace, spliced

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(spark, docs, model).where(F.col("tw_quality") >= quality.REJECT).select(*COLUMNS)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(spark, docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.where(F.col("tw_n_hit") * 2 < F.greatest("tw_n_words", F.lit(1)))
    cut = F.size("tw_spans") > 0
    rest = spliced(F.col("text"), F.col("tw_spans"), lambda *_: F.lit(""))
    return found.withColumn("rest", rest).select("doc_id", F.col("rest").alias("text"), "lang", "source", F.when(cut, F.length("rest").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redacted(secrets.scanned(docs))
    return found.select("doc_id", "text", "lang", "source", F.when(F.size("tw_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encoded(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "lang", "source", F.col("tw_n_tokens").alias("n_tokens"), F.col("tw_ids").alias("ids"), F.col("tw_ids_sha256").alias("ids_sha256"), F.col("tw_decoded_sha256").alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", benchmark_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]

#: Trained classifiers and byte-pair merges have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
