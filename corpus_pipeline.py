"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs. All but the last return the
columns of documents. Each works on every row that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, ngram_join, packing, quality, recompression
from quillon.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking scores below its threshold go."""
    labels = table(spark, sf_dir, "labels").where(~F.coalesce(quality.held_out(0, 5), F.lit(False)))
    ranking = quality.learn(docs, labels)
    score = "_score"
    while score in docs.columns:
        score += "_"
    scored = quality.rate(docs, ranking, score)
    return scored.where(F.col(score) >= quality.REJECT_BELOW).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id."""
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a text that loses any becomes its other words, joined by one space.

    A document that is left without words by this goes too; n_chars follows the text.
    """
    kept = recompression.strip_repeats(docs, keep_text=True)
    changed = F.col("n_removed") > 0
    kept = kept.where(~changed | (F.col("kept") != ""))
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, each taken copy a row, shuffled within its shard.

    A null source is one of its own, a null or empty text counts for nothing and
    goes with its block, rows equal in doc_id, source and text are placed alike,
    an empty table gives an empty mix.
    """
    return mixing.shuffled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is its end token alone, repeated rows are packed each, an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Learned scores, hashed draws and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _remove(spark, before)  # what the written stage was made from
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
