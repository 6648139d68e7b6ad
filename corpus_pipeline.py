"""Documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next one's docs:

1. quality: importance resampling against the labelled target; rejected documents go.
2. exact_dedup: one document of each group of equal texts stays, the smallest doc_id.
3. near_dedup: one document of each near-duplicate component (five-word shingles, 0.8) stays.
4. pii: personal data and what bootstrapped patterns find is masked; n_chars follows the text.
5. packing: the texts as token pieces in sequences, by vector best-fit under three capacities.

All but the last return the columns of documents, further ones included.  Null, empty and blank texts
leave in stage 1; rows without id, or of one id, are judged each by its text; repeated rows leave in
stage 2; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, near_dedup, packing, pii, quality
from textloom.llm.common import materialise, table
from textloom.llm.registry import CAPACITIES, tokenizer_path


REMEMBERED = 60_000  # words: executors hold other stages' memory too
BATCH = "1024"  # rows of an Arrow batch: both the JVM and the workers keep the memory of the largest one


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH rows; texts are long, and results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that reach the sample; null, empty and blank texts go."""
    _small_batches(spark)
    return quality.select(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; texts of a shared or missing id all have one."""
    _small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component; ids may recur or be null."""
    _small_batches(spark)
    return near_dedup.near_dedup(docs, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, texts masked; null and empty texts stay as they are."""
    _small_batches(spark)
    return pii.redact(docs, pii.learn(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece; a null or empty text is a piece of the end id alone."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_path(), with_ids=True, remembered=REMEMBERED, **CAPACITIES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Resampling noise, MinHash and bootstrapping have no SQL form; tests/llm hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
