"""The corpus pipeline: five operators in a row, each working on what the one before kept.

    toxicity        rows that score 0.3 or more go
    near_copies     one document of each group of near copies stays
    benchmark       rows that hold a benchmark item go
    personal_data   personal data in the texts is masked; n_chars follows the text
    packing         token pieces of binary lengths, one sequence each

Stages are written to the shared folder and read back, so a lost executor repeats one stage at most.
Rows with a NULL id are judged like others; of repeated rows (same id and text) one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workfold.llm import decontaminate, jaccard, packing, pii, toxicity
from workfold.llm.common import id_key, read_table, shipped, text_of, vocabulary_path
from workfold.plans.pin import pin


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 1_000  # whole texts sent to a Python worker at once; they are judged one by one


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans run inside send few texts at once, so a worker and its executor hold few copies; the session's value returns."""
    before = spark.conf.get(BATCH_CONF)
    if int(before) <= 0 or int(before) > TEXTS:
        spark.conf.set(BATCH_CONF, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def one_by_one(stage):
    """A stage that hands over its rows written, computed with few texts at once."""
    @wraps(stage)
    def written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return pin(stage(spark, docs, sf_dir), stage.__name__)

    return written


@one_by_one
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the threshold, learned from the labels that are not held out."""
    p = toxicity.Toxicity()
    score = toxicity.scorer(toxicity.learn(docs, read_table(spark, sf_dir, "labels"), p))
    return docs.where(score(text_of("text")) < p.threshold)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id."""
    shipped(spark)
    kept = jaccard.jaccard_classes(docs).where("kept").select(id_key("doc_id").alias("id"), "mark").distinct()
    # The row is one column, so no name of the table's can clash with the keys.
    keyed = docs.select(id_key("doc_id").alias("id"), F.xxhash64(text_of("text")).alias("mark"), F.struct("*").alias("row"))
    return keyed.join(kept, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("row.*")


@one_by_one
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@one_by_one
def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data masked."""
    shipped(spark)
    masked = pii.mask_personal(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary lengths."""
    shipped(spark)
    return packing.pack_power_of_two(docs, vocabulary_path(), end_id=2, most=4096)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("personal_data", mask_personal), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if hasattr(stage, "__wrapped__") else pin(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the corpus, without the ids themselves."""
    return run(spark, sf_dir).drop("ids")


ORACLE_SQL = None
QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
