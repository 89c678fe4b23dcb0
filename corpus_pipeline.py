"""A corpus pipeline of five stages, each written and read again before the next.

Language identification drops documents that it rejects: without letters, or
of no learned language with at least half the probability. Near-duplicate
groups keep one document each. Personal data gets surrogates. Sources are mixed
to target weights, which repeats, drops and cuts documents. The result is
packed into sequences of 1,024 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import language, mixing, neardup, packing, pii
from lakemill.llm.batches import fresh
from lakemill.llm.store import Workspace

#: Least probability of the predicted language that keeps a document.
LEAST_LANGUAGE = 0.5

#: No SQL expresses a trained classifier or a tokeniser.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    out = language.identify(spark, docs, language.fold(4) != 2, added=(found, score))
    return out.where((F.col(found) != "und") & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups by five-word shingles at a similarity of 0.8 or more; one row of each stays.

    Rows go by a hash of doc_id and text, as doc_id may be null or repeated: rows equal in both are copies of each other.
    Rows without words are linked with nothing."""
    ws = Workspace(spark, "near_dedup")
    row = fresh("row_key", docs.columns)
    rows = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit(""))))
    found = neardup.near_duplicates(spark, rows.select(F.col(row).alias("doc_id"), "text"), size=5).where("kept")
    kept = found.groupBy(F.col("doc_id").alias(row)).agg(F.count("*").alias("many"), F.max("n_shingles").alias("n"))
    kept = ws.put(kept.select(row, ((F.col("many") > 1) & (F.col("n") > 0)).alias("copied")), "kept")
    single = rows.join(kept.where("NOT copied").select(row), row, "left_semi")
    copied = rows.join(kept.where("copied").select(row), row, "left_semi").dropDuplicates([row])
    return single.select(*docs.columns).unionByName(copied.select(*docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_entities(spark, docs, pii.KEY, counted=fresh("n_entities", docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks_path, pattern = packing.public_vocabulary()
    return packing.pack_documents(spark, docs, ranks_path=ranks_path, pattern=pattern)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.put(docs, name)
    return docs
