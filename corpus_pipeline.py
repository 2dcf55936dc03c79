"""A training corpus from raw documents: language, exact copies, near copies, benchmark leaks,
mixing. Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
reread as the next one's docs.

Every stage reads all its predecessor kept, with nulls, empty texts, ties, repeated rows and
extra columns as its operator defines. All but the last return the columns of documents. Rows are
dropped by a number they get on entry, so null and repeated ids are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontam, exact, langid, mixing, similar
from maskwright.llm.common import ROW, crc_mod, delete, numbered, passing, scratch, table, without, write


#: Languages that stay, and the least share of the posterior at which a prediction counts.
LANGUAGES, LEAST_SCORE = ("de", "en", "es", "fr"), 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in one of LANGUAGES with a score of at least LEAST_SCORE."""
    model = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.identify(docs.withColumn("__docs", F.struct(*docs.columns)), model)
    return found.where(F.col("lang_pred").isin(*LANGUAGES) & (F.col("lang_score") >= LEAST_SCORE)).select("__docs.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows that share it, one."""
    rows = numbered(docs)
    found = exact.exact_groups(rows, ROW).where("group_size > 1").select(F.col(ROW).alias("id"), F.col("keep_id").alias("component_id"))
    found = table(found.join(rows.select(F.col(ROW).alias("id"), "doc_id"), "id").select("component_id", F.struct("doc_id", "id").alias("row")), "members")
    kept = found.groupBy("component_id").agg(F.max("row").alias("kept"))
    gone = found.join(kept, "component_id").where("row.id <> kept.id").select(F.col("row.id").alias(ROW))
    return without(rows, table(gone, "copies"), ROW).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 in its form for Jaccard similarity, fingerprints first: of texts with a Jaccard similarity of 0.8 or more over five-word shingles, directly or
    by way of others, the row with the smallest doc_id."""
    rows = numbered(docs)
    found = similar.groups(rows, ROW, size=5, similarity=0.8).join(rows.select(F.col(ROW).alias("id"), "doc_id"), "id")
    found = table(found.select("component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id").alias("row")), "members")
    kept = found.groupBy("component_id").agg(F.min("row").alias("kept"))
    gone = found.join(kept, "component_id").where("row.id <> kept.id").select(F.col("row.id").alias(ROW))
    return without(rows, table(gone, "near"), ROW).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = numbered(docs)
    gone = decontam.decontaminate(rows, items, id_col=ROW).where("contaminated").select(ROW)
    return without(rows, table(gone, "leaks"), ROW).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix: mix_block, mix_slot, mix_rank, in_mix."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: Trained predictions and 64-bit hashes have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote besides its result goes when that is written, and so does its input."""
    docs = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = getattr(docs, "table_path", None)
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{i}")
        with passing(spark):
            write(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs.drop(ROW)
