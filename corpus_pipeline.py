"""A corpus from raw documents to packed training sequences.

STAGES are applied in order; each reads all that its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read
from genolith.llm.decontaminate import contained_items
from genolith.llm.minhash import near_duplicates
from genolith.llm.packing import pack_documents
from genolith.llm.quality import filter_quality
from genolith.llm.secrets import redact

#: Ids that are broadcast at most to drop their rows (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not among ids. A null key is kept."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, key, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and so do null and empty texts. A null doc_id or language is a value like others;
    repeated rows are judged alike; extra columns stay as they are."""
    return filter_quality(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), Scratch(spark, "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id stays; of
    rows that share a doc_id and are near-duplicates the one whose text has the smallest hash, of equal ones any. Rows that share a
    doc_id but not the text are different documents. Null doc_ids come after all others. Null and empty texts are
    duplicates of nothing and stay. Extra columns stay as they are."""
    scratch = Scratch(spark, "near_dedup")
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        # ids that do not tell rows apart are replaced by the place in their order
        ordered = docs.repartitionByRange(F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
        docs_, key = scratch.keep(ordered.withColumn("_nd_row", F.monotonically_increasing_id()), "rows"), "_nd_row"
    else:
        docs_, key = docs, "doc_id"
    judged = near_duplicates(docs_.select(F.col(key).alias("doc_id"), "text"), scratch)
    dropped = scratch.keep(judged.where("NOT kept").select(F.col("doc_id").alias(key)), "dropped")
    return _without(docs_, dropped, key).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, with all rows of their doc_id. Rows with a null doc_id or text stay, as do
    extra columns and repeated rows; null and empty items are contained in nothing."""
    scratch = Scratch(spark, "decontamination")
    found = contained_items(docs, read(spark, sf_dir, "benchmark", "item_id", "text"), scratch)
    return _without(docs, scratch.keep(found.select("doc_id").distinct(), "leaks")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind. All rows stay, repeated ones too; a null text stays null; n_chars follows the text, other columns stay as they are."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, their sequence and their place in it. A null or empty text is its end id alone; repeated rows and
    null doc_ids are packed like others; extra columns do not come along."""
    return pack_documents(docs, Scratch(spark, "packing"), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: The classifier, the tokens and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            scratch.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
