"""From raw documents to packed token sequences, in five stages.

Each stage takes what the stage before kept, as a Parquet table, and returns
the table for the next: toxic documents go, one document of each group of near
duplicates stays, documents that repeat benchmark passages go, secrets are
masked, and the rest is packed.  All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbspark.llm.decontamination import find_windows
from verbspark.llm.minhash_dedup import near_duplicates
from verbspark.llm.packing import pack
from verbspark.llm.queries import TOXIC, table, tokenizer_path
from verbspark.llm.secret_ledger import redact, scan
from verbspark.llm.session import checkpointed, delete, scratch, shared_folder
from verbspark.llm.toxicity_pu import learn, score

#: Up to so many rows of ids or findings are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: SQL has no counterpart of the learned first stage; tests hold the others against brute force.
ORACLE_SQL = None


def _small(side: DataFrame) -> DataFrame:
    side = checkpointed(side)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, learned from all labels, does not call toxic.

    Each row is decided by its own text, whatever its id; a null or empty text
    has the lowest score and stays.  Without toxic labels the score of all rows
    is the prior, which is too small to reject any.  No rows give no rows.
    """
    model = learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = score(docs, model, carry=tuple(c for c in docs.columns if c != "doc_id"))
    return scored.where(F.col("score") < TOXIC).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id.

    Rows are numbered first, so each is decided by its own text, whatever its
    id: rows that share an id are told apart, of repeated rows one stays, and a
    row with a null id stays only if all of its group have one.  Null and empty
    texts are in no group and stay.  No rows give no rows.
    """
    rows = checkpointed(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = checkpointed(near_duplicates(rows, id_col="_row", carry=("doc_id",)).select("_row", "doc_id", "component_id", "kept"))
    groups = found.where("not kept").select("component_id").distinct()
    members = found.join(groups, "component_id", "left_semi")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("best"))
    others = members.join(best, "component_id").where(F.col("_row") != F.col("best")["_row"]).select("_row")
    return rows.join(_small(others), "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark window.

    Each row is decided by its own text, whatever its id; null and empty texts
    have no words and stay.  An empty benchmark rejects nothing, and no rows
    give no rows.
    """
    found = find_windows(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where(F.size("spans") == 0).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret in their texts replaced by a mark and n_chars counted anew for those.

    Overlapping secrets are one mark.  Texts without a secret, null ones among
    them, and their n_chars stay as they are; equal texts are masked alike,
    whatever their ids.  No rows give no rows.
    """
    found = scan(docs).findings.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    found = _small(found.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")))
    joined = docs.join(found, F.sha2("text", 256) == F.col("_blob"), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(redact("text", F.col("_spans")))
    masked = joined.withColumn("text", text).withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return masked.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with a checksum of each piece's ids.

    A null or empty text is a document of one token; every row is a document,
    also those that repeat an id.  No rows give no pieces.
    """
    pieces = pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir.

    Each stage's table is written to the shared folder; what a stage wrote on
    its way is deleted then, and so is the table before it.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
