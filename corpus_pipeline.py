"""From raw documents to packed training bins.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  Null,
repeated and missing ids are ordinary rows everywhere; no stage joins by id but to labels.  Input columns may
have any name, those of results included: filtering stages return exactly the columns that they got.
An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import packing, pii, quality_model, quality_rules, simhash, token_count
from vertexloom.llm.common import Shared, fresh, remove, scratch, shared_dir, table

#: Tokens in a bin.
WINDOW = 4096
#: Rows to drop that are broadcast, at most (8 bytes each); more are joined.
FEW = 4_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go.

    Null and empty texts are scored like any other; equal rows have equal scores, so all stay or all go.
    Without labels of both classes the share of label 1 decides.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, keep=docs.columns).where("predicted = 1").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the current policy rejects go, among them null, empty and all other texts of fewer than 50 words; equal rows stay or go together."""
    return quality_rules.judge(quality_rules.ledger(docs, keep=docs.columns)).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near duplicates, the row of the smallest id stays.

    Rows count as documents of their own, whether they repeat an id or have none: they
    are told apart by a number, which is written with them so that it can't change.  Of
    rows of equal id the first stays; a row without id stays only where no other row of
    its group has one.  Texts without a word are near duplicates of each other.

    The numbers of rows that go are written first.  Up to FEW of them are sent to the
    texts; only beyond that are texts shuffled.
    """
    row, shared = fresh(docs, "__row"), Shared(spark)
    rows = shared.save(docs.withColumn(row, F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    groups = simhash.near_duplicates(rows.select(key.alias("key"), "text"), "key")
    gone = shared.save(groups.where("key.row <> component_id.row").select(F.col("key.row").alias(row)))
    return rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, row, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: spans of personal data give way to their kind, and ``n_chars`` is counted again (null for null text); every row stays."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: bins of WINDOW tokens, of lengths counted by operator 3.

    Texts that became near copies of each other when their personal data went (operator 2
    again) don't share a bin.  A null or empty text takes a separator; equal rows are packed each.
    """
    counted = token_count.count_tokens(docs.select("doc_id", "source", "text"))
    rows = packing.near_copies(counted.select("doc_id", "source", "text", F.col("n_tokens").alias("units")), Shared(spark))
    return packing.pack_documents(rows, rows["units"], source=rows["source"], cluster=rows["cluster"], capacity=WINDOW)


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: The classifier, fingerprints and packing can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's tables go once the next has been written."""
    docs, base, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            remove(spark, f"{base}/{before}")
        docs, before = spark.read.parquet(f"{base}/{name}"), name
    return docs
