"""A corpus pipeline: toxicity filter, near-duplicate removal, decontamination, redaction, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``; the last returns one row of token ids per document.

Defined results: a null or empty text passes every stage (it has no shingles, windows, spans or tokens) unless the
classifier's bias alone rejects it; rows with a null id take part in every stage and come after the others where one
row of a group is chosen; rows that repeat both id and text become one, rows that share an id but not a text are
judged by text and stay apart; an empty table gives no rows; further columns are carried along untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontam, jaccard, pii, toxicity
from barloom.llm._common import fold, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained as in op1) scores 0.7 or more go."""
    learn = docs.select("doc_id", "text").filter(fold("doc_id", 3) != 1)
    return toxicity.accepted(docs, toxicity.fit(learn, table(spark, sf_dir, "labels", "doc_id", "toxic")))


#: Stand-in ids of rows without one lie above all real ids; equal texts share one.
NO_ID = 1 << 62


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the smallest id stays; rows without an id come last."""
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID)))
    groups = jaccard.near_duplicates(docs.select(node.alias("doc_id"), "text"))
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_node")).distinct()
    rows = docs.withColumn("_node", node).join(kept, "_node", "left_semi")
    return rows.dropDuplicates(["_node", "text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    encoded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", encode_tokens),
]

#: Learned filters and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
