"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. ``docs`` has at least an integer ``doc_id`` and a
``text``; other columns may have any name and type and pass through as they are, but for the last
stage. An empty table gives an empty result in every stage, null texts count as empty, and rows that
repeat an id and a text are treated alike.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, decontam, exact_dedup, minhash, quality
from quernstone.llm.common import is_held_out, shared_folder, spread, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier rejects.

    It learns from labelled documents outside the held-out fold; without any, nothing is rejected. Null texts are
    scored as empty ones; rows with equal texts stay or go together, whatever their ids.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~is_held_out("doc_id"))
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of equal texts: the row with the smallest id.

    Null and empty texts are one group. Null ids come last; of rows that also share the id the smallest by the other
    columns stays, so repeated rows leave one.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of texts whose five-word shingles are similar to 0.8 or more: the smallest id.

    Null, empty and blank texts and null ids stay. Rows that repeat an id stay or go together.
    """
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark: ten of an item's words in a row, or a whole shorter item.

    Null and empty texts stay; ids are not read; an empty benchmark drops nothing.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text and check the round trip: ``doc_id, n_tokens, ids, round_trip``; other columns end here.

    A null or empty text has no ids and a true round trip; repeated rows and null ids have a row each.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    some = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    both = bpe.round_trip(some, ranks, pattern, keep=["doc_id", "sha"])
    return both.select("doc_id", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_leaks),
    ("byte_bpe", to_tokens),
]

#: The classifier and near-duplicate groups cannot be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``.

    Stages are written to the session's shared folder, and removed when the next one is; the last is the result's own.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spread(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _remove(spark, before)
        before = f"{base}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
