"""A training-data pipeline: five stages over ``documents``, each one operator applied to all that came before.

1. quality: the quadratic discriminant, learned from ``labels``; documents that it rejects go.
2. near_copies: the grouped prefix join; of each group of near copies the document with the smallest id stays
   (of repeated ids all rows; a row goes only if its own text is such a copy, whatever else its id names).
3. secrets: values found by the patterns or by their guess cost are replaced in the text.
4. mixture: sources are brought to their target shares; documents repeat as often as they are taken and
   stand in the order of their training positions, over the part files by number.
5. encoding: every text as token ids, with what the ids decode to as a digest, and ``position``, the document's
   place in that order from 0. Rows come in any order; sorted by position they are the curriculum.

Stages write Parquet in the shared folder and the next one reads it; what a stage wrote besides goes when it
ends. Defined results, of all stages: an empty table gives an empty table; columns beyond those of documents are
carried along whatever their names; a null in another column than id, text and source changes nothing. Null ids are
kept by every stage: they name no document, so no group of copies loses them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, mixing, qda, secrets, shinglejoin
from stowage.session import scratch, table, tidied, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts. A null text is judged as an empty one; repeated rows are judged alike;
    without rows of both labels every row has the same score, the share of label 1, and all stay or all go."""
    return qda.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not a near copy of a row with a smaller id. Null and empty texts are copies of nothing.

    The ids to drop are written first, so that Spark knows their size: few are sent to all tasks, and texts stay where they are.
    """
    copy, hashed = _fresh(docs, "copy"), _fresh(docs, "hash")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo < hi")
    if several.isEmpty():
        found = shinglejoin.near_duplicates(docs)
        copies = found.where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct()
        copies = written(copies, "copies")
        return docs.join(copies, docs["doc_id"] == copies[copy], "left_anti")
    # ids that name different texts: each text is a node of its own, in the order of ids
    rows = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text.alias("hash"))).alias("row"), "text")
    found = shinglejoin.near_duplicates(rows, "row")
    copies = found.where("component_id is not null and row.doc_id <> component_id.doc_id").select(F.col("row.doc_id").alias(copy), F.col("row.hash").alias(hashed)).distinct()
    copies = written(copies, "copies")
    return docs.join(copies, (docs["doc_id"] == copies[copy]) & (text == copies[hashed]), "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets of their texts replaced and ``n_chars`` of changed texts counted anew; null and empty
    texts stay as they are, repeated rows are changed alike."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows as often as the mix takes them, in order. A null source is a source of its own; rows without words
    stand once, at the end; repeated rows are documents of their own."""
    return mixing.dealt(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, position`` of every row; a null text is an empty one."""
    return bpe.digest(mixing.positions(docs), keep=("position",))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_copies", near_copies), ("secrets", hide_secrets), ("mixture", mixture), ("encoding", encoding)]

#: The discriminant, the guess costs and the merges are not SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"{k}-{name}")
        with tidied(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
