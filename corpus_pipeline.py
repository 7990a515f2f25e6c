"""Corpus pipeline over ``documents``: five stages, each calling one operator of aerocast.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its
result is written to the shared folder as Parquet and read back for the next one. All but
the last return the input's columns (doc_id, text, lang, source, n_chars and any further
ones). Rows with a null doc_id go through every stage, compared with nothing; rows that
repeat a doc_id with other texts are documents of their own where documents are compared,
rows that repeat id and text are copies; null and empty texts are kept unless the
classifier rejects them; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocast.llm.bpe import encode_documents
from aerocast.llm.common import fresh, written
from aerocast.llm.decontaminate import with_leaks
from aerocast.llm.line_dedup import dedup_lines
from aerocast.llm.minhash import near_duplicates
from aerocast.llm.quality import score_quality

#: Fitted and tokenizer-based stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

SHINGLE_WORDS, SIMILARITY = 5, 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier (operator 4, fitted on the labels) accepts."""
    score, keep = fresh(docs, "__score"), fresh(docs, "__keep")
    scored = score_quality(docs, _table(spark, sf_dir, "labels"), score_col=score, keep_col=keep)
    return scored.filter(F.col(keep)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out (operator 10); a document of which nothing but white
    space is left goes, n_chars is counted anew where lines went."""
    lines, removed = fresh(docs, "__lines"), fresh(docs, "__removed")
    cut = dedup_lines(docs, lines_col=lines, removed_col=removed)
    bare = (F.col(removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = cut.filter(~F.coalesce(bare, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


#: Numbers of texts that come under the id of another text: above all ids below 2**62, so the id's first text stands for a group.
OTHER_TEXTS = 1 << 62


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id (operator 7). The texts of a
    repeated doc_id are compared each for itself: the one with the smallest SHA-256 under the id, the others under
    numbers of their own (of 61 hashed bits); only what is linked to a kept text goes. Of rows equal in id and text the
    smallest in the order of the columns stays."""
    number, first, digest = (fresh(docs, c) for c in ("__number", "__first", "__digest"))
    i = fresh(docs, "__id")
    rows = docs.withColumn(digest, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    again = (rows.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(i)).agg(F.min(digest).alias(first), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(i, first))
    if again.isEmpty():
        rows = docs.withColumn(number, F.col("doc_id").cast("long"))
    else:
        again = written(again, "repeated")
        other = F.lit(OTHER_TEXTS) + F.shiftrightunsigned(F.xxhash64("doc_id", digest), 3)
        own = F.when(F.col(first).isNull() | (F.col(first) == F.col(digest)), F.col("doc_id").cast("long")).otherwise(other)
        rows = rows.join(again, rows["doc_id"] == again[i], "left").withColumn(number, own)
        once = rows.filter(F.col(i).isNotNull()).groupBy(number).agg(F.min(F.struct(*docs.columns)).alias(first)).select(f"{first}.*", number)
        rows = rows.filter(F.col(i).isNull()).select(*docs.columns, number).union(once)
        rows = written(rows, "numbered")
    copies = (near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), shingle=SHINGLE_WORDS, similarity=SIMILARITY)
              .filter(~F.col("kept")).select(F.col("doc_id").alias(i)))
    return rows.join(copies, rows[number] == copies[i], "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 3)."""
    leaks = fresh(docs, "__leaks")
    found = with_leaks(docs, _table(spark, sf_dir, "benchmark"), leaks_col=leaks)
    return found.filter(F.size(leaks) == 0).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of each document (operator 2)."""
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_bytes=False)
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
