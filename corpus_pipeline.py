"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. toxicity: documents that the model rejects go.
2. n-gram Jaccard join: of each group of near copies the document with the least doc_id stays.
3. secret scans: reported spans are replaced in the texts.
4. mixing: documents come as often as the mix takes them.
5. byte-level BPE: ids, as counts and digests of ids and of their decoding.

Defined cases: null and empty texts pass the first stage, stay in the second, and are taken 0 times in
the fourth; rows with one id and text are one document in the second stage, rows with one id and other
texts are several; of a group of near copies the least id stays, one that is not null if there is any;
texts of any length are taken whole; an empty table gives an empty result. Extra columns of any names
are carried through the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatix.llm.byte_bpe import round_trip
from verbatix.llm.common import staged, staged_once, table
from verbatix.llm.ngram_join import near_duplicates
from verbatix.llm.secret_scan import redact
from verbatix.llm.source_mix import mixed_documents
from verbatix.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model doesn't reject."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and every document without words."""
    found = staged(near_duplicates(docs), "near-copies")
    this = ["doc_id", "text_hash"]
    # the document that stays: the least id (a null one last), of texts with one id the least hash
    stays = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("stays"))
    marked = found.where("group is not null").groupBy("group", *this).agg(F.count("*").alias("copies")).join(stays, "group")
    first = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    # what goes, and what stays of several equal rows
    marked = marked.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("of"), first.alias("stays"), "copies").where("not stays or copies > 1")
    rows = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("bigint").alias("a"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")).alias("b"))
    same = F.col("a").eqNullSafe(F.col("id")) & (F.col("b") == F.col("of"))
    once = rows.join(marked, same, "left_anti").select("row")
    twice = rows.join(marked.where("stays"), same, "left_semi").dropDuplicates(["a", "b"]).select("row")
    return once.unionByName(twice).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the documents."""
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("mixing", mixing), ("byte-level BPE", byte_bpe)]

#: SQL has no compression distance, no tokenizer and no suffix of the mix's schedule; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's own tables and its predecessor's result are removed when it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = before = staged_once(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"), before)  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
