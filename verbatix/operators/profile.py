"""Profiles of a corpus: counts that show leaks, duplicates and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _tokens():
    return F.regexp_extract_all("text", F.lit("(" + X.TOKEN + ")"), F.lit(1))


def token_frequency(rows: DataFrame) -> DataFrame:
    """token, n, n_rows of the redaction tokens."""
    per = rows.select("id", F.explode(_tokens()).alias("token")).groupBy("id", "token").agg(F.count("*").alias("k"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("n_rows"))


def token_families(rows: DataFrame) -> DataFrame:
    """family, n_distinct, tokens (sorted, joined)."""
    t = rows.select(F.explode(F.regexp_extract_all("text", F.lit("(" + X.FAMILY_TOKEN + ")"), F.lit(1))).alias("token")).distinct()
    t = t.withColumn("family", F.regexp_extract("token", X.FAMILY_TOKEN, 1))
    return t.groupBy("family").agg(F.count("*").alias("n_distinct"), F.array_join(F.sort_array(F.collect_set("token")), " ").alias("tokens"))


def presence_confusion(rows: DataFrame, positive: str = "MGY") -> DataFrame:
    """tp, fp, fn, tn of the rule that any token means positive."""
    has, pos = F.col("text").rlike(X.TOKEN), F.col("label") == positive
    return rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", has & pos), ("fp", has & ~pos), ("fn", ~has & pos), ("tn", ~has & ~pos))])


def duplicate_profile(rows: DataFrame) -> DataFrame:
    """n_texts, n_distinct, n_repeated, n_rows_repeated; texts are told apart by md5, so they are not shuffled."""
    n = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"))
    many = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    return n.agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum(many).alias("n_rows_repeated"))


def token_length_stats(rows: DataFrame) -> DataFrame:
    """avg_len, min_len, max_len in white-space tokens."""
    n = F.size(X.white_tokens(F.col("text")))
    return rows.agg(F.avg(n).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))


def template_profile(rows: DataFrame) -> DataFrame:
    """template (md5 of it), n, first_label (of the least id), buckets (sorted, joined)."""
    key = F.md5(X.template_id(F.col("text"), drop_punctuation=False).cast("binary"))
    # by count, then by the least id
    return rows.groupBy(key.alias("template")).agg(F.count("*").alias("n"), F.min("id").alias("_id"), F.min_by("label", "id").alias("first_label"), F.array_join(F.sort_array(F.collect_set("bucket")), ",").alias("buckets")).orderBy(F.desc("n"), "_id").drop("_id")


def distinct_text_by_bucket(rows: DataFrame) -> DataFrame:
    """bucket, n_distinct."""
    return rows.select("bucket", F.md5(F.col("text").cast("binary")).alias("h")).distinct().groupBy("bucket").agg(F.count("*").alias("n_distinct"))


def script_share(rows: DataFrame, script: str = "[\\u0900-\\u097F]", other: str = "[À-ÿ]") -> DataFrame:
    """label, n, n_script, n_other: rows with a character of a range (Devanagari), and of another one (accented Latin)."""
    has = lambda x: F.count_if(F.col("text").rlike(x))
    return rows.groupBy("label").agg(F.count("*").alias("n"), has(script).alias("n_script"), has(other).alias("n_other"))


def bucket_samples(rows: DataFrame, n: int = 3) -> DataFrame:
    """bucket, id, place: the first n rows of each bucket; tasks keep n rows of a bucket before the shuffle."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
    return rows.select("bucket", "id", place.alias("place")).where(F.col("place") <= n)
