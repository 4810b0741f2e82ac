"""Corpora: schemas, scans, and the labelled corpus as a view over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

_text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])

FOUND = _text("id", "text", "label", "bucket")
DIAGNOSTIC = _text("id", "text", "label", "category", "frame_id", "pair_id", "subject", "token")
PREDICTIONS = T.StructType([T.StructField("model", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("predictions", T.ArrayType(_text("id", "pred")))])

#: The abuse words of the documents, numbered from 1.
ABUSE = ["trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
SEED = 12345


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = FOUND) -> DataFrame:
    """A quoted CSV with a header: quotes doubled, line breaks inside quotes, columns as declared."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=False)


def scan_csv_split(spark: SparkSession, path: str, schema: T.StructType = FOUND) -> DataFrame:
    """The same rows as scan_csv, read by as many tasks as the files have blocks.

    Whether a line break ends a record depends on whether the quotes before it are even in number. Lines
    are read block by block; the quotes of the blocks before are a sum over one row per block, those
    within a block a running sum over the block. Records of one line, nearly all, stay where they are;
    only lines of longer records meet by a shuffle. Files are UTF-8; a carriage return before the end of
    a record is dropped; the first record of each file is its header and must name the columns.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    within = Window.partitionBy("file", "block").orderBy("at")
    run = lines.withColumn("upto", F.sum("quotes").over(within)).withColumn("from", F.col("upto") - F.col("quotes"))
    # what holds for a block whose first line stands after an even number of quotes, and after an odd one
    even = lambda c, extra: (F.col(c) + extra) % 2 == 0
    blocks = run.groupBy("file", "block").agg(F.sum("quotes").alias("q"), *[F.count_if(even("from", k)).alias(f"starts{k}") for k in (0, 1)])
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("odd", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("records", F.coalesce(F.sum(F.when(F.col("odd") == 0, F.col("starts0")).otherwise(F.col("starts1"))).over(before), F.lit(0)))
    run = run.join(blocks.select("file", "block", "odd", "records"), ["file", "block"])
    starts, ends = even("from", F.col("odd")), even("upto", F.col("odd"))
    run = run.withColumn("record", F.col("records") + F.sum(starts.cast("long")).over(within)).select("file", "block", "at", "record", "value", (starts & ends).alias("whole"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    longer = run.where(~F.col("whole")).groupBy("file", "record").agg(F.array_join(pieces, "\n").alias("value"))
    both = run.where("whole").select("file", "record", "value").unionByName(longer).withColumn("value", F.regexp_replace("value", "\r$", ""))
    names = F.lit(",".join(schema.names))
    wrong = F.raise_error(F.concat(F.lit("unexpected header: "), F.col("value"))).cast("boolean")
    is_row = F.when(F.col("record") > 1, F.col("value") != "").when(F.replace("value", F.lit('"'), F.lit("")) == names, False).otherwise(wrong)
    return both.where(is_row).select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "multiLine": "true"}).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """The same format, written by as many tasks as df has."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def found(rows: DataFrame) -> DataFrame:
    """The found corpus: label and bucket trimmed, missing ones empty, and the template."""
    clean = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c)
    return rows.select("id", "text", clean("label"), clean("bucket"), X.template_id(F.col("text")).alias("template"))


def diagnostic(rows: DataFrame) -> DataFrame:
    """The diagnostic corpus: bucket is the category, the pair comes from pair_id, the template is the construction group."""
    return rows.select("id", "text", "label", F.col("category").alias("bucket"), "category", "frame_id", F.col("pair_id").alias("pair"), "subject", "token", X.construction_group(F.col("category"), F.col("frame_id")).alias("template"))


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """model, prompt, pos, id, pred of prediction files; raises ValueError if one isn't of that shape."""
    docs = spark.read.schema(PREDICTIONS).json(path, multiLine=True)
    if docs.where("model is null or prompt is null or predictions is null").limit(1).count():
        raise ValueError(f"{path}: model, prompt and predictions are required")
    return exploded(docs)


def exploded(docs: DataFrame) -> DataFrame:
    """One row for each prediction, with its position."""
    return docs.select("model", "prompt", F.posexplode("predictions").alias("pos", "p")).select("model", "prompt", "pos", "p.id", "p.pred")


def scan_json_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A results file, None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).json(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small relation of fixed values."""
    return spark.createDataFrame(rows, ddl)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, label, bucket, source of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    bucket = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "STRONG").when(F.col("toxic") == 1, "CONTEXT").otherwise("NOT")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", F.when(F.col("toxic") == 1, "MGY").otherwise("NOT").alias("label"), bucket.alias("bucket"), "source")


def redact(text) -> F.Column:
    """Abuse words as [FSLUR_nn], e-mail addresses as [CTX_01]: one pass marks the words, plain replacements number them.

    Texts without the character that a replacement needs are not searched for it.
    """

    def numbered(s):
        for k, w in enumerate(ABUSE, 1):
            s = F.regexp_replace(s, rf"(?i)\[FSLUR_{w}\]", f"[FSLUR_{k:02d}]")
        return s

    with_ = lambda s, c, changed: F.when(F.contains(s, F.lit(c)), changed).otherwise(s)
    marked = F.regexp_replace(text, r"(?i)(?<![A-Za-z0-9_])(" + "|".join(ABUSE) + r")(?![A-Za-z0-9_])", "[FSLUR_$1]")
    return X.let(X.let(marked, lambda s: with_(s, "[", numbered(s))), lambda s: with_(s, "@", F.regexp_replace(s, EMAIL, "[CTX_01]")))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its texts redacted."""
    return corpus(spark, sf_dir).withColumn("text", redact(F.col("text")))


def paired(rows: DataFrame) -> DataFrame:
    """id, label, pair: within a source the n-th MGY row and the n-th NOT row, in hash order, form a pair.

    Ranks are taken within (source, label), of which there are many.
    """
    rank = F.row_number().over(Window.partitionBy("source", "label").orderBy(F.md5(F.concat(F.lit("pair:"), F.col("id").cast("string")).cast("binary")), "id"))
    ranked = rows.select("id", "label", "source", rank.alias("n"))
    both = ranked.groupBy("source", "n").agg(F.count("*").alias("k")).where("k = 2").select("source", "n")
    return ranked.join(both, ["source", "n"]).select("id", "label", F.concat_ws(":", "source", F.col("n").cast("string")).alias("pair"))


def predictions(rows: DataFrame) -> DataFrame:
    """id, pred: each label flipped for about a fifth of the ids, by hash."""
    flip = F.substring(F.md5(F.concat(F.lit("pred:"), F.col("id").cast("string")).cast("binary")), 1, 1).isin("0", "1", "2")
    return rows.select("id", F.when(flip, F.when(F.col("label") == "MGY", "NOT").otherwise("MGY")).otherwise(F.col("label")).alias("pred"))
