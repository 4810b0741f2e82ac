"""What the operators of this subpackage share: table access, staged tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+; bytes.split() cuts at exactly these bytes.
SPACES = b" \t\n\x0b\x0c\r"
#: A-Z to a-z, other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Records and bytes of one Arrow batch: a batch ends at whichever comes first, so long texts don't add up.
BATCH_ROWS, BATCH_BYTES = 2000, 64 << 20
#: Estimates from this size on are the optimizer's word for not knowing.
UNKNOWN = 1 << 58
MOST_PARTS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session gets a temporary folder of its machine, set once; any
    other session gets a ValueError, since its executors would write to folders of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="verbatix-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/verbatix/{uuid.uuid4().hex}"


#: Folders that staged() has written, per thread, so that they can be removed when no plan needs them any more.
_staged = threading.local()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps start from files, whatever executors are lost."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    _staged.paths = [*getattr(_staged, "paths", ()), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_once(make: Callable[[], DataFrame], name: str, before: DataFrame | None = None) -> DataFrame:
    """What make() gives, staged; the tables that it staged on the way, and the one before, are removed."""
    outer, _staged.paths = getattr(_staged, "paths", []), []
    df = staged(make(), name)
    store = df.sparkSession._jvm.org.apache.hadoop.fs
    old = [] if before is None else [f.rsplit("/", 1)[0] for f in before.inputFiles()[:1]]
    for path in [*_staged.paths[:-1], *old]:
        folder = store.Path(path)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    _staged.paths = [*outer, _staged.paths[-1]]
    return df


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; for a scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, mb: float) -> int:
    """How many partitions hold about mb megabytes of df's input files each; at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return least if size >= UNKNOWN else max(least, min(MOST_PARTS, int(size / (mb * 1e6)) + 1))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS records and about BATCH_BYTES; both are settings of the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def id_and_text(df: DataFrame) -> DataFrame:
    """doc_id as bigint and the text's UTF-8 bytes (null text: empty); other columns are not read."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def pairs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch as tuples of Python values."""
    return zip(*(c.to_pylist() for c in batch.columns))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from a list of tuples."""
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
