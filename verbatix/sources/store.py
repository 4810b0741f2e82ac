"""Folders that driver and executors share: working tables, and a versioned store of results.

A store is a folder of Parquet tables and one small file per version that names the version's tables in
order: rows of a later table stand in the place of earlier ones with their key. A change writes its own
rows alone; after MOST_TABLES of them the tables are merged. The version's file is created without
overwriting, so of two writers one gets the number and the other names its table in the next one; readers
take the highest number whose file is whole. A store that isn't there reads as None; a version whose
writer died is passed over.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local session without the setting gets a temporary folder, any other a ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="verbatix-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/verbatix/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what follows starts from files."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_for_now(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df written as by written, and what deletes the folder."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Tables of a version before they are merged.
MOST_TABLES = 16


class Store:
    """Rows by key in numbered versions."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self) -> list[int]:
        top = self._path(f"{self.path}/versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _content(self, n: int) -> tuple[list[str], str] | None:
        """The tables and the mark of a version; None if its writer died."""
        file = self._fs.open(self._path(f"{self.path}/versions/{n}"))
        try:
            return file.readUTF().split(" "), file.readUTF()
        except Py4JJavaError:
            return None
        finally:
            file.close()

    def versions(self) -> dict[int, tuple[list[str], str]]:
        """The whole versions in order, each with its tables and its mark."""
        return {n: c for n in self._listed() if (c := self._content(n))}

    def _rows(self, tables: list[str]) -> DataFrame:
        if len(tables) == 1:
            return self.spark.read.parquet(f"{self.path}/{tables[0]}")
        each = [self.spark.read.parquet(f"{self.path}/{t}").withColumn("_n", F.lit(n)) for n, t in enumerate(tables)]
        columns = [c for c in each[0].columns if c != "_n"]
        both = each[0]
        for more in each[1:]:
            both = both.unionByName(more)
        last = both.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "_n").alias("_last"))
        return last.select(*[F.col("_last")[c].alias(c) for c in columns])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the last; None if there is none."""
        known = self.versions()
        at = max(known, default=None) if version is None else version
        return self._rows(known[at][0]) if at in known else None

    def _write(self, rows: DataFrame) -> str:
        name = f"table-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def put(self, rows: DataFrame, mark: str = "") -> int:
        """A new version: the last one with rows in the place of those with their keys (of equal keys in rows, any one). A change whose mark a version has is not made again."""
        table = None
        while True:
            known = self.versions()
            for n, (_, made) in known.items():
                if mark and made == mark:
                    return n
            table = table or self._write(rows.dropDuplicates(list(self.keys)))
            tables = [*(known[max(known)][0] if known else []), table]
            if len(tables) > MOST_TABLES:
                tables = [self._write(self._rows(tables))]
            n = max(self._listed(), default=0) + 1
            try:
                file = self._fs.create(self._path(f"{self.path}/versions/{n}"), False)
            except Py4JJavaError:
                continue  # another writer has the number
            file.writeUTF(" ".join(tables))
            file.writeUTF(mark)
            file.close()
            return n
