"""Document fingerprints by content-defined chunking.

A gear hash over the last 8 bytes sets the chunk borders: below the normal length the strict mask
has to match, above it the loose one (normalised chunking), so lengths gather around the normal one
and a border depends on nearby bytes only. The fingerprint is the set of chunk digests with the
chunks' lengths; the part of a text's distinct chunk bytes that another fingerprint has as well is
its containment.

Defined cases: a null or empty text has the empty fingerprint, contained wholly in an empty one and
not at all in another; equal texts have equal fingerprints; null ids come before all others, rows
with one id are ordered by text; a table of one row follows itself; texts of any length are chunked
whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, parts, table, to_batch

#: Bytes of a chunk.
LEAST, NORMAL, MOST = 4, 16, 64
#: Bits that must be zero at a border before and after the normal length.
STRICT, LOOSE = 5, 2
#: A random value for each byte.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
ENTRY = np.dtype([("digest", "<u4"), ("length", "<u2")])


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4):
        if n > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    bits = h >> np.uint32(16)
    at = np.flatnonzero((bits & np.uint32((1 << LOOSE) - 1)) == 0)
    strict = ((bits[at] & np.uint32((1 << STRICT) - 1)) == 0).tolist()
    out, start = [], 0
    for end, sure in zip((at + 1).tolist(), strict):
        size = end - start
        while size > MOST:
            start += MOST
            out.append(start)
            size -= MOST
        if size >= NORMAL or (sure and size >= LEAST):
            out.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        out.append(start)
    if n > start:
        out.append(n)
    return out


def fingerprint(data: bytes) -> dict[int, int]:
    """Length by digest of the distinct chunks."""
    out, start, digest = {}, 0, xxhash.xxh32_intdigest
    for end in borders(data):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def packed(chunks: dict[int, int]) -> str:
    """The fingerprint as text: base64 of (digest, length), by digest."""
    rows = np.array(sorted(chunks.items()), ENTRY) if chunks else np.zeros(0, ENTRY)
    return base64.b64encode(rows.tobytes()).decode()


def unpacked(text: str) -> dict[int, int]:
    """The inverse of packed()."""
    rows = np.frombuffer(base64.b64decode(text), ENTRY)
    return dict(zip(rows["digest"].tolist(), rows["length"].tolist()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The part of a's distinct chunk bytes that b has as well."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, tail, key, doc_id, text) in ranges of ids, sorted: each part ends with a tail row, the first row of the part after it (after the last: of the first)."""
    rows = id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = parts(docs, 8)
    cuts = np.array(sorted({int(c) for c in rows.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else [], np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("part", part_of("key"))
    # one row for each range
    first = sorted((r.part, r.key) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    tails = docs.sparkSession.createDataFrame([(first[k - 1][0], first[k][1]) for k in range(len(first))], "to int, key long")
    tail = rows.select("key", "doc_id", "text").join(F.broadcast(tails), "key").select(F.col("to").alias("part"), F.lit(1).alias("tail"), "key", "doc_id", "text")
    every = rows.select("part", F.lit(0).alias("tail"), "key", "doc_id", "text").unionByName(tail)
    return every.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "tail", "key", "text")


def op4_doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter taken from the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def row(i: int, text: bytes, own: dict, after: bytes, other: dict) -> tuple:
        chars = text.decode("utf-8", "replace")
        n = len(chars)
        edited = (chars[: n - n // 4] + after.decode("utf-8", "replace")[: n // 4]).encode("utf-8", "replace")
        new = fingerprint(edited)
        return i, n, hashlib.sha256(edited).hexdigest(), packed(own), packed(new), containment(own, new), containment(own, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for part, tail, i, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if held is not None and held[0] == part:
                    chunks = fingerprint(text)
                    out.append(row(*held[1:], text, chunks))
                elif tail:
                    continue
                else:
                    chunks = fingerprint(text)
                held = None if tail else (part, i, text, chunks)
            yield to_batch(out, schema)

    return arrow_map(with_next(table(spark, sf_dir, "documents")), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
