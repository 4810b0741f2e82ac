"""Word and character n-grams of many texts at once, named by 64-bit hashes.

functions/text.py makes the same features as strings, one by one. Here a batch of normalised texts is one
array of code points; a polynomial hash of any stretch of it is a difference of two running sums, so all
n-grams of a kind are a few operations on arrays. Equal features have equal hashes, in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Code points of texts that are hashed together; a longer text is alone.
POINTS = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
Kind = tuple[tuple[int, int] | None, tuple[int, int] | None]


@dataclass(frozen=True)
class Grams:
    """Words and characters of a text, as X.features takes them; of: other ranges for some settings."""

    text: Column
    word: tuple[int, int] | None = None
    char: tuple[int, int] | None = None
    of: tuple[tuple[str, Kind], ...] = ()

    @property
    def normal(self) -> Column:
        return X.normalize(self.text)

    def kinds(self) -> tuple[list[tuple[str, int]], dict[str, list[tuple[str, int]]]]:
        """("w" or "c", n) of each kind of feature; those of the settings that have their own."""
        listed = lambda word, char: [(p, n) for p, r in (("w", word), ("c", char)) if r for n in range(r[0], r[1] + 1)]
        return listed(self.word, self.char), {s: listed(*k) for s, k in self.of}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None], most: int = 0) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about `most` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > (most or POINTS):
            yield begin, i
            begin, size = i, 0
        size += len(t or "") + 2
    if len(texts) > begin:
        yield begin, len(texts)


class Batch:
    """Normalised texts (null: without features), with a space at each end."""

    def __init__(self, texts: list[str | None]):
        sizes = np.array([0 if t is None else len(t) + 2 for t in texts], np.int64)
        self.joined = "".join([f" {t} " for t in texts if t is not None])
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(sizes)
        self.row_end = np.repeat(self.ends, sizes)
        self.n = len(texts)
        blank = points == 32
        # a running product of the base and of its inverse, modulo 2^64
        self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(points), _BASE, np.uint64)])
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(points), pow(_BASE, -1, 1 << 64), np.uint64)])
        value = _mixed(np.where(blank, np.uint32(95), points).astype(np.uint64) + np.uint64(_BASE))
        self.sums = np.r_[np.uint64(0), np.cumsum(value * back[:-1], dtype=np.uint64)]
        self.word_start = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(points) else np.zeros(0, np.int64)
        self.word_end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1 if len(points) else np.zeros(0, np.int64)

    def stretches(self, kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each feature of a kind, in order."""
        if kind == "c":
            begin = np.flatnonzero(np.arange(n, len(self.row_end) + n) <= self.row_end)
            return begin, begin + n
        m = max(0, len(self.word_start) - n + 1)
        begin, end = self.word_start[:m], self.word_end[n - 1 :][:m]
        inside = end <= self.row_end[begin]
        return begin[inside], end[inside]

    def hashes(self, kind: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and hash of each feature of a kind."""
        begin, end = self.stretches(kind, n)
        h = (self.sums[end] - self.sums[begin]) * self.power[begin]
        return begin, end, _mixed(h ^ np.uint64(ord(kind) << 32 | n)).view(np.int64)

    def name(self, kind: str, n: int, begin: int, end: int) -> str:
        return f"{kind}{n}:" + self.joined[begin:end].replace(" ", "_")

    def bags(self, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
        """The hashes of each text's features."""
        found = []
        for kind, n in kinds:
            begin, _, h = self.hashes(kind, n)
            found.append((h, np.searchsorted(begin, np.r_[0, self.ends])))
        return [np.concatenate([h[at[i] : at[i + 1]] for h, at in found]) if found else np.zeros(0, np.int64) for i in range(self.n)]

    def names(self, kind: str, n: int, owner: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct features of a kind, how many owners of texts have them, and how often they come."""
        begin, end, h = self.hashes(kind, n)
        if not len(h):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        whose = owner[np.searchsorted(self.ends, begin, "right")]
        order = np.lexsort((whose, h))
        h, whose, begin, end = h[order], whose[order], begin[order], end[order]
        new = np.r_[True, h[1:] != h[:-1]]
        start = np.flatnonzero(new)
        df = np.add.reduceat((new | np.r_[True, whose[1:] != whose[:-1]]).astype(np.int64), start)
        found = [self.name(kind, n, b, e) for b, e in zip(begin[start].tolist(), end[start].tolist())]
        return found, df, np.diff(np.r_[start, len(h)])


def frequency(rows: DataFrame, grams: Grams) -> DataFrame:
    """feat, df, tf over rows (id, what grams read), added up in each task before features are shuffled; rows with one id count once."""
    (kinds, _), schema = grams.kinds(), pa.schema([("feat", pa.string()), ("df", pa.int64()), ("tf", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("texts").to_pylist()
            for a, b in chunks(["".join(t) for t in every], 2 * POINTS):
                owner = np.repeat(np.arange(b - a), [len(t) for t in every[a:b]])
                some = Batch([t for texts in every[a:b] for t in texts])
                for kind, n in kinds:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(some.names(kind, n, owner), schema)], schema=schema)

    texts = rows.groupBy("id").agg(F.collect_list(grams.normal).alias("texts"))
    return texts.select("texts").mapInArrow(count, "feat string, df long, tf long").groupBy("feat").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def names(rows: DataFrame, grams: Grams, feats: list[int] | None = None) -> DataFrame:
    """feat (hash), name of the features of rows (what grams read), once for each stretch of texts; feats: of these alone."""
    kinds, _ = grams.kinds()
    wanted = None if feats is None else np.array(sorted(feats), np.int64)
    schema = pa.schema([("feat", pa.int64()), ("name", pa.string())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                some = Batch(texts[a:b])
                for kind, n in kinds:
                    begin, end, h = some.hashes(kind, n)
                    h, first = np.unique(h, return_index=True)
                    if wanted is not None:
                        asked = np.isin(h, wanted, assume_unique=True)
                        h, first = h[asked], first[asked]
                    found = [some.name(kind, n, x, y) for x, y in zip(begin[first].tolist(), end[first].tolist())]
                    yield pa.record_batch([pa.array(h), pa.array(found, pa.string())], schema=schema)

    return rows.select(grams.normal.alias("text")).mapInArrow(tell, "feat long, name string")
