"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

The Jaccard distance is a metric, and the join works by pivots at two levels.

1. Pivots of the first level are single shingles. A set is nearer to a shingle that it holds than to
   any other (1 - 1/size against 1), and of those it holds the first in one global order counts as
   nearest, rarest first. Two sets at most 0.25 apart differ in so few shingles that the first one
   they share is among the first size - ceil(0.75 size) + 1 of either: these are the regions of a set,
   its own and the ones that the distance bound makes it visit.
2. In each of these regions the least set is the pivot of the second level, and the regions of one
   pivot are one region. Distances to it link sets; what is not linked yet is joined recursively: new
   pivots, a cell for each, and a set goes to every cell whose pivot is at most 2 * 0.25 farther away
   than its nearest one (the triangle inequality allows no partner elsewhere). Small regions, and
   those that cells don't make smaller, are compared pair by pair.

Sets that cannot have a partner leave before the regions are formed: first by how many of their first
shingles any other set has, then by how many of all. Equal sets are one set all along.

Every shingle meets its likes by messages of whole blocks of sets (one for each block and shingle), so
a shingle of very many sets costs one row a block. A region larger than REGION shingles is cut into
parts: sets near the pivot are linked by it and need no comparison with each other, so only the others
go to every part, in chunks of REGION shingles. Links leave a region as a spanning forest.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; repeated rows
are one set and appear as often as they come; a document with a null doc_id is linked like others, but
null is never a component's id unless all its documents have none; texts of any length are read whole;
an empty table gives no rows; columns other than doc_id and text are not read. Sets are told apart by
128-bit hashes, shingles by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, id_and_text, pairs, parts, staged, table, to_batch
from .components import components

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
PART, WHOLE = 75, 100
EPS = 1 - PART / WHOLE
#: Shingles of one block of sets, and of one region that a task joins.
BLOCK, REGION = 1_000_000, 2_000_000
#: Survivors' ids are broadcast up to so many rows (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets that share 64 bits of their hash with another one.
MOST_NAMES = 100_000
LEAF, PIVOTS = 24, 8

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word)
        return n


_words = _Words()


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    s = w[: len(w) - k + 1] + np.uint64(k)
    for i in range(1, k):
        s = s * _MUL + w[i : len(w) - k + 1 + i]
    s ^= s >> np.uint64(29)
    s *= _MIX
    s ^= s >> np.uint64(32)
    return np.unique(s)


def _least(n):
    """How many shingles a set of n must share with a partner."""
    return -(-n * PART // WHOLE)


def _first(n: int) -> tuple[int, int]:
    """How many of the first shingles of a set of n are looked at, and how many of them a partner must have."""
    return min(n, n - _least(n) + max(1, n // 8)), max(1, _least(n) // 8)


def _by_bucket(keys: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column's part) of the rows dealt to n buckets by key."""
    bucket = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) % n
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, *(c[cut[b] : cut[b + 1]].tobytes() for c in columns)


def _u64(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint64)


def counted(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: doc_id, cls, other, n, text_hash for each document (cls, other: 128 bits of its set's hash; n its size), and cls, common: first shingles of the set that another set has, for sets that have enough of them.

    What a bucket of shingles knows of its sets goes to the sets' buckets as one message each, and is added up there.
    """
    n_buckets = parts(docs, 8)
    out = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, owners, size, turn = set(), [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            h, c = np.concatenate(keys), np.repeat(np.array([o for o, _ in owners], np.uint64), [k for _, k in owners])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            times = np.diff(np.r_[start, len(h)])
            # a shingle of several sets of this block is known to be shared: its sets are counted here
            shared, how_many = np.unique(c[np.repeat(times, times) > 1], return_counts=True)
            yield to_batch([(turn % n_buckets, 2, shared.tobytes(), how_many.astype(np.uint64).tobytes(), None, None, None)], out)
            h, one, many = h[start], c[start], (times > 1).astype(np.uint8)
            yield to_batch([(b, 1, x, y, z, None, None) for b, x, y, z in _by_bucket(h, n_buckets, h, one, many)], out)

        for batch in batches:
            ids, cls, other, ns, null, texts = [], [], [], [], [], []
            for i, text, text_hash in pairs(batch):
                s = shingles(text)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                mine = d & 0xFFFFFFFFFFFFFFFF
                ids.append(i or 0)
                null.append(i is None)
                cls.append(mine)
                other.append(d >> 64)
                ns.append(len(s))
                texts.append(text_hash)
                if len(s) and mine not in seen:
                    seen.add(mine)
                    k = _first(len(s))[0]
                    keys.append(s[:k])
                    owners.append((mine, k))
                    size += k
            turn += 1
            docs_of = np.array(ns, np.uint64) | (np.array(null, np.uint64) << np.uint64(63))
            yield to_batch([((TaskContext.get().partitionId() + turn) % n_buckets, 0, np.array(ids, np.int64).tobytes(), np.array(cls, np.uint64).tobytes(), np.array(other, np.uint64).tobytes(), docs_of.tobytes(), np.array(texts, np.int64).tobytes())], out)
            if size > BLOCK // 2:
                yield from flush()
                keys, owners, size = [], [], 0
        yield from flush()
        _words.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, m = [], [], []
        for batch in batches:
            for _, kind, a, b, x, y, z in pairs(batch):
                if kind == 0:
                    # documents stay in one message, and their sets' sizes go to the sets
                    yield to_batch([(TaskContext.get().partitionId() % n_buckets, 0, a, b, x, y, z)], out)
                    of, size = np.unique(np.stack([np.frombuffer(b, np.uint64), np.frombuffer(y, np.uint64) & np.uint64((1 << 63) - 1)]), axis=1)
                    yield to_batch([(i, 3, *both, None, None, None) for i, *both in _by_bucket(of, n_buckets, of, size)], out)
                elif kind == 2:
                    yield to_batch([(i, 2, *both, None, None, None) for i, *both in _by_bucket(np.frombuffer(a, np.uint64), n_buckets, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))], out)
                else:
                    h.append(a)
                    c.append(b)
                    m.append(x)
        if h:
            h, c, m = _u64(h), _u64(c), np.frombuffer(b"".join(m), np.uint8)
            order = np.lexsort((c, h))
            h, c, m = h[order], c[order], m[order]
            new_h = np.r_[True, h[1:] != h[:-1]]
            new_c = new_h | np.r_[True, c[1:] != c[:-1]]
            start = np.flatnonzero(new_h)
            shared = (np.add.reduceat(new_c.astype(np.int64), start) > 1) | (np.maximum.reduceat(m, start) > 0)
            # a set counts once for a shingle here; where its block has counted it, not again
            mine = np.repeat(shared, np.diff(np.r_[start, len(h)])) & new_c & (m == 0)
            if mine.any():
                of, times = np.unique(c[mine], return_counts=True)
                yield to_batch([(i, 2, *both, None, None, None) for i, *both in _by_bucket(of, n_buckets, of, times.astype(np.uint64))], out)

    result = "doc_id long, cls long, other long, n long, text_hash long, common long"
    schema = pa.schema([(x.split()[0], pa.int64()) for x in result.split(", ")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = lambda n: pa.nulls(n, pa.int64())
        found, sizes = [], []
        for batch in batches:
            for _, kind, a, b, x, y, z in pairs(batch):
                if kind == 0:
                    n = np.frombuffer(y, np.uint64)
                    null = (n >> np.uint64(63)).astype(bool)
                    n = (n & np.uint64((1 << 63) - 1)).astype(np.int64)
                    yield pa.record_batch([pa.array(np.frombuffer(a, np.int64), mask=null), pa.array(np.frombuffer(b, np.int64)), pa.array(np.frombuffer(x, np.int64)), pa.array(n), pa.array(np.frombuffer(z, np.int64)), nothing(len(n))], schema=schema)
                else:
                    (found if kind == 2 else sizes).append((a, b))
        if not found:
            return
        c, at = np.unique(_u64([a for a, _ in found]), return_inverse=True)
        common = np.zeros(len(c), np.int64)
        np.add.at(common, at, _u64([b for _, b in found]).astype(np.int64))
        # sets that share cls are judged by the smallest here, and each by its own size later
        of, size = _u64([a for a, _ in sizes]), _u64([b for _, b in sizes]).astype(np.int64)
        order = np.lexsort((size, of))
        of, size = of[order], size[order]
        n = size[np.searchsorted(of, c)]
        enough = common >= np.maximum(1, _least(n) // 8)
        c, common = c[enough], common[enough]
        yield pa.record_batch([nothing(len(c)), pa.array(c.view(np.int64)), nothing(len(c)), nothing(len(c)), nothing(len(c)), pa.array(common)], schema=schema)

    rows = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    messages = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
    dealt = arrow_map(rows, sketch, messages).repartition(n_buckets, "bucket")
    told = arrow_map(dealt, count, messages).repartition(n_buckets, "bucket")
    return staged(arrow_map(told, add, result), "counted")


BLOCK_DDL = "block long, cls binary, n binary, size binary, hashes binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("cls", pa.binary()), ("n", pa.binary()), ("size", pa.binary()), ("hashes", pa.binary())])


def _wanted(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """cls, other, text: one text for each set that may have a partner. cls tells these sets apart: where sets share it, all but one get another."""
    per = counts.where("n > 0").groupBy("cls", "other").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    common = counts.where("n is null").groupBy("cls").agg(F.sum("common").alias("common"))
    needed = F.greatest(F.lit(1), (-F.floor(-F.col("n") * PART / WHOLE) / 8).cast("bigint"))
    left = staged(per.join(common, "cls").where(F.col("common") >= needed).select("doc_id", "cls", "other"), "survivors")
    named = left.where("doc_id is not null")
    keep = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    rows = id_and_text(docs).join(keep, "doc_id").select("cls", "other", "text")
    # sets whose documents all have a null doc_id: the texts of such documents are hashed again to find them
    nameless = left.where("doc_id is null").select("cls", "other")
    if nameless.isEmpty():
        return rows
    schema = pa.schema([("cls", pa.int64()), ("other", pa.int64()), ("text", pa.binary())])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text in pairs(batch):
                a, b = _halves(shingles(text))
                out.append((a, b, text))
            yield to_batch(out, schema)
        _words.clear()

    found = arrow_map(id_and_text(docs.where("doc_id is null")), again, "cls long, other long, text binary")
    return rows.unionByName(found.join(nameless, ["cls", "other"]).select("cls", "other", "text"))


def _halves(s: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's hash, signed."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    high, low = np.frombuffer(d, ">i8").tolist()
    return low, high


def renamed(counts: DataFrame) -> DataFrame:
    """cls, other, name: of sets that share cls, those that get a name of their own."""
    sets = counts.where("n > 0").select("cls", "other").distinct().groupBy("cls").agg(F.sort_array(F.collect_list("other")).alias("others"))
    return sets.where(F.size("others") > 1).select("cls", F.explode(F.expr("slice(others, 2, size(others))")).alias("other")).withColumn("name", F.xxhash64("cls", "other"))


def blocks_of_sets(docs: DataFrame, counts: DataFrame, names: dict[tuple[int, int], int]) -> DataFrame:
    """The sets that may have a partner, in blocks: class (or the set's own name), size, how many hashes follow, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size, turn = set(), [], 0, 0
        for batch in batches:
            for cls, other, text in pairs(batch):
                s = shingles(text)
                if (cls, other) not in seen and _halves(s) == (cls, other):
                    seen.add((cls, other))
                    held.append((names.get((cls, other), cls), s))
                    size += len(s)
                if size > BLOCK:
                    yield _block(TaskContext.get().partitionId() << 32 | turn, held)
                    held, size, turn = [], 0, turn + 1
        if held:
            yield _block(TaskContext.get().partitionId() << 32 | turn, held)
        _words.clear()

    return staged(arrow_map(_wanted(docs, counts), run, BLOCK_DDL), "blocks")


def _block(number: int, sets: list[tuple]) -> pa.RecordBatch:
    size = np.array([len(s) for _, s in sets], np.int64)
    return to_batch([(number, np.array([c for c, _ in sets], np.int64).tobytes(), size.tobytes(), size.tobytes(), np.concatenate([s for _, s in sets]).tobytes())], BLOCK_SCHEMA)


def _unblock(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    _, cls, n, size, hashes = row
    return np.frombuffer(cls, np.int64), np.frombuffer(n, np.int64), np.frombuffer(size, np.int64), np.frombuffer(hashes, np.uint64)


def _first_regions(cls: np.ndarray, n: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner's index and hash of the first-level regions of a block's sets, whose shingles are in order without those that no other set has (which come first)."""
    k = np.maximum(0, np.minimum(n - _least(n) + 1 - (n - size), size))
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(cls)), k)
    return owner, hashes[np.repeat(start - (np.cumsum(k) - k), k) + np.arange(k.sum())]


def _asked(blocks: DataFrame, n_buckets: int, regions: bool) -> DataFrame:
    """For each block and shingle that any two sets have (as a first-level region, if regions): the number of its sets and the least of them, in messages to the block."""
    message = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("h", pa.binary()), ("v", pa.binary()), ("c", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in pairs(batch):
                cls, n, size, hashes = _unblock(row)
                if regions:
                    owner, hashes = _first_regions(cls, n, size, hashes)
                else:
                    owner = np.repeat(np.arange(len(cls)), size)
                order = np.lexsort((cls[owner], hashes))
                h, o = hashes[order], owner[order]
                if not len(h):
                    continue
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                yield to_batch([(b, row[0], x, y, z) for b, x, y, z in _by_bucket(h[start], n_buckets, h[start], cls[o[start]], np.diff(np.r_[start, len(h)]).astype(np.int64))], message)

    reply = pa.schema([("block", pa.int64()), ("h", pa.binary()), ("v", pa.binary()), ("c", pa.binary())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in pairs(batch)]
        if not got:
            return
        h, v, c = _u64([r[2] for r in got]), np.frombuffer(b"".join(r[3] for r in got), np.int64), np.frombuffer(b"".join(r[4] for r in got), np.int64)
        number = np.array(sorted({r[1] for r in got}), np.int64)
        block = np.repeat(np.searchsorted(number, [r[1] for r in got]), [len(r[2]) // 8 for r in got])
        order = np.argsort(h, kind="stable")
        h, v, c, block = h[order], v[order], c[order], block[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        times = np.diff(np.r_[start, len(h)])
        v, c = np.repeat(np.minimum.reduceat(v, start), times), np.repeat(np.add.reduceat(c, start), times)
        back = np.flatnonzero(c > 1)
        back = back[np.argsort(block[back], kind="stable")]
        cut = np.searchsorted(block[back], np.arange(len(number) + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            at = back[cut[k] : cut[k + 1]]
            yield to_batch([(int(number[k]), h[at].tobytes(), v[at].tobytes(), c[at].tobytes())], reply)

    dealt = arrow_map(blocks, ask, "bucket int, block long, h binary, v binary, c binary").repartition(n_buckets, "bucket")
    return arrow_map(dealt, answer, "block long, h binary, v binary, c binary")


def _met(blocks: DataFrame, answers: DataFrame, n: int, fn, ddl: str) -> DataFrame:
    """Each block with its answers, in one task: fn(block's row, hashes ascending, least sets, counts) gives batches."""
    nothing = F.lit(None).cast("binary")
    left = blocks.withColumns({"h": nothing, "v": nothing, "c": nothing})
    right = answers.select("block", *[nothing.alias(x) for x in ("cls", "n", "size", "hashes")], "h", "v", "c")
    rows = left.unionByName(right).repartition(n, "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, told = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            h = _u64([t[0] for t in told])
            order = np.argsort(h)
            v, c = (np.frombuffer(b"".join(t[k] for t in told), np.int64)[order] for k in (1, 2))
            yield from fn(own, h[order], v, c)

        for batch in batches:
            for row in pairs(batch):
                if row[0] != now and own is not None:
                    yield from done()
                    own, told = None, []
                now = row[0]
                if row[1] is not None:
                    own = row[:5]
                else:
                    told.append(row[5:])
        if own is not None:
            yield from done()

    return arrow_map(rows, run, ddl)


def in_order(blocks: DataFrame, n: int) -> DataFrame:
    """The blocks with each set's shared shingles alone, rarest first; sets with too few of them are gone."""

    def order(row: tuple, h: np.ndarray, v: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        cls, full, size, hashes = _unblock(row)
        owner = np.repeat(np.arange(len(cls)), size)
        at = np.searchsorted(h, hashes)
        found = at < len(h)
        found[found] = h[at[found]] == hashes[found]
        owner, hashes, times = owner[found], hashes[found], c[at[found]]
        kept = np.bincount(owner, minlength=len(cls))
        enough = kept >= _least(full)
        stay = enough[owner]
        owner, hashes, times = owner[stay], hashes[stay], times[stay]
        by = np.lexsort((hashes, times, owner))
        if enough.any():
            yield to_batch([(row[0], cls[enough].tobytes(), full[enough].tobytes(), kept[enough].astype(np.int64).tobytes(), hashes[by].tobytes())], BLOCK_SCHEMA)

    return staged(_met(blocks, _asked(blocks, n, regions=False), n, order, BLOCK_DDL), "ordered")


def second_regions(blocks: DataFrame, n: int) -> DataFrame:
    """pivot, cls, n, hashes, w (how many): every set in the region of each pivot that one of its first-level regions has."""
    schema = pa.schema([("pivot", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("w", pa.int64())])

    def place(row: tuple, h: np.ndarray, v: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        cls, full, size, hashes = _unblock(row)
        owner, keys = _first_regions(cls, full, size, hashes)
        at = np.searchsorted(h, keys)
        found = at < len(h)
        found[found] = h[at[found]] == keys[found]
        member = np.unique(np.stack([owner[found], v[at[found]]], 1), axis=0)
        start, out, held = np.cumsum(size) - size, [], 0
        for o, pivot in member.tolist():
            out.append((pivot, int(cls[o]), int(full[o]), hashes[start[o] : start[o] + size[o]].tobytes(), int(size[o])))
            held += len(out[-1][3])
            if held > 1 << 24:
                yield to_batch(out, schema)
                out, held = [], 0
        yield to_batch(out, schema)

    return staged(_met(blocks, _asked(blocks, n, regions=True), n, place, "pivot long, cls long, n long, hashes binary, w long"), "regions")


class _Region:
    """Sets of one region; links are kept as a forest."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray]):
        self.n = n
        size = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.start, self.ids = np.r_[0, np.cumsum(size)], ids
        self.mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        self.root = np.arange(len(n))
        self.links: list[tuple[int, int]] = []
        #: regions that have been split by cells
        self.cells = 0

    def distances(self, pivot: int, idx: np.ndarray, rows: tuple) -> np.ndarray:
        """Distances of the sets idx to a pivot; those near enough are linked with it."""
        ids, owner = rows
        own = self.ids[self.start[pivot] : self.start[pivot + 1]]
        self.mark[own] = True
        both = np.bincount(owner[self.mark[ids]], minlength=len(idx))
        self.mark[own] = False
        union = self.n[idx] + self.n[pivot] - both
        self.near = WHOLE * both >= PART * union
        for x in idx[self.near & (self.root[idx] != self.root[pivot])].tolist():
            if (a := self.root[x]) != (b := self.root[pivot]):
                self.root[self.root == max(a, b)] = min(a, b)
                self.links.append((x, pivot))
        return 1 - both / union

    def rows(self, idx: np.ndarray) -> tuple:
        size = self.start[idx + 1] - self.start[idx]
        owner = np.repeat(np.arange(len(idx)), size)
        return self.ids[np.repeat(self.start[idx] - (np.cumsum(size) - size), size) + np.arange(size.sum())], owner

    def join(self, idx: np.ndarray) -> None:
        """Links all pairs among idx, up to those that links join already."""
        roots = self.root[idx]
        if len(idx) < 2 or (roots == roots[0]).all():
            return
        rows = self.rows(idx)
        if len(idx) > LEAF:
            pivots = idx[np.linspace(0, len(idx) - 1, PIVOTS).astype(int)]
            d = np.stack([self.distances(int(p), idx, rows) for p in pivots])
            inside = d <= d.min(0) + 2 * EPS + 1e-9
            if inside.sum(1).max() <= 0.7 * len(idx):
                self.cells += 1
                for k in range(len(pivots)):
                    self.join(idx[inside[k]])
                return
        # pairs within the largest linked group need no comparison: one of each other pair is outside it
        roots = self.root[idx]
        values, times = np.unique(roots, return_counts=True)
        for x in idx[roots != values[times.argmax()]].tolist():
            if (self.root[idx] != self.root[x]).any():
                self.distances(x, idx, rows)


def region_links(pivot: int, cls: list[int], n: list[int], hashes: list[bytes]) -> list[tuple[int, int]]:
    """Links (as a forest) of one region's sets."""
    r = _Region(np.array(n, np.int64), [np.frombuffer(h, np.uint64) for h in hashes])
    every = np.arange(len(cls))
    r.distances(cls.index(pivot), every, r.rows(every))
    r.join(every)
    return [(cls[a], cls[b]) for a, b in r.links]


def part_links(cls: list[int], n: list[int], hashes: list[bytes], linked: list[bool]) -> list[tuple[int, int]]:
    """Links (as a forest) of a part of a region and of sets from all of it that its pivot doesn't link; those it does are linked already."""
    first = {c: k for k, c in reversed(list(enumerate(cls)))}
    keep = sorted(first.values())  # a set of this part may stand beside its own copy
    r = _Region(np.array(n, np.int64)[keep], [np.frombuffer(hashes[k], np.uint64) for k in keep])
    mine = np.flatnonzero(np.array(linked)[keep])
    if len(mine):
        r.root[mine] = mine[0]
    r.join(np.arange(len(keep)))
    return [(cls[keep[a]], cls[keep[b]]) for a, b in r.links]


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in lists of those whose first `width` columns agree; they follow each other."""
    now, held = None, []
    for batch in batches:
        for row in pairs(batch):
            if row[:width] != now and held:
                yield now, held
                held = []
            now = row[:width]
            held.append(row[width:])
    if held:
        yield now, held


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(regions: DataFrame) -> DataFrame:
    """a, b: links between sets, enough to connect all that are linked."""
    size = regions.groupBy("pivot").agg(F.count("*").alias("k"), F.sum("w").alias("w")).where("k > 1")
    size = staged(size.select("pivot", F.ceil(F.col("w") / REGION).cast("int").alias("cuts")), "sizes")
    n = parts(regions, 4)
    rows = regions.join(size, "pivot").select("pivot", "cls", "n", "hashes", "w", "cuts")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot,), held in _by_key(batches, 1):
            yield to_batch(region_links(pivot, *map(list, zip(*held))), LINKS)

    found = arrow_map(rows.where("cuts = 1").select("pivot", "cls", "n", "hashes").repartition(n, "pivot").sortWithinPartitions("pivot", "cls"), whole, "a long, b long")
    hot = size.where("cuts > 1")
    if hot.isEmpty():
        return found

    # large regions: first the links with the pivot, which goes to every part
    part = F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int")
    hot = rows.where("cuts > 1").withColumn("part", part)
    pivots = hot.where("cls = pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    near = hot.where("cls <> pivot").unionByName(pivots).select("pivot", "part", "cls", "n", "hashes")
    near = near.repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part", "cls")
    told = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_())])

    def by_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _), held in _by_key(batches, 2):
            cls, size_, hashes = map(list, zip(*held))
            r = _Region(np.array(size_, np.int64), [np.frombuffer(h, np.uint64) for h in hashes])
            every = np.arange(len(cls))
            r.distances(cls.index(pivot), every, r.rows(every))
            yield to_batch([(c, pivot, x) for c, x in zip(cls, r.near.tolist())], told)

    told_links = staged(arrow_map(near, by_pivot, "a long, b long, near boolean"), "pivot-links")
    found = found.unionByName(told_links.where("near and a <> b").select("a", "b"))

    # then the sets that it doesn't link, with every part of their region
    left = told_links.where("not near").select(F.col("b").alias("pivot"), F.col("a").alias("cls"))
    left = staged(hot.join(left, ["pivot", "cls"]), "left")
    chunks = left.groupBy("pivot").agg(F.ceil(F.sum("w") / REGION).cast("int").alias("chunks"))
    probes = left.join(chunks, "pivot").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), F.col("cls")), F.col("chunks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    base = hot.join(left.select("pivot", "cls", F.lit(False).alias("linked")), ["pivot", "cls"], "left").join(chunks, "pivot").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ("pivot", "part", "chunk", "cls", "n", "hashes", "linked")
    both = base.withColumn("linked", F.coalesce("linked", F.lit(True))).select(*columns).unionByName(probes.withColumn("linked", F.lit(False)).select(*columns))
    both = both.repartition(n, "pivot", "part", "chunk").sortWithinPartitions("pivot", "part", "chunk", "cls")

    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_key(batches, 3):
            yield to_batch(part_links(*map(list, zip(*held))), LINKS)

    return found.unionByName(arrow_map(both, with_part, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text) and group, one row for each row of docs.

    group tells components apart where ids do not: it is null for a text without shingles, and the same
    for all rows of a component.
    """
    counts = counted(docs)
    info = counts.where("n is not null").select("doc_id", "cls", "other", "n", "text_hash")
    # sets of one 64-bit class are rare even among 10^10 sets
    names = renamed(counts).limit(MOST_NAMES + 1).collect()
    if len(names) > MOST_NAMES:
        raise ValueError("the hash of sets does not tell them apart")
    if names:
        info = info.join(F.broadcast(docs.sparkSession.createDataFrame(names)), ["cls", "other"], "left").select("doc_id", F.coalesce("name", "cls").alias("cls"), "other", "n", "text_hash")
    blocks = blocks_of_sets(docs, counts, {(r.cls, r.other): r.name for r in names})
    n = parts(blocks, 4)
    found = components(links(second_regions(in_order(blocks, n), n)))
    groups = info.where("n > 0").groupBy("cls", "other").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    groups = groups.join(found.select(F.col("node").alias("cls"), "root"), "cls", "left").where("copies > 1 or root is not null")
    lowest = groups.where("root is not null").groupBy("root").agg(F.min("least").alias("lowest"))
    named = groups.join(lowest, "root", "left").select("cls", "other", "root", F.coalesce("lowest", "least").alias("component_id"))
    out = info.join(named, ["cls", "other"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("group"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
