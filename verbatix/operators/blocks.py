"""Rows of features in packed blocks, and sums or means by feature over all blocks.

Features are named by 64-bit hashes. A block holds the rows that a task meets one after the other, up to a
bounded number of features, as compressed sparse rows over its own features. What blocks know of their
features meets by key: each block sends one piece to every part of the keys, a part adds up its pieces and
answers each with its own keys. So a feature is shuffled once per block that has it and not once per row,
and a frequent feature is no larger than another.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import Batch, Grams, chunks

#: Features, repeated or not, of one block; rows that are packed by one task.
TOKENS, ROWS = 6_000_000, 1000
#: Values that a part of the keys has to sum.
VALUES = 12_000_000
#: Of a block that keeps texts: distinct features, characters, and rows that a task packs if there are tasks enough.
FEATS, CHARS, LONG = 400_000, 24_000_000, 8000
#: Parts that counted blocks send; fewer are put together where they are summed.
BINS = 128
BLOCK = "setting string, block long, tokens long, cells long, n_feats long, top int, body binary"


def packed(x: object) -> bytes:
    raw = pickle.dumps(x, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(body: bytes) -> object:
    return pickle.loads(pa.decompress(memoryview(body)[8:], int.from_bytes(body[:8], "little"), "zstd"))


class Rows:
    """Compressed sparse rows over their own features, in the order of their ids."""

    def __init__(self, ids: list, labels: list, roles: np.ndarray, feats: np.ndarray, row: np.ndarray, col: np.ndarray, tf: np.ndarray):
        self.ids, self.labels, self.roles, self.feats, self.row, self.col, self.tf = ids, labels, roles, feats, row, col, tf
        self.start = np.r_[0, np.cumsum(np.bincount(row, minlength=len(ids)))]

    @classmethod
    def of_bags(cls, ids: list, labels: list, roles: np.ndarray, bags: list[np.ndarray]) -> Rows:
        return cls.of_counts(ids, labels, roles, [np.unique(b, return_counts=True) for b in bags])

    @classmethod
    def of_counts(cls, ids: list, labels: list, roles: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        """bags: each row's distinct features in order, and how often they come."""
        order = np.argsort(np.array([str(x) for x in ids]), kind="stable")
        bags = [bags[i] for i in order]
        feats, col = np.unique(np.concatenate([b for b, _ in bags]) if bags else np.zeros(0, np.int64), return_inverse=True)
        tf = np.concatenate([n for _, n in bags]) if bags else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])
        return cls([ids[i] for i in order], [labels[i] for i in order], roles[order], feats, row.astype(np.int32), col.astype(np.int32), tf.astype(np.int32))

    def pack(self) -> bytes:
        """Columns as differences: they rise within a row."""
        return packed((self.ids, self.labels, self.roles, np.diff(self.feats, prepend=0), np.bincount(self.row, minlength=len(self.ids)).astype(np.int32), np.diff(self.col, prepend=np.int32(0)), self.tf))

    @classmethod
    def unpack(cls, body: bytes) -> Rows:
        ids, labels, roles, feats, sizes, col, tf = unpacked(body)
        return cls(ids, labels, roles, np.cumsum(feats), np.repeat(np.arange(len(ids), dtype=np.int32), sizes), np.cumsum(col, dtype=np.int32), tf)

    @classmethod
    def merge(cls, bodies: list[bytes]) -> Rows:
        each = [cls.unpack(b) for b in bodies]
        ids = [i for e in each for i in e.ids]
        order = np.argsort(np.array([str(x) for x in ids]), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        feats = np.unique(np.concatenate([e.feats for e in each]))
        before = np.cumsum([0, *[len(e.ids) for e in each]])
        row = np.concatenate([place[e.row + at] for e, at in zip(each, before)]) if each else np.zeros(0, np.int64)
        col = np.concatenate([np.searchsorted(feats, e.feats)[e.col] for e in each])
        by = np.argsort(row * max(1, len(feats)) + col)
        labels = [x for e in each for x in e.labels]
        return cls([ids[i] for i in order], [labels[i] for i in order], np.concatenate([e.roles for e in each])[order], feats, row[by].astype(np.int32), col[by].astype(np.int32), np.concatenate([e.tf for e in each])[by])


def hashed(bag: Column) -> Column:
    return F.coalesce(F.transform(bag, lambda f: F.xxhash64(f)), F.array().cast("array<bigint>"))


def blocks(rows: DataFrame, bag: Column | Grams, tokens: int | None = None) -> DataFrame:
    """setting, block, tokens, cells (non-zeros), n_feats, top (the largest role), body of rows (setting, id, label, roles, what bag reads).

    Rows are dealt to tasks by id before their features are made, so texts are shuffled and not features.
    A bag is an expression of strings, or Grams, which are made from the normalised text where rows are packed.
    """
    tokens, made_here = tokens or TOKENS, isinstance(bag, Grams)
    n = max(1, -(-rows.select("id").count() // ROWS))
    dealt = rows.repartition(n, "id").sortWithinPartitions("setting", F.xxhash64(F.col("id").cast("string")), "id")
    some = dealt.select("setting", "id", "label", F.col("roles").cast("array<int>").alias("roles"), bag.normal.alias("text") if made_here else hashed(bag).alias("bag"))
    kinds, of = bag.kinds() if made_here else ([], {})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list] = {}
        made, at = 0, TaskContext.get().partitionId() << 32

        def told(setting: str) -> pa.RecordBatch:
            nonlocal made
            got = held.pop(setting)
            roles = np.stack([r for _, _, r, _ in got]).astype(np.int16)
            block = Rows.of_counts([i for i, _, _, _ in got], [y for _, y, _, _ in got], roles, [b for _, _, _, b in got])
            made += 1
            cells = [[setting], [at + made], [int(block.tf.sum())], [len(block.tf)], [len(block.feats)], [int(roles.max(initial=-1))], [block.pack()]]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cells, types)], ["setting", "block", "tokens", "cells", "n_feats", "top", "body"])

        def bags_of(batch: pa.RecordBatch, settings: list[str]) -> Iterator[np.ndarray]:
            if not made_here:
                bags = batch.column("bag")
                ends, flat = bags.offsets.to_numpy(), bags.values.to_numpy()
                for k in range(len(batch)):
                    yield flat[ends[k] : ends[k + 1]]
                return
            texts = batch.column("text").to_pylist()
            cut = [k for k in range(1, len(settings)) if settings[k] != settings[k - 1]]
            for begin, end in zip([0, *cut], [*cut, len(settings)]):
                for a, b in chunks(texts[begin:end]):
                    yield from Batch(texts[begin + a : begin + b]).bags(of.get(settings[begin], kinds))

        size: dict[str, int] = {}
        for batch in batches:
            column = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
            settings = column("setting")
            role = batch.column("roles").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for k, (setting, id_, label, mine) in enumerate(zip(settings, column("id"), column("label"), bags_of(batch, settings))):
                if setting in held and size[setting] + len(mine) > tokens:
                    yield told(setting)
                if setting not in held:
                    held[setting], size[setting] = [], 0
                feats, tf = np.unique(mine, return_counts=True)
                held[setting].append((id_, label, role[k].copy(), (feats, tf.astype(np.int32))))
                size[setting] += len(mine)
        for setting in list(held):
            yield told(setting)

    return some.mapInArrow(pack, BLOCK)


PIECE = "setting string, block long, part int, body binary"


def batch_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in columns.values()], list(columns))


def pieces_of(setting: str, block: int, keys: np.ndarray, vals: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part of the keys that a block has."""
    part = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
    found = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()] if parts > 1 else [(0, np.arange(len(keys)))]
    n = len(found)
    return batch_of({"setting": ([setting] * n, pa.string()), "block": ([block] * n, pa.int64()), "part": ([p for p, _ in found], pa.int32()), "body": ([packed((keys[at], vals[at])) for _, at in found], pa.binary())})


def summed(pieces: DataFrame, answer: Callable[[str, np.ndarray, np.ndarray, np.ndarray], tuple], read: Callable[[str, bytes], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """For each piece (setting, block, part, body) the same keys with the answer's values; a row with block -1 and the part's own result.

    answer: from the setting, a part's sorted keys, the sums of their values and how many blocks hold each to
    values by key, a result and, if some keys need no answer, which do. read: from a setting and a body to keys
    and values. A block may have several pieces in a part if no key is in two of them.
    """

    def add(table: pa.Table) -> pa.Table:
        setting, part = table.column("setting")[0].as_py(), table.column("part")[0].as_py()
        each = [read(setting, b) if read else unpacked(b) for b in table.column("body").to_pylist()]
        keys, inverse = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
        total = np.zeros((len(keys), each[0][1].shape[1]), np.float64 if each[0][1].dtype.kind == "f" else np.int64)
        holders, at, ends = np.bincount(inverse, minlength=len(keys)), 0, []
        for k, v in each:
            here = inverse[at : (at := at + len(k))]
            total[here] += v  # a block has a key once
            ends.append(here)
        each = [k for k, _ in each]
        back, result, *needed = answer(setting, keys, total, holders)
        if needed:
            some = [needed[0][here] for here in ends]
            each, ends = [k[x] for k, x in zip(each, some)], [here[x] for here, x in zip(ends, some)]
        n = len(each)
        bodies = [packed((k, back[here])) for k, here in zip(each, ends)]
        return pa.table({"setting": pa.array([setting] * (n + 1), pa.string()), "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "part": pa.array([part] * (n + 1), pa.int32()), "body": pa.array([*bodies, packed(result)], pa.binary())})

    return pieces.groupBy("setting", "part").applyInArrow(add, PIECE)


def gathered(feats: np.ndarray, bodies: list[bytes], width: int, dtype=np.float64) -> np.ndarray:
    """The pieces' values in the order of feats; zeros for keys without an answer."""
    out = np.zeros((len(feats), width), dtype)
    for body in bodies:
        keys, vals = unpacked(body)
        out[np.searchsorted(feats, keys)] = vals
    return out




def stretches(held: list, kinds: list[tuple[str, int]]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Begin, end and bags of stretches of rows; held: texts whose features are made here, or bags."""
    if held and isinstance(held[0], np.ndarray):
        yield 0, len(held), held
        return
    for a, b in chunks(held):
        yield a, b, Batch(held[a:b]).bags(kinds)


def counted_blocks(rows: DataFrame, bag: Column | Grams, count: Callable[[Rows, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """setting, block, part, n_feats, top (the largest role), body: blocks that keep texts and know the counts of their features.

    rows and bag as those of blocks(). For each block: as part -2 its rows, packed (ids, labels, roles, texts or
    bags); as part -1 what count gives for all of its rows, summed; as parts from 0 on its features with what
    count gives by feature, as whole numbers. count: from rows and the number of roles to both. Texts take
    a fraction of the room of their features, so features are made again where they are scored; what a task
    holds is bounded by the distinct features of a block.
    """
    made_here = isinstance(bag, Grams)
    n = max(1, rows.select("id").count())
    tasks = min(-(-n // ROWS), max(-(-n // LONG), 2 * rows.sparkSession.sparkContext.defaultParallelism)) if made_here else -(-n // ROWS)
    dealt = rows.repartition(tasks, "id").sortWithinPartitions("setting", F.xxhash64(F.col("id").cast("string")), "id")
    some = dealt.select("setting", "id", "label", F.col("roles").cast("array<int>").alias("roles"), (bag.normal if made_here else hashed(bag)).alias("held"))
    (kinds, of), feats, chars = bag.kinds() if made_here else ([], {}), FEATS, CHARS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        setting, held, known = None, [], None

        def added(now: tuple | None, keys: np.ndarray, values: np.ndarray, sums: np.ndarray) -> tuple:
            if now is None:
                return keys, values, sums
            every = np.union1d(now[0], keys)
            out = []
            for a, b, rows_ in ((now[1], values, (now[0], keys)), (now[2], sums, None)):
                # roles may rise from one stretch to the next: by key, split, role and count
                shape = (len(every) if rows_ else 1, *np.maximum(a.shape[1:], b.shape[1:]))
                both = np.zeros(shape, a.dtype)
                for x, k in zip((a, b), rows_ or (None, None)):
                    at = np.searchsorted(every, k) if rows_ else np.zeros(1, int)
                    both[at, :, : x.shape[2]] += x
                out.append(both)
            return every, *out

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal block
            block += 1
            keys, values, sums = known
            body = packed(([i for i, _, _, _ in held], [y for _, y, _, _ in held], np.stack([r for _, _, r, _ in held]).astype(np.int16), [x for _, _, _, x in held]))
            part = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(BINS)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(BINS + 1))
            parts, bodies = [-2, -1], [body, packed(sums)]
            for p in range(BINS):
                at = order[ends[p] : ends[p + 1]]
                if len(at):
                    few = np.ascontiguousarray(values[at].reshape(len(at), -1).T)  # mostly zeros
                    parts.append(p)
                    bodies.append(packed((np.diff(keys[at], prepend=0), few.astype(np.min_scalar_type(int(few.max(initial=0)))), values.shape[1:])))
            m = len(parts)
            for a in range(0, m, 32):
                b = min(m, a + 32)
                yield batch_of({"setting": ([setting] * (b - a), pa.string()), "block": ([block] * (b - a), pa.int64()), "part": (parts[a:b], pa.int32()), "n_feats": ([len(keys)] * (b - a), pa.int64()), "top": ([sums.shape[2] - 1] * (b - a), pa.int32()), "body": (bodies[a:b], pa.binary())})

        for batch in batches:
            column = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
            settings, ids, labels = column("setting"), column("id"), column("label")
            role = batch.column("roles").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            texts = column("held") if made_here else [np.array(x, np.int64) for x in column("held")]
            cut = [k for k in range(1, len(settings)) if settings[k] != settings[k - 1]]
            for begin, end in zip([0, *cut], [*cut, len(settings)]):
                if held and settings[begin] != setting:
                    yield from told()
                    held, known = [], None
                setting = settings[begin]
                for a, b, bags in stretches(texts[begin:end], of.get(setting, kinds)):
                    a, b = begin + a, begin + b
                    here = Rows.of_bags(ids[a:b], labels[a:b], role[a:b].astype(np.int16), bags)
                    known = added(known, here.feats, *count(here, max(1, int(here.roles.max(initial=-1)) + 1)))
                    held += [(ids[k], labels[k], role[k].copy(), texts[k]) for k in range(a, b)]
                    if len(known[0]) >= feats or sum(len(x or "") if made_here else len(x) for _, _, _, x in held) >= chars:
                        yield from told()
                        held, known = [], None
        if held:
            yield from told()

    return some.mapInArrow(pack, "setting string, block long, part int, n_feats long, top int, body binary")


def counted_piece(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a piece of counted_blocks, with n roles."""
    keys, few, shape = unpacked(body)
    values = np.zeros((few.shape[1], shape[0], n, shape[2]), np.int32)
    values[:, :, : shape[1]] = few.T.reshape(-1, *shape)
    return np.cumsum(keys), values.reshape(len(values), -1)
