"""Logistic regression and Pegasos over sparse rows, row after row.

A model is trained as a plain loop would: rows in the order of their ids, dealt anew in each epoch by the
setting's seed, each step from the weights that the step before left. So results don't depend on the
number of rows, blocks or tasks. What is shared out is the work around the loop, and the models: each
model (one per fold, or one per part of a learning curve) is a task of its own.

Rows of a setting are packed in blocks (operators/blocks.py). Document frequencies are summed by feature
over all blocks, features are numbered from the most frequent down, and blocks are written anew with the
numbers. A feature of one row alone needs no number: its weight moves with the row's other such features,
in proportion to their values, so a row's lone features count as one. A task streams the setting's blocks
into files of its executor's temporary folder, which the tasks beside it read too, and maps them: in memory
are a model's weights and a few numbers for each row. Time grows with rows times epochs and more machines
don't shorten the training of one model.

A model whose training rows lack a class is left out: it has no scores and no weights.
"""

from __future__ import annotations

import contextlib
import fcntl
import math
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written, written_for_now
from . import blocks as B
from .grams import Grams

#: A block has at most CELLS / LEAST non-zeros.
CELLS, LEAST = 24_000_000, 5
#: Least parts of the keys in which features are numbered.
PARTS = 64
#: Numbers below this take two bytes.
HOT = 1 << 16
#: Non-zeros that are read at a time where rows are summed.
STRETCH = 4_000_000
#: Non-zeros of a model whose values are kept in memory from one epoch to the next; others are made again.
KEPT = 32_000_000
#: Tasks of a setting at most; more models are trained one after the other in them.
TASKS = 48
NONE, TRAIN, TEST = 0, 1, 2
UNION = "spark.sql.unionOutputPartitioning"


@dataclass(frozen=True)
class Spec:
    """How a setting's models are trained; the second name is the positive class."""

    kind: str = "logreg"
    names: tuple[str, str] = ("MGY", "NOT")
    epochs: int = 80
    rate: float = 0.5
    l2: float = 1e-4
    lam: float = 1e-4
    min_df: int = 1
    seed: int = 1


def numbered(keys: np.ndarray, df: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Class (by powers of two, the most frequent first; -1: fewer rows than least) and place within the class of each key; how many each class has."""
    kind = np.where(df >= least, 63 - np.floor(np.log2(np.maximum(df, 1))).astype(np.int64), -1)
    place = np.zeros(len(keys), np.int64)
    for c in np.unique(kind[kind >= 0]).tolist():
        at = np.flatnonzero(kind == c)
        place[at] = np.arange(len(at))
    return np.stack([kind, place], 1), np.bincount(kind[kind >= 0], minlength=64)


def renumbered(rows: B.Rows, number: np.ndarray, keep_feats: bool) -> tuple[bytes, int]:
    """A block by its features' numbers (-1: of one row alone), in their order within a row, and the largest count."""
    n, col = len(rows.ids), number[rows.col]
    lone = col < 0
    square = np.bincount(rows.row[lone], rows.tf[lone].astype(float) ** 2, n)
    row, col, tf = rows.row[~lone], col[~lone], rows.tf[~lone]
    by = np.lexsort((col, row))
    row, col, tf = row[by], col[by], tf[by]
    hot = col < HOT
    most = int(tf.max(initial=1))
    tf = tf.astype(np.min_scalar_type(most))
    parts = []
    for some, kind in ((hot, np.uint16), (~hot, np.int32)):
        at = col[some].astype(kind)
        parts.append((np.bincount(row[some], minlength=n), np.diff(at, prepend=at.dtype.type(0)), tf[some]))
    names = (number[number >= 0], rows.feats[number >= 0]) if keep_feats else None
    return B.packed((rows.ids, rows.labels, rows.roles, square, parts, names)), most


@contextlib.contextmanager
def beside(name: str, build: Callable[[str], None]) -> Iterator[str]:
    """A folder of the executor's temporary folder that tasks share, made by the first and deleted by the last."""
    folder = os.path.join(tempfile.gettempdir(), f"verbatix-{name}")

    @contextlib.contextmanager
    def alone() -> Iterator[int]:
        while True:
            held = os.open(f"{folder}.users", os.O_RDWR | os.O_CREAT)
            fcntl.flock(held, fcntl.LOCK_EX)
            with contextlib.suppress(FileNotFoundError):
                if os.stat(f"{folder}.users").st_ino == os.fstat(held).st_ino:
                    break
            os.close(held)  # another task deleted it meanwhile
        try:
            yield held
        finally:
            os.close(held)

    def users(held: int, change: int) -> int:
        now = int(os.pread(held, 20, 0) or b"0") + change
        os.ftruncate(held, 0)
        os.pwrite(held, str(now).encode(), 0)
        return now

    with alone() as held:
        if users(held, 0) == 0:
            shutil.rmtree(folder, ignore_errors=True)
            os.mkdir(folder)
            try:
                build(folder)
            except BaseException:
                shutil.rmtree(folder, ignore_errors=True)
                os.unlink(f"{folder}.users")
                raise
        users(held, 1)
    try:
        yield folder
    finally:
        with alone() as held:
            if users(held, -1) == 0:
                shutil.rmtree(folder, ignore_errors=True)
                os.unlink(f"{folder}.users")


def gather(bodies: Iterator[bytes], folder: str, kind: np.dtype, n_feats: int) -> None:
    """Writes renumbered blocks to files of one number after the other; counts have the given type."""
    ids, labels, roles, square, sizes, feats = [], [], [], [], ([], []), None
    with contextlib.ExitStack() as files:
        out = [(files.enter_context(open(f"{folder}/at{k}", "wb")), files.enter_context(open(f"{folder}/tf{k}", "wb"))) for k in (0, 1)]
        for body in bodies:
            i, y, r, s, parts, names = B.unpacked(body)
            ids += i
            labels += y
            roles.append(r.astype(np.int8))
            square.append(s)
            for k, (size, at, tf) in enumerate(parts):
                sizes[k].append(size)
                out[k][0].write(np.cumsum(at, dtype=at.dtype).tobytes())
                out[k][1].write(tf.astype(kind).tobytes())
            if names is not None:
                feats = np.zeros(n_feats, np.int64) if feats is None else feats
                feats[names[0]] = names[1]
    starts = [np.r_[0, np.cumsum(np.concatenate(s))] for s in sizes]
    with open(f"{folder}/rows", "wb") as f:
        pickle.dump((ids, labels, np.concatenate(roles), np.concatenate(square), starts, feats, kind.str, n_feats), f, 5)


class Task:
    """One model over the rows of a folder: a row's value of a feature is tf * idf / length."""

    def __init__(self, folder: str, spec: Spec, model: int, family: slice = slice(None)):
        with open(f"{folder}/rows", "rb") as f:
            self.ids, self.labels, self.roles, square, self.start, self.feats, kind, n_feats = pickle.load(f)
        self.spec, self.model, self.family, self.n = spec, model, family, len(self.ids)
        mapped = lambda name, kind: np.asarray(np.memmap(f"{folder}/{name}", kind, "r")) if os.path.getsize(f"{folder}/{name}") else np.zeros(0, kind)
        self.at, self.tf = [mapped("at0", np.uint16), mapped("at1", np.int32)], [mapped(f"tf{k}", np.dtype(kind)) for k in (0, 1)]
        self.train = self.roles[:, model] == TRAIN
        self.y = np.array([x == spec.names[1] for x in self.labels], float)
        n = int(self.train.sum())
        self.good = 0 < self.y[self.train].sum() < n
        if not self.good:
            return
        df = np.zeros(n_feats, np.int64)
        for k, a, b, row in self.stretches():
            df += np.bincount(self.at[k][a:b][self.train[row]], minlength=n_feats)
        idf = lambda d: np.where(d >= max(1, spec.min_df), np.log((1 + n) / (1 + d)) + 1, 0.0)
        self.idf = idf(df)
        # a feature of one row alone is known to the models that train on the row
        self.lone = np.sqrt(square) * np.where(self.train, idf(np.ones(1, np.int64)), 0.0)
        norm = self.lone**2 + self.summed(self.idf**2, 2)
        self.inv = 1 / np.sqrt(np.where(norm > 0, norm, 1.0))
        self.lone *= self.inv

    def stretches(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Part, begin, end of stretches of numbers, and the row of each."""
        for k, start in enumerate(self.start):
            a = 0
            while a < self.n:
                b = max(a + 1, int(np.searchsorted(start, start[a] + STRETCH, "right")) - 1)
                if start[b] > start[a]:
                    yield k, start[a], start[b], np.repeat(np.arange(a, b), np.diff(start[a : b + 1]))
                a = b

    def summed(self, values: np.ndarray, power: int) -> np.ndarray:
        """For each row the sum of tf ** power * values."""
        out = np.zeros(self.n)
        for k, a, b, row in self.stretches():
            first = row[0]
            out[first : row[-1] + 1] += np.bincount(row - first, self.tf[k][a:b].astype(float) ** power * values[self.at[k][a:b]])
        return out

    def steps(self) -> Iterator[int]:
        """Rows of all steps, dealt over the rows that any model of the family trains on."""
        order = np.argsort(np.array([str(x) for x in self.ids]), kind="stable")
        rows = np.flatnonzero((self.roles[order, self.family] == TRAIN).any(1))
        draw = np.random.default_rng((self.spec.seed, 0))
        for _ in range(self.spec.epochs):
            now = order[draw.permutation(rows)]
            yield from now[self.train[now]].tolist()

    def reader(self) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        """From a row to its numbers and values."""
        (hot, cold), (tf0, tf1), (s0, s1) = self.at, self.tf, [s.tolist() for s in self.start]
        idf, inv, join, kept, room = self.idf, self.inv.tolist(), np.concatenate, {}, KEPT

        def read(i: int) -> tuple[np.ndarray, np.ndarray]:
            nonlocal room
            a, b, c, d = s0[i], s0[i + 1], s1[i], s1[i + 1]
            at = join((hot[a:b], cold[c:d]), dtype=np.intp)
            x = kept.get(i)
            if x is None:
                x = idf.take(at)
                x *= join((tf0[a:b], tf1[c:d]))
                x *= inv[i]
                if len(x) <= room:
                    kept[i] = x
                    room -= len(x)
            return at, x

        return read

    def fit(self) -> None:
        self.w, self.own, self.b = np.zeros(len(self.idf)), np.zeros(self.n), 0.0
        FITS[self.spec.kind](self)

    def scores(self) -> dict[str, list]:
        """id, label, score, pred of every test row."""
        z = self.summed(self.w * self.idf, 1) * self.inv + self.b
        rows = np.flatnonzero(self.roles[:, self.model] == TEST)
        names = np.array(self.spec.names, object)
        return {"id": [self.ids[i] for i in rows.tolist()], "label": [self.labels[i] for i in rows.tolist()], "score": z[rows], "pred": names[(z[rows] >= 0).astype(int)].tolist()}

    def weights(self) -> dict[str, list]:
        """feat, weight of every feature of the vocabulary."""
        at = np.flatnonzero(self.w)
        return {"feat": self.feats[at], "weight": self.w[at]}


def _logreg(task: Task) -> None:
    spec, read, w, own, lone, y = task.spec, task.reader(), task.w, task.own.tolist(), task.lone.tolist(), task.y.tolist()
    decay, rate, b, exp = 1 - spec.rate * spec.l2, spec.rate, 0.0, math.exp
    for i in task.steps():
        at, x = read(i)
        mine = w.take(at)
        z = float(mine.dot(x)) + own[i] * lone[i] + b
        g = rate * (1 / (1 + exp(-min(80.0, max(-80.0, z)))) - y[i])
        # a row's weights decay with its step
        mine *= decay
        mine -= x * g
        w[at] = mine
        own[i] = own[i] * decay - g * lone[i]
        b -= g
    task.own, task.b = np.array(own), b


def _pegasos(task: Task) -> None:
    spec, read, w, own, lone, sign = task.spec, task.reader(), task.w, task.own, task.lone.tolist(), (2 * task.y - 1).tolist()
    b, scale = 0.0, 1.0
    for t, i in enumerate(task.steps(), 1):
        eta = 1 / (spec.lam * t)
        at, x = read(i)
        margin = sign[i] * (scale * (float(w.take(at).dot(x)) + float(own[i]) * lone[i]) + b)
        # the decay of all weights is one factor
        scale *= 1 - eta * spec.lam
        if scale < 1e-9:
            w *= scale
            own *= scale
            scale = 1.0
        if margin < 1:
            w[at] += x * (eta * sign[i] / scale)
            own[i] += lone[i] * (eta * sign[i] / scale)
            b += eta * sign[i]
    w *= scale
    own *= scale
    task.b = b


FITS: dict[str, Callable] = {"logreg": _logreg, "svm": _pegasos}


def train(examples: DataFrame, specs: dict[str, Spec], n_models: int, weights: bool = False, cells: int = CELLS, rounds: int | None = None, bag: Column | Grams | None = None, families: int = 1) -> DataFrame:
    """Scores (setting, model, id, label, score, pred) of the test rows, or weights (setting, model, feat, weight) if asked for.

    examples: setting, id, label, roles (array of n_models: 0 none, 1 training, 2 test) and the features
    (array of strings, repeated or not; null: none), as the column bag or made by the expression bag from
    other columns, where the rows are packed. Features are the xxhash64 of their strings, those of Grams the
    hashes that Grams give them; weights name them so. cells bounds a block and doesn't change results;
    rounds has no effect any more (training has no rounds) and is still taken. Models in several families, of
    consecutive models each, give what each family gives as a setting of its own, with the rows packed once.
    """
    spark, kind = examples.sparkSession, dict(examples.dtypes)["id"]
    out = "setting string, model int, feat long, weight double" if weights else f"setting string, model int, id {kind}, label string, score double, pred string"
    some = examples.where(F.col("setting").isin(list(specs)))
    made, drop_made = written_for_now(B.blocks(some, F.col("bag") if bag is None else bag, max(1, min(B.TOKENS, cells // LEAST))))
    # lone features are told apart where their weights are asked for
    least = 1 if weights else 2
    parts = max(PARTS, -(-(made.agg(F.sum("n_feats")).first()[0] or 0) // B.VALUES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for setting, block, body in zip(*[batch.column(c).to_pylist() for c in ("setting", "block", "body")]):
                rows = B.Rows.unpack(body)
                yield B.pieces_of(setting, block, rows.feats, np.bincount(rows.col, minlength=len(rows.feats))[:, None].astype(np.int32), parts)

    given, drop_given = written_for_now(B.summed(made.mapInArrow(count, B.PIECE), lambda setting, keys, total, holders: numbered(keys, total[:, 0], least)))
    found: dict[str, np.ndarray] = {}
    for r in given.where("block < 0").select("setting", "part", "body").toLocalIterator():
        found.setdefault(r.setting, np.zeros((64, parts), np.int64))[:, r.part] = B.unpacked(bytes(r.body))
    # the first number of each class and part
    first = {s: (np.cumsum(x) - x.reshape(-1)).reshape(x.shape) for s, x in found.items()}

    def number(_, table: pa.Table, pieces: pa.Table) -> pa.Table:
        setting, rows = table.column("setting")[0].as_py(), B.Rows.unpack(table.column("body")[0].as_py())
        numbers = np.full(len(rows.feats), -1, np.int64)
        for part, body in zip(pieces.column("part").to_pylist(), pieces.column("body").to_pylist()):
            keys, (c, place) = (lambda k, v: (k, v.T))(*B.unpacked(body))
            numbers[np.searchsorted(rows.feats, keys)] = np.where(c < 0, -1, first[setting][c, part] + place)
        body, most = renumbered(rows, numbers, weights)
        return pa.table({"setting": pa.array([setting], pa.string()), "most": pa.array([most], pa.int32()), "body": pa.array([body], pa.binary())})

    ready, drop_ready = written_for_now(made.groupBy("block").cogroup(given.where("block >= 0").groupBy("block")).applyInArrow(number, "setting string, most int, body binary"))
    # what was written goes when it is no longer read
    drop_made()
    drop_given()
    run = uuid.uuid4().hex
    types = {"model": pa.int32(), "feat": pa.int64(), "weight": pa.float64(), "label": pa.string(), "score": pa.float64(), "pred": pa.string(), "id": pa.int64() if kind == "bigint" else pa.string()}

    def models_of(at: int, setting: str, models: range, counts: np.dtype, n_feats: int) -> Callable:
        of = n_models // families

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bodies = (x.as_py() for batch in batches for x in batch.column("body"))
            with beside(f"{run}-{at}", lambda folder: gather(bodies, folder, counts, n_feats)) as folder:
                for _ in batches:
                    pass  # another task has put them there
                for model in models:
                    task = Task(folder, specs[setting], model, slice(model // of * of, (model // of + 1) * of))
                    if not task.good:
                        continue
                    task.fit()
                    told = task.weights() if weights else task.scores()
                    n = len(next(iter(told.values())))
                    yield pa.record_batch([pa.array([setting] * n, pa.string()), pa.array([model] * n, pa.int32()), *[pa.array(x, types[c]) for c, x in told.items()]], ["setting", "model", *told])

        return fit

    each = []
    for at, (setting, most) in enumerate(sorted(map(tuple, ready.groupBy("setting").agg(F.max("most")).collect()))):
        blocks, n_tasks = ready.where(F.col("setting") == setting).select("body"), min(n_models, TASKS)
        for k in range(n_tasks):
            # one task that reads all blocks, so nothing is shuffled or copied for a model
            fit = models_of(at, setting, range(k, n_models, n_tasks), np.dtype(np.min_scalar_type(most)), int(found[setting].sum()) if setting in found else 0)
            each.append(blocks.coalesce(1).mapInArrow(fit, out))
    if not each:
        drop_ready()
        return spark.createDataFrame([], out)
    while len(each) > 1:
        # a plan of few levels
        each = [a[0].unionByName(a[1]) if len(a) > 1 else a[0] for a in (each[i : i + 2] for i in range(0, len(each), 2))]
    # a union of single partitions would be one partition, and its models trained one after the other
    before = spark.conf.get(UNION, "true")
    spark.conf.set(UNION, "false")
    try:
        result = written(each[0])
    finally:
        spark.conf.set(UNION, before)
    drop_ready()
    return result


def fold_roles(fold: Column, k: int) -> Column:
    """roles of k-fold cross-validation: a row is tested by its fold's model and trains the others."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda m: F.when(m == fold, TEST).otherwise(TRAIN))


def cross_validated(rows: DataFrame, bag: Column | Grams, spec: Spec, k: int = 5, **options) -> DataFrame:
    """id, fold, label, pred, score of rows (id, label, fold) under the models of the other folds; folds whose training rows lack a class are left out."""
    examples = rows.select("*", F.lit("one").alias("setting"), fold_roles(F.col("fold"), k).alias("roles"))
    return train(examples, {"one": spec}, k, bag=bag, **options).select("id", F.col("model").alias("fold"), "label", "pred", "score")


#: Candidates whose names alone are made; beyond, all names are made and joined.
CANDIDATES = 100_000


def top(weights: DataFrame, names: DataFrame | Callable[[list[int] | None], DataFrame], n: int) -> DataFrame:
    """side, rank, feat, weight: the n highest and the n lowest weights, ties by name; names: feat (hash), name, or what gives them for some features (None: for all).

    The candidates are the n-th weight from each end and all beyond it, so ties at the border are not cut by chance.
    """
    sides, beyond = (("top", 1.0), ("bottom", -1.0)), None
    for side, sign in sides:
        w = weights.select(F.lit(side).alias("side"), "feat", (F.col("weight") * sign).alias("w"))
        edge = w.orderBy(F.desc("w")).limit(n).agg(F.min("w").alias("edge"))
        some = w.join(F.broadcast(edge), F.col("w") >= F.col("edge")).drop("edge")
        beyond = some if beyond is None else beyond.unionByName(some)
    if callable(names):
        # names are strings of every text: made once for both sides, and for the candidates alone
        asked = [r.feat for r in beyond.select("feat").distinct().limit(CANDIDATES + 1).collect()]
        names = names(None if len(asked) > CANDIDATES else asked)
    named = beyond.join(names, "feat").select("side", "w", "name").distinct()
    out = None
    for side, sign in sides:
        # names may come from many rows
        first = named.where(F.col("side") == side).orderBy(F.desc("w"), "name").limit(n)
        ranked = first.agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("m"), "name"))).alias("l")).select(F.posexplode("l").alias("pos", "x"))
        one = ranked.select(F.lit(side).alias("side"), (F.col("pos") + 1).alias("rank"), F.col("x.name").alias("feat"), (-F.col("x.m") * sign).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out
