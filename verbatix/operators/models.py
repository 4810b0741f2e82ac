"""Features and models.

Counts are made once per fold; a fold's training counts are the whole less the fold's own, so k-fold
lexicons and Naive Bayes models take one pass over the features, the latter over packed blocks of rows. Every row keeps a score, whether it
has features or not. Linear models are trained in operators/linear.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import written, written_for_now
from . import blocks as B
from .grams import Grams


def exploded(rows: DataFrame, bag: Column, *keep: str) -> DataFrame:
    """id, keep, feat, tf. Rows are dealt by id first, so that a row's features are counted where it is, without a shuffle of features."""
    return rows.repartition("id").select("id", *keep, F.explode(bag).alias("feat")).groupBy("id", *keep, "feat").agg(F.count("*").alias("tf"))


def document_frequency(rows: DataFrame, bag: Column) -> DataFrame:
    """feat, df, tf."""
    return exploded(rows, bag).groupBy("feat").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def idf(rows: DataFrame, bag: Column, min_df: int = 1) -> DataFrame:
    """feat, df, idf = ln((1 + N) / (1 + df)) + 1 of the features in min_df rows at least."""
    n = rows.agg(F.count("*").alias("n"))
    w = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return document_frequency(rows, bag).where(F.col("df") >= min_df).crossJoin(F.broadcast(n)).select("feat", "df", w.alias("idf"))


def tfidf(rows: DataFrame, bag: Column, min_df: int = 1) -> DataFrame:
    """id, feat, w: tf * idf with unit length in each row; other features are dropped."""
    x = exploded(rows, bag).join(idf(rows, bag, min_df).select("feat", "idf"), "feat").withColumn("x", F.col("tf") * F.col("idf"))
    return x.withColumn("w", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))).select("id", "feat", "w")


def lexicon(rows: DataFrame, positive: str = "MGY", min_count: int = 2, min_precision: float = 0.9) -> DataFrame:
    """token, total, pos, precision of the words that mark the positive class."""
    seen = rows.select("label", F.explode(F.array_distinct(X.word_tokens(F.col("text")))).alias("token"))
    n = seen.groupBy("token").agg(F.count("*").alias("total"), F.sum((F.col("label") == positive).cast("int")).alias("pos"))
    return n.withColumn("precision", F.col("pos") / F.col("total")).where((F.col("total") >= min_count) & (F.col("precision") >= min_precision))


#: Words (by fold) of a lexicon that is broadcast.
LISTED = 200_000


def lexicon_cv(rows: DataFrame, positive: str = "MGY", negative: str = "NOT", min_count: int = 2, min_precision: float = 0.9) -> DataFrame:
    """rows with pred: positive where a word is in the lexicon of the other folds."""
    seen = rows.select("id", "fold", "label", F.explode(F.array_distinct(X.word_tokens(F.col("text")))).alias("token"))
    own = seen.groupBy("token", "fold").agg(F.count("*").alias("n"), F.sum((F.col("label") == positive).cast("int")).alias("m"))
    w = Window.partitionBy("token")
    rest = own.select("token", "fold", (F.sum("n").over(w) - F.col("n")).alias("n"), (F.sum("m").over(w) - F.col("m")).alias("m"))
    listed = rest.where((F.col("n") >= min_count) & (F.col("m") >= min_precision * F.col("n"))).select("token", "fold")
    listed = written(listed)
    # a list of some 100,000 words goes to the rows' tokens; a longer one meets them by a shuffle
    hits = seen.join(F.broadcast(listed) if listed.count() <= LISTED else listed, ["token", "fold"]).select("id").distinct().withColumn("hit", F.lit(True))
    return rows.join(hits, "id", "left").withColumn("pred", F.when(F.col("hit"), positive).otherwise(negative)).drop("hit")


def lexicon_rule(rows: DataFrame, words: list[str], positive: str = "MGY", negative: str = "NOT", tokenizer: Callable[[Column], Column] = X.word_tokens) -> DataFrame:
    """rows with pred: positive for any listed word or redaction token; tokenizer gives the words of a text."""
    any_ = F.arrays_overlap(tokenizer(F.col("text")), F.array(*[F.lit(w) for w in words])) | F.col("text").rlike(X.TOKEN)
    return rows.withColumn("pred", F.when(any_, positive).otherwise(negative))


def majority_cv(rows: DataFrame) -> DataFrame:
    """rows with pred: the most frequent label of the other folds, of equally frequent ones the first by name."""
    own = rows.groupBy("fold", "label").agg(F.count("*").alias("n"))
    every = own.select("fold").distinct().crossJoin(own.groupBy("label").agg(F.sum("n").alias("total"))).join(own, ["fold", "label"], "left")
    rest = every.select("fold", "label", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n"))
    best = rest.groupBy("fold").agg(F.min(F.struct(-F.col("n"), "label")).alias("b")).select("fold", F.col("b.label").alias("pred"))
    return rows.join(F.broadcast(best), "fold")


def nb_train(rows: DataFrame, bag: Column, classes: list[str], alpha: float = 1.0, min_df: int = 1) -> DataFrame:
    """label, feat, cnt, loglik, log_prior of a model of all rows; unseen features have cnt 0."""
    x = exploded(rows, bag, "label")
    per = x.groupBy("feat").agg(F.count("*").alias("df"), *[F.sum(F.when(F.col("label") == c, F.col("tf")).otherwise(0)).alias(f"k{i}") for i, c in enumerate(classes)]).where(F.col("df") >= min_df)
    tot = per.agg(F.count("*").alias("v"), *[F.sum(f"k{i}").alias(f"t{i}") for i in range(len(classes))])
    docs = rows.agg(F.count("*").alias("n"), *[F.sum((F.col("label") == c).cast("int")).alias(f"d{i}") for i, c in enumerate(classes)])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"k{i}").alias("cnt"), F.col(f"t{i}").alias("t"), F.col(f"d{i}").alias("d")) for i, c in enumerate(classes)]))
    rows_ = per.crossJoin(F.broadcast(tot.crossJoin(docs))).select("feat", "v", "n", one.alias("c"))
    return rows_.select("c.label", "feat", "c.cnt", F.ln((F.col("c.cnt") + alpha) / (F.col("c.t") + alpha * F.col("v"))).alias("loglik"), F.ln(F.col("c.d") / F.col("n")).alias("log_prior"))


def _of(a: DataFrame, b: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """a with b's few rows of the same key; without a key, with its one row."""
    return a.join(F.broadcast(b), list(by), how) if by else a.crossJoin(F.broadcast(b))


def nb_cv(rows: DataFrame, bag: Column | Grams, classes: list[str], alpha: float | dict[str, float] = 1.0, min_df: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, id, fold, label, class, score: each row under the model of the other folds.

    log prior (not smoothed) plus tf * ln((count + alpha) / (total + alpha * V)) over all of its
    features, those that the model doesn't know with count 0. Folds whose training part lacks a class
    are left out. by: one column of settings that are counted beside each other in one pass, a row of each
    for every row, with folds, an array of the row's folds under several splits, in place of fold; the
    result has split, the fold's place. alpha may then differ by setting.

    Rows are packed in blocks once (operators/blocks.py), as texts; features meet by their 64-bit hashes and are
    made twice, where they are counted and where rows are scored. A feature of one row has no answer: the
    other rows don't have it.
    """
    k, kind = len(classes), dict(rows.dtypes)["id"]
    roles = F.col("folds") if by else F.array("fold")
    some = rows.withColumns({"setting": F.col(by[0]) if by else F.lit(""), "roles": roles})
    at_class = {c: i for i, c in enumerate(classes)}

    def counted(block: B.Rows, n: int) -> tuple[np.ndarray, np.ndarray]:
        """By feature, split and fold: rows, and occurrences in each class; by split and fold: rows, and those of each class."""
        y = np.array([at_class.get(x, -1) for x in block.labels], np.int64)
        n_splits = block.roles.shape[1]
        out, docs = np.zeros((len(block.feats), n_splits, n, 1 + k), np.int32), np.zeros((1, n_splits, n, 1 + k), np.int64)
        flat, known = out.reshape(-1), y >= 0
        cells = block.col.astype(np.int64) * (n_splits * n * (1 + k))
        for s in range(n_splits):
            fold = block.roles[:, s].astype(np.int64)
            dealt = fold >= 0
            np.add.at(docs, (0, s, fold[dealt], 0), 1)
            np.add.at(docs, (0, s, fold[dealt & known], 1 + y[dealt & known]), 1)
            base = cells + (s * n + fold[block.row]) * (1 + k)
            on = dealt[block.row]
            np.add.at(flat, base[on], 1)
            on &= known[block.row]
            np.add.at(flat, base[on] + 1 + y[block.row][on], block.tf[on])
        return out, docs

    made, drop = written_for_now(B.counted_blocks(some, bag, counted))
    sizes = {r.setting: r for r in made.where("part = -2").groupBy("setting").agg(F.sum("n_feats").alias("n"), (F.max("top") + 1).alias("k")).collect()}
    if not sizes:
        drop()
        return _nb_empty(rows, by)
    n_folds = {s: max(1, r.k) for s, r in sizes.items()}
    # by setting, split and fold: rows, rows of each class, known features, their occurrences in each class
    docs, sums = ({s: 0 for s in sizes} for _ in range(2))
    for r in made.where("part = -1").select("setting", "body").toLocalIterator():
        one = B.unpacked(bytes(r.body))[0]
        docs[r.setting] = docs[r.setting] + np.pad(one, ((0, 0), (0, n_folds[r.setting] - one.shape[1]), (0, 0)))
    n_splits = max(x.shape[0] for x in docs.values())
    parts = {s: min(B.BINS, max(1, -(-r.n * n_splits * n_folds[s] * (1 + k) // B.VALUES))) for s, r in sizes.items()}

    def answer(setting: str, keys: np.ndarray, total: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the other folds hold: occurrences by class, 0 where the model doesn't know the feature; by split and fold the known features and their occurrences; which features have answers."""
        own = total.reshape(len(keys), n_splits, n_folds[setting], 1 + k)
        rest = own.sum(2, keepdims=True) - own
        known = (rest[..., 0] >= min_df).astype(np.int64)
        values = rest[..., 1:] * known[..., None]
        back = values.reshape(len(keys), -1)
        return back.astype(np.int32), np.concatenate([known.sum(0)[..., None], values.sum(0)], 2), (own[..., 0].sum(2) > 1).any(1)

    n_parts = F.create_map(*[F.lit(x) for s in parts for x in (s, parts[s])])
    counts = made.where("part >= 0").select("setting", "block", (F.col("part") % n_parts[F.col("setting")]).cast("int").alias("part"), "body")
    found = written(B.summed(counts, answer, lambda setting, body: B.counted_piece(body, n_folds[setting])))
    for r in found.where("block < 0").select("setting", "body").toLocalIterator():
        sums[r.setting] = sums[r.setting] + B.unpacked(bytes(r.body))
    # counts go when the answers are there
    bodies = written(made.where("part = -2").select("setting", "block", "body"))
    drop()
    kinds, of = bag.kinds() if isinstance(bag, Grams) else ([], {})

    def scored(_, table: pa.Table, pieces: pa.Table) -> pa.Table:
        setting, (ids, labels, roles, held) = table.column("setting")[0].as_py(), B.unpacked(table.column("body")[0].as_py())
        n, smooth = n_folds[setting], alpha[setting] if isinstance(alpha, dict) else alpha
        each = [B.unpacked(x) for x in pieces.column("body").to_pylist()]
        keys = np.sort(np.concatenate([x for x, _ in each])) if each else np.zeros(0, np.int64)
        rest = np.zeros((len(keys) + 1, n_splits * n * k), np.int32)  # the last for features without an answer
        while each:
            x, v = each.pop()
            rest[np.searchsorted(keys, x)] = v
        rest = rest.reshape(len(rest), n_splits, n, k)
        train = docs[setting].sum(1, keepdims=True) - docs[setting]
        known = sums[setting] if isinstance(sums[setting], np.ndarray) else np.zeros((n_splits, n, 1 + k), np.int64)
        out = {c: [] for c in ("split", "row", "fold", "score")}
        for a, b, bags in B.stretches(held, of.get(setting, kinds)):
            # places stand in for ids: rows keep their order
            block = B.Rows.of_bags([f"{i:09d}" for i in range(a, b)], labels[a:b], roles[a:b], bags)
            place = np.searchsorted(keys, block.feats)
            place[(place == len(keys)) | (np.r_[keys, 0][place] != block.feats)] = len(keys)
            m = np.bincount(block.row, block.tf, b - a)
            for s in range(n_splits):
                fold = block.roles[:, s].astype(np.int64)
                row = np.flatnonzero((fold >= 0) & (train[s, fold, 1:] > 0).all(1))
                prior = np.log(train[s, fold[row], 1:] / train[s, fold[row], :1])
                seen = rest[place[block.col], s, fold[block.row]]
                here = np.stack([np.bincount(block.row, block.tf * np.log(seen[:, c] + smooth), b - a) for c in range(k)], 1)
                size = known[s, fold[row], 1:] + smooth * known[s, fold[row], :1]
                score = prior + here[row] - np.where(m[row, None] > 0, m[row, None] * np.log(np.maximum(size, 1e-300)), 0.0)
                out["split"].append(np.full(len(row) * k, s))
                out["row"].append(np.repeat(row + a, k))
                out["fold"].append(np.repeat(fold[row], k))
                out["score"].append(score.ravel())
        row, score = np.concatenate(out["row"]).tolist(), np.concatenate(out["score"])
        columns = {
            "setting": pa.array([setting] * len(row), pa.string()), "split": pa.array(np.concatenate(out["split"]), pa.int32()),
            "id": pa.array([ids[i] for i in row], pa.int64() if kind == "bigint" else pa.string()), "fold": pa.array(np.concatenate(out["fold"]), pa.int32()),
            "label": pa.array([labels[i] for i in row], pa.string()), "class": pa.array(classes * (len(row) // k), pa.string()), "score": pa.array(score, pa.float64()),
        }
        return pa.table(columns)

    asked = bodies.groupBy("setting", "block").cogroup(found.where("block >= 0").groupBy("setting", "block"))
    told = asked.applyInArrow(scored, f"setting string, split int, id {kind}, fold int, label string, class string, score double")
    return told.withColumnRenamed("setting", by[0]) if by else told.drop("setting", "split")


def _nb_empty(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    kind = dict(rows.dtypes)["id"]
    keys = f"{by[0]} string, split int, " if by else ""
    return rows.sparkSession.createDataFrame([], f"{keys}id {kind}, fold int, label string, class string, score double")


def best_class(scores: DataFrame, by: tuple[str, ...] = ("id", "fold", "label")) -> DataFrame:
    """by, pred: the class with the highest score (to 9 places), the first by name of equal ones."""
    best = F.min(F.struct(-F.round("score", 9), F.col("class").alias("pred"))).alias("b")
    return scores.groupBy(*by).agg(best).select(*by, "b.pred")


def linear_score(rows: DataFrame, bag: Column, weights: list[tuple[str, float]], bias: float, names: tuple[str, str]) -> DataFrame:
    """id, score, pred under given weights; the second name from 0 on."""
    w = rows.sparkSession.createDataFrame(weights, "feat string, weight double")
    sums = exploded(rows, bag).join(F.broadcast(w), "feat").groupBy("id").agg(F.sum(F.col("tf") * F.col("weight")).alias("s"))
    score = F.coalesce("s", F.lit(0.0)) + bias
    return rows.select("id").join(sums, "id", "left").select("id", score.alias("score"), F.when(score >= 0, names[1]).otherwise(names[0]).alias("pred"))
