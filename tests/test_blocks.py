"""Packed blocks of rows: what they hold, what is added up over them, and that features are made once."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from verbatix.functions import text as X
from verbatix.operators import blocks as B
from verbatix.operators import linear, models
from verbatix.operators.grams import Grams
from verbatix.sources import store


def sample(spark, n=60):
    texts = [" ".join(["common", f"w{k % 7}", f"x{k}"] * (1 + k % 3)) for k in range(n)]
    return spark.createDataFrame([(k, t, "POS" if k % 2 else "NEG", k % 5) for k, t in enumerate(texts)], "id long, text string, label string, fold int")


def test_rows_survive_packing_and_merging():
    bags = [np.array([5, 5, -9], np.int64), np.zeros(0, np.int64), np.array([7], np.int64)]
    roles = np.array([[1], [2], [1]], np.int16)
    whole = B.Rows.of_bags([3, 1, 2], ["a", "b", "c"], roles, bags)
    parts = [B.Rows.of_bags([i], [y], r[None], [b]).pack() for i, y, r, b in zip([3, 1, 2], "abc", roles, bags)]
    for got in (B.Rows.unpack(whole.pack()), B.Rows.merge(parts)):
        assert got.ids == [1, 2, 3] and got.labels == ["b", "c", "a"] and got.roles.tolist() == [[2], [1], [1]]
        assert [got.feats[got.col[got.start[i] : got.start[i + 1]]].tolist() for i in range(3)] == [[], [7], [-9, 5]] and got.tf.tolist() == [1, 1, 2]


def test_naive_bayes_makes_features_once(spark):
    """What follows the packing reads blocks: no text expression is left in the plan, however often the counts are used."""
    scores = models.nb_cv(sample(spark), X.features(F.col("text"), word=(1, 2)), ["NEG", "POS"])
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "normalize" not in plan and scores.count() == 120


def test_naive_bayes_over_many_blocks_and_parts(spark, monkeypatch):
    bag = X.features(F.col("text"), word=(1, 2))
    run = lambda: {(r.id, r["class"]): r.score for r in models.nb_cv(sample(spark), bag, ["NEG", "POS"], min_df=2).collect()}
    one = run()
    monkeypatch.setattr(B, "ROWS", 7)
    monkeypatch.setattr(B, "VALUES", 200)
    many = run()
    assert set(one) == set(many) and len(one) == 120 and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_weights_of_many_shards(spark):
    """One weight for each feature, the mean over its shards; a shard holds at most its share of the cells and a block."""
    rows = sample(spark).select("*", F.lit("s").alias("setting"), F.array(F.lit(linear.TRAIN)).alias("roles"))
    bag = X.features(F.col("text"), word=(1, 2))
    spec = {"s": linear.Spec(names=("NEG", "POS"), epochs=10)}
    found = linear.train(rows, spec, 1, weights=True, cells=400, bag=bag).collect()
    assert len({r.feat for r in found}) == len(found) > 60
    blocks = B.blocks(rows, bag, tokens=80).select("tokens").collect()
    assert max(r.tokens for r in blocks) <= 80 and len(blocks) > 3


def test_naive_bayes_keeps_texts_and_no_counts(spark, monkeypatch, tmp_path):
    """What stays on disk is less than half of the packed features; blocks bounded by their distinct features give the same scores."""
    words = [f"w{k * k % 97}x" for k in range(400)]
    rows = spark.createDataFrame([(k, " ".join(words[(k * 7 + j * (k % 5 + 1)) % 400] for j in range(300)), "POS" if k % 2 else "NEG", k % 5) for k in range(40)], "id long, text string, label string, fold int")
    bag = Grams(F.col("text"), word=(1, 2), char=(2, 4))
    found = []
    for feats in (B.FEATS, 500):
        monkeypatch.setattr(B, "FEATS", feats)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8" if feats == 500 else "10000")
        monkeypatch.setattr(store, "scratch", lambda _, at=itertools.count(): f"{tmp_path}/{feats}/{next(at)}")  # noqa: B023
        found.append({(r.id, r["class"]): r.score for r in models.nb_cv(rows, bag, ["NEG", "POS"]).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    packed = sum(len(r.body) for r in B.blocks(rows.select("*", F.lit("").alias("setting"), F.array("fold").alias("roles")), bag).collect())
    assert len(found[0]) == 80 and set(found[0]) == set(found[1]) and all(abs(found[0][k] - found[1][k]) < 1e-9 for k in found[0])
    tables = [spark.read.parquet(str(p)) for p in (tmp_path / "500").iterdir() if any(p.glob("*.parquet"))]
    assert len(tables) == 2 and not any("n_feats" in t.columns for t in tables)
    bodies = next(t for t in tables if "part" not in t.columns).collect()
    assert len(bodies) > 2 and sum(len(r.body) for r in bodies) < packed / 2
    plain = models.nb_cv(rows, X.features(F.col("text"), word=(1, 2), char=(2, 4)), ["NEG", "POS"]).collect()
    assert all(abs(found[0][r.id, r["class"]] - r.score) < 1e-9 for r in plain)
