"""N-grams of batches against the expressions of functions/text.py."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from verbatix.functions import text as X
from verbatix.operators import blocks as B
from verbatix.operators import grams as G
from verbatix.operators import linear, models
from verbatix.sources import corpus as C

TEXTS = ["the cat, the CAT", "a_b c a b_c", "", "   ", None, "ä\U0001f600b \U0001f600 ab", "one", "x y  z w. [q]"]


def test_bags_are_those_of_the_expressions(spark):
    """Equal features and only those have equal hashes, in bags of the same sizes."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id long, text string")
    both = G.Grams(F.col("text"), word=(1, 2), char=(2, 4))
    got = rows.select("id", both.normal.alias("t"), X.features(F.col("text"), (1, 2), (2, 4)).alias("bag")).orderBy("id").collect()
    bags = [b for a, e in G.chunks([r.t for r in got], 5) for b in G.Batch([r.t for r in got[a:e]]).bags(both.kinds()[0])]
    name_of = {}
    for r, bag in zip(got, bags):
        assert len(bag) == len(r.bag or [])
        for h, name in zip(bag.tolist(), r.bag or []):
            assert name_of.setdefault(h, name) == name
    assert len(set(name_of.values())) == len(name_of)


def test_frequency_is_the_exploded_count(spark, monkeypatch):
    """Over several chunks, with a repeated id."""
    monkeypatch.setattr(G, "POINTS", 4)
    rows = spark.createDataFrame([(k % 6, t) for k, t in enumerate(TEXTS)], "id long, text string")
    want = models.document_frequency(rows, X.char_ngrams(F.col("text"), 2, 4))
    got = G.frequency(rows, G.Grams(F.col("text"), char=(2, 4)))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.columns == want.columns


def test_features_are_made_where_rows_are_packed(spark):
    """No n-gram is a value of Spark's; Naive Bayes over Grams is that over strings."""
    rows = spark.createDataFrame([(k, f"w{k % 7} common x{k}", "POS" if k % 2 else "NEG", k % 5) for k in range(60)], "id long, text string, label string, fold int")
    run = lambda bag: {(r.id, r["class"]): r.score for r in models.nb_cv(rows, bag, ["NEG", "POS"], min_df=2).collect()}
    a, b = run(G.Grams(F.col("text"), word=(1, 2))), run(X.features(F.col("text"), word=(1, 2)))
    assert set(a) == set(b) and len(a) == 120 and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_redaction_skips_only_texts_without_its_marks(spark):
    rows = ["you Idiot", "[fslur_idiot] a", "a@b.c idiot", "plain", None, "x[FSLUR_MORON]@"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id long, text string").orderBy("id").select(C.redact(F.col("text")).alias("t")).collect()]
    assert got == ["you [FSLUR_03]", "[FSLUR_03] a", "[CTX_01] [FSLUR_03]", "plain", None, "x[FSLUR_06]@"]


def test_names_of_candidates_alone(spark):
    """Names are made once for both ends, and of the features at them alone; too many candidates get all names. The result is that of all names."""
    rows = spark.createDataFrame([(k, f"w{k:02d} common x{k % 3}") for k in range(30)], "id long, text string")
    bag, asked = G.Grams(F.col("text"), word=(1, 1)), []
    every = {r.name: r.feat for r in G.names(rows, bag).collect()}
    weights = spark.createDataFrame([(every[f"w1:w{k:02d}"], float(max(k, 3) - 15)) for k in range(30)], "feat long, weight double")

    def names(feats):
        asked.append(feats)
        return G.names(rows, bag, feats)

    want = linear.top(weights, G.names(rows, bag), 2).collect()
    got = linear.top(weights, names, 2).collect()
    assert got == want and [r.feat for r in got if r.side == "bottom"] == ["w1:w00", "w1:w01"]
    # four features tie at the lower border
    assert len(asked) == 1 and len(asked[0]) == 6 and {r.name for r in names(asked[0]).collect()} == {f"w1:w{k:02d}" for k in (0, 1, 2, 3, 28, 29)}


def test_more_candidates_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(linear, "CANDIDATES", 3)
    rows = spark.createDataFrame([(k, f"w{k}") for k in range(9)], "id long, text string")
    bag, asked = G.Grams(F.col("text"), word=(1, 1)), []
    weights = G.names(rows, bag).select("feat", F.lit(1.0).alias("weight"))
    got = linear.top(weights, lambda feats: asked.append(feats) or G.names(rows, bag, feats), 2).where("side = 'top'").collect()
    assert asked == [None] and [r.feat for r in got] == ["w1:w0", "w1:w1"]
