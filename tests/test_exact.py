"""Linear models are those of the plain loop, whatever the number of rows, blocks and tasks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from verbatix.operators import crossval, linear
from verbatix.operators.grams import Grams

NAMES = ("NEG", "POS")


@pytest.fixture(scope="module")
def rows(spark):
    text = lambda k: f"{'good' if k % 3 else 'bad'} w{k * k % 23} w{k % 7} only{k} " + "again " * (300 if k == 5 else k % 4)
    return spark.createDataFrame([(k, text(k), NAMES[k % 3 > 0], k % 4) for k in range(120)], "id long, text string, label string, fold int").cache()


@pytest.mark.parametrize("kind", ["logreg", "svm"])
def test_blocks_dont_change_scores(rows, kind):
    """Many blocks give the scores of one, to the last digit."""
    spec, bag = linear.Spec(kind, NAMES, epochs=7, lam=5e-3), Grams(F.col("text"), word=(1, 2))
    found = []
    for cells in (linear.CELLS, 400):
        found.append({(r.id, r.fold): r.score for r in linear.cross_validated(rows, bag, spec, 4, cells=cells).collect()})
    assert len(found[0]) == 120 and found[0] == found[1]


def test_blocks_dont_change_weights(rows):
    """Lone features have weights too."""
    bag = Grams(F.col("text"), word=(1, 2))
    examples = rows.select("*", F.lit("s").alias("setting"), F.array(F.lit(linear.TRAIN)).alias("roles"))
    found = [{r.feat: r.weight for r in linear.train(examples, {"s": linear.Spec(names=NAMES, epochs=5)}, 1, weights=True, cells=cells, bag=bag).collect()} for cells in (linear.CELLS, 400)]
    assert len(found[0]) > 240 and found[0] == found[1]
    assert not [f for f in os.listdir(tempfile.gettempdir()) if f.startswith("verbatix-") and f.endswith(".users")]


def test_a_curve_packs_its_rows_once(spark, monkeypatch):
    """All repeats are families of one setting and give what each gives alone."""
    few = spark.createDataFrame([(k, f"word{k % 3} {'good' if k % 2 else 'bad'} x{k % 7}", NAMES[k % 2], str(k % 10)) for k in range(60)], "id long, text string, label string, template string")
    packed, blocks, found = [], linear.B.blocks, []
    monkeypatch.setattr(linear.B, "blocks", lambda rows, *a: packed.append(rows.count()) or blocks(rows, *a))
    for chars in (crossval.CURVE_CHARS, 1):
        monkeypatch.setattr(crossval, "CURVE_CHARS", chars)
        found.append(crossval.learning_curve(few, "svm", "accuracy", list(NAMES), repeats=2, fractions=(0.3, 1.0)).orderBy("frac").collect())
    assert packed == [60, 60, 60] and found[0] == found[1] and [r.n_repeats for r in found[0]] == [2, 2]
