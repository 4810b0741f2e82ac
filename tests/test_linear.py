"""Linear models over sparse rows against plain loops, and what is built on them."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatix.functions import text as X
from verbatix.operators import crossval, folds, generate, linear, metrics
from verbatix.sources import corpus as C
from verbatix.sources import store

NAMES = ("MGY", "NOT")


@pytest.fixture(scope="module")
def rows(spark):
    return C.diagnostic(generate.gen_rows(spark)).cache()


def dealt(rows):
    return folds.grouped(rows, 5, 12345, "template").withColumn("text", X.represent(F.col("text"), "masked"))


def bag():
    return X.features(F.col("text"), word=(1, 2))


def plain(rows, kind, **options):
    """id: score, by one dictionary of weights per fold; rows (id, label, fold, bag) in the order of their ids."""
    held, out = sorted(rows, key=lambda r: str(r.id)), {}
    for fold in range(5):
        train = [i for i, r in enumerate(held) if r.fold != fold]
        df = Counter(f for i in train for f in set(held[i].bag))
        idf = {f: math.log((1 + len(train)) / (1 + n)) + 1 for f, n in df.items()}

        def vector(r):
            x = {f: n * idf[f] for f, n in Counter(r.bag).items() if f in idf}  # noqa: B023
            length = math.sqrt(sum(v * v for v in x.values())) or 1.0
            return {f: v / length for f, v in x.items()}

        x, w, b, t = [vector(r) for r in held], Counter(), 0.0, 0
        draw = np.random.default_rng((1, 0))
        for _ in range(options["epochs"]):
            for i in draw.permutation(np.arange(len(held))):
                if held[i].fold == fold:
                    continue
                y = held[i].label == NAMES[1]
                z = sum(w[f] * v for f, v in x[i].items()) + b
                if kind == "logreg":
                    g = 1 / (1 + math.exp(-z)) - y
                    for f, v in x[i].items():
                        w[f] -= 0.5 * (g * v + 1e-4 * w[f])
                    b -= 0.5 * g
                else:
                    t += 1
                    eta, sign = 1 / (options["lam"] * t), 1 if y else -1
                    for f in w:
                        w[f] *= 1 - eta * options["lam"]
                    if sign * z < 1:
                        for f, v in x[i].items():
                            w[f] += eta * sign * v
                        b += eta * sign
        out |= {r.id: sum(w[f] * v for f, v in x[i].items()) + b for i, r in enumerate(held) if r.fold == fold}
    return out


@pytest.mark.parametrize("kind,options", [("logreg", {"epochs": 6}), ("svm", {"epochs": 4, "lam": 5e-3})])
def test_one_shard_is_the_plain_loop(rows, kind, options):
    """To the last digits that sums in another order leave."""
    few = dealt(rows).where("id < 'D0150'")
    want = plain(few.select("id", "label", "fold", bag().alias("bag")).collect(), kind, **options)
    got = linear.cross_validated(few, bag(), linear.Spec(kind, NAMES, **options)).collect()
    assert {r.id for r in got} == set(want) and all(abs(r.score - want[r.id]) < 1e-6 * max(1, abs(want[r.id])) for r in got)
    assert all(r.pred == NAMES[r.score >= 0] for r in got)


@pytest.mark.parametrize("kind", ["logreg", "svm"])
def test_many_shards_come_near(spark, rows, kind):
    """Rounds of means over four shards and 40 epochs: 90 % of the predictions agree, accuracies differ by 5 points at most. With half the epochs Pegasos differs by more."""
    spec = linear.Spec(kind, NAMES, epochs=40, lam=5e-3)
    few = dealt(rows)
    one = {r.id: r for r in linear.cross_validated(few, bag(), spec).collect()}
    cells = few.select(F.sum(F.size(bag()))).first()[0] * 5 // 4 + 5
    many = {r.id: r for r in linear.cross_validated(few, bag(), spec, cells=cells).collect()}
    assert set(one) == set(many) and len(one) == 416
    same = sum(one[i].pred == many[i].pred for i in one) / len(one)
    right = [sum(r.pred == r.label for r in m.values()) / len(m) for m in (one, many)]
    assert same >= 0.9 and abs(right[0] - right[1]) <= 0.05


def test_settings_and_shards_beside_each_other(rows):
    """A setting with one shard beside one with several gives what it gives alone; weights come once per feature."""
    both = dealt(rows).select("id", "label", bag().alias("bag"), linear.fold_roles(F.col("fold"), 5).alias("roles"))
    small = both.where("id < 'D0060'").withColumn("setting", F.lit("small"))
    all_ = small.unionByName(both.withColumn("setting", F.lit("large")))
    specs = {"small": linear.Spec("logreg", NAMES, epochs=5), "large": linear.Spec("logreg", NAMES, epochs=10)}
    cells = both.where("id < 'D0060'").select(F.sum(F.size("bag"))).first()[0] * 5 + 5
    got = linear.train(all_, specs, 5, cells=cells).collect()
    alone = {r.id: r.score for r in linear.train(small, specs, 5).collect()}
    assert {r.id: r.score for r in got if r.setting == "small"} == alone and sum(r.setting == "large" for r in got) == 416
    weights = linear.train(all_.where("setting = 'large'"), specs, 5, weights=True, cells=cells)
    assert weights.count() == weights.select("model", "feat").distinct().count() > 0


def test_folds_without_a_class(spark, rows):
    """Left out and counted, by linear models, models of the user's own and Naive Bayes; a single class gives no rows."""
    few = spark.createDataFrame([(k, f"word{k % 3} a b", "POS" if k < 2 else "NEG", k % 2, "g") for k in range(8)], "id long, text string, label string, fold int, template string")
    one = few.where("id <> 1")  # the training rows of fold 0 have no POS
    for fit in (crossval.MODELS["logreg"], crossval.MODELS["svm"], crossval.MODELS["nb"], crossval.MODELS["logreg_ovr"], crossval.of_factory(lambda texts, labels: lambda text: labels[0])):
        scored = fit(one, ["NEG", "POS"], 2)
        assert {r.fold for r in scored.collect()} <= {1} and metrics.confusion(scored, ["NEG", "POS"], ("fold",)).count() <= 4
    every = crossval.of_factory(lambda texts, labels: lambda text: labels[0])(few, ["NEG", "POS"], 2).collect()
    assert len(every) == 8
    assert linear.cross_validated(few.where("label = 'NEG'"), bag(), linear.Spec(names=("NEG", "POS"))).count() == 0
    assert linear.cross_validated(few.limit(0), bag(), linear.Spec(names=("NEG", "POS"))).count() == 0
    curve = crossval.learning_curve(few.withColumn("template", F.col("id").cast("string")), "logreg", "mcc", ["NEG", "POS"], repeats=5, fractions=(0.15, 1.0)).orderBy("frac").collect()
    assert [r.frac for r in curve] == [0.15, 1.0] and curve[0].n_repeats < 5


def test_repeats_of_a_curve_are_trained_in_turns(spark, monkeypatch, tmp_path):
    """Turn by turn as all at once, and no features or weights of a turn stay on disk, with one shard and with several."""
    few = spark.createDataFrame([(k, f"word{k % 3} {'good' if k % 2 else 'bad'} x{k % 7}", "POS" if k % 2 else "NEG", str(k % 10)) for k in range(60)], "id long, text string, label string, template string")
    got, asked, train = [], [], linear.train
    for chars, cells in ((crossval.CURVE_CHARS, linear.CELLS), (1000, linear.CELLS), (1000, 4000)):
        asked.append(0)
        monkeypatch.setattr(linear, "train", lambda *a, **b: asked.append(asked.pop() + 1) or train(*a, cells=cells, rounds=2, **b))  # noqa: B023
        monkeypatch.setattr(crossval, "CURVE_CHARS", chars)
        monkeypatch.setattr(store, "scratch", lambda _, top=tmp_path / f"{len(got)}", at=itertools.count(): f"{top}/{next(at)}")
        got.append(crossval.learning_curve(few, "logreg", "accuracy", ["NEG", "POS"], repeats=3, fractions=(0.5, 1.0)).orderBy("frac").collect())
        left = [spark.read.parquet(str(p)).columns for p in (tmp_path / f"{len(got) - 1}").iterdir() if any(p.glob("*.parquet"))]
        assert left and not any("body" in c for c in left)
    assert asked == [1, 3, 3] and got[0] == got[1] and [(r.frac, r.n_repeats) for r in got[2]] == [(0.5, 3), (1.0, 3)]


def test_rows_without_features(spark):
    some = spark.createDataFrame([(k, "" if k % 4 == 0 else None if k % 4 == 1 else "good" if k % 4 == 2 else "bad", "POS" if k % 4 in (0, 2) else "NEG", k % 5) for k in range(40)], "id long, text string, label string, fold int")
    got = linear.cross_validated(some, bag(), linear.Spec(names=("NEG", "POS"), epochs=20)).collect()
    assert len(got) == 40 and all(r.pred == r.label for r in got if r.id % 4 > 1)


def test_top_features_and_ties(spark):
    weights = spark.createDataFrame([(k, w) for k, w in enumerate([3.0, 1.0, 1.0, 1.0, -1.0, -1.0, -2.0, 0.5])], "feat long, weight double")
    names = spark.createDataFrame([(k, n) for k, n in enumerate("hgfedcba")], "feat long, name string")
    got = [tuple(r) for r in linear.top(weights, names, 2).orderBy("side", "rank").collect()]
    assert got == [("bottom", 1, "b", -2.0), ("bottom", 2, "c", -1.0), ("top", 1, "h", 3.0), ("top", 2, "e", 1.0)]


def test_published_figures(rows):
    """Use against counter-speech on the generated corpus, with other folds and draws than the published ones (accuracy 0.928 SVM, 0.922 LR): within 0.1."""
    use = rows.where(F.col("category").isin("USE_SLUR", "COUNTER"))
    got = {r.model: r for r in crossval.grid(use, [(m, "masked", "group") for m in ("nb", "svm_wide", "logreg")], list(NAMES), use.select("id", "pair")).collect()}
    assert abs(got["svm_wide"].accuracy_mean - 0.928) < 0.1 and abs(got["logreg"].accuracy_mean - 0.922) < 0.1 and abs(got["nb"].accuracy_mean - 0.922) < 0.1
    assert got["logreg"].n_folds == 5 and got["logreg"].consistency > 0.7


def test_grid_is_its_settings(rows):
    """One scan for all gives what each setting gives alone."""
    settings = [("nb", "masked", "group"), ("cues", "stripped", "random"), ("lexicon", "raw", "group"), ("majority", "raw", "random"), ("svm", "masked", "random")]
    few = rows.where("id < 'D0200'")
    got = {}
    for r in crossval.grid_scores(few, settings, list(NAMES)).collect():
        got.setdefault((r.model, r.representation, r.split), {})[r.id] = (r.fold, r.pred)
    for m, shown, split in settings:
        assert got[m, shown, split] == {r.id: (r.fold, r.pred) for r in crossval.cross_validate(few, m, shown, split, classes=list(NAMES)).collect()}


def test_lexicon_options_and_metric_hook(rows):
    strict = crossval.cross_validate(rows, crossval.lexicon("NOT", min_count=5, min_precision=1.0), classes=list(NAMES))
    assert strict.count() == 416
    share = lambda matrix, by: matrix.groupBy(*by).agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("value"))
    a, b = (crossval.learning_curve(rows, "cues", m, list(NAMES), repeats=3, fractions=(0.5,)).first() for m in (share, "accuracy"))
    assert abs(a["mean"] - b["mean"]) < 1e-12 and a.n_repeats == 3
