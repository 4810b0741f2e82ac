"""Cross-validation with a model argument, grids of settings, learning curves, and the summary of each.

Counting models (majority, lexicon, Naive Bayes with words, characters or cues) are plans that count
once for all folds, and Naive Bayes once for all settings of a grid; linear models of all settings and
folds are trained beside each other (operators/linear.py). A grid's representations and folds are made
once and written to the shared folder; every model reads its own text column from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import written, written_for_now
from . import folds, linear, metrics, models
from .grams import Grams

#: A model of the user's own: from training texts and labels to a function from a text to a label.
Factory = Callable[[list[str], list[str]], Callable[[str], str]]
K = 5


def _with_cues(text: Column) -> Column:
    return F.concat_ws(" ", text, F.nullif(F.array_join(X.cues(text), " "), F.lit("")))


#: Naive Bayes models by name: their features and smoothing.
NB: dict[str, tuple[Callable[[Column], Grams], float]] = {
    "nb": (lambda t: Grams(t, word=(1, 2)), 1.0),
    "nb_char": (lambda t: Grams(t, char=(2, 4)), 1.0),
    "nb_cues": (lambda t: Grams(_with_cues(t), word=(1, 2)), 1.0),
    "cues": (lambda t: Grams(X.cue_text(t), word=(1, 1)), 0.5),
}
#: Linear models by name: their options. All take words of 1 and 2 and characters of 3 and 4.
LINEAR: dict[str, dict] = {
    "logreg": {"kind": "logreg"},
    "logreg_60": {"kind": "logreg", "epochs": 60},
    "svm": {"kind": "svm", "epochs": 60},
    "svm_wide": {"kind": "svm", "lam": 5e-3, "epochs": 120},
}


def lexicon(positive: str | None = None, min_count: int = 2, min_precision: float = 0.9) -> Callable:
    """The learned lexicon with its options; without a positive class, MGY if it is the first class and else the last."""

    def model(rows: DataFrame, classes: list[str], k: int = K) -> DataFrame:
        yes = positive or (classes[0] if classes[0] == "MGY" else classes[-1])
        no = next(c for c in classes if c != yes)
        return models.lexicon_cv(rows, yes, no, min_count, min_precision).select("id", "fold", "label", "pred")

    return model


def _both(text: Column) -> Grams:
    return Grams(text, word=(1, 2), char=(3, 4))


def _nb(name: str) -> Callable:
    bag, alpha = NB[name]
    return lambda rows, classes, k=K: models.best_class(models.nb_cv(rows, bag(F.col("text")), classes, alpha=alpha))


def _linear(name: str) -> Callable:
    # a linear model tells the second class from the others, whatever their number
    return lambda rows, classes, k=K: linear.cross_validated(rows, _both(F.col("text")), linear.Spec(names=(classes[0], classes[1]), **LINEAR[name]), k).select("id", "fold", "label", "pred")


def one_vs_rest(rows: DataFrame, classes: list[str], k: int = K, **options) -> DataFrame:
    """id, fold, label, pred by a logistic model per class, all trained beside each other; the highest score counts, of equal ones the first class."""
    bag, roles = _both(F.col("text")), linear.fold_roles(F.col("fold"), k)
    one = F.explode(F.array(*[F.lit(c) for c in classes])).alias("setting")
    examples = rows.select("id", "label", "text", roles.alias("roles"), one)
    scores = linear.train(examples, {c: linear.Spec(names=("", c), **options) for c in classes}, k, bag=bag)
    best = F.min(F.struct(-F.col("score"), F.col("setting").alias("pred"))).alias("b")
    return scores.groupBy("id", F.col("model").alias("fold"), "label").agg(best).select("id", "fold", "label", "b.pred")


#: Models by name: from rows (id, text, label, fold), the sorted classes and the number of folds to id, fold, label, pred.
MODELS: dict[str, Callable[..., DataFrame]] = {
    "majority": lambda rows, classes, k=K: models.majority_cv(rows).select("id", "fold", "label", "pred"),
    "lexicon": lexicon(),
    "lexicon_context": lexicon("CONTEXT", min_precision=0.8),
    "logreg_ovr": one_vs_rest,
    **{name: _nb(name) for name in NB},
    **{name: _linear(name) for name in LINEAR},
}


def sorted_classes(rows: DataFrame, label: str = "label", most: int = 1000) -> list[str]:
    """The labels in order; raises ValueError for more than most."""
    found = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} classes")
    return found


def of_factory(factory: Factory, most: int = 20_000) -> Callable[..., DataFrame]:
    """A model of the user's own as one of MODELS.

    Each fold's model is made in a task of its own, from the training rows among the `most` rows that come
    first in hash order; then every row is scored where it is. Folds whose training rows lack a class are
    left out.
    """

    def model(rows: DataFrame, classes: list[str], k: int = K) -> DataFrame:
        sample = rows.select("id", "text", "label", "fold").orderBy(folds.hashed("sample", "id"), "id").limit(most)
        ks = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("of")
        every = sample.select("id", "text", "label", "fold", ks).where("fold <> of")

        def fit(table: pa.Table) -> pa.Table:
            pdf = table.to_pandas().sort_values("id", ignore_index=True)
            made = [] if set(classes) - set(pdf.label) else [cloudpickle.dumps(factory(pdf.text.tolist(), pdf.label.tolist()))]
            return pa.table({"of": pa.array(pdf.of.tolist()[:1] * len(made), pa.int32()), "made": pa.array(made, pa.binary())})

        known = {r.of: bytes(r.made) for r in every.groupBy("of").applyInArrow(fit, "of int, made binary").collect()}

        def run(batches):
            ready = {of: pickle.loads(made) for of, made in known.items()}
            for b in batches:
                b = b[b.fold.isin(list(ready))].reset_index(drop=True)
                yield pd.DataFrame({"id": b.id, "fold": b.fold, "label": b.label, "pred": pd.Series([ready[f](t) for f, t in zip(b.fold, b.text)], dtype=object)})

        return rows.select("id", "text", "label", "fold").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, fold int, label string, pred string")

    return model


def _dealt(rows: DataFrame, split: str, k: int, seed: int, group: str) -> DataFrame:
    return folds.stratified(rows, k, seed) if split == "random" else folds.grouped(rows, k, seed, group)


def cross_validate(rows: DataFrame, model: str | Callable | None = None, representation: str = "raw", split: str = "random", k: int = K, seed: int = 12345, group: str = "template", classes: list[str] | None = None, factory: Factory | None = None) -> DataFrame:
    """id, fold, label, pred of a model over k folds, random within labels or of whole groups.

    model: a name of MODELS or a function like those; factory: a model of the user's own instead. Without
    classes, the labels found. Folds whose training part lacks a class are left out by all models but the
    majority and the lexicon.
    """
    fit = of_factory(factory) if factory else MODELS[model] if isinstance(model, str) else model
    shown = rows.withColumn("text", X.represent(F.col("text"), representation))
    return fit(_dealt(shown, split, k, seed, group), classes or sorted_classes(rows), k)


SUMMARY = ("accuracy", "macro_f1", "mcc")


def _summaries(scored: DataFrame, classes: list[str], by: tuple[str, ...], pairs: DataFrame | None) -> DataFrame:
    per = metrics.fold_summary(metrics.all_metrics(metrics.confusion(scored, classes, (*by, "fold")), (*by, "fold")), SUMMARY, by)
    pooled = metrics.all_metrics(metrics.confusion(scored, classes, by), by).select(*by, *[F.col(n).alias(f"pooled_{n}") for n in SUMMARY])
    out = models._of(per, pooled, by)
    if pairs is None:
        return out
    return models._of(out, metrics.pair_consistency(scored.join(pairs, "id"), by).select(*by, "n_pairs", "consistency"), by, "left")


def summary(scored: DataFrame, classes: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """One row: n_folds, the mean and deviation of accuracy, macro_f1 and mcc over folds, pooled ones, and the consistency of pairs (id, pair)."""
    return _summaries(scored, classes, (), pairs)


def grid_scores(rows: DataFrame, settings: list[tuple[str, str, str]], classes: list[str], k: int = K, seed: int = 12345, group: str = "template") -> DataFrame:
    """model, representation, split, id, fold, label, pred of every setting, from one scan of rows."""
    kinds, splits = sorted({r for _, r, _ in settings}), sorted({s for _, _, s in settings})
    # texts and groups are made once, and folds are dealt to rows without their texts
    base, drop = written_for_now(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", group, *[X.represent(F.col("text"), r).alias(f"text {r}") for r in kinds]))
    dealt = base.select("row", "id", "label", group)
    for s in splits:
        dealt = _dealt(dealt, s, k, seed, group).withColumnRenamed("fold", f"fold {s}")
    base = written(base.join(dealt.select("row", *[f"fold {s}" for s in splits]), "row").drop("row"))
    drop()
    of = lambda r, s: [F.col(f"text {r}").alias("text"), F.col(f"fold {s}").alias("fold")]
    found = []
    name = lambda split: F.concat("setting", F.lit("|"), F.element_at(F.array(*[F.lit(x) for x in splits]), split + 1))
    wanted = [f"{m}|{r}|{s}" for m, r, s in settings]

    def texts(of: list[tuple[str, str, str]], roles: Column) -> DataFrame:
        """Rows with the text of each model and representation, once for all splits."""
        each = F.array(*[F.struct(F.lit(f"{m}|{r}").alias("setting"), F.col(f"text {r}").alias("text")) for m, r in dict.fromkeys((m, r) for m, r, _ in of)])
        return base.select("id", "label", roles, F.explode(each).alias("e")).select("id", "label", *base.select(roles).columns, "e.*")

    counted = [x for x in settings if x[0] in NB]
    if counted:
        read, kinds = None, {}
        for m in sorted({m for m, _, _ in counted}):
            grams = NB[m][0](F.col("text"))
            read = (F if read is None else read).when(F.col("setting").startswith(f"{m}|"), grams.text)
            kinds |= {f"{m}|{r}": (grams.word, grams.char) for n, r, _ in counted if n == m}
        bag = Grams(read, of=tuple(kinds.items()))
        alpha = {f"{m}|{r}": NB[m][1] for m, r, _ in counted}
        scores = models.nb_cv(texts(counted, F.array(*[F.col(f"fold {s}") for s in splits]).alias("folds")), bag, classes, alpha=alpha, by=("setting",))
        found.append(models.best_class(scores.withColumn("setting", name(F.col("split"))), ("setting", "id", "fold", "label")))
    trained = [x for x in settings if x[0] in LINEAR]
    if trained:
        roles = F.concat(*[linear.fold_roles(F.col(f"fold {s}"), k) for s in splits]).alias("roles")
        specs = {f"{m}|{r}": linear.Spec(names=(classes[0], classes[1]), **LINEAR[m]) for m, r, _ in trained}
        scores = linear.train(texts(trained, roles), specs, k * len(splits), bag=_both(F.col("text")))
        found.append(scores.select(name((F.col("model") / k).cast("int")).alias("setting"), "id", (F.col("model") % k).alias("fold"), "label", "pred"))
    for m, r, s in settings:
        if m not in NB and m not in LINEAR:
            found.append(MODELS[m](base.select("id", "label", *of(r, s)), classes, k).select(F.lit(f"{m}|{r}|{s}").alias("setting"), "id", "fold", "label", "pred"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    part = lambda n: F.split_part("setting", F.lit("|"), F.lit(n))
    return out.where(F.col("setting").isin(wanted)).select(part(1).alias("model"), part(2).alias("representation"), part(3).alias("split"), "id", "fold", "label", "pred")


def grid(rows: DataFrame, settings: list[tuple[str, str, str]], classes: list[str], pairs: DataFrame | None = None, **options) -> DataFrame:
    """model, representation, split and the summary of each setting; settings without any scored fold have no row."""
    return _summaries(written(grid_scores(rows, settings, classes, **options)), classes, ("model", "representation", "split"), pairs)


FRACTIONS = (0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0)


#: Characters of texts, once for each repeat, that are trained at a time: a task has all of the turn's roles, some 7 bytes for each text and repeat.
CURVE_CHARS = 25_000_000_000


def _curve_linear(rows: DataFrame, spec: linear.Spec, places: DataFrame, fractions: tuple[float, ...], group: str) -> DataFrame:
    """rep, at, label, pred: the parts of all repeats of a turn are models of one setting, so its rows are packed once for all.

    Repeats are trained in turns, as many at a time as CURVE_CHARS holds and one at least; a turn's features go
    before the next one's.
    """
    trains = [F.col("r") - F.col("n_test") < folds.curve_size(F.lit(f)) for f in fractions]
    roles = F.array(*[F.when(F.col("r") < F.col("n_test"), linear.TEST).when(t, linear.TRAIN).otherwise(linear.NONE) for t in trains])
    reps = sorted(r.rep for r in places.select("rep").distinct().collect())
    rows, drop = written_for_now(rows.select("id", "label", group, "text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    at_once, out, n = max(1, CURVE_CHARS // max(1, size)), None, len(fractions)
    for a in range(0, len(reps), at_once):
        turn = reps[a : a + at_once]
        # a group's roles in every repeat of the turn
        dealt = places.where(F.col("rep").isin(turn)).groupBy(group).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rep", roles.alias("roles")))), lambda x: x["roles"])).alias("roles"))
        examples = rows.join(dealt, group).select(F.lit("curve").alias("setting"), "id", "label", "text", "roles")
        rep = F.element_at(F.array(*[F.lit(r) for r in turn]), (F.col("model") / n).cast("int") + 1)
        one = linear.train(examples, {"curve": spec}, n * len(turn), bag=_both(F.col("text")), families=len(turn)).select(rep.cast("int").alias("rep"), (F.col("model") % n).alias("at"), "label", "pred")
        out = one if out is None else out.unionByName(one)
    drop()
    return out if out is not None else rows.sparkSession.createDataFrame([], "rep int, at int, label string, pred string")


def _curve_nb(rows: DataFrame, bag: Grams, alpha: float, classes: list[str], places: DataFrame, fractions: tuple[float, ...], group: str) -> DataFrame:
    """rep, at, label, pred by Naive Bayes: counts are made once per feature and group; a part's counts are sums over a beginning of the repeat's list."""
    fs, k = range(len(fractions)), range(len(classes))
    within = [(F.col("r") >= F.col("n_test")) & (F.col("r") - F.col("n_test") < folds.curve_size(F.lit(f))) for f in fractions]
    if_ = lambda i, c: F.coalesce(F.sum(F.when(within[i], F.col(f"k{c}"))), F.lit(0)).alias(f"s{i}_{c}")
    x = models.exploded(rows, X.features(bag.text, bag.word, bag.char), "label", group)
    at = lambda n: [F.sum(F.when(F.col("label") == c, F.col(n)).otherwise(0)).alias(f"k{j}") for j, c in enumerate(classes)]
    counts = x.groupBy("feat", group).agg(*at("tf")).join(places, group).groupBy("rep", "feat").agg(*[if_(i, c) for i in fs for c in k])
    known = [F.count_if(sum(F.col(f"s{i}_{c}") for c in k) > 0).alias(f"v{i}") for i in fs]
    whole = counts.groupBy("rep").agg(*known, *[F.sum(f"s{i}_{c}").alias(f"t{i}_{c}") for i in fs for c in k])
    docs = rows.withColumn("one", F.lit(1)).groupBy(group).agg(*at("one")).join(places, group).groupBy("rep").agg(*[if_(i, c).alias(f"n{i}_{c}") for i in fs for c in k])
    test = places.where("r < n_test").select("rep", group)
    ln = lambda i, c: F.sum(F.col("tf") * F.ln(F.coalesce(f"s{i}_{c}", F.lit(0)) + F.lit(alpha))).alias(f"p{i}_{c}")
    sums = x.select("id", "feat", "tf", group).join(test, group).join(counts, ["rep", "feat"], "left").groupBy("rep", "id").agg(F.sum("tf").alias("m"), *[ln(i, c) for i in fs for c in k])
    every = rows.select("id", "label", group).join(test, group).join(F.broadcast(docs), "rep").join(F.broadcast(whole), "rep", "left").join(sums, ["rep", "id"], "left")
    n = lambda i: sum(F.col(f"n{i}_{c}") for c in k)
    total = lambda i, c: F.ln(F.coalesce(f"t{i}_{c}", F.lit(0)) + alpha * F.coalesce(f"v{i}", F.lit(0)))
    score = lambda i, c: F.ln(F.col(f"n{i}_{c}") / n(i)) + F.coalesce(f"p{i}_{c}", F.lit(0.0)) - F.coalesce("m", F.lit(0)) * total(i, c)
    best = lambda i: F.array_min(F.array(*[F.struct((-F.round(score(i, c), 9)).alias("s"), F.lit(name).alias("pred")) for c, name in enumerate(classes)]))["pred"]
    all_ = lambda i: F.least(*[F.col(f"n{i}_{c}") for c in k]) > 0
    made = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), F.when(all_(i), best(i)).alias("pred")) for i in fs]), lambda e: e["pred"].isNotNull())
    return every.select("rep", "label", F.explode(made).alias("e")).select("rep", "e.at", "label", "e.pred")


def learning_curve(rows: DataFrame, model: str, metric: str | Callable[[DataFrame, tuple[str, ...]], DataFrame], classes: list[str], representation: str = "raw", repeats: int = 25, fractions: tuple[float, ...] = FRACTIONS, group: str = "template") -> DataFrame:
    """frac, n_templates, n_repeats, mean, sd of a metric over repeats; a repeat whose training part lacks a class has none and is not counted.

    Each repeat holds 30 % of the groups out and trains on growing beginnings of the others. metric: a
    column of all_metrics, or a function from a confusion matrix and its keys to the keys and `value`.
    """
    shown = rows.select("id", "label", group, X.represent(F.col("text"), representation).alias("text"))
    places = folds.curve_places(rows.select(group), repeats, group)
    if model in NB:
        bag, alpha = NB[model]
        scored = _curve_nb(shown, bag(F.col("text")), alpha, classes, places, fractions, group)
    else:
        scored = _curve_linear(shown, linear.Spec(names=(classes[0], classes[1]), **LINEAR[model]), written(places), fractions, group)
    by = ("rep", "at")
    matrix = metrics.confusion(scored, classes, by)
    of = metric(matrix, by) if callable(metric) else metrics.all_metrics(matrix, by).withColumn("value", F.col(metric))
    fracs = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(fractions)), "at int, frac double"))
    size = places.select("t", "n_test").limit(1).crossJoin(fracs).select("at", "frac", F.least(folds.curve_size(F.col("frac")), F.col("t") - F.col("n_test")).alias("n_templates"))
    told = of.groupBy("at").agg(F.count("value").alias("n_repeats"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return F.broadcast(size).join(told, "at", "left").select("frac", "n_templates", F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"), "mean", "sd")
