"""Classification metrics as aggregates: counts are made once, everything else works on the few counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def confusion(scored: DataFrame, classes: list[str], by: tuple[str, ...] = (), truth: str = "label", pred: str = "pred") -> DataFrame:
    """by, t, p, n for all pairs of classes, zeros included; raises in execution if a class is not listed.

    Cells that occur come from one aggregate by their key; those that don't are added where by occurs.
    """
    known = F.col(truth).isin(classes) & F.col(pred).isin(classes)
    said = F.concat(F.lit("unknown class: "), F.coalesce(truth, F.lit("null")), F.lit(", "), F.coalesce(pred, F.lit("null")))
    rows = scored.withColumn("_ok", F.when(known, True).otherwise(F.raise_error(said).cast("boolean"))).where("_ok")
    counts = rows.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct("t", "p"), "n")))
    held = counts.groupBy(*by).agg(cells.alias("_cells"))
    names = F.array(*[F.lit(c) for c in classes])
    every = held.select(*by, "_cells", F.explode(names).alias("t")).select(*by, "_cells", "t", F.explode(names).alias("p"))
    return every.select(*by, "t", "p", F.coalesce(F.element_at("_cells", F.struct("t", "p")), F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, class, precision, recall, f1, support; 0 where a denominator is 0."""
    return _classes(matrix, by).select(*by, "class", "precision", "recall", "f1", "support")


def _classes(matrix: DataFrame, by: tuple[str, ...]) -> DataFrame:
    both = matrix.select(*by, F.explode(F.array_distinct(F.array("t", "p"))).alias("class"), "t", "p", "n")
    at = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    true, named = F.col("t") == F.col("class"), F.col("p") == F.col("class")
    sums = both.groupBy(*by, "class").agg(at(true & named).alias("tp"), at(true).alias("support"), at(named).alias("named"))
    rows = sums.withColumns({"precision": _ratio(F.col("tp"), F.col("named")), "recall": _ratio(F.col("tp"), F.col("support"))})
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def all_metrics(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, accuracy, the means of precision, recall and F1 over all listed classes, and mcc (0 where its denominator is 0)."""
    x = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    sums = _classes(matrix, by).groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("hit"), F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), F.avg("f1").alias("macro_f1"),
        x("support", "named").alias("tp"), x("support", "support").alias("tt"), x("named", "named").alias("pp"),
    )
    s = F.col("n").cast("double")
    mcc_ = _ratio(F.col("hit") * s - F.col("tp"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt"))))
    return sums.select(*by, "n", _ratio(F.col("hit"), F.col("n")).alias("accuracy"), "macro_p", "macro_r", "macro_f1", mcc_.alias("mcc"))


def macro_metrics(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """all_metrics without mcc."""
    return all_metrics(matrix, by).drop("mcc")


def mcc(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, mcc for any number of classes."""
    return all_metrics(matrix, by).select(*by, "mcc")


def fold_summary(per_fold: DataFrame, names: tuple[str, ...] = ("accuracy", "macro_f1", "mcc"), by: tuple[str, ...] = ()) -> DataFrame:
    """by, mean and population deviation of each metric over folds, and how many folds there are."""
    both = [x for m in names for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return per_fold.groupBy(*by).agg(F.count("*").alias("n_folds"), *both)


def pair_consistency(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n_pairs, consistency: the share of pairs with exactly two scored rows that has both right; null without pairs."""
    pairs = scored.where("pair is not null and pair <> ''").groupBy(*by, "pair").agg(F.count("*").alias("k"), F.min((F.col("label") == F.col("pred")).cast("int")).alias("both")).where("k = 2")
    return pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("both").alias("consistency"))


def accuracy_by(scored: DataFrame, column: str) -> DataFrame:
    """column, n, n_correct, accuracy."""
    hit = F.sum((F.col("label") == F.col("pred")).cast("int"))
    return scored.groupBy(column).agg(F.count("*").alias("n"), hit.alias("n_correct"), (hit / F.count("*")).alias("accuracy"))


#: Categories in their order, with the label that each implies (fixed values).
CATEGORIES = {"USE_SLUR": "MGY", "IMPLICIT": "MGY", "COUNTER": "NOT", "BENIGN_OVERLAP": "NOT", "BENIGN_NEUTRAL": "NOT"}


def by_category(scored: DataFrame) -> DataFrame:
    """place, category, gold, n, n_correct, accuracy: predictions against the label that the category implies."""
    known = scored.sparkSession.createDataFrame([(k, c, g) for k, (c, g) in enumerate(CATEGORIES.items())], "place int, category string, gold string")
    rows = scored.join(F.broadcast(known), "category")
    hit = F.sum((F.col("gold") == F.col("pred")).cast("int"))
    return rows.groupBy("place", "category", "gold").agg(F.count("*").alias("n"), hit.alias("n_correct"), (hit / F.count("*")).alias("accuracy")).orderBy("place")


def error_rows(scored: DataFrame) -> DataFrame:
    """The rows with a wrong prediction."""
    return scored.where(F.col("label") != F.col("pred"))


def error_direction(scored: DataFrame) -> DataFrame:
    """direction (truth->prediction), n of the errors."""
    return error_rows(scored).groupBy(F.concat_ws("->", "label", "pred").alias("direction")).agg(F.count("*").alias("n"))
