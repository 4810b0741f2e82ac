"""Scoring predictions made elsewhere: checks, joins, scores, and the store of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import metrics as M


def last_by_id(preds: DataFrame) -> DataFrame:
    """id, pred (MGY or NOT): of predictions with one id the last."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("pos").desc()))
    return preds.withColumn("_r", last).where("_r = 1").select("id", X.coerce_prediction(F.col("pred")).alias("pred"))


def missing(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """The gold ids without a prediction."""
    return gold.select("id").join(preds.select("id").distinct(), "id", "left_anti")


def scored(gold: DataFrame, preds: DataFrame, strict: bool = False) -> DataFrame:
    """gold with pred; ids that gold lacks are ignored. strict: raises ValueError if a gold id has no prediction."""
    if strict and (some := missing(gold, preds).limit(3).collect()):
        raise ValueError(f"no prediction for {', '.join(str(r.id) for r in some)}, ...")
    return gold.join(last_by_id(preds), "id")


def score(rows: DataFrame, classes: list[str]) -> DataFrame:
    """accuracy, macro_f1, mcc, consistency, n_pairs of scored rows with label, pred, pair."""
    pairs = M.pair_consistency(rows)
    return M.all_metrics(M.confusion(rows, classes)).select("accuracy", "macro_f1", "mcc").crossJoin(pairs.select("consistency", "n_pairs"))


def score_each(rows: DataFrame, classes: list[str], by: tuple[str, ...] = ("model", "prompt"), category: str = "category") -> DataFrame:
    """by, accuracy, macro_f1, mcc, consistency, n_pairs, per_category (map) of scored rows, one row for each value of by."""
    all_ = M.all_metrics(M.confusion(rows, classes, by), by).select(*by, "accuracy", "macro_f1", "mcc")
    per = rows.groupBy(*by, category).agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("a"))
    per = per.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "a")))).alias("per_category"))
    out = all_.join(M.pair_consistency(rows, by), list(by), "left").join(per, list(by))
    return out.withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0))).select(*by, "accuracy", "macro_f1", "mcc", "consistency", "n_pairs", "per_category")


def upsert(store: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("model", "prompt")) -> DataFrame:
    """The store with new's rows in the place of those with their keys."""
    return store.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def static_join(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows with the fixed answer of their frame; raises in execution for a frame without one."""
    joined = rows.join(F.broadcast(answers), "frame_id", "left")
    return joined.withColumn("pred", F.coalesce("pred", F.raise_error(F.concat(F.lit("no answer for "), "frame_id"))))
