"""Folds and splits by hash order: reruns agree, and nothing is ordered in one task.

A rank over many rows is taken in two steps: within buckets of the hash, and over the buckets' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(seed: int | str, *columns: str) -> Column:
    """md5 of seed:a:b as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def ranked(rows: DataFrame, seed: int | str, by: tuple[str, ...] = (), key: str = "id", name: str = "pos") -> DataFrame:
    """rows with the rank (from 0) of each in hash order, within by; ties of the hash by key."""
    h = rows.withColumn("_h", hashed(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    counts = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by, F.lit(0)).orderBy("_b")
    before = counts.select(*by, "_b", (F.sum("_n").over(over) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)) - 1
    return h.withColumn("_i", inner).join(before, [*by, "_b"]).withColumn(name, (F.col("_i") + F.col("_before")).cast("bigint")).select(*rows.columns, name)


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """rows with their place in a seeded order."""
    return ranked(rows, seed)


def stratified(rows: DataFrame, k: int, seed: int, label: str = "label") -> DataFrame:
    """rows with a fold; each label's rows are dealt to the folds in turn, beginning with fold 0."""
    return ranked(rows, seed, (label,), name="_r").withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r")


def grouped(rows: DataFrame, k: int, seed: int, group: str = "source") -> DataFrame:
    """rows with a fold; the groups are dealt to the folds in turn, so none is in two."""
    groups = ranked(rows.select(group).distinct(), seed, key=group, name="_r")
    return rows.join(groups.select(group, (F.col("_r") % k).cast("int").alias("fold")), group)


def split_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """fold, split, label, n: rows of each fold's test and training part, from one count per fold and label."""
    own = rows.groupBy("fold", label).agg(F.count("*").alias("n"))
    folds, labels = own.select("fold").distinct(), own.groupBy(label).agg(F.sum("n").alias("total"))
    every = folds.crossJoin(labels).join(own, ["fold", label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    part = F.explode(F.array(F.struct(F.lit("test").alias("split"), F.col("n").alias("n")), F.struct(F.lit("train").alias("split"), (F.col("total") - F.col("n")).alias("n"))))
    return every.select("fold", label, part.alias("p")).select("fold", "p.split", label, "p.n")


def curve_places(rows: DataFrame, repeats: int, group: str = "source", held_out: float = 0.3) -> DataFrame:
    """rep, group, r, t, n_test: for each repeat a shuffled list of the groups; r is a group's place, the first n_test of t are held out."""
    groups = rows.select(group).distinct().crossJoin(F.broadcast(rows.sparkSession.range(repeats).select(F.col("id").cast("int").alias("rep"))))
    place = ranked(groups.withColumn("_k", F.concat_ws(":", F.col("rep").cast("string"), group)), 1000, ("rep",), key="_k", name="r").drop("_k")
    size = place.groupBy("rep").agg(F.count("*").alias("t")).withColumn("n_test", F.greatest(F.lit(1), F.round(F.col("t") * F.lit(held_out)).cast("bigint")))
    return place.join(F.broadcast(size), "rep")


def curve_size(frac: Column) -> Column:
    """How many groups a fraction of the training groups is: two at least."""
    return F.greatest(F.lit(2), F.round(frac * (F.col("t") - F.col("n_test"))).cast("bigint"))


def curve_groups(rows: DataFrame, repeats: int, fractions: list[float], group: str = "source", held_out: float = 0.3) -> DataFrame:
    """rep, frac, group, part: for each repeat a shuffled list of groups, its beginning held out, and of the rest growing beginnings to train on."""
    place = curve_places(rows, repeats, group, held_out)
    test = place.where("r < n_test").select("rep", F.lit(None).cast("double").alias("frac"), group, F.lit("test").alias("part"))
    fracs = rows.sparkSession.createDataFrame([(f,) for f in fractions], "frac double")
    train = place.where("r >= n_test").crossJoin(F.broadcast(fracs)).where(F.col("r") - F.col("n_test") < curve_size(F.col("frac"))).select("rep", "frac", group, F.lit("train").alias("part"))
    return test.unionByName(train)
