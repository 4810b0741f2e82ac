"""Counts of shared shingles meet by set before they become rows."""

from pyspark.sql import functions as F

from verbatix.llm import ngram_join
from verbatix.operators import grams, linear


def test_a_set_is_told_once(spark, monkeypatch):
    """One row for each set that may have a partner, however many buckets its shingles fall in; sets with too few shared shingles have none."""
    monkeypatch.setattr(ngram_join, "BLOCK", 60)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
        texts = [words(k) + (" end" if copy else "") for k in range(12) for copy in (0, 1)] + [words(f"alone{k}") for k in range(10)] + [words(f"few{k}") + " " + "a b c d e" for k in range(5)] + ["", None]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
        rows = ngram_join.counted(docs)
        told = rows.where("n is null")
        assert told.count() == told.select("cls").distinct().count()
        paired = {r.cls for r in rows.where("doc_id < 24").collect()}
        assert {r.cls for r in told.collect()} >= paired and rows.where("n is not null").count() == len(texts)
        alone = {r.cls for r in rows.where("doc_id >= 24 and doc_id < 34 and n > 0").collect()}
        assert not alone & {r.cls for r in told.collect()}
        found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
        assert all(found[k] == k - k % 2 for k in range(24)) and all(found[k] == k for k in range(24, len(texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shards_are_alone_and_steps_are_those_of_a_plain_loop(spark):
    """Names of several rows count once; every hash partition of a setting with several shards holds one of them."""
    rows = spark.createDataFrame([(k, f"good fine x{k % 9} common" if k % 2 else f"bad poor y{k % 9} common", "POS" if k % 2 else "NEG") for k in range(90)], "id long, text string, label string")
    bag = grams.Grams(F.col("text"), word=(1, 2))
    examples = rows.select("*", F.lit("s").alias("setting"), F.array(F.lit(linear.TRAIN)).alias("roles"))
    for cells in (linear.CELLS, 800):
        weights = linear.train(examples, {"s": linear.Spec(names=("NEG", "POS"), epochs=20)}, 1, weights=True, cells=cells, bag=bag)
        top = linear.top(weights, grams.names(rows.repartition(5), bag), 3).collect()
        assert len({r.feat for r in top}) == 6 and all((r.weight > 0) == (r.side == "top") for r in top)
        assert {r.feat for r in top} & {"w1:good", "w1:fine", "w2:good_fine"} and {r.feat for r in top} & {"w1:bad", "w1:poor", "w2:bad_poor"}
