"""Facts that hold for the operators: hand values, published matrices, properties of folds and of the generated corpus."""

import math

import pytest
from pyspark.sql import functions as F

from verbatix.functions import text as X
from verbatix.operators import folds, generate, metrics, linear, models, profile, prompts, scoring
from verbatix.plans import report
from verbatix.sources import corpus as C


def matrix(spark, cells):
    return spark.createDataFrame([(t, p, n) for (t, p), n in cells.items()], "t string, p string, n long")


def test_metrics_by_hand(spark):
    m = matrix(spark, {("POS", "POS"): 40, ("POS", "NEG"): 10, ("NEG", "POS"): 5, ("NEG", "NEG"): 45})
    r = metrics.all_metrics(m).first()
    c = {x["class"]: x for x in metrics.class_metrics(m).collect()}
    assert r.accuracy == pytest.approx(0.85) and c["POS"].precision == pytest.approx(40 / 45) and c["POS"].recall == pytest.approx(40 / 50)
    assert c["POS"].f1 == pytest.approx(2 * (40 / 45) * 0.8 / (40 / 45 + 0.8))
    assert r.mcc == pytest.approx((40 * 45 - 5 * 10) / math.sqrt(45 * 50 * 50 * 55))


@pytest.mark.parametrize(
    "classes, rows, accuracy",
    [(["CONTEXT", "STRONG"], [[31, 8], [14, 72]], 103 / 125), (["CONTEXT", "NOT", "STRONG"], [[34, 0, 5], [93, 282, 0], [41, 0, 45]], 361 / 500), (["MGY", "NOT"], [[58, 14], [0, 72]], 130 / 144)],
)
def test_published_matrices(spark, classes, rows, accuracy):
    m = matrix(spark, {(t, p): rows[i][j] for i, t in enumerate(classes) for j, p in enumerate(classes)})
    r = metrics.all_metrics(m).first()
    s = sum(map(sum, rows))
    t, p, c = [sum(x) for x in rows], [sum(x) for x in zip(*rows)], sum(rows[i][i] for i in range(len(rows)))
    want = (c * s - sum(a * b for a, b in zip(t, p))) / math.sqrt((s * s - sum(b * b for b in p)) * (s * s - sum(a * a for a in t)))
    assert r.accuracy == pytest.approx(accuracy) and r.mcc == pytest.approx(want)


def test_metrics_without_rows_of_a_class(spark):
    m = metrics.confusion(spark.createDataFrame([("A", "A")], "label string, pred string"), ["A", "B"])
    r = metrics.all_metrics(m).first()
    assert r.mcc == 0 and r.accuracy == 1 and r.macro_f1 == pytest.approx(0.5)


def test_unknown_class_ends_the_query(spark):
    with pytest.raises(Exception, match="unknown class"):
        metrics.confusion(spark.createDataFrame([("A", "C")], "label string, pred string"), ["A", "B"]).collect()


def test_folds(spark):
    rows = spark.createDataFrame([(i, "A" if i < 30 else "B", f"g{i % 10}") for i in range(100)], "id long, label string, source string")
    s = folds.stratified(rows, 5, 42).toPandas()
    assert len(s) == 100 and s.id.is_unique and (s[s.label == "A"].groupby("fold").size() == 6).all()
    g = folds.grouped(rows, 5, 7).toPandas()
    assert (g.groupby("source").fold.nunique() == 1).all() and (g.groupby("fold").source.nunique() == 2).all()
    assert sorted(folds.shuffled(rows.select("id"), 3).toPandas().pos) == list(range(100))
    assert folds.shuffled(rows.select("id").limit(0), 3).count() == 0


def toy(spark):
    return spark.createDataFrame([(i, i % 5, "POS" if i < 40 else "NEG", "good happy great nice" if i < 40 else "bad awful terrible sad") for i in range(80)], "id long, fold int, label string, text string")


def test_models_learn_a_separable_corpus(spark):
    rows, bag = toy(spark), X.word_ngrams(F.col("text"), 1, 1)
    for pred in (models.best_class(models.nb_cv(rows, bag, ["NEG", "POS"])), *[linear.cross_validated(rows, bag, linear.Spec(m, ("NEG", "POS"), epochs=20)) for m in linear.FITS], models.lexicon_cv(rows, "POS", "NEG")):
        assert pred.where("label = pred").count() == 80


def test_rows_without_features_are_scored(spark):
    rows = toy(spark).unionByName(spark.createDataFrame([(99, 0, "POS", "")], "id long, fold int, label string, text string"))
    s = models.nb_cv(rows, X.word_ngrams(F.col("text"), 1, 1), ["NEG", "POS"]).where("id = 99").collect()
    assert len(s) == 2 and all(x.score == pytest.approx(math.log(0.5), abs=0.02) for x in s)


@pytest.mark.parametrize(
    "raw, label",
    [("LABEL: MGY", "MGY"), ("label: not", "NOT"), ("LABEL: MGY ... LABEL: NOT", "MGY"), ("I would say MGY", "MGY"), ("MGY or NOT", "NOT"), ("MGY because the claim targets her", "MGY"), ("", "NOT"), (None, "NOT")],
)
def test_parse_label(spark, raw, label):
    assert spark.createDataFrame([(raw,)], "raw string").select(X.parse_label(F.col("raw"))).first()[0] == label


def test_text(spark):
    t = "Us [FSLUR_03]  ladki, ladkiyon (ok) [CTX_01]!"
    one = lambda c: spark.createDataFrame([(t,)], "text string").select(c.alias("x")).first().x
    assert one(X.represent(F.col("text"), "masked")) == "Us <RDW>  ladki, ladkiyon (ok) <RDW>!"
    assert one(X.represent(F.col("text"), "stripped")) == "Us  ladki, ladkiyon (ok)  !"
    assert one(X.normalize(F.col("text"))) == "us fslur_03 ladki ladkiyon ok ctx_01"
    assert one(X.template_id(F.col("text"))) == "us <tok> <SUBJ> <SUBJ> (ok) <tok>"
    assert one(X.word_ngrams(F.lit("a b c"), 1, 2)) == ["w1:a", "w1:b", "w1:c", "w2:a_b", "w2:b_c"]
    assert one(X.char_ngrams(F.lit("ab"), 2, 3)) == ["c2:_a", "c2:ab", "c2:b_", "c3:_ab", "c3:ab_"]
    assert one(X.word_ngrams(F.lit(""), 1, 2)) == []
    with pytest.raises(ValueError):
        X.represent(F.col("text"), "other")


def test_generated_corpus(spark):
    rows = generate.gen_rows(spark).toPandas()
    assert len(rows) == 416 and (rows.label == "MGY").sum() == 163 and rows.frame_id.nunique() == 40 and rows.id.is_unique
    pairs = rows[rows.pair_id != ""].groupby("pair_id")
    assert len(pairs) == 163 and (pairs.label.nunique() == 2).all() and (pairs.subject.nunique() == 1).all() and (pairs.size() == 2).all()
    assert rows[rows.token != ""].label.value_counts().to_dict() == {"MGY": 72, "NOT": 72}
    assert not rows.text.str.contains(r"[{}]").any()
    perfect = C.diagnostic(generate.gen_rows(spark)).withColumn("pred", F.col("label"))
    assert metrics.pair_consistency(perfect).first().asDict() == {"n_pairs": 163, "consistency": 1.0}


def test_profile_of_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, "x", "MGY", "A"), (2, "x", "NOT", "B"), (3, None, "NOT", "B"), (4, "", "NOT", "A")], "id long, text string, label string, bucket string")
    assert profile.duplicate_profile(rows).first().asDict() == {"n_texts": 4, "n_distinct": 3, "n_repeated": 1, "n_rows_repeated": 2}
    assert profile.bucket_samples(rows, 1).count() == 2
    assert profile.token_frequency(rows).count() == 0


def test_scoring(spark, tmp_path):
    gold = spark.createDataFrame([("a", "MGY", "p"), ("b", "NOT", "p"), ("c", "NOT", None)], "id string, label string, pair string")
    (tmp_path / "p.json").write_text('{"model": "m", "prompt": "q", "predictions": [{"id": "a", "pred": "NOT"}, {"id": "a", "pred": "mgy!"}, {"id": "z", "pred": "MGY"}, {"id": "b", "pred": null}]}')
    preds = C.scan_predictions(spark, str(tmp_path / "p.json"))
    assert {r.id: r.pred for r in scoring.scored(gold, preds).collect()} == {"a": "MGY", "b": "NOT"}
    assert [r.id for r in scoring.missing(gold, preds).collect()] == ["c"]
    with pytest.raises(ValueError, match="no prediction"):
        scoring.scored(gold, preds, strict=True)
    assert scoring.score(scoring.scored(gold, preds), ["MGY", "NOT"]).first().consistency == 1.0
    (tmp_path / "bad.json").write_text('{"model": "m"}')
    with pytest.raises(ValueError):
        C.scan_predictions(spark, str(tmp_path / "bad.json"))


def test_prompts_and_client(spark):
    rendered = prompts.render_prompts(spark.createDataFrame([(1, "hello")], "id long, text string"), prompts.prompts(spark))
    raw = prompts.call_model(rendered, lambda system, user: "LABEL: MGY" if "hello" in user else "")
    assert raw.count() == 8 and raw.where("raw = 'LABEL: MGY'").count() == 8


def test_report(spark):
    rows = report.rows_of(spark.createDataFrame([("A", "A", 3), ("A", "B", 1)], "t string, p string, n long"))
    assert "| A | 3 | 1 |" in report.confusion_markdown(rows, ["A", "B"]) and report.heatmap(rows, ["A", "B"]).startswith("<svg")
    assert report.spread(None, None) == "—" and report.spread(0.5, 0.1) == "0.500±0.100"
    assert "polyline" in report.line_chart([{"x": 0.1, "m": 0.5, "s": 0.1}], "x", "m", "s") and "rect" in report.bar_chart([{"a": "x", "v": 0.5}], "a", "v")
    with pytest.raises(ValueError):
        report.rows_of(spark.range(5), 3)


def test_stream_upsert(spark, tmp_path):
    from verbatix.streaming import upsert_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("m", "p", 1.0)], "model string, prompt string, value double").write.parquet(src)
    stream = lambda: spark.readStream.schema("model string, prompt string, value double").parquet(src)
    upsert_stream(stream(), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([("m", "p", 2.0), ("m", "q", 3.0)], "model string, prompt string, value double").write.mode("append").parquet(src)
    upsert_stream(stream(), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    from verbatix.sources.store import Store

    assert sorted((r.prompt, r.value) for r in Store(spark, str(tmp_path / "store"), ("model", "prompt")).read().collect()) == [("p", 2.0), ("q", 3.0)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
