"""Cross-validation against plain versions on the generated corpus, and what stands around it."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatix.functions import text as X
from verbatix.operators import crossval, folds, generate, metrics, profile, prompts, scoring
from verbatix.plans import queries, report
from verbatix.sources import corpus as C


@pytest.fixture(scope="module")
def rows(spark):
    return C.diagnostic(generate.gen_rows(spark)).cache()


def plain_nb(train, test, alpha):
    count, docs = {}, Counter(y for _, y in train)
    for bag, y in train:
        count.setdefault(y, Counter()).update(bag)
    v = len({f for c in count.values() for f in c})
    total = {y: sum(c.values()) for y, c in count.items()}
    score = lambda bag, y: math.log(docs[y] / len(train)) + sum(math.log((count[y][f] + alpha) / (total[y] + alpha * v)) for f in bag)
    return [max(sorted(count), key=lambda y: round(score(bag, y), 9)) for bag in test]


@pytest.mark.parametrize("model,alpha", [("nb", 1.0), ("cues", 0.5)])
def test_naive_bayes(rows, model, alpha):
    bag = X.features(X.represent(F.col("text"), "masked"), word=(1, 2)) if model == "nb" else X.features(X.cue_text(X.represent(F.col("text"), "masked")), word=(1, 1))
    dealt = folds.grouped(rows, 5, 12345, "template").select("id", "label", "fold", bag.alias("bag")).collect()
    want = {}
    for k in range(5):
        test = [r for r in dealt if r.fold == k]
        want |= dict(zip([r.id for r in test], plain_nb([(r.bag, r.label) for r in dealt if r.fold != k], [r.bag for r in test], alpha)))
    got = {r.id: r.pred for r in crossval.cross_validate(rows, model, "masked", "group").collect()}
    assert got == want


def test_linear_models_and_factory(spark, rows):
    use = rows.where(F.col("category").isin("USE_SLUR", "COUNTER"))
    found = crossval.summary(crossval.cross_validate(use, "svm_wide", "masked", "group", classes=queries.BINARY), queries.BINARY, use.select("id", "pair")).first()
    # published: 0.928 and 0.819 with other folds and other draws
    assert found.accuracy_mean > 0.75 and found.n_pairs <= 72 and found.consistency > 0.5

    def longest(texts, labels):
        common = Counter(labels).most_common(1)[0][0]
        return lambda text: "MGY" if "bol diya" in text else common

    own = crossval.cross_validate(rows, factory=longest, split="random").collect()
    assert len(own) == 416 and {r.pred for r in own} == {"MGY", "NOT"}
    assert crossval.sorted_classes(rows) == ["MGY", "NOT"]


def test_curve(rows):
    use = rows.where(F.col("category").isin("USE_SLUR", "COUNTER"))
    got = crossval.learning_curve(use, "cues", "mcc", queries.BINARY, "masked", repeats=4, fractions=(0.3, 1.0)).orderBy("frac").collect()
    assert [r.frac for r in got] == [0.3, 1.0] and all(r.n_repeats <= 4 and -1 <= r["mean"] <= 1 for r in got) and got[0].n_templates < got[1].n_templates


def test_categories(rows):
    scored = rows.withColumn("pred", F.when(F.col("category") == "COUNTER", "MGY").otherwise(F.col("label")))
    got = metrics.by_category(scored).collect()
    assert [r.category for r in got] == list(metrics.CATEGORIES) and [r.accuracy for r in got] == [1, 1, 0, 1, 1] and all(r.gold == metrics.CATEGORIES[r.category] for r in got)


def test_prompts_end_to_end(spark, rows):
    few = rows.where("id < 'D0040'")
    said = few.join(few.select("id"), "id").select("id", "label").collect()
    texts = {r.text: r.label for r in few.select("text", "label").collect()}

    def client(system, user):
        return next(f"so\nLABEL: {y}" for t, y in texts.items() if f'"{t}"' in user)

    scored = prompts.run_prompts(few, prompts.prompts(spark), client, "m")
    got = scoring.score_each(scored, queries.BINARY).collect()
    assert len(got) == 8 and all(r.accuracy == 1 and set(r.per_category) == {"USE_SLUR", "COUNTER"} for r in got) and len(said) == few.count()
    page = report.prompt_results([r.asDict() for r in got])
    assert page.startswith("## m") and "| cot | 1.000 |" in page

    def broken(system, user):
        raise OSError("no network")

    assert prompts.classify(few, broken).count() == 0
    with pytest.raises(Exception, match="no network"):
        prompts.call_model(prompts.render_prompts(few, prompts.single_prompt(spark)), broken).count()
    assert prompts.classify(few, lambda s, u: "mgy").where("pred = 'MGY'").count() == few.count()


def test_generated_file(spark, tmp_path):
    written = generate.write_corpus(spark, str(tmp_path / "c"))
    read = C.scan_csv(spark, str(tmp_path / "c"), written.drop("pos").schema)
    assert read.count() == 416 and written.orderBy("pos").first().id == read.first().id != "D0001"


def test_reports(tmp_path):
    report.write_json([{"a": 1.5}], str(tmp_path / "x.json"))
    assert json.load(open(tmp_path / "x.json")) == [{"a": 1.5}]
    assert report.shortened("Random Forest (all features)", 8) == "Random …" and report.shortened("nb (x)") == "nb"
    rows = [{"model": "nb", "accuracy_mean": 0.8, "consistency": 0.5}, {"model": "svm", "accuracy_mean": 0.9, "consistency": 0.7}]
    assert report.consistency_chart(rows).count("<rect") == 4
    assert report.gradient_chart(rows, [{"consistency": 0.9}, {"consistency": 0.6}]).count("<rect") == 3
    told = []
    log = report.Log(told.append)
    log.say("a")
    assert told == ["a"] and log.text() == "a\n"


def test_scripts(spark):
    rows = spark.createDataFrame([("MGY", "पानी"), ("MGY", "é"), ("NOT", "x")], "label string, text string")
    assert sorted(map(tuple, profile.script_share(rows).collect())) == [("MGY", 2, 1, 1), ("NOT", 1, 0, 0)]
