"""One query per operator over the tables of a data folder; plans/sql.py has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import crossval, folds, generate, grams, linear, metrics, models, profile, prompts, scoring
from ..operators.grams import Grams
from ..sources import corpus as C
from ..sources.store import scratch, written

SEED, K = C.SEED, 5
BINARY, THREE = ["MGY", "NOT"], ["CONTEXT", "NOT", "STRONG"]
CURVE_REPEATS, FRACTIONS = 25, [0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0]
#: Example weights of the linear scorer.
WEIGHTS = [("w1:idiot", 1.5), ("w1:moron", 1.25), ("w1:the", -0.01), ("w1:of", -0.02), ("w1:scum", 2.0), ("w1:de", -0.01)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
col, lit = F.col, F.lit


def query(f):
    QUERIES[f.__name__] = f
    return f


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, so that sums in another order agree."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def corpus(s, d):
    return C.corpus(s, d)


def redacted(s, d):
    return C.redacted(s, d)


def masked_bag(text: Column = None, word=(1, 2)) -> Column:
    return X.features(X.represent(col("text") if text is None else text, "masked"), word=word)


def masked_grams() -> Grams:
    """The same features, made where rows are packed."""
    return Grams(X.represent(col("text"), "masked"), word=(1, 2))


def rule(s, d) -> DataFrame:
    """The redacted corpus with the presence rule's prediction."""
    return redacted(s, d).withColumn("pred", F.when(col("text").rlike(X.TOKEN), "MGY").otherwise("NOT"))


def flipped(s, d) -> DataFrame:
    """The corpus with the synthetic predictions and pairs."""
    rows = corpus(s, d).select("id", "label", "bucket", "source")
    return rows.join(C.predictions(rows), "id").join(C.paired(rows).select("id", "pair"), "id", "left")


def by_source(s, d) -> DataFrame:
    return folds.grouped(redacted(s, d), K, SEED)


def nb_scores_(s, d) -> DataFrame:
    return models.nb_cv(by_source(s, d), masked_grams(), BINARY, alpha=1.0, min_df=2)


def nb_fold_metrics(s, d) -> DataFrame:
    return metrics.all_metrics(metrics.confusion(models.best_class(nb_scores_(s, d)), BINARY, ("fold",)), ("fold",))


def templated(rows: DataFrame) -> DataFrame:
    """rows with the text template as the group of disjoint folds."""
    return rows.withColumn("template", md5(X.template_id(col("text"))))


def diagnostic(s, d) -> DataFrame:
    """The labelled documents as a diagnostic corpus.

    MGY rows with a redaction token use it, those without are implicit; NOT rows with one counter it,
    those without overlap if they are paired and else are neutral. Frames are the sources.
    """
    rows = redacted(s, d).join(C.paired(corpus(s, d).select("id", "label", "source")).select("id", "pair"), "id", "left")
    token, paired = F.regexp_extract("text", X.TOKEN, 0), F.coalesce("pair", lit(""))
    positive = col("label") == "MGY"
    category = F.when(positive & (token != ""), "USE_SLUR").when(positive, "IMPLICIT").when(token != "", "COUNTER").when(paired != "", "BENIGN_OVERLAP").otherwise("BENIGN_NEUTRAL")
    subject = F.lower(F.regexp_extract("text", "(?i)" + X.whole_word(X.RULE_SUBJECTS), 0))
    return rows.select("id", "text", "label", category.alias("category"), F.concat(category, lit(":"), "source").alias("frame_id"), paired.alias("pair_id"), subject.alias("subject"), token.alias("token"))


def gen(s, d) -> DataFrame:
    """The diagnostic view with its folds over construction groups."""
    return folds.grouped(C.diagnostic(diagnostic(s, d)), K, SEED, "template")


# scans and profiles
@query
def scan_corpus(s, d):
    return corpus(s, d).select("id", "label", "bucket", "source", F.length("text").alias("n_chars"), md5(col("text")).alias("text_md5"))


@query
def label_distribution(s, d):
    return corpus(s, d).groupBy("label").agg(F.count("*").alias("n"))


@query
def label_bucket_crosstab(s, d):
    return corpus(s, d).groupBy("label", "bucket").agg(F.count("*").alias("n"))


@query
def token_frequency(s, d):
    return profile.token_frequency(redacted(s, d))


@query
def presence_by_bucket(s, d):
    return redacted(s, d).groupBy("bucket", col("text").rlike(X.TOKEN).alias("has_token")).agg(F.count("*").alias("n"))


@query
def presence_confusion(s, d):
    return profile.presence_confusion(redacted(s, d))


@query
def duplicate_profile(s, d):
    return profile.duplicate_profile(C.table(s, d, "documents").select("text"))


@query
def token_length_stats(s, d):
    return r6(profile.token_length_stats(C.table(s, d, "documents").select("text")), "avg_len")


@query
def token_families(s, d):
    return profile.token_families(redacted(s, d))


@query
def template_profile(s, d):
    return profile.template_profile(redacted(s, d))


@query
def distinct_text_by_bucket(s, d):
    return profile.distinct_text_by_bucket(corpus(s, d))


@query
def script_share(s, d):
    return profile.script_share(corpus(s, d))


@query
def bucket_samples(s, d):
    return profile.bucket_samples(corpus(s, d))


# filters and rules
@query
def filter_positive(s, d):
    return corpus(s, d).where("label = 'MGY'").groupBy("bucket").agg(F.count("*").alias("n"))


@query
def filter_contrast_subset(s, d):
    return corpus(s, d).where(col("bucket").isin("STRONG", "CONTEXT")).select("id", "bucket")


@query
def presence_rule(s, d):
    return rule(s, d).select("id", "label", "pred")


@query
def constant_rule_on_token_rows(s, d):
    rows = diagnostic(s, d).where("token <> ''").withColumn("pred", lit("MGY"))
    return rows.agg(F.count("*").alias("n"), F.avg((col("label") == col("pred")).cast("int")).alias("accuracy"))


@query
def subject_rule(s, d):
    rows = diagnostic(s, d).where(col("text").rlike("(?i)" + X.whole_word(X.RULE_SUBJECTS)))
    return rows.agg(F.count("*").alias("n"), F.avg((col("label") == "MGY").cast("int")).alias("accuracy"))


@query
def lexicon_rule(s, d):
    return models.lexicon_rule(redacted(s, d), ["spam", "free", "click"]).select("id", "label", "pred")


# text
def _represented(mode):
    def run(s, d):
        t = X.represent(col("text"), mode)
        return redacted(s, d).select("id", md5(t).alias("text_md5"), F.length(t).alias("n_chars"))

    run.__name__ = "repr_" + mode.replace("-", "_")
    return query(run)


for _m in X.REPRESENTATIONS:
    _represented(_m)


@query
def normalize_text(s, d):
    return redacted(s, d).select("id", md5(X.normalize(col("text"))).alias("text_md5"))


@query
def word_tokens(s, d):
    t = X.word_tokens(col("text"))
    return redacted(s, d).select("id", F.size(t).alias("n_tokens"), md5(F.array_join(t, " ")).alias("tokens_md5"))


@query
def word_ngrams(s, d):
    return models.document_frequency(redacted(s, d), X.word_ngrams(col("text"), 1, 3))


@query
def char_ngrams(s, d):
    return grams.frequency(redacted(s, d), Grams(col("text"), char=(2, 4)))


@query
def features_both(s, d):
    bag = X.features(col("text"), word=(1, 2), char=(3, 4))
    n = lambda p: F.size(F.filter(col("bag"), lambda x: x.startswith(p)))
    return redacted(s, d).select("id", bag.alias("bag")).select("id", n("w").alias("n_word"), n("c").alias("n_char"), F.size(F.array_distinct("bag")).alias("n_distinct"))


@query
def template_id(s, d):
    return redacted(s, d).select("id", md5(X.template_id(col("text"))).alias("template_md5"))


@query
def construction_group(s, d):
    return diagnostic(s, d).groupBy("category", X.construction_group(col("category"), col("frame_id")).alias("template")).agg(F.count("*").alias("n"))


@query
def cue_features(s, d):
    return diagnostic(s, d).select("id", X.cue_text(col("text")).alias("cues"))


def answers(s, d) -> DataFrame:
    """id, raw: model answers of several shapes, by hash."""
    forms = ["LABEL: MGY", "label: not", "first LABEL: MGY then LABEL: NOT", "I would say MGY", "MGY or NOT", "MGY because the claim targets her", "", "nothing to see: not MGY at all, I am sure of it"]
    k = F.instr(lit("0123456789abcdef"), F.substring(folds.hashed("raw", "id"), 1, 1)) - 1
    return corpus(s, d).select("id", F.element_at(F.array(*[lit(x) for x in forms]), k % len(forms) + 1).alias("raw"))


@query
def parse_label(s, d):
    return answers(s, d).select("id", X.parse_label(col("raw")).alias("pred"))


# folds
@query
def seeded_shuffle(s, d):
    return folds.shuffled(corpus(s, d).select("id"), SEED)


@query
def stratified_kfold(s, d):
    return folds.stratified(corpus(s, d).select("id", "label"), K, SEED)


@query
def group_kfold(s, d):
    return folds.grouped(corpus(s, d).select("id", "source"), K, SEED).select("id", "source", "fold")


@query
def cv_split(s, d):
    return folds.split_counts(folds.stratified(corpus(s, d).select("id", "label"), K, SEED))


@query
def learning_curve_split(s, d):
    rows = corpus(s, d).select("source")
    parts = folds.curve_groups(rows, CURVE_REPEATS, FRACTIONS)
    size = rows.groupBy("source").agg(F.count("*").alias("n"))
    return parts.join(size, "source").groupBy("rep", F.coalesce("frac", lit(0.0)).alias("frac"), "part").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


# features and models
@query
def document_frequency(s, d):
    return models.document_frequency(redacted(s, d), masked_bag()).select("feat", "df")


@query
def idf(s, d):
    return r6(models.idf(redacted(s, d), masked_bag(), min_df=2), "idf")


@query
def tfidf(s, d):
    return r6(models.tfidf(redacted(s, d), masked_bag(), min_df=2), "w")


@query
def learned_lexicon(s, d):
    return r6(models.lexicon(redacted(s, d)), "precision")


@query
def lexicon_predict(s, d):
    return models.lexicon_cv(folds.stratified(redacted(s, d), K, SEED)).select("id", "fold", "label", "pred")


@query
def majority_baseline(s, d):
    rows = models.majority_cv(folds.stratified(corpus(s, d).select("id", "label"), K, SEED))
    return r6(rows.groupBy("fold", "pred").agg(F.count("*").alias("n"), F.avg((col("label") == col("pred")).cast("int")).alias("accuracy")), "accuracy")


@query
def nb_train(s, d):
    return r6(models.nb_train(redacted(s, d), masked_bag(), BINARY, min_df=2), "loglik", "log_prior")


@query
def nb_scores(s, d):
    return r6(nb_scores_(s, d), "score")


@query
def nb_predict(s, d):
    return models.best_class(nb_scores_(s, d))


@query
def nb_cues_predict(s, d):
    text = F.concat_ws(" ", X.represent(col("text"), "masked"), F.nullif(F.array_join(X.cues(col("text")), " "), lit("")))
    return models.best_class(models.nb_cv(gen(s, d), Grams(text, word=(1, 2)), BINARY))


@query
def cues_only_predict(s, d):
    return models.best_class(models.nb_cv(gen(s, d), Grams(X.cue_text(col("text")), word=(1, 1)), BINARY, alpha=0.5))


@query
def linear_score(s, d):
    return r6(models.linear_score(redacted(s, d), X.word_ngrams(col("text"), 1, 1), WEIGHTS, -0.5, ("NOT", "MGY")), "score")


# metrics
@query
def confusion_matrix(s, d):
    return metrics.confusion(rule(s, d), BINARY)


@query
def class_metrics(s, d):
    return r6(metrics.class_metrics(metrics.confusion(rule(s, d), BINARY)), "precision", "recall", "f1")


@query
def macro_metrics(s, d):
    return r6(metrics.macro_metrics(metrics.confusion(rule(s, d), BINARY)), "accuracy", "macro_p", "macro_r", "macro_f1")


@query
def mcc(s, d):
    return r6(metrics.mcc(metrics.confusion(rule(s, d), BINARY)), "mcc")


@query
def pair_consistency(s, d):
    return r6(metrics.pair_consistency(flipped(s, d)), "consistency")


@query
def per_category_accuracy(s, d):
    return r6(metrics.accuracy_by(flipped(s, d), "bucket"), "accuracy")


@query
def cv_fold_summary(s, d):
    names = ("accuracy", "macro_f1", "mcc")
    return r6(metrics.fold_summary(nb_fold_metrics(s, d), names), *[f"{n}_{x}" for n in names for x in ("mean", "std")])


@query
def cv_pooled(s, d):
    return r6(metrics.all_metrics(metrics.confusion(models.best_class(nb_scores_(s, d)), BINARY)), "accuracy", "macro_p", "macro_r", "macro_f1", "mcc")


@query
def cv_consistency(s, d):
    pairs = C.paired(corpus(s, d).select("id", "label", "source")).select("id", "pair")
    return r6(metrics.pair_consistency(models.best_class(nb_scores_(s, d)).join(pairs, "id", "left")), "consistency")


@query
def error_rows(s, d):
    return metrics.error_rows(models.lexicon_cv(folds.stratified(redacted(s, d), K, SEED))).select("id", "label", "pred", md5(col("text")).alias("text_md5"))


@query
def error_direction(s, d):
    return metrics.error_direction(flipped(s, d))


# scoring and prompts
def prediction_document(s, d) -> DataFrame:
    """One document of predictions: most ids once, some twice, some left out, one unknown."""
    rows = C.predictions(corpus(s, d))
    h = F.substring(folds.hashed("doc", "id"), 1, 1)
    kept = rows.where(h != "0").select(col("id").cast("string").alias("id"), F.lower("pred").alias("pred"), lit(0).alias("pos"))
    again = rows.where(h == "1").select(col("id").cast("string").alias("id"), lit("NOT").alias("pred"), lit(1).alias("pos"))
    extra = s.createDataFrame([("unknown", "MGY", 2)], "id string, pred string, pos int")
    return kept.unionByName(again).unionByName(extra).select(lit("m1").alias("model"), lit("p1").alias("prompt"), "pos", "id", "pred")


def gold(s, d) -> DataFrame:
    return flipped(s, d).drop("pred").withColumn("id", col("id").cast("string"))


@query
def scan_predictions(s, d):
    one = F.to_json(F.struct(lit("m1").alias("model"), lit("p1").alias("prompt"), F.array(F.struct("id", "pred")).alias("predictions")))
    docs = prediction_document(s, d).select(F.from_json(one, C.PREDICTIONS).alias("j")).select("j.*")
    return C.exploded(docs)


@query
def score_predictions(s, d):
    return r6(scoring.score(scoring.scored(gold(s, d), prediction_document(s, d)), BINARY), "accuracy", "macro_f1", "mcc", "consistency")


@query
def missing_predictions(s, d):
    return scoring.missing(gold(s, d), prediction_document(s, d))


@query
def static_prediction_join(s, d):
    answers_ = C.literal(s, generate.static_predictions(), "frame_id string, pred string, conf string")
    return scoring.static_join(drawn(s, d), answers_).select("source", "id", "frame_id", "label", "pred", "conf")


@query
def score_upsert(s, d):
    ids = corpus(s, d).groupBy(F.concat(lit("m"), (col("id") % 7).cast("string")).alias("model"), F.concat(lit("p"), (col("id") % 3).cast("string")).alias("prompt"))
    store = ids.agg(F.count("*").alias("value"))
    new = corpus(s, d).where("label = 'MGY'").groupBy(F.concat(lit("m"), (col("id") % 9).cast("string")).alias("model"), lit("p1").alias("prompt")).agg((-F.count("*")).alias("value"))
    return scoring.upsert(store, new)


@query
def render_prompts(s, d):
    out = prompts.render_prompts(corpus(s, d), prompts.prompts(s))
    return out.select("prompt_id", "id", md5(F.concat("system", lit("|"), "user")).alias("md5"))


# generator
def drawn(s, d) -> DataFrame:
    """A generated corpus for each source of the documents."""
    return generate.gen_rows(s, C.table(s, d, "documents").select("source").distinct())


@query
def gen_rows(s, d):
    return drawn(s, d)


@query
def gen_summary(s, d):
    return generate.gen_summary(drawn(s, d), ("source",))


# learning curve
def curve(s, d) -> DataFrame:
    """rep, frac, accuracy of the lexicon over growing training groups; counts are made once per word and group."""
    rows = redacted(s, d)
    parts = folds.curve_groups(rows.select("source"), CURVE_REPEATS, FRACTIONS)
    test = parts.where("part = 'test'").select("rep", "source")
    seen = rows.select("id", "source", "label", F.explode(F.array_distinct(X.word_tokens(col("text")))).alias("token"))
    counts = seen.groupBy("token", "source").agg(F.count("*").alias("n"), F.sum((col("label") == "MGY").cast("int")).alias("m"))
    hopeful = counts.groupBy("token").agg(F.sum("m").alias("m")).where("m >= 2").select("token")
    counts = counts.join(hopeful, "token")
    train = parts.where("part = 'train'").select("rep", "frac", "source")
    lexicon = counts.join(F.broadcast(train), "source").groupBy("rep", "frac", "token").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n >= 2 and m >= 0.9 * n").select("rep", "frac", "token")
    hits = seen.join(hopeful, "token", "left_semi").join(F.broadcast(test), "source").join(lexicon, ["rep", "token"]).select("rep", "frac", "id").distinct().withColumn("hit", lit(True))
    every = rows.select("id", "source", "label").join(F.broadcast(test), "source").crossJoin(F.broadcast(train.select("frac").distinct()))
    pred = F.when(col("hit"), "MGY").otherwise("NOT")
    return every.join(hits, ["rep", "frac", "id"], "left").groupBy("rep", "frac").agg(F.avg((col("label") == pred).cast("int")).alias("accuracy"))


@query
def learning_curve(s, d):
    return r6(curve(s, d).groupBy("frac").agg(F.count("*").alias("n_repeats"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("sd")), "mean", "sd")


@query
def learning_curve_gain(s, d):
    from pyspark.sql import Window

    means = curve(s, d).groupBy("frac").agg(F.avg("accuracy").alias("mean"))
    gain = col("mean") - F.lag("mean").over(Window.orderBy("frac"))  # one row for each fraction
    out = means.select("frac", gain.alias("gain"))
    return r6(out.withColumn("climbing", F.coalesce(F.round("gain", 9) > 0.02, lit(False))), "gain")


# linear models, grids and curves
@query
def logreg_cv(s, d):
    return linear.cross_validated(gen(s, d), Grams(X.represent(col("text"), "stripped"), word=(1, 2), char=(3, 4)), linear.Spec())


@query
def svm_cv(s, d):
    return linear.cross_validated(gen(s, d), masked_grams(), linear.Spec("svm", lam=5e-3, epochs=120))


def subtypes(s, d) -> DataFrame:
    """The positive rows by subtype."""
    return templated(redacted(s, d).where("label = 'MGY'").withColumn("label", col("bucket")))


def three_way(s, d) -> DataFrame:
    return templated(redacted(s, d).withColumn("label", col("bucket")))


@query
def top_features(s, d):
    """The heaviest features of the subtypes' logistic model, tokens masked."""
    # read twice, for the features and for their names
    rows = written(subtypes(s, d).select("id", "label", "text"))
    bag = masked_grams()
    examples = rows.select(lit("all").alias("setting"), "id", "label", "text", F.array(lit(linear.TRAIN)).alias("roles"))
    weights = linear.train(examples, {"all": linear.Spec(names=("CONTEXT", "STRONG"), epochs=150, l2=1e-3)}, 1, weights=True, bag=bag)
    return linear.top(written(weights), lambda feats: grams.names(rows, bag, feats), 12)


def pairs(rows: DataFrame) -> DataFrame:
    return rows.select("id", "pair")


DIAGNOSTIC = ["lexicon", "nb", "svm_wide", "logreg", "cues"]


@query
def diagnostic_binary(s, d):
    """Five models on the diagnostic view without its tokens, construction groups apart."""
    rows = C.diagnostic(diagnostic(s, d))
    return r6_all(crossval.grid(rows, [(m, "stripped", "group") for m in DIAGNOSTIC], BINARY, pairs(rows)))


@query
def diagnostic_use_mention(s, d):
    """The same on use against counter-speech, tokens masked."""
    rows = C.diagnostic(diagnostic(s, d)).where(col("category").isin("USE_SLUR", "COUNTER"))
    return r6_all(crossval.grid(rows, [(m, "masked", "group") for m in DIAGNOSTIC], BINARY, pairs(rows)))


@query
def diagnostic_by_category(s, d):
    """category, gold, n, n_correct, accuracy of the logistic model, in the categories' fixed order."""
    rows = C.diagnostic(diagnostic(s, d))
    scored = crossval.cross_validate(rows, "logreg", "stripped", "group", classes=BINARY).join(rows.select("id", "category"), "id")
    return metrics.by_category(scored)


@query
def diagnostic_errors(s, d):
    """model, direction, n: errors of the logistic model and of cues on the subtypes, templates apart."""
    scored = crossval.grid_scores(subtypes(s, d), [("logreg", "masked", "group"), ("cues", "masked", "group")], SUBTYPES)
    return metrics.error_rows(scored).groupBy("model", F.concat_ws("->", "label", "pred").alias("direction")).agg(F.count("*").alias("n"))


SUBTYPES = ["CONTEXT", "STRONG"]


@query
def representation_grid(s, d):
    """Whether a token's identity tells the subtype: the logistic model under each representation, random folds."""
    return r6_all(crossval.grid(subtypes(s, d), [("logreg", r, "random") for r in X.REPRESENTATIONS], SUBTYPES))


@query
def protocol_grid(s, d):
    """Random folds against whole templates: four models without tokens."""
    settings = [(m, "stripped", split) for split in ("random", "group") for m in ("lexicon", "nb", "nb_char", "logreg_60")]
    return r6_all(crossval.grid(templated(redacted(s, d)), settings, BINARY))


@query
def subtype_grid(s, d):
    """STRONG against CONTEXT by six models, random folds and templates apart."""
    settings = [(m, "masked", split) for split in ("random", "group") for m in ("majority", "lexicon_context", "nb", "logreg", "nb_cues", "cues")]
    return r6_all(crossval.grid(subtypes(s, d), settings, SUBTYPES))


@query
def three_way_grid(s, d):
    """All three buckets, templates apart: the logistic model telling the second class from the others, and one per class."""
    settings = [(m, "stripped", "group") for m in ("nb", "logreg", "logreg_ovr", "nb_cues")]
    return r6_all(crossval.grid(three_way(s, d), settings, THREE))


@query
def counting_grid(s, d):
    """The counting models of protocol_grid, which SQL can express."""
    settings = [(m, "stripped", split) for split in ("random", "group") for m in ("lexicon", "nb", "nb_char")]
    return r6_all(crossval.grid(templated(redacted(s, d)), settings, BINARY))


@query
def counting_subtype_grid(s, d):
    """The counting models of subtype_grid, which SQL can express."""
    settings = [(m, "masked", split) for split in ("random", "group") for m in ("lexicon_context", "nb", "nb_cues", "cues")]
    return r6_all(crossval.grid(subtypes(s, d), settings, SUBTYPES))


def r6_all(df: DataFrame) -> DataFrame:
    return r6(df, *[n for n, t in df.dtypes if t == "double"])


def cues_curve(s, d) -> DataFrame:
    return crossval.learning_curve(subtypes(s, d), "cues", "mcc", SUBTYPES, "masked", CURVE_REPEATS, tuple(FRACTIONS))


@query
def learning_curve_cues(s, d):
    """frac, n_templates, n_repeats, mean, sd of the cues' correlation on the subtypes."""
    return r6_all(cues_curve(s, d))


@query
def learning_curve_tasks(s, d):
    """task, frac, n_templates, n_repeats, mean, sd: three tasks, 25 repeats over templates."""
    rows = templated(redacted(s, d))
    first = crossval.learning_curve(rows, "logreg_60", "macro_f1", BINARY, "stripped", CURVE_REPEATS, tuple(FRACTIONS))
    third = crossval.learning_curve(subtypes(s, d), "logreg", "mcc", SUBTYPES, "masked", CURVE_REPEATS, tuple(FRACTIONS))
    tasks = [("logreg macro_f1", first), ("cues mcc", cues_curve(s, d)), ("logreg mcc", third)]
    out = None
    for name, curve_ in tasks:
        one = curve_.select(lit(name).alias("task"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query
def scan_csv_roundtrip(s, d):
    path = f"{scratch(s)}/csv"
    rows = corpus(s, d).select(col("id").cast("string").alias("id"), "text", "label", "bucket")
    C.write_csv(rows, path)
    return C.found(C.scan_csv_split(s, path)).select("id", md5(col("text")).alias("text_md5"), "label", "bucket")


def entry(s: SparkSession, d: str) -> DataFrame:
    """The flagship: the presence rule's metrics over the redacted corpus."""
    return metrics.all_metrics(metrics.confusion(rule(s, d), BINARY))
