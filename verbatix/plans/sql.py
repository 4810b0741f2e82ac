"""The queries of plans/queries.py in DuckDB's SQL, written apart from them."""

from __future__ import annotations

from ..functions.text import CONDEMN, REPORT, RULE_SUBJECTS, TEMPLATE_SUBJECTS
from ..operators.generate import GARMENTS, SUBJECTS, frame_rows, static_predictions
from ..operators.prompts import PROMPTS
from ..sources.corpus import ABUSE, EMAIL
from .queries import CURVE_REPEATS, FRACTIONS, WEIGHTS

SQL: dict[str, str] = {}


def q(x) -> str:
    """A literal."""
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") AS v({columns})"


TOKEN = r"\[(?:FSLUR|CTX)_\d+\]"
MARK = r"""[।.,!?;:"''()\[\]{}]"""
CORPUS = """corpus AS (SELECT doc_id AS id, text, source, CASE WHEN toxic = 1 THEN 'MGY' ELSE 'NOT' END AS label,
  CASE WHEN toxic = 1 AND quality = 1 THEN 'STRONG' WHEN toxic = 1 THEN 'CONTEXT' ELSE 'NOT' END AS bucket
  FROM documents JOIN labels USING (doc_id))"""
_t = "text"
for _k, _w in enumerate(ABUSE, 1):
    _t = rf"regexp_replace({_t}, '(?i)\b{_w}\b', '[FSLUR_{_k:02d}]', 'g')"
RED = CORPUS + f""", red AS (SELECT id, label, bucket, source, regexp_replace({_t}, '{EMAIL}', '[CTX_01]', 'g') AS text FROM corpus)"""


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '{MARK}', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def masked(x: str = "text") -> str:
    return f"regexp_replace({x}, '{TOKEN}', '<RDW>', 'g')"


def grams(words: str, a: int, b: int) -> str:
    each = [f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n} + 2), lambda i: 'w{n}:' || array_to_string({words}[i:i + {n - 1}], '_')) ELSE [] END" for n in range(a, b + 1)]
    return each[0] if len(each) == 1 else f"list_concat({', '.join(each)})" if len(each) == 2 else f"list_concat(list_concat({each[0]}, {each[1]}), {each[2]})"


def add(name: str, head: str, body: str) -> None:
    SQL[name] = (f"WITH {head} " if head else "") + body


RULE = RED + rf", rule AS (SELECT *, CASE WHEN regexp_matches(text, '{TOKEN}') THEN 'MGY' ELSE 'NOT' END AS pred FROM red)"
HEX = "instr('0123456789abcdef', substr({h}, {k}, 1)) - 1"


def byte(h: str) -> str:
    return f"(({HEX.format(h=h, k=1)}) * 16 + {HEX.format(h=h, k=2)})"


def pick(of: list[str], what: str) -> str:
    return f"list_value({', '.join(map(q, of))})[{byte(f'md5({q(what + chr(58))} || key)')} % {len(of)} + 1]"


GEN = f"""frames AS (SELECT * FROM {values(frame_rows(), 'base, copies, half, category, frame_id, label, pattern, has')}),
numbers AS (SELECT *, unnest(range(base, base + copies)) AS number FROM frames),
numbered AS (SELECT *, coalesce(source, '') || ':' || number AS key FROM numbers, (SELECT DISTINCT source FROM documents)),
slots AS (SELECT *, CASE WHEN half < 2 THEN {pick(SUBJECTS, 'S')} ELSE '' END AS subject,
  CASE WHEN has THEN printf('[FSLUR_%02d]', {byte("md5('T:' || key)")} % 20 + 1) ELSE '' END AS token,
  CASE WHEN half = 0 THEN {pick(GARMENTS, 'G0')} ELSE {pick(GARMENTS, 'G1')} END AS garment FROM numbered),
gen AS (SELECT source, printf('D%04d', CASE WHEN half < 2 THEN 2 * number - 1 + half ELSE number END) AS id,
  replace(replace(replace(pattern, '{{S}}', subject), '{{T}}', token), '{{G}}', garment) AS text, label, category, frame_id,
  CASE WHEN half < 2 THEN 'P' || number ELSE '' END AS pair_id, subject, token FROM slots),
built AS (SELECT *, CASE WHEN category IN ('USE_SLUR', 'COUNTER') THEN 'UC:' WHEN category IN ('IMPLICIT', 'BENIGN_OVERLAP') THEN 'IB:' ELSE 'BN:' END || split_part(frame_id, ':', 2) AS template FROM gen)"""


GENERATED = GEN
_CAT = "CASE WHEN label = 'MGY' AND token <> '' THEN 'USE_SLUR' WHEN label = 'MGY' THEN 'IMPLICIT' WHEN token <> '' THEN 'COUNTER' WHEN pair_id <> '' THEN 'BENIGN_OVERLAP' ELSE 'BENIGN_NEUTRAL' END"


def folded(rows: str, group: str) -> str:
    return f"""groups AS (SELECT g, (row_number() OVER (ORDER BY md5('12345:' || g), g) - 1) % 5 AS fold FROM (SELECT DISTINCT {group} AS g FROM {rows})),
folded AS (SELECT r.*, CAST(fold AS INT) AS fold FROM {rows} r JOIN groups ON g = {group})"""


STRAT = "strat AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('12345:' || id), id) - 1) % 5 AS INT) AS fold FROM {rows})"
PAIRS = """ranks AS (SELECT id, label, source, row_number() OVER (PARTITION BY source, label ORDER BY md5('pair:' || id), id) AS n FROM corpus),
pairs AS (SELECT a.id, a.label, a.source || ':' || a.n AS pair FROM ranks a JOIN ranks b ON a.source = b.source AND a.n = b.n AND a.label <> b.label)"""
FLIP = PAIRS + """, preds AS (SELECT id, CASE WHEN substr(md5('pred:' || id), 1, 1) IN ('0', '1', '2') THEN CASE WHEN label = 'MGY' THEN 'NOT' ELSE 'MGY' END ELSE label END AS pred FROM corpus),
flipped AS (SELECT c.id, c.label, c.bucket, c.source, preds.pred, pairs.pair FROM corpus c JOIN preds USING (id) LEFT JOIN pairs USING (id))"""


#: The diagnostic view of the labelled documents.
GEN = RED + ", " + PAIRS + rf""", marked AS (SELECT red.*, regexp_extract(text, '{TOKEN}') AS token, coalesce(pairs.pair, '') AS pair_id FROM red LEFT JOIN pairs USING (id)),
gen AS (SELECT id, text, label, {_CAT} AS category, {_CAT} || ':' || source AS frame_id, pair_id, token FROM marked),
built AS (SELECT *, CASE WHEN category IN ('USE_SLUR', 'COUNTER') THEN 'UC:' WHEN category IN ('IMPLICIT', 'BENIGN_OVERLAP') THEN 'IB:' ELSE 'BN:' END || split_part(frame_id, ':', 2) AS template FROM gen)"""


def nb(rows: str, bag: str, alpha: float, min_df: int, bags: str | None = None) -> str:
    """Naive Bayes with a training per fold, spelled out: every fold joined with the rows outside it."""
    bags = bags or f"bags AS (SELECT id, fold, label, unnest({bag}) AS feat FROM (SELECT *, {tokens('text')} AS ws FROM ({rows})))"
    return f"""{bags},
tf AS (SELECT id, fold, label, feat, count(*) AS tf FROM bags GROUP BY ALL),
ks AS (SELECT DISTINCT fold AS f FROM ({rows})), cls AS (SELECT unnest(['MGY', 'NOT']) AS class),
prior AS (SELECT f, class, count(*) FILTER (label = class) AS n, count(*) AS total FROM ks, cls, ({rows}) WHERE fold <> f GROUP BY ALL),
good AS (SELECT f FROM prior GROUP BY f HAVING min(n) > 0),
vocab AS (SELECT f, feat, sum(tf) FILTER (label = 'MGY') AS m, sum(tf) FILTER (label = 'NOT') AS o FROM good JOIN tf ON fold <> f GROUP BY f, feat HAVING count(*) >= {min_df}),
counts AS (SELECT f, feat, 'MGY' AS class, coalesce(m, 0) AS c FROM vocab UNION ALL SELECT f, feat, 'NOT', coalesce(o, 0) FROM vocab),
size AS (SELECT f, class, sum(c) AS t, count(*) AS v FROM counts GROUP BY ALL),
parts AS (SELECT tf.id, size.class, sum(tf.tf * ln((coalesce(c, 0) + {alpha}) / (t + {alpha} * v))) AS s FROM tf JOIN size ON size.f = tf.fold LEFT JOIN counts ON counts.f = tf.fold AND counts.feat = tf.feat AND counts.class = size.class GROUP BY ALL),
scores AS (SELECT r.id, r.fold, r.label, prior.class, ln(n / total) + coalesce(s, 0) AS score FROM ({rows}) r JOIN good ON good.f = r.fold JOIN prior ON prior.f = r.fold LEFT JOIN parts ON parts.id = r.id AND parts.class = prior.class),
best AS (SELECT id, fold, label, class AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, class) AS r FROM scores) WHERE r = 1)"""


def metric(rows: str, by: str = "") -> str:
    """Metrics of two classes straight from the rows."""
    b = f"{by}, " if by else ""
    f1 = lambda x, y: f"CASE WHEN {x} + {y} = 0 THEN 0 ELSE 2 * {x} * {y} / ({x} + {y}) END"
    ratio = lambda x, y: f"CASE WHEN {y} = 0 THEN 0.0 ELSE CAST({x} AS DOUBLE) / {y} END"
    return f"""cells AS (SELECT {b}count(*) FILTER (label = 'MGY' AND pred = 'MGY') AS a, count(*) FILTER (label = 'MGY' AND pred = 'NOT') AS b, count(*) FILTER (label = 'NOT' AND pred = 'MGY') AS c, count(*) FILTER (label = 'NOT' AND pred = 'NOT') AS d FROM {rows} {'GROUP BY ' + by if by else ''}),
pr AS (SELECT *, {ratio('a', '(a + c)')} AS p1, {ratio('a', '(a + b)')} AS r1, {ratio('d', '(b + d)')} AS p0, {ratio('d', '(c + d)')} AS r0 FROM cells),
m AS (SELECT {b}a + b + c + d AS n, a, b, c, d, p1, r1, p0, r0, {f1('p1', 'r1')} AS f1, {f1('p0', 'r0')} AS f0, {ratio('a + d', '(a + b + c + d)')} AS accuracy,
  CASE WHEN (a + b) * (a + c) * (d + b) * (d + c) = 0 THEN 0 ELSE (CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c) / sqrt(CAST(a + b AS DOUBLE) * (a + c) * (d + b) * (d + c)) END AS mcc FROM pr)"""


# scans and profiles
add("scan_corpus", CORPUS, "SELECT id, label, bucket, source, length(text) AS n_chars, md5(text) AS text_md5 FROM corpus")
add("label_distribution", CORPUS, "SELECT label, count(*) AS n FROM corpus GROUP BY label")
add("label_bucket_crosstab", CORPUS, "SELECT label, bucket, count(*) AS n FROM corpus GROUP BY ALL")
add("token_frequency", RED, rf"SELECT token, count(*) AS n, count(DISTINCT id) AS n_rows FROM (SELECT id, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM red) GROUP BY token")
add("presence_by_bucket", RULE, "SELECT bucket, pred = 'MGY' AS has_token, count(*) AS n FROM rule GROUP BY ALL")
add("presence_confusion", RULE + ", " + metric("rule"), "SELECT a AS tp, c AS fp, b AS fn, d AS tn FROM m")
add("duplicate_profile", "", "SELECT CAST(sum(n) AS BIGINT) AS n_texts, count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_rows_repeated FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)")
add("token_length_stats", "", r"SELECT round(avg(n), 6) AS avg_len, min(n) AS min_len, max(n) AS max_len FROM (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)")
add("token_families", RED, r"SELECT regexp_extract(token, '\[([A-Z]+)_', 1) AS family, count(*) AS n_distinct, string_agg(token, ' ' ORDER BY token) AS tokens FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\[[A-Z]+_\d+\]')) AS token FROM red) GROUP BY ALL")


def template(drop: bool) -> str:
    s = rf"regexp_replace(lower(regexp_replace(text, '{TOKEN}', '<TOK>', 'g')), '\b({'|'.join(TEMPLATE_SUBJECTS)})\b', '<SUBJ>', 'g')"
    s = f"regexp_replace({s}, '[।.,!?]', '', 'g')" if drop else s
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


add("template_profile", RED, f"SELECT md5(t) AS template, count(*) AS n, arg_min(label, id) AS first_label, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS buckets FROM (SELECT *, {template(False)} AS t FROM red) GROUP BY t")
add("distinct_text_by_bucket", CORPUS, "SELECT bucket, count(DISTINCT text) AS n_distinct FROM corpus GROUP BY bucket")
add("script_share", CORPUS, r"SELECT label, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\x{0900}-\x{097F}]')) AS n_script, count(*) FILTER (regexp_matches(text, '[À-ÿ]')) AS n_other FROM corpus GROUP BY label")
add("bucket_samples", CORPUS, "SELECT bucket, id, CAST(place AS INT) AS place FROM (SELECT bucket, id, row_number() OVER (PARTITION BY bucket ORDER BY id) AS place FROM corpus) WHERE place <= 3")
# filters and rules
add("filter_positive", CORPUS, "SELECT bucket, count(*) AS n FROM corpus WHERE label = 'MGY' GROUP BY bucket")
add("filter_contrast_subset", CORPUS, "SELECT id, bucket FROM corpus WHERE bucket <> 'NOT'")
add("presence_rule", RULE, "SELECT id, label, pred FROM rule")
add("constant_rule_on_token_rows", GEN, "SELECT count(*) AS n, avg(CASE WHEN label = 'MGY' THEN 1.0 ELSE 0.0 END) AS accuracy FROM gen WHERE token <> ''")
add("subject_rule", GEN, rf"SELECT count(*) AS n, avg(CASE WHEN label = 'MGY' THEN 1.0 ELSE 0.0 END) AS accuracy FROM gen WHERE regexp_matches(text, '(?i)\b({'|'.join(RULE_SUBJECTS)})\b')")
add("lexicon_rule", RED, rf"SELECT id, label, CASE WHEN list_has_any({tokens('text')}, ['spam', 'free', 'click']) OR regexp_matches(text, '{TOKEN}') THEN 'MGY' ELSE 'NOT' END AS pred FROM red")
# text
for _n, _x in (("raw", "text"), ("masked", masked()), ("stripped", rf"regexp_replace(text, '{TOKEN}\s*', ' ', 'g')"), ("mask_distinct", r"regexp_replace(regexp_replace(text, '\[FSLUR_\d+\]', '<FSLUR>', 'g'), '\[CTX_\d+\]', '<CTX>', 'g')")):
    add(f"repr_{_n}", RED, f"SELECT id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT id, {_x} AS t FROM red)")
add("normalize_text", RED, f"SELECT id, md5({norm('text')}) AS text_md5 FROM red")
add("word_tokens", RED, f"SELECT id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT id, {tokens('text')} AS t FROM red)")
_DF = "SELECT feat, count(*) AS df, CAST(sum(k) AS BIGINT) AS tf FROM (SELECT id, feat, count(*) AS k FROM bags GROUP BY ALL) GROUP BY feat"
add("word_ngrams", RED + f", bags AS (SELECT id, unnest({grams('ws', 1, 3)}) AS feat FROM (SELECT id, {tokens('text')} AS ws FROM red))", _DF)
LETTERS = f"""padded AS (SELECT id, string_split(replace(' ' || {norm('text')} || ' ', ' ', '_'), '') AS cs, {tokens('text')} AS ws FROM red),
letters AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM padded),
ahead AS (SELECT id, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3 FROM letters WINDOW w AS (PARTITION BY id ORDER BY i)),
c34 AS (SELECT id, 'c3:' || c || c1 || c2 AS feat FROM ahead WHERE c2 IS NOT NULL UNION ALL SELECT id, 'c4:' || c || c1 || c2 || c3 FROM ahead WHERE c3 IS NOT NULL)"""
add("char_ngrams", RED + f", {LETTERS}, bags AS (SELECT id, 'c2:' || c || c1 AS feat FROM ahead WHERE c1 IS NOT NULL UNION ALL SELECT * FROM c34)", _DF)
add("features_both", RED + f", {LETTERS}, w12 AS (SELECT id, unnest({grams('ws', 1, 2)}) AS feat FROM padded), every AS (SELECT * FROM w12 UNION ALL SELECT * FROM c34)", "SELECT red.id, count(feat) FILTER (feat[1] = 'w') AS n_word, count(feat) FILTER (feat[1] = 'c') AS n_char, count(DISTINCT feat) AS n_distinct FROM red LEFT JOIN every USING (id) GROUP BY red.id")
add("template_id", RED, f"SELECT id, md5({template(True)}) AS template_md5 FROM red")
add("construction_group", GEN, "SELECT category, template, count(*) AS n FROM built GROUP BY ALL")


def cue_text(words: str) -> str:
    found = [f"CASE WHEN list_contains({words}, {q(w)}) THEN {q(kind + w)} END" for kind, of in (("CND:", CONDEMN), ("REP:", REPORT)) for w in of]
    found += [f"CASE WHEN list_has_any({words}, [{', '.join(map(q, of))}]) THEN '{name}' END" for name, of in (("HAS_CONDEMN", CONDEMN), ("HAS_REPORT", REPORT))]
    return f"coalesce(nullif(concat_ws(' ', {', '.join(found)}), ''), 'NONE')"


add("cue_features", GEN, f"SELECT id, {cue_text('ws')} AS cues FROM (SELECT id, {tokens('text')} AS ws FROM gen)")
_FORMS = [("LABEL: MGY", "MGY"), ("label: not", "NOT"), ("first LABEL: MGY then LABEL: NOT", "MGY"), ("I would say MGY", "MGY"), ("MGY or NOT", "NOT"), ("MGY because the claim targets her", "MGY"), ("", "NOT"), ("nothing to see: not MGY at all, I am sure of it", "MGY")]
add("parse_label", CORPUS, f"SELECT id, ([{', '.join(q(y) for _, y in _FORMS)}])[({HEX.format(h=chr(109) + 'd5(' + q('raw:') + ' || id)', k=1)}) % 8 + 1] AS pred FROM corpus")
# folds
add("seeded_shuffle", CORPUS, "SELECT id, row_number() OVER (ORDER BY md5('12345:' || id), id) - 1 AS pos FROM corpus")
add("stratified_kfold", CORPUS + ", " + STRAT.format(rows="corpus"), "SELECT id, label, fold FROM strat")
add("group_kfold", CORPUS + ", " + folded("corpus", "source"), "SELECT id, source, fold FROM folded")
add("cv_split", CORPUS + ", " + STRAT.format(rows="corpus") + ", ks AS (SELECT DISTINCT fold AS f FROM strat)", "SELECT CAST(f AS INT) AS fold, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS split, label, count(*) AS n FROM ks, strat GROUP BY ALL")
CURVE = f"""places AS (SELECT rep, source, row_number() OVER (PARTITION BY rep ORDER BY md5('1000:' || rep || ':' || source), source) - 1 AS r, count(*) OVER (PARTITION BY rep) AS t FROM (SELECT DISTINCT source FROM corpus), range({CURVE_REPEATS}) x(rep)),
cut AS (SELECT *, greatest(1, CAST(round(t * CAST(0.3 AS DOUBLE)) AS BIGINT)) AS n_test FROM places),
fracs AS (SELECT CAST(unnest([{', '.join(map(str, FRACTIONS))}]) AS DOUBLE) AS frac),
parts AS (SELECT CAST(rep AS INT) AS rep, CAST(0 AS DOUBLE) AS frac, source, 'test' AS part FROM cut WHERE r < n_test
  UNION ALL SELECT CAST(rep AS INT), frac, source, 'train' FROM cut, fracs WHERE r >= n_test AND r - n_test < greatest(2, CAST(round(frac * (t - n_test)) AS BIGINT)))"""
add("learning_curve_split", CORPUS + ", " + CURVE, "SELECT rep, frac, part, count(DISTINCT source) AS n_groups, count(*) AS n_rows FROM parts JOIN corpus USING (source) GROUP BY ALL")
# features and models
BAGS = RED + f", bags AS (SELECT id, label, unnest({grams('ws', 1, 2)}) AS feat FROM (SELECT id, label, {tokens(masked())} AS ws FROM red)), tf AS (SELECT id, label, feat, count(*) AS tf FROM bags GROUP BY ALL), df AS (SELECT feat, count(*) AS df FROM tf GROUP BY feat)"
IDF = BAGS + ", idf AS (SELECT feat, df, ln((1 + (SELECT count(*) FROM red)) / (1 + df)) + 1 AS idf FROM df WHERE df >= 2)"
add("document_frequency", BAGS, "SELECT feat, df FROM df")
add("idf", IDF, "SELECT feat, df, round(idf, 6) AS idf FROM idf")
add("tfidf", IDF + ", x AS (SELECT id, feat, tf * idf AS x FROM tf JOIN idf USING (feat)), l AS (SELECT id, sqrt(sum(x * x)) AS l FROM x GROUP BY id)", "SELECT id, feat, round(x / l, 6) AS w FROM x JOIN l USING (id)")
SEEN = ", seen AS (SELECT id, fold, label, unnest(list_distinct(" + tokens("text") + ")) AS token FROM strat)"
add("learned_lexicon", RED + f", seen AS (SELECT label, unnest(list_distinct({tokens('text')})) AS token FROM red)", "SELECT token, count(*) AS total, count(*) FILTER (label = 'MGY') AS pos, round(count(*) FILTER (label = 'MGY') / count(*), 6) AS precision FROM seen GROUP BY token HAVING count(*) >= 2 AND count(*) FILTER (label = 'MGY') / count(*) >= 0.9")
LEX = RED + ", " + STRAT.format(rows="red") + SEEN + """, ks AS (SELECT DISTINCT fold AS f FROM strat),
lex AS (SELECT f, token FROM ks JOIN seen ON fold <> f GROUP BY f, token HAVING count(*) >= 2 AND count(*) FILTER (label = 'MGY') >= 0.9 * count(*)),
lp AS (SELECT id, fold, label, text, CASE WHEN id IN (SELECT id FROM seen JOIN lex ON f = fold AND lex.token = seen.token) THEN 'MGY' ELSE 'NOT' END AS pred FROM strat)"""
add("lexicon_predict", LEX, "SELECT id, fold, label, pred FROM lp")
add("majority_baseline", CORPUS + ", " + STRAT.format(rows="corpus") + ", ks AS (SELECT DISTINCT fold AS f FROM strat), n AS (SELECT f, label, count(*) AS n FROM ks JOIN strat ON fold <> f GROUP BY ALL), b AS (SELECT f, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, label) AS r FROM n) WHERE r = 1)", "SELECT fold, pred, count(*) AS n, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM strat JOIN b ON f = fold GROUP BY ALL")
add("nb_train", BAGS + ", c AS (SELECT feat, class, coalesce(sum(tf) FILTER (label = class), 0) AS cnt FROM tf JOIN df USING (feat), (SELECT unnest(['MGY', 'NOT']) AS class) WHERE df >= 2 GROUP BY ALL), t AS (SELECT class, sum(cnt) AS t, count(*) AS v FROM c GROUP BY class), p AS (SELECT class, count(*) FILTER (label = class) AS d, count(*) AS n FROM red, (SELECT DISTINCT class FROM c) GROUP BY class)", "SELECT c.class AS label, feat, CAST(cnt AS BIGINT) AS cnt, round(ln((cnt + 1.0) / (t + v)), 6) AS loglik, round(ln(d / n), 6) AS log_prior FROM c JOIN t USING (class) JOIN p USING (class)")
NB = RED + ", " + folded("red", "source") + ", " + nb(f"SELECT id, fold, label, {masked()} AS text FROM folded", grams("ws", 1, 2), 1.0, 2)
add("nb_scores", NB, "SELECT id, fold, label, class, round(score, 6) AS score FROM scores")
add("nb_predict", NB, "SELECT id, fold, label, pred FROM best")
_GF = GEN + ", " + folded("built", "template")
add("nb_cues_predict", _GF + f", cued AS (SELECT *, {tokens('text')} AS cw FROM folded), " + nb(f"SELECT id, fold, label, {masked()} || ' ' || nullif({cue_text('cw')}, 'NONE') AS text FROM cued WHERE {cue_text('cw')} <> 'NONE' UNION ALL SELECT id, fold, label, {masked()} FROM cued WHERE {cue_text('cw')} = 'NONE'", grams("ws", 1, 2), 1.0, 1), "SELECT id, fold, label, pred FROM best")
add("cues_only_predict", _GF + f", cued AS (SELECT *, {tokens('text')} AS cw FROM folded), " + nb(f"SELECT id, fold, label, {cue_text('cw')} AS text FROM cued", grams("ws", 1, 1), 0.5, 1), "SELECT id, fold, label, pred FROM best")
add("linear_score", RED + f", w AS (SELECT 'w1:' || unnest({tokens('text')}) AS feat, id FROM red), s AS (SELECT id, sum(weight) AS s FROM w JOIN {values(WEIGHTS, 'feat, weight')} USING (feat) GROUP BY id), z AS (SELECT id, CAST(coalesce(s, 0) - 0.5 AS DOUBLE) AS z FROM red LEFT JOIN s USING (id))", "SELECT id, round(z, 6) AS score, CASE WHEN z >= 0 THEN 'MGY' ELSE 'NOT' END AS pred FROM z")
# metrics
_RM = RULE + ", " + metric("rule")
add("confusion_matrix", _RM, "SELECT 'MGY' AS t, 'MGY' AS p, a AS n FROM m UNION ALL SELECT 'MGY', 'NOT', b FROM m UNION ALL SELECT 'NOT', 'MGY', c FROM m UNION ALL SELECT 'NOT', 'NOT', d FROM m")
add("class_metrics", _RM, 'SELECT \'MGY\' AS "class", round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1, 6) AS f1, a + b AS support FROM m UNION ALL SELECT \'NOT\', round(p0, 6), round(r0, 6), round(f0, 6), c + d FROM m')
_MACRO = "n, round(accuracy, 6) AS accuracy, round((p1 + p0) / 2, 6) AS macro_p, round((r1 + r0) / 2, 6) AS macro_r, round((f1 + f0) / 2, 6) AS macro_f1"
add("macro_metrics", _RM, f"SELECT {_MACRO} FROM m")
add("mcc", _RM, "SELECT round(mcc, 6) AS mcc FROM m")
_PAIR = "SELECT count(*) AS n_pairs, round(avg(ok), 6) AS consistency FROM (SELECT pair, min(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS ok FROM {rows} WHERE pair IS NOT NULL GROUP BY pair HAVING count(*) = 2)"
_F = CORPUS + ", " + FLIP
add("pair_consistency", _F, _PAIR.format(rows="flipped"))
add("per_category_accuracy", _F, "SELECT bucket, count(*) AS n, count(*) FILTER (label = pred) AS n_correct, round(count(*) FILTER (label = pred) / count(*), 6) AS accuracy FROM flipped GROUP BY bucket")
add("cv_fold_summary", NB + ", " + metric("best", "fold"), "SELECT count(*) AS n_folds, " + ", ".join(f"round(avg({x}), 6) AS {n}_mean, round(stddev_pop({x}), 6) AS {n}_std" for n, x in (("accuracy", "accuracy"), ("macro_f1", "(f1 + f0) / 2"), ("mcc", "mcc"))) + " FROM m")
add("cv_pooled", NB + ", " + metric("best"), f"SELECT {_MACRO}, round(mcc, 6) AS mcc FROM m")
add("cv_consistency", NB + ", " + PAIRS + ", bp AS (SELECT best.*, pairs.pair FROM best LEFT JOIN pairs USING (id))", _PAIR.format(rows="bp"))
add("error_rows", LEX, "SELECT id, label, pred, md5(text) AS text_md5 FROM lp WHERE label <> pred")
add("error_direction", _F, "SELECT label || '->' || pred AS direction, count(*) AS n FROM flipped WHERE label <> pred GROUP BY ALL")
# scoring and prompts
DOC = _F + """, h AS (SELECT CAST(id AS VARCHAR) AS id, lower(pred) AS pred, substr(md5('doc:' || id), 1, 1) AS h FROM preds),
doc AS (SELECT 0 AS pos, id, pred FROM h WHERE h <> '0' UNION ALL SELECT 1, id, 'NOT' FROM h WHERE h = '1' UNION ALL SELECT 2, 'unknown', 'MGY'),
gold AS (SELECT CAST(id AS VARCHAR) AS id, label, pair FROM flipped),
joined AS (SELECT gold.*, upper(arg_max(doc.pred, pos)) AS pred FROM gold JOIN doc USING (id) GROUP BY ALL)"""
add("scan_predictions", DOC, "SELECT 'm1' AS model, 'p1' AS prompt, 0 AS pos, id, pred FROM doc")
add("score_predictions", DOC + ", " + metric("joined") + ", pc AS (" + _PAIR.format(rows="joined") + ")", "SELECT round(accuracy, 6) AS accuracy, round((f1 + f0) / 2, 6) AS macro_f1, round(mcc, 6) AS mcc, consistency, n_pairs FROM m, pc")
add("missing_predictions", DOC, "SELECT id FROM gold WHERE id NOT IN (SELECT id FROM doc)")
add("static_prediction_join", GENERATED, f"SELECT source, id, frame_id, label, pred, conf FROM gen JOIN {values(static_predictions(), 'frame_id, pred, conf')} USING (frame_id)")
add("score_upsert", CORPUS + """, store AS (SELECT 'm' || (id % 7) AS model, 'p' || (id % 3) AS prompt, count(*) AS value FROM corpus GROUP BY ALL),
news AS (SELECT 'm' || (id % 9) AS model, 'p1' AS prompt, -count(*) AS value FROM corpus WHERE label = 'MGY' GROUP BY ALL)""", "SELECT * FROM news UNION ALL SELECT store.* FROM store LEFT JOIN news USING (model, prompt) WHERE news.value IS NULL")
add("render_prompts", CORPUS, f"SELECT prompt_id, id, md5(system || '|' || prefix || text || suffix) AS md5 FROM corpus, {values(PROMPTS, 'prompt_id, system, prefix, suffix')}")
# generator
add("gen_rows", GENERATED, "SELECT * FROM gen")
add("gen_summary", GENERATED, "SELECT source, category, label, count(*) AS n, count(DISTINCT nullif(pair_id, '')) AS n_pairs, count(DISTINCT frame_id) AS n_frames, count(*) FILTER (token <> '') AS n_token_rows FROM gen GROUP BY ALL")
# learning curve
LC = RED + ", " + CURVE + f""", seen AS (SELECT id, source, label, unnest(list_distinct({tokens('text')})) AS token FROM red),
lex AS (SELECT rep, frac, token FROM parts JOIN seen USING (source) WHERE part = 'train' GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (label = 'MGY') >= 0.9 * count(*)),
hits AS (SELECT DISTINCT lex.rep, lex.frac, id FROM parts JOIN seen USING (source) JOIN lex ON lex.rep = parts.rep AND lex.token = seen.token WHERE part = 'test'),
tested AS (SELECT rep, fracs.frac, id, label FROM parts JOIN red USING (source), fracs WHERE part = 'test'),
acc AS (SELECT rep, frac, avg(CASE WHEN label = CASE WHEN hits.id IS NULL THEN 'NOT' ELSE 'MGY' END THEN 1.0 ELSE 0.0 END) AS accuracy FROM tested LEFT JOIN hits USING (rep, frac, id) GROUP BY ALL)"""
add("learning_curve", LC, "SELECT frac, count(*) AS n_repeats, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS sd FROM acc GROUP BY frac")
add("learning_curve_gain", LC + ", g AS (SELECT frac, avg(accuracy) - lag(avg(accuracy)) OVER (ORDER BY frac) AS gain FROM acc GROUP BY frac)", "SELECT frac, round(gain, 6) AS gain, coalesce(round(gain, 9) > 0.02, false) AS climbing FROM g")


# grids of counting models: every setting spelled out, every metric from its rows
def _classes(sql: str, classes: tuple[str, str]) -> str:
    return sql.replace("'MGY'", q(classes[0])).replace("'NOT'", q(classes[1]))


STRIPPED = rf"regexp_replace(text, '{TOKEN}\s*', ' ', 'g')"
CHARS = f"""letters AS (SELECT id, fold, label, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT *, string_split(replace(' ' || {norm('text')} || ' ', ' ', '_'), '') AS cs FROM r)),
ahead AS (SELECT id, fold, label, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3 FROM letters WINDOW w AS (PARTITION BY id ORDER BY i)),
bags AS (SELECT id, fold, label, 'c2:' || c || c1 AS feat FROM ahead WHERE c1 IS NOT NULL UNION ALL SELECT id, fold, label, 'c3:' || c || c1 || c2 FROM ahead WHERE c2 IS NOT NULL UNION ALL SELECT id, fold, label, 'c4:' || c || c1 || c2 || c3 FROM ahead WHERE c3 IS NOT NULL)"""


def _lexicon(positive: str, negative: str, precision: float) -> str:
    return f"""seen AS (SELECT id, fold, label, unnest(list_distinct({tokens('text')})) AS token FROM r), ks AS (SELECT DISTINCT fold AS f FROM r),
lex AS (SELECT f, token FROM ks JOIN seen ON fold <> f GROUP BY f, token HAVING count(*) >= 2 AND count(*) FILTER (label = '{positive}') >= {precision} * count(*)),
best AS (SELECT id, fold, label, CASE WHEN id IN (SELECT id FROM seen JOIN lex ON f = fold AND lex.token = seen.token) THEN '{positive}' ELSE '{negative}' END AS pred FROM r)"""


def _model(name: str, classes: tuple[str, str]) -> str:
    cued = f"SELECT id, fold, label, text || coalesce(' ' || nullif({cue_text('cw')}, 'NONE'), '') AS text FROM (SELECT *, {tokens('text')} AS cw FROM r)"
    cues = f"SELECT id, fold, label, {cue_text('cw')} AS text FROM (SELECT *, {tokens('text')} AS cw FROM r)"
    if name.startswith("lexicon"):
        return _lexicon("CONTEXT", "STRONG", 0.8) if name == "lexicon_context" else _lexicon("MGY", "NOT", 0.9)
    sql = {"nb": lambda: nb("SELECT * FROM r", grams("ws", 1, 2), 1.0, 1), "nb_char": lambda: nb("SELECT * FROM r", "", 1.0, 1, CHARS), "nb_cues": lambda: nb(cued, grams("ws", 1, 2), 1.0, 1), "cues": lambda: nb(cues, grams("ws", 1, 1), 0.5, 1)}[name]()
    return _classes(sql, classes)


def grid(rows: str, names: list[str], representation: str, shown: str, classes: tuple[str, str]) -> str:
    """The summaries of models under both splits; rows: id, label, template, text, to be shown so."""
    each = []
    for split, dealt in (("random", STRAT.format(rows="base") + ", r AS (SELECT id, fold, label, text FROM strat)"), ("group", folded("base", "template") + ", r AS (SELECT id, fold, label, text FROM folded)")):
        for n in names:
            each.append(f"SELECT '{n}' AS model, '{representation}' AS representation, '{split}' AS split, * FROM (WITH base AS (SELECT id, label, template, {shown} AS text FROM {rows}), {dealt}, {_model(n, classes)} SELECT id, fold, label, pred FROM best)")
    key = "model, representation, split"
    of = lambda by: "(WITH " + _classes(metric("scored", by), classes) + " SELECT * FROM m)"
    cells = ", ".join(f"round(avg({x}), 6) AS {n}_mean, round(stddev_pop({x}), 6) AS {n}_std" for n, x in (("accuracy", "accuracy"), ("macro_f1", "(f1 + f0) / 2"), ("mcc", "mcc")))
    return f"""scored AS MATERIALIZED ({" UNION ALL ".join(each)}),
per AS (SELECT {key}, count(*) AS n_folds, {cells} FROM {of(key + ", fold")} GROUP BY ALL),
pooled AS (SELECT {key}, round(accuracy, 6) AS pooled_accuracy, round((f1 + f0) / 2, 6) AS pooled_macro_f1, round(mcc, 6) AS pooled_mcc FROM {of(key)})"""


TEMPLATED = RED + f", templated AS (SELECT id, label, bucket, text, md5({template(True)}) AS template FROM red)"
SUBTYPES = TEMPLATED + ", subtypes AS (SELECT id, bucket AS label, text, template FROM templated WHERE label = 'MGY')"
add("counting_grid", TEMPLATED + ", " + grid("templated", ["lexicon", "nb", "nb_char"], "stripped", STRIPPED, ("MGY", "NOT")), "SELECT * FROM per JOIN pooled USING (model, representation, split)")
add("counting_subtype_grid", SUBTYPES + ", " + grid("subtypes", ["lexicon_context", "nb", "nb_cues", "cues"], "masked", masked(), ("CONTEXT", "STRONG")), "SELECT * FROM per JOIN pooled USING (model, representation, split)")
# the cues' curve: one training for every repeat and fraction
add("learning_curve_cues", SUBTYPES + f""", places AS (SELECT rep, template, row_number() OVER (PARTITION BY rep ORDER BY md5('1000:' || rep || ':' || template), template) - 1 AS r, count(*) OVER (PARTITION BY rep) AS t FROM (SELECT DISTINCT template FROM subtypes), range({CURVE_REPEATS}) x(rep)),
cut AS (SELECT *, greatest(1, CAST(round(t * CAST(0.3 AS DOUBLE)) AS BIGINT)) AS n_test FROM places),
fracs AS (SELECT CAST(unnest([{', '.join(map(str, FRACTIONS))}]) AS DOUBLE) AS frac),
sized AS (SELECT *, greatest(2, CAST(round(frac * (t - n_test)) AS BIGINT)) AS m FROM cut, fracs),
bags AS (SELECT id, label, template, unnest({grams('ws', 1, 1)}) AS feat FROM (SELECT *, {tokens('cue')} AS ws FROM (SELECT *, {cue_text('cw')} AS cue FROM (SELECT *, {tokens(masked())} AS cw FROM subtypes)))),
cls AS (SELECT unnest(['CONTEXT', 'STRONG']) AS class),
train AS (SELECT rep, frac, id, label FROM sized JOIN subtypes USING (template) WHERE r >= n_test AND r - n_test < m),
prior AS (SELECT rep, frac, class, count(*) FILTER (label = class) AS n, count(*) AS total FROM train, cls GROUP BY ALL),
good AS (SELECT rep, frac FROM prior GROUP BY ALL HAVING min(n) > 0),
counts AS (SELECT rep, frac, feat, class, count(*) FILTER (train.label = class) AS c FROM train JOIN bags USING (id), cls GROUP BY ALL),
size AS (SELECT rep, frac, class, sum(c) AS t, count(*) AS v FROM counts GROUP BY ALL),
tested AS (SELECT DISTINCT rep, frac, id, label FROM sized JOIN subtypes USING (template) JOIN good USING (rep, frac) WHERE r < n_test),
parts AS (SELECT rep, frac, tested.id, size.class, sum(ln((coalesce(c, 0) + 0.5) / (t + 0.5 * v))) AS s FROM tested JOIN bags USING (id) JOIN size USING (rep, frac) LEFT JOIN counts USING (rep, frac, feat, class) GROUP BY ALL),
scores AS (SELECT rep, frac, tested.id, tested.label, prior.class, ln(n / total) + coalesce(s, 0) AS score FROM tested JOIN prior USING (rep, frac) LEFT JOIN parts USING (rep, frac, id, class)),
best AS (SELECT rep, frac, label, class AS pred FROM (SELECT *, row_number() OVER (PARTITION BY rep, frac, id ORDER BY round(score, 9) DESC, class) AS k FROM scores) WHERE k = 1),
""" + _classes(metric("best", "rep, frac"), ("CONTEXT", "STRONG")), "SELECT frac, min(least(s.m, t - n_test)) AS n_templates, count(DISTINCT m.rep) AS n_repeats, round(avg(mcc), 6) AS mean, round(stddev_pop(mcc), 6) AS sd FROM sized s LEFT JOIN m USING (frac) GROUP BY frac")

add("scan_csv_roundtrip", CORPUS, "SELECT CAST(id AS VARCHAR) AS id, md5(text) AS text_md5, label, bucket FROM corpus")
