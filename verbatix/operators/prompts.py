"""Prompts: eight templates as a relation, rendered by a join; and the hook for a model client."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import Store, written

# Fixed values.
FEWSHOT = [
    ("aurat ko kitchen me hi rehna chahiye, bahar kya kaam.", "MGY"),
    ("kisi bhi ladki ko gaali dena bilkul galat hai, mat karo.", "NOT"),
    ("kal ka demo kitne baje hai?", "NOT"),
    ("usko sab online slur bol ke harass kar rahe the.", "MGY"),
]
ONE_TOKEN = "Answer with exactly one token: MGY or NOT."
RULE = f"""Decide whether a code-mixed Hinglish (Romanised Hindi + English) message is MISOGYNISTIC (MGY) or NOT.
Rules:
- A slur or sexist claim directed at / used against a woman is MGY.
- Implicit misogyny (stereotyping, moral-policing, objectification) with no slur is still MGY.
- A slur that is only mentioned, quoted, or condemned (counter-speech such as "don't call her that", "calling her X is wrong") is NOT.
{ONE_TOKEN}"""
RUBRIC = """Classify a Hinglish message into ONE category, then map to a binary label.
Categories:
- USE_SLUR: an explicit slur used against a woman          -> MGY
- IMPLICIT: stereotyping / moral-policing / objectification -> MGY
- COUNTER: a slur only condemned / reported (counter-speech) -> NOT
- BENIGN_GENDERED: a neutral/positive statement about a woman -> NOT
- NEUTRAL: unrelated content                                 -> NOT
End with a final line exactly "LABEL: MGY" or "LABEL: NOT"."""
EITHER = '"\nLabel (MGY or NOT):'
EXAMPLES = "\n\n".join(f'Message: "{t}"\nLabel: {y}' for t, y in FEWSHOT)
#: prompt_id, system, what stands before the text, what stands after it.
PROMPTS = [
    ("minimal", f"You classify messages as misogynistic or not. {ONE_TOKEN}", 'Message: "', '"\nLabel:'),
    ("definition", f"You are a misogyny classifier for code-mixed Hinglish. Misogyny = hostility, contempt, slurs, stereotyping, moral-policing, or objectification targeting women. {ONE_TOKEN}", 'Message: "', EITHER),
    ("usemention", RULE, 'Message: "', EITHER),
    ("cot", RULE + '\nFirst reason briefly, then end with a final line exactly "LABEL: MGY" or "LABEL: NOT".', 'Message: "', '"\nThink step by step about who the slur/claim targets and whether it is used or merely condemned, then give the LABEL line.'),
    ("fewshot", RULE, EXAMPLES + '\n\nMessage: "', '"\nLabel:'),
    ("role", f"You are an experienced Trust & Safety content moderator fluent in Hinglish. You protect women from abuse but you must not flag people who are condemning or reporting abuse. {ONE_TOKEN}", 'Moderate this message. Message: "', EITHER),
    ("translate", RULE + '\nFirst translate the message to English, then classify. End with "LABEL: MGY" or "LABEL: NOT".', 'Message (Hinglish): "', '"\nTranslate to English, then decide, then give the LABEL line.'),
    ("rubric", RUBRIC, 'Message: "', '"\nPick the category, then give the LABEL line.'),
]


def prompts(spark: SparkSession) -> DataFrame:
    """prompt_id, system, prefix, suffix."""
    return spark.createDataFrame(PROMPTS, "prompt_id string, system string, prefix string, suffix string")


def render_prompts(rows: DataFrame, of: DataFrame) -> DataFrame:
    """prompt_id, id, system, user: every prompt with every text; the eight prompts are broadcast."""
    return rows.select("id", "text").crossJoin(F.broadcast(of)).select("prompt_id", "id", "system", F.concat("prefix", "text", "suffix").alias("user"))


# The single prompt of the plain baseline.
SINGLE_SYSTEM = """You are a careful content-moderation classifier for code-mixed Hinglish (Romanised Hindi + English).
Decide whether a message is MISOGYNISTIC (label MGY) or NOT (label NOT).
CRITICAL: a slur being *mentioned, quoted, or condemned* (counter-speech, e.g. "don't call her X", "calling her X is wrong") is NOT misogynistic.
A slur or sexist claim *directed at / used against* a woman IS misogynistic.
Implicit misogyny (stereotyping, moral-policing, objectification) with no slur is still MGY.
Answer with exactly one token: MGY or NOT."""
SINGLE = [("single", SINGLE_SYSTEM, 'Message: "', EITHER)]


def single_prompt(spark: SparkSession) -> DataFrame:
    """The one prompt of the plain baseline, as a relation like prompts()."""
    return spark.createDataFrame(SINGLE, "prompt_id string, system string, prefix string, suffix string")


def http_client(base: str, key: str, model: str, max_tokens: int = 200, timeout: float = 60.0) -> Callable[[str, str], str]:
    """A client of a chat-completions service at base: temperature 0, the first choice's text; errors are raised."""

    def client(system: str, user: str) -> str:
        body = {"model": model, "temperature": 0, "max_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(f"{base.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            choices = json.load(answer).get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""

    return client


def call_model(rendered: DataFrame, client: Callable[[str, str], str], tries: int = 3, skip: bool = False, pause: float = 0.0, per_second: float | None = None) -> DataFrame:
    """prompt_id, id, raw: client(system, user) for every row, tried up to `tries` times; then its error ends the task, or with skip the row has a null.

    pause: seconds before the second try, twice as many before each further one; per_second: calls that a
    task makes at most.
    """

    def asked(system: str, user: str) -> str | None:
        for k in range(tries):
            try:
                return client(system, user)
            except Exception:  # whatever a client raises
                if k + 1 == tries and not skip:
                    raise
                time.sleep(pause * 2**k if k + 1 < tries else 0)
        return None

    def paced(system: str, user: str) -> str | None:
        began = time.monotonic()
        raw = asked(system, user)
        if per_second:
            time.sleep(max(0.0, 1 / per_second - (time.monotonic() - began)))
        return raw

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"prompt_id": b.prompt_id, "id": b.id, "raw": [paced(s, u) for s, u in zip(b.system, b.user)]})

    return rendered.mapInPandas(run, f"prompt_id string, id {dict(rendered.dtypes)['id']}, raw string")


def ask_and_store(rows: DataFrame, of: DataFrame, client: Callable[[str, str], str], model: str, store: Store, parts: int = 1, **options) -> DataFrame:
    """model, prompt, id, label, pred and the other columns of rows, as run_prompts(), from answers that a store keeps.

    Each different text is asked once per prompt, and only if the store (keys model, prompt, text_md5) has
    no answer to it. Answers are stored prompt by prompt and in `parts` of the texts, so a run that dies
    loses the part it was at; the next run asks the rest. Texts without an answer (skip) are asked again
    by the next run and have no row.
    """
    marked = rows.withColumn("text_md5", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    texts = marked.groupBy(F.col("text_md5").alias("id")).agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    for prompt in of.collect():  # the prompts, a handful
        for part in range(parts):
            mine = texts.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
            if (known := store.read()) is not None:
                there = known.where((F.col("model") == model) & (F.col("prompt") == prompt.prompt_id)).select(F.col("text_md5").alias("id"))
                mine = mine.join(there, "id", "left_anti")
            one = rows.sparkSession.createDataFrame([prompt], of.schema)
            raw = call_model(render_prompts(mine, one), client, **options).where("raw is not null")
            answers = written(raw.select(F.lit(model).alias("model"), F.col("prompt_id").alias("prompt"), F.col("id").alias("text_md5"), "raw"))
            if not answers.isEmpty():
                store.put(answers)
    known = store.read()
    if known is None:
        known = rows.sparkSession.createDataFrame([], "model string, prompt string, text_md5 string, raw string")
    asked = known.where(F.col("model") == model).join(F.broadcast(of.select(F.col("prompt_id").alias("prompt"))), "prompt", "left_semi")
    read = asked.select("model", "prompt", "text_md5", X.parse_label(F.col("raw")).alias("pred"))
    return marked.join(read, "text_md5").drop("text_md5")


def classify(rows: DataFrame, client: Callable[[str, str], str], **options) -> DataFrame:
    """id, pred of the plain baseline: one prompt, and MGY where the answer names it; rows without an answer are skipped."""
    raw = call_model(render_prompts(rows, single_prompt(rows.sparkSession)), client, skip=True, **options).where("raw is not null")
    return raw.select("id", X.coerce_prediction(F.col("raw")).alias("pred"))


def run_prompts(rows: DataFrame, of: DataFrame, client: Callable[[str, str], str], model: str, **options) -> DataFrame:
    """model, prompt, id, label, pred and the other columns of rows: every prompt rendered, asked and its answer read."""
    raw = call_model(render_prompts(rows, of), client, **options).where("raw is not null")
    read = raw.select(F.lit(model).alias("model"), F.col("prompt_id").alias("prompt"), "id", X.parse_label(F.col("raw")).alias("pred"))
    return rows.join(read, "id")
