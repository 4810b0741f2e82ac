"""A paired corpus: minimal pairs of use and counter-speech, of implicit claims and overlapping harmless ones, and neutral filler.

Slots are filled by hash of the pair's number, so the corpus is the same on every machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import write_csv
from .folds import shuffled

# Slots, frames with {S} subject, {T} token, {G} garment, and how often each frame is filled.
SUBJECTS = ["ladki", "ladkiyon", "aurat", "mahila", "women", "girl", "larki", "woman", "us ladki", "us aurat"]
GARMENTS = ["jeans", "shorts", "crop top", "western kapde", "skirt", "dress"]
N_TOKENS = 20
USE = [
    "{S} ko {T} bol diya.",
    "{S} ko {T} keh ke DM kiya.",
    "comment section me {S} ko {T} likh diya.",
    "{S} ko {T} bol ke tag kar diya.",
    "online sab {S} ko {T} keh rahe hain.",
    "{S} ne {G} pehna to log {T} bolne lage.",
    "{S} ko public post me {T} likha gaya.",
    "group me {S} ko {T} keh ke chhed rahe the.",
]
COUNTER = [
    "{S} ko {T} bolna bilkul galat hai.",
    "kisi {S} ko {T} mat bolo.",
    "{S} ko {T} kehna turant band karo.",
    "{T} jaise shabd {S} ke liye use mat karo.",
    "report karo agar koi {S} ko {T} bole.",
    "{S} ko {T} bolna kisi bhi haal me sahi nahi.",
    "please {S} ko {T} mat kaho, ye galat hai.",
    "{S} ko {T} kehne walon ko block karo.",
]
IMPLICIT = {
    "ghar": "{S} ka kaam sirf ghar sambhalna hai.",
    "kapde": "{S} ko {G} nahi pehनना chahiye, sanskaar khatam.",
    "kaam": "{S} ka kaam office me nahi, kitchen me hai.",
    "padhai": "{S} ko zyada padhne ki zaroorat nahi hoti.",
    "driving": "{S} dhang se gaadi chala hi nahi sakti.",
    "leadership": "{S} emotional hoti hai, team lead nahi kar sakti.",
    "bahar": "{S} ko raat ko bahar nikalna hi nahi chahiye.",
}
OVERLAP = {
    "ghar": "{S} ghar aur office dono badhiya sambhal leti hai.",
    "kapde": "{S} ne aaj {G} liye, look acha tha.",
    "kaam": "{S} ne aaj ka kaam time se pehle finish kiya.",
    "padhai": "{S} ne entrance exam top kiya, proud moment.",
    "driving": "{S} ne lambi highway drive solo complete ki.",
    "leadership": "{S} ne meeting bahut confidently lead ki.",
    "bahar": "{S} raat ki shift karke safe ghar pahunch gayi.",
}
NEUTRAL = [
    "kal standup kitne baje hai?",
    "weekend plans bana liye kya?",
    "PR me comments resolve kar do.",
    "coffee peene chalte ho?",
    "meeting notes share kar dena.",
    "laptop charge rehna chahiye meeting se pehle.",
    "aaj ka match dekhoge?",
    "client call postpone ho gaya.",
    "presentation kal tak ready ho jayegi.",
    "code review kal subah rakho.",
]
COPIES_USE, COPIES_TOPIC, COPIES_NEUTRAL = 9, 13, 9


def frame_rows() -> list[tuple]:
    """(first pair or row number, copies, half, category, frame_id, label, pattern, has token) of each frame."""
    out, pair = [], 1
    for k, (use, counter) in enumerate(zip(USE, COUNTER)):
        out += [(pair, COPIES_USE, 0, "USE_SLUR", f"USE_SLUR:{k}", "MGY", use, True), (pair, COPIES_USE, 1, "COUNTER", f"COUNTER:{k}", "NOT", counter, True)]
        pair += COPIES_USE
    for topic in IMPLICIT:
        out += [(pair, COPIES_TOPIC, 0, "IMPLICIT", f"IMPLICIT:{topic}", "MGY", IMPLICIT[topic], False), (pair, COPIES_TOPIC, 1, "BENIGN_OVERLAP", f"BENIGN_OVERLAP:{topic}", "NOT", OVERLAP[topic], False)]
        pair += COPIES_TOPIC
    row = 2 * (pair - 1) + 1
    for k, pattern in enumerate(NEUTRAL):
        out.append((row, COPIES_NEUTRAL, 2, "BENIGN_NEUTRAL", f"BENIGN_NEUTRAL:{k}", "NOT", pattern, False))
        row += COPIES_NEUTRAL
    return out


def _draw(what: str, key: Column, n: int) -> Column:
    """A number below n from the first byte of md5(what:key)."""
    h = F.md5(F.concat(F.lit(f"{what}:"), key.cast("string")).cast("binary"))
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(h, k, 1)) - 1
    return (digit(1) * 16 + digit(2)) % n


def gen_rows(spark: SparkSession, seeds: DataFrame | None = None) -> DataFrame:
    """id, text, label, category, frame_id, pair_id, subject, token; with seeds (one text column), a corpus drawn anew for each, which stands first."""
    frames = spark.createDataFrame(frame_rows(), "base int, copies int, half int, category string, frame_id string, label string, pattern string, has boolean")
    rows = frames.withColumn("number", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("copies") - 1)))
    key, first = F.col("number"), []
    if seeds is not None:
        # the 40 frames go to the seeds
        rows, first = seeds.crossJoin(F.broadcast(rows)), seeds.columns
        key = F.concat(F.coalesce(F.col(first[0]), F.lit("")), F.lit(":"), F.col("number").cast("string"))
    paired = F.col("half") < 2
    pick = lambda of, at: F.element_at(F.array(*[F.lit(x) for x in of]), at + 1)
    subject = F.when(paired, pick(SUBJECTS, _draw("S", key, len(SUBJECTS)))).otherwise("")
    token = F.when(F.col("has"), F.format_string("[FSLUR_%02d]", _draw("T", key, N_TOKENS) + 1)).otherwise("")
    # implicit and overlapping halves draw their garments apart
    garment = pick(GARMENTS, F.when(F.col("half") == 0, _draw("G0", key, len(GARMENTS))).otherwise(_draw("G1", key, len(GARMENTS))))
    text = F.replace(F.replace(F.replace("pattern", F.lit("{S}"), subject), F.lit("{T}"), token), F.lit("{G}"), garment)
    uid = F.when(paired, 2 * (F.col("number") - 1) + F.col("half") + 1).otherwise(F.col("number"))
    pair = F.when(paired, F.concat(F.lit("P"), F.col("number").cast("string"))).otherwise("")
    return rows.select(*first, F.format_string("D%04d", uid).alias("id"), text.alias("text"), "label", "category", "frame_id", pair.alias("pair_id"), subject.alias("subject"), token.alias("token"))


def gen_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, category, label, n, n_pairs, n_frames, n_token_rows."""
    return rows.groupBy(*by, "category", "label").agg(F.count("*").alias("n"), F.countDistinct(F.nullif("pair_id", F.lit(""))).alias("n_pairs"), F.countDistinct("frame_id").alias("n_frames"), F.sum((F.col("token") != "").cast("int")).alias("n_token_rows"))


def static_predictions() -> list[tuple]:
    """frame_id, pred, conf: a fixed answer for each of the 40 frames."""
    unsure = {"IMPLICIT:bahar", "USE_SLUR:5", "USE_SLUR:6"}
    return [(f, "MGY" if c in ("USE_SLUR", "IMPLICIT") else "NOT", "borderline" if f in unsure else "high") for _, _, _, c, f, _, _, _ in frame_rows()]


def write_corpus(spark: SparkSession, path: str, seed: int = 12346) -> DataFrame:
    """Writes the corpus as CSV in a seeded order, in one file since it has 416 rows, and returns its rows with their place."""
    rows = shuffled(gen_rows(spark), seed)
    write_csv(rows.coalesce(1).sortWithinPartitions("pos").drop("pos"), path)
    return rows
