"""Mixing sources to target weights by a low-discrepancy schedule.

Point i of the schedule is the fractional part of i times the golden ratio; on the line of cumulative
targets it falls into the part of one source, so every stretch of the schedule has nearly the target
shares. A source's documents, shuffled by a hash, lie end to end on a line of words that is cut into
equal blocks, and the blocks are shuffled once more for each of the line's two laps. A source's points
are ranked, and its r-th slot brings block r of its shuffled laps: that is where in the mix a block
stands. A source stops when its slots have its target; points of sources that have theirs are passed
over. The last block brings only what is missing.

Nothing is ranked in one task: slots are ranked within stretches and documents placed within hash
buckets, and only the sums of stretches and buckets are added up over a whole source.

Defined cases: a null or empty text has size 0 and is taken 0 times, in no slot; null sources form one
source, last in order; rows of one id and text are interchangeable; texts of any length are cut into
blocks like others; an empty table gives no rows. Other columns may have any names: the query doesn't
read them, and the mixed documents carry them. More than SOURCES sources raise ValueError.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has so many times all words; a source gives at most LIMIT times its own.
SHARE, LIMIT = 1.5, 2.0
#: Words of a block: at most MOST, and few enough that there are about SLOTS slots for each source.
MOST, SLOTS = 1024, 200
#: Slots of one stretch, and documents of one bucket.
STRETCH, BUCKET = 1 << 14, 2000
#: The driver and every task hold one row for each source: no more than so many.
SOURCES = 200_000
#: The golden ratio's multiples modulo 1 in integers: i * STEP modulo 2^BITS.
BITS = 40
STEP = int((5**0.5 - 1) / 2 * (1 << BITS)) | 1


def words(text: Column) -> Column:
    """How many matches of [^\\x20\\x09-\\x0D]+ a text has (null: 0): the places where one begins."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(spaced) - F.length(F.translate(spaced, "w", ""))).cast("bigint")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text with what stands between them."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.concat_ws("", F.slice(ends, F.lit(1), n.cast("int")))


def targets(sizes: list[tuple], weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Targets of sources in order: share of all words by weight, none above limit times its size, the excess dealt out again by weight."""
    size = [float(s) for s in sizes]
    weight = [weights[k % len(weights)] for k in range(len(size))]
    left, out, free = share * sum(size), [0.0] * len(size), [k for k in range(len(size)) if size[k] > 0]
    while free:
        unit = left / sum(weight[k] for k in free)
        full = [k for k in free if unit * weight[k] > limit * size[k]]
        if not full:
            for k in free:
                out[k] = unit * weight[k]
            break
        for k in full:
            out[k] = limit * size[k]
            left -= out[k]
        free = [k for k in free if k not in set(full)]
    return out


def _coprime(n: int) -> int:
    """A number near n times the golden ratio (2^20 at most) without a divisor in common with n: its multiples modulo n are a shuffle."""
    m = max(1, int(0.618 * min(n, 1 << 20)))
    while math.gcd(m, n) > 1:
        m += 1
    return m


def schedule(spark: SparkSession, need: list[int], step: int = STEP) -> DataFrame:
    """k, r, slot: the place in the schedule of the r-th slot of source k, which has need[k] slots."""
    slots = sum(need)
    line = 1 << BITS
    cells = 1 << min(20, max(10, len(need).bit_length()))
    edges, at = [], 0
    for k, m in enumerate(need):
        if m:
            edges.append((k, at * line // slots, (at + m) * line // slots, m))
        at += m
    # the part of each source by the cells of the line that it meets
    parts = spark.createDataFrame(edges, "k int, low long, high long, need long")
    width = line // cells
    parts = parts.withColumn("cell", F.explode(F.sequence((F.col("low") / width).cast("bigint"), ((F.col("high") - 1) / width).cast("bigint"))))
    # some more points than slots: sources are a few points early or late
    n = slots + slots // 8 + 64
    half = 1 << (BITS // 2)
    low, high = F.pmod(F.col("id"), F.lit(half)), F.pmod((F.col("id") / half).cast("bigint"), F.lit(half))
    point = F.pmod(low * step + F.pmod(high * step, F.lit(half)) * half, F.lit(line))
    timed = spark.range(0, n, 1, max(1, min(n // (8 * STRETCH) + 1, 10_000))).select("id", (F.col("id") / STRETCH).cast("bigint").alias("stretch"), point.alias("x"))
    timed = timed.withColumn("cell", (F.col("x") / width).cast("bigint")).join(F.broadcast(parts), "cell").where("x >= low and x < high")
    stretch = timed.groupBy("k", "stretch").agg(F.count("*").alias("n"))
    before = stretch.select("k", "stretch", (F.sum("n").over(Window.partitionBy("k").orderBy("stretch")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("k", "stretch").orderBy("id")) - 1
    ranked = timed.withColumn("r", within.cast("bigint")).join(before, ["k", "stretch"]).select("k", (F.col("r") + F.col("before")).alias("r"), "need", "id").where("r < need")
    # slots that a source still lacks after these points come at the end, in turns
    had = stretch.groupBy("k").agg(F.sum("n").alias("n"))
    owed = spark.createDataFrame([(e[0], e[3]) for e in edges], "k int, need long").join(had, "k", "left")
    owed = owed.select("k", F.coalesce("n", F.lit(0)).alias("n"), "need").where("n < need").select("k", "n", F.explode(F.expr("sequence(n, need - 1)")).alias("r"))
    late = owed.select("k", "r", (F.lit(n) + (F.col("r") - F.col("n")) * len(need) + F.col("k")).alias("id"))
    return ranked.select("k", "r", F.col("id").alias("slot")).unionByName(late.withColumnRenamed("id", "slot"))


def taken_blocks(docs: DataFrame, size: Column | None = None, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """The documents on their lines (key, doc_id, source, h1, h2, size, source_size, target), and what the mix takes of them: key, h1, h2, size, lap, slot (the first), w (words)."""
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text")
    sized = staged(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), (words(text) if size is None else size).alias("size"), *text_key()), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).limit(SOURCES + 1).collect()
    if len(per) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    per = sorted(per, key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    goal = targets([r.n for r in per])
    whole = [min(round(g), int(LIMIT * r.n)) for g, r in zip(goal, per)]
    block = max(1, min(MOST, int(sum(goal) / (SLOTS * max(1, len(per))))))
    facts, need = [], []
    for k, r in enumerate(per):
        full, lap = r.n // block, -(-r.n // block)
        need.append(-(-whole[k] // block) if whole[k] <= r.n else lap + -(-(whole[k] - r.n) // block))
        facts.append((k, r.source, int(r.n), goal[k], whole[k], full, lap, _coprime(full) if full else 1, r.docs // BUCKET + 1))
    facts = F.broadcast(spark.createDataFrame(facts, "k int, of string, source_size long, target double, whole long, full long, per_lap long, turn long, buckets long"))

    # the lines of words: where each document lies in its source
    placed = sized.join(facts, sized.source.eqNullSafe(facts.of)).drop("of").withColumn("bucket", F.pmod("h1", "buckets"))
    sums = placed.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    offset = sums.select("k", "bucket", (F.sum("n").over(Window.partitionBy("k").orderBy("bucket")) - F.col("n")).alias("offset"))
    inner = F.sum("size").over(Window.partitionBy("k", "bucket").orderBy("h2", "h1", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    lines = placed.withColumn("inner", inner).join(offset, ["k", "bucket"]).withColumn("begin", F.col("inner") + F.col("offset")).withColumn("key", F.monotonically_increasing_id())
    lines = staged(lines.drop("bucket", "buckets", "inner", "offset"), "lines")

    # a document's part of each block, the block's rank in each lap, and the slot of that rank
    piece = lines.where("size > 0").withColumn("block", F.explode(F.sequence((F.col("begin") / block).cast("bigint"), ((F.col("begin") + F.col("size") - 1) / block).cast("bigint"))))
    piece = piece.withColumn("a", F.greatest("begin", F.col("block") * block)).withColumn("w", F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.col("a"))
    piece = piece.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
    rank = F.when(F.col("block") >= F.col("full"), F.col("full")).otherwise(F.expr("pmod(turn * block + lap * (full div 2), greatest(full, 1L))"))
    piece = piece.withColumn("rank", rank).withColumn("at", F.col("lap") * F.col("source_size") + F.col("rank") * block + F.col("a") - F.col("block") * block)
    piece = piece.withColumn("w", F.least(F.col("w"), F.col("whole") - F.col("at"))).where("w > 0").select("key", "h1", "h2", "size", "k", "lap", "w", (F.col("lap") * F.col("per_lap") + F.col("rank")).alias("r"))
    if not sum(need):
        return lines, piece.select("key", "h1", "h2", "size", "lap", F.lit(0).cast("bigint").alias("slot"), "w")
    met = piece.join(schedule(spark, need, step), ["k", "r"])
    return lines, met.groupBy("key", "h1", "h2", "size", "lap").agg(F.min("slot").alias("slot"), F.sum("w").alias("w"))


def text_key() -> list[Column]:
    """Two hashes of doc_id and text: rows that agree in both have one id and text."""
    return [F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull()).alias(name) for seed, name in (("mix", "h1"), ("order", "h2"))]


def mix(docs: DataFrame, size: Column | None = None, step: int = STEP) -> DataFrame:
    """docs' doc_id and source with size, source_size, target, taken (words of the document that the mix takes, repeats counted) and first_slot (the place in the mix of the first block with words of it)."""
    lines, blocks = taken_blocks(docs, size, step)
    taken = blocks.groupBy("key").agg(F.sum("w").alias("taken"), F.min("slot").alias("first_slot"))
    return lines.join(taken, "key", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, step: int = STEP) -> DataFrame:
    """The mix as documents: each as often as it is taken, the last time perhaps with its first words only; n_chars is counted anew.

    Each partition has a random part of the documents, in the order of the schedule: every file of the
    mix, and every beginning of one, has nearly the target shares.
    """
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    rows = docs.select(*text_key(), F.struct(*names).alias("row")).withColumnsRenamed({"h1": "a1", "h2": "a2"})
    takes = taken_blocks(docs, step=step)[1].groupBy("h1", "h2", "size", "lap").agg(F.min("slot").alias("slot"), F.sum("w").alias("w"))
    # rows of one id and text are one text, taken as often as all of them
    takes = takes.groupBy("h1", "h2", "size").agg(F.collect_list(F.struct("lap", "slot", "w")).alias("laps"))
    met = rows.join(takes, (F.col("a1") == F.col("h1")) & (F.col("a2") == F.col("h2"))).dropDuplicates(["h1", "h2"])
    met = met.withColumn("take", F.explode("laps")).withColumn("n", F.explode(F.expr("transform(sequence(0, (take.w - 1) div size), i -> least(size, take.w - i * size))")))
    met = met.sortWithinPartitions("take.slot", "h1", "h2")
    text = F.when(F.col("n") >= F.col("size"), F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("n")))
    return met.withColumn("made", text).select(*[F.col("made").alias(c) if c == "text" else F.length("made").cast("bigint").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).drop("source")
