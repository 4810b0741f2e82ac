"""URL filters by cascades of Bloom filters, in built-in expressions alone.

A cascade holds which keys of a universe are listed. Level 0 is a Bloom filter of the listed keys,
level 1 one of the other keys that pass level 0, level 2 one of the listed keys that pass level 1, and
so on until none passes. A key's answer is read off the first level that it doesn't pass. Since the
levels are made over every key of the corpus, the answer is exact for each of them, and reading it
takes no join: the filters are one value of 64-bit words in a task's memory.

Two cascades judge a URL. One tells which of the URL's candidates (its host or an end of it, and a
beginning of its path, in the lengths that rules have) are rules; the longest is the URL's rule. The
other tells which rules and which hosts are to be blocked; a URL without a rule has its host's verdict.

Size: a cascade takes about 1.44 log2(others / listed) + 23 bits for each listed key that occurs (the
second part less for more than a million). Above MOST_BYTES it is cut by the keys' hash into parts, and
rows take one part after the other, written to the shared folder between them; nothing is shuffled.

Defined cases: a null URL or one without :// has an empty host and path, no rule and the verdict allow;
null and repeated page ids are rows like others; hosts are compared as they stand (ports and user
parts included) after A-Z to a-z; of rules with one host and path block wins; of a URL's rules with
equal length the one with the longer host wins; rules without a host are not taken; URLs of any length
are taken whole; an empty table gives an empty result; columns other than page_id and url are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Bytes of filters that a task holds at once.
MOST_BYTES = 32 << 20
#: Words of 64 bits in one block of a filter.
BLOCK = 4096
#: Levels of up to so many keys let one key in 65,536 pass, larger ones one in 16.
SMALL = 1 << 20
MOST_LEVELS = 100
#: The rules of the query, as host, path and verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
lit = F.lit


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its place among the cascade's levels, its first block, its bits and hashes."""

    place: int
    block: int
    bits: int
    hashes: int

    def positions(self, key: Column) -> list[Column]:
        """The bits of a key: two halves of one hash, the second taken 0, 1, 2, ... times."""
        h = F.xxhash64(key, lit(self.place))
        return [(F.shiftrightunsigned(h, 32) + lit(i) * h.bitwiseAND(0xFFFFFFFF)) % self.bits for i in range(self.hashes)]

    def passes(self, filters: Column, key: Column) -> Column:
        """Whether all bits of a key are set; filters is an array of blocks, each an array of words."""
        set_ = lambda p: F.getbit(F.get(F.get(filters, (lit(self.block) + F.shiftright(p, 18)).cast("int")), F.shiftright(p, 6).bitwiseAND(BLOCK - 1).cast("int")), p.bitwiseAND(63).cast("int")) == 1
        return F.forall(F.array(*self.positions(key)), set_)


@dataclass(frozen=True)
class Part:
    """The cascade of the keys of one part of the hash space: a table of blocks, and the levels in them."""

    blocks: DataFrame
    levels: list[Level]

    def filters(self) -> Column:
        """All blocks in order, as one value."""
        return self.blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "words"))), lambda b: b["words"])).scalar()

    def lists(self, filters: Column, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        told = lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            told = F.when(level.passes(filters, key), told).otherwise(lit(level.place % 2 == 1))
        return told


@dataclass(frozen=True)
class Cascade:
    """Exact membership of the keys of a universe."""

    parts: list[Part]

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, lit("part")), lit(len(self.parts)))

    def mark(self, rows: DataFrame, keys: str, name: str) -> DataFrame:
        """rows with an array of booleans: which keys of an array of strings are listed."""
        rows = rows.withColumn(name, F.transform(keys, lambda k: lit(False)))
        for n, part in enumerate(self.parts):
            if not part.levels:
                continue
            here = rows.select("*", part.filters().alias("_filters"))
            found = lambda k, old: old | ((self.part(k) == n) & part.lists(F.col("_filters"), k))  # noqa: B023, E731
            rows = here.withColumn(name, F.zip_with(keys, name, found)).drop("_filters")
            rows = staged(rows, "marked") if len(self.parts) > 1 else rows
        return rows


def _shape(n: int, others: int, place: int) -> tuple[int, int]:
    """Bits and hashes of a level of n keys: the first lets about n of the others pass, the later ones few."""
    hashes = min(16, max(1, math.ceil(math.log2(max(1, others) / n)))) if place == 0 and others else 16 if n <= SMALL else 4
    return 64 * math.ceil(max(64, n * hashes / math.log(2)) / 64), hashes


def _blocks(keys: DataFrame, level: Level) -> DataFrame:
    """block, words of a level; bits are set by an aggregate over words, blocks have all their words."""
    n = math.ceil(level.bits / 64 / BLOCK)
    set_ = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p")).select(F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int")).alias("b"))
    none = keys.sparkSession.range(n * BLOCK).select(F.col("id").alias("w"), lit(0).cast("bigint").alias("b"))
    words = set_.unionByName(none).groupBy("w").agg(F.bit_or("b").alias("b"))
    block = words.groupBy(F.floor(F.col("w") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("x"))
    return block.select((F.col("block") + level.block).cast("int").alias("block"), F.transform("x", lambda w: w["b"]).alias("words"))


def _part(universe: DataFrame) -> Part:
    spark = universe.sparkSession
    # the keys that the next level encodes, and those that it must keep out
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    n, others = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    made, levels, block = None, [], 0
    while n:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = Level(len(levels), block, *_shape(n, others, len(levels)))
        this = staged(_blocks(inside, level), "level")
        made = this if made is None else made.unionByName(this)
        passed = staged(outside.select("key", Part(this.withColumn("block", F.col("block") - block), []).filters().alias("_f")).where(Level(level.place, 0, level.bits, level.hashes).passes(F.col("_f"), F.col("key"))).select("key"), "passed")
        levels.append(level)
        block += math.ceil(level.bits / 64 / BLOCK)
        inside, outside, n, others = passed, inside, passed.count(), n
    return Part(spark.range(0).select(F.col("id").cast("int").alias("block"), F.array("id").alias("words")) if made is None else made, levels)


def cascade(universe: DataFrame, listed: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade:
    """The cascade of the listed keys that occur in a universe; both have a column key (null is no key), repeated or not."""
    keys = universe.select("key", lit(False).alias("listed")).unionByName(listed.select("key", lit(True).alias("listed"))).where("key is not null")
    keys = staged(keys.groupBy("key").agg(F.bool_or(~F.col("listed")).alias("occurs"), F.bool_or("listed").alias("listed")).where("occurs").select("key", "listed"), "keys")
    n, n_listed = keys.agg(F.count("*"), F.count_if("listed")).first()
    bits, _ = _shape(n_listed, n - n_listed, 0) if n_listed else (0, 0)
    whole = Cascade([Part(keys, [])] * max(1, math.ceil((bits + 23 * n_listed) / 8 / most_bytes)))
    if len(whole.parts) == 1:
        return Cascade([_part(keys)])
    return Cascade([_part(keys.where(whole.part(F.col("key")) == n)) for n in range(len(whole.parts))])


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every page."""
    url = F.coalesce(F.col("url").cast("string"), lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER)
    return pages.select("page_id", rest.alias("rest")).select("page_id", host.alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def cleaned(rules: DataFrame) -> DataFrame:
    """rule (host and path), host, path, verdict, each rule once."""
    whole = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", lit("")).alias("path"), "verdict").where("host <> ''")
    return whole.groupBy(F.concat("host", "path").alias("rule"), "host", "path").agg(F.max("verdict").alias("verdict"))


def _candidates(rules: DataFrame) -> Column:
    """What could be a URL's rules, longest first: the lengths of hosts and paths come from the rules."""
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")).distinct().agg(F.collect_list(F.struct("labels", "n"))).scalar()
    fits = lambda s: (s["labels"] <= F.size(F.split("host", r"\."))) & (s["n"] <= F.length("path"))
    ends = lambda s: F.struct(F.call_function("substring_index", F.col("host"), lit("."), -s["labels"]).alias("h"), F.substring(F.col("path"), lit(1), s["n"]).alias("p"))
    found = F.transform(F.filter("_shapes", fits), ends)
    order = F.transform(found, lambda c: F.struct((-F.length(c["h"]) - F.length(c["p"])).alias("a"), (-F.length(c["h"])).alias("b"), F.concat(c["h"], c["p"]).alias("key")))
    return shape, F.transform(F.array_sort(order), lambda c: c["key"])


def with_rules(pages: DataFrame, rules: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule of every page: the longest rule of a host or a part of its end whose path begins the URL's."""
    rules = cleaned(rules)
    shapes, keys = _candidates(rules)
    rows = parsed(pages).select("*", shapes.alias("_shapes")).select("page_id", "host", "path", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(keys).alias("keys"))
    is_rule = cascade(rows.select(F.explode("keys").alias("key")), rules.select(F.col("rule").alias("key")), most_bytes)
    marked = is_rule.mark(rows, "keys", "hits")
    rule = F.get(F.col("keys"), F.array_position("hits", True).cast("int") - 1)
    return staged(marked.select("page_id", "host", "path", rule.alias("rule")), "rules")


def with_verdicts(found: DataFrame, rules: DataFrame, hosts: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict: what with_rules() gives and block or allow, by the rule or else by the listed hosts (column host)."""
    key = F.when(F.col("rule").isNotNull(), F.concat(lit("rule:"), "rule")).otherwise(F.concat(lit("host:"), "host"))
    rows = found.withColumn("keys", F.array(key))
    blocking = cleaned(rules).where("verdict = 'block'").select(F.concat(lit("rule:"), "rule").alias("key"))
    listed = blocking.unionByName(hosts.where("host <> ''").select(F.concat(lit("host:"), F.translate("host", UPPER, LOWER)).alias("key")))
    blocked = cascade(rows.select(F.get("keys", lit(0)).alias("key")), listed, most_bytes).mark(rows, "keys", "hits")
    return blocked.select("page_id", "host", "path", "rule", F.when(F.get("hits", lit(0)), "block").otherwise("allow").alias("verdict"))


def mostly_blocked(found: DataFrame, rules: DataFrame) -> DataFrame:
    """host: those of which rules block more pages than they allow."""
    counts = found.where("rule is not null").groupBy("host", "rule").agg(F.count("*").alias("n")).join(cleaned(rules).select("rule", "verdict"), "rule")
    votes = counts.groupBy("host").agg(F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(-F.col("n"))).alias("votes"))
    return votes.where("votes > 0").select("host")


def rules_table(spark: SparkSession) -> DataFrame:
    """The query's rules as a table."""
    rows = [F.struct(lit(h).alias("host"), lit(p).alias("path"), lit(v).alias("verdict")) for h, p, v in RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; hosts that rules block more often than they allow are listed."""
    rules = rules_table(spark)
    found = with_rules(table(spark, sf_dir, "pages"), rules)
    return with_verdicts(found, rules, mostly_blocked(found, rules))
