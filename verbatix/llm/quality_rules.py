"""Quality rules on repetition, from a suffix array over words.

All texts of a block share one suffix array, by prefix doubling: suffixes are ranked by document and
first word, then by twice as many words in each round, and only suffixes that are not told apart yet
are sorted again. The ranks of the rounds give the longest common prefix of neighbours; for each
position the longer of its two is the longest substring that starts there and occurs again. Those
that cannot be extended to the left are the maximal repeated substrings; their spans are united.

Defined cases: a null or empty text has no words and fails the base rule (fewer than 20 words);
repeated rows are judged one by one; texts of any length are judged whole, long ones in a suffix array
of their own; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, id_and_text, pairs, table, to_batch

#: Words of one suffix array; a longer text has one of its own.
BLOCK_WORDS = 400_000
#: A repeat counts from so many words on: shorter than the base rule's windows, so that texts made of short repeated lines are seen.
LEAST = 4
#: A text is rejected if repeats cover more than this part of its words, or the longest is longer than LONGEST words. Of the labelled
#: texts at sf0.1 that pass the base rule, those of good quality are covered by 0.28 at most and have no repeat of over 13 words.
COVERED, LONGEST = 0.40, 50


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and occurs again in its document.

    words: ids of all words, document after document; doc: each position's document, ascending.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, side="right")
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    levels, h = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        ahead = open_ + h
        second = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)], -1)
        k = rank[open_] * (n + 1) + second + 1
        o = np.argsort(k, kind="stable")
        at, k = open_[o], k[o]
        old = rank[at]
        place = np.arange(len(at))
        first_of_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        first_of_new = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], place, 0))
        rank = rank.copy()
        rank[at] = old + first_of_new - first_of_old
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    same = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[same], right[same]
    length = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        fits = (x < end[a]) & (y < end[b])
        fits[fits] = levels[k][x[fits]] == levels[k][y[fits]]
        length[fits] += 1 << k
    common[same] = length
    best = np.zeros(n, np.int64)
    best[left] = common
    best[right] = np.maximum(best[right], common)
    return best


def _united(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def maximal_repeats(best: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeated substrings of at least `least` words."""
    extends = np.r_[False, (best[:-1] == best[1:] + 1) & (doc[:-1] == doc[1:])]
    at = np.flatnonzero((best >= least) & ~extends)
    return at, best[at]


def measure(texts: list[bytes]) -> list[tuple[int, int, int, int, int, int, int]]:
    """For each text: words, word characters, symbols, repeated lines, words in repeated 8-word windows, words in repeats, longest repeat."""
    ids, cut = _Ids(), [t.split() for t in texts]
    size = np.array([len(w) for w in cut], np.int64)
    words = np.fromiter((ids[w] for t in cut for w in t), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(len(texts)), size)
    best = longest_repeats(words, doc)
    at = np.flatnonzero(best >= 8)
    window = np.bincount(doc[_united(at, np.full(len(at), 8), len(words))], minlength=len(texts))
    at, length = maximal_repeats(best, doc, LEAST)
    covered = np.bincount(doc[_united(at, length, len(words))], minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[at], length)
    out = []
    for k, t in enumerate(texts):
        bare = t.translate(None, SPACES)
        lines = [x for x in t.split(b"\n") if x.strip()]
        chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
        out.append((int(size[k]), chars, len(t) - len(t.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), int(window[k]), int(covered[k]), int(longest[k])))
    return out


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id with the figures of measure(), one row for each row of docs."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for i, t in pairs(b):
                held.append((i, t))
                size += len(t) // 6
                if size >= BLOCK_WORDS:
                    yield to_batch([(i, *m) for (i, _), m in zip(held, measure([t for _, t in held]))], schema)
                    held, size = [], 0
            if held:
                yield to_batch([(i, *m) for (i, _), m in zip(held, measure([t for _, t in held]))], schema)

    return arrow_map(id_and_text(docs), run, ", ".join(f"{n} long" for n in ("doc_id", *names)))


def judged(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("n_covered_words") <= COVERED * F.col("n_words")) & (F.col("longest_repeat") <= LONGEST)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and the verdict."""
    return judged(repetition(table(spark, sf_dir, "documents")))
