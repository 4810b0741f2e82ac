"""Toxicity by compression distance.

Two zstandard dictionaries are made from the texts of labelled rows. Both end in one that zstandard
trains on the ordinary texts; the toxic one begins with passages of toxic texts, the other with as many
zero bytes, so that distances to the shared part are equal. Where a passage stands in the shared part
too, with or without the blanks at its ends, it is overwritten with zero bytes there, so that the toxic
dictionary alone has it. Windows of several words slide over the whole text, each overlapping the next
one, whatever blanks the text has. The difference of a window's
two compressed lengths is its gain. Each gain has a weight, how much oftener (as a logarithm) windows of
toxic texts have it than those of ordinary ones; a text's weights are added up, and it is toxic from a
calibrated sum on. Weights and threshold come from texts that the dictionaries were not made of: each
half of the sample is scored with the dictionaries of the other half; the model has those of all of it.

Passages are found by the bytes of the texts, blanks included, so that short words and several words
together count as well as long words: strings that stand in many different contexts of toxic texts and
in hardly any ordinary text, the most telling first, each as long as nearly all its places share.
Places mostly within a chosen passage are no evidence for another one. As many are taken as there is evidence
for. Counting contexts, not texts, keeps copies of one toxic text from adding their words.

The sample is bounded: TOXIC and ORDINARY labelled rows, in the order of a hash of their ids.

Defined cases: a null or empty text has one window without a gain; rows without a label, or with a null
one, are scored but not learned from; without any toxic or any ordinary label every score is 0; repeated
rows are scored one by one; texts of any length are scored whole; an empty table gives no rows; columns
other than doc_id and text are not read, and are kept by keep_clean whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, id_and_text, pairs, table, to_batch

#: Labelled rows that are learned from, at most.
TOXIC, ORDINARY = 2000, 6000
#: Bytes of a window, and from one window's start to the next one's: what has up to WINDOW - STEP bytes is whole in some window.
WINDOW, STEP = 64, 32
#: zstandard's level, and the strategy that keeps its matches in a tree: it finds passages behind common beginnings wherever they are.
#: These and the windows were chosen by two halves of the sample, each scored with the other's dictionaries; held-out rows were not used.
LEVEL, STRATEGY, SEARCH = 13, zstandard.STRATEGY_BTLAZY2, 12
#: Windows that are compressed at once.
AT_ONCE = 20_000
#: Bytes of the dictionary of ordinary text (zstandard's usual size), and how many times as long its training text is at least.
DICTIONARY, SAMPLES = 112_640, 10
#: Lengths of the strings that passages grow from.
GRAMS = (4, 5, 6, 7, 8)
#: Gains outside these count as these.
LEAST, MOST = -6, 14
#: A string is telling from so many times as many toxic texts in a hundred as ordinary ones on.
TELLING = 5


def plain(text: bytes) -> bytes:
    """Lower-case text with single blanks between words and at its ends."""
    return b" " + b" ".join(text.translate(LOWER).split()) + b" "


def windows(text: bytes) -> Iterator[list[bytes]]:
    """Overlapping windows of the whole text, in lists of at most AT_ONCE."""
    starts = range(0, max(1, len(text) - (WINDOW - STEP)), STEP)
    for k in range(0, len(starts), AT_ONCE):
        yield [text[i : i + WINDOW] for i in starts[k : k + AT_ONCE]]


@dataclass(frozen=True)
class Model:
    """What is broadcast to score: two dictionaries and the calibration."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    needed: float = 0.0


def _grams(text: bytes, k: int) -> np.ndarray:
    """Every string of k bytes of a text, as a number."""
    x = np.frombuffer(text, np.uint8)
    out = np.zeros(max(0, len(x) - k + 1), np.uint64)
    for i in range(k if len(out) else 0):
        out <<= np.uint64(8)
        out |= x[i : i + len(out)]
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)


def _once(grams: np.ndarray) -> np.ndarray:
    grams = np.sort(grams)
    return grams[np.r_[True, grams[1:] != grams[:-1]]] if len(grams) else grams


def _evidence(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio statistic of strings in a toxic and b ordinary texts, with toxic ones at a share of all."""
    log = lambda x, of: x * np.log(np.maximum(x, 1) / np.maximum(of, 1e-9))
    return 2 * (log(a, (a + b) * share) + log(b, (a + b) * (1 - share)))


def _passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Passages typical of the toxic texts, the most telling first."""
    share = len(toxic) / (len(toxic) + len(ordinary))
    starts = np.cumsum([0] + [len(t) + 1 for t in toxic])
    edge = b"\0" * 16
    text = edge + b"\0".join(toxic) + edge
    x = np.frombuffer(text, np.uint8)
    found = []
    for k in GRAMS:
        grams = np.concatenate([_once(_grams(t, k)) for t in toxic])
        grams.sort()
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
        a = np.diff(np.r_[first, len(grams)])
        enough = (a >= 5) & (_evidence(a, 0 * a, share) >= 20)
        seen, a = grams[first[enough]], a[enough]
        del grams, first

        def among(t: bytes, k: int = k) -> tuple[np.ndarray, np.ndarray]:
            """Places in t of strings seen, and which ones."""
            g = _grams(t, k)
            at = np.flatnonzero(some[_slot(g)])
            which = np.minimum(np.searchsorted(seen, g[at]), len(seen) - 1)
            same = seen[which] == g[at]
            return at[same], which[same]

        some = np.zeros(1 << 22, bool)
        some[_slot(seen)] = True
        b = np.zeros(len(seen), np.int64)
        for t in ordinary if len(seen) else ():
            b[among(t)[1]] += 1
        telling = (a / len(toxic) >= TELLING * (b + 0.25) / len(ordinary)) & (_evidence(a, b, share) >= 20)
        seen, a, b = seen[telling], a[telling], b[telling]
        if not len(seen):
            continue
        some[:] = False
        some[_slot(seen)] = True
        places = [among(t) for t in toxic]
        at = np.concatenate([p + s + len(edge) for (p, _), s in zip(places, starts)])
        which = np.concatenate([w for _, w in places])
        around = np.zeros(len(at), np.uint64)
        for i in (*range(-8, 0), *range(k, k + 8)):
            around = around * np.uint64(0x100000001B3) ^ x[at + i]
        order = np.lexsort((around, which))
        new = np.r_[True, (which[order][1:] != which[order][:-1]) | (around[order][1:] != around[order][:-1])]
        contexts = np.bincount(which[order][new], minlength=len(seen))
        held = np.split(at[order], np.cumsum(np.bincount(which, minlength=len(seen)))[:-1])
        found += [(-round(float(e)), -k, text[p[0] : p[0] + k], p, int(m)) for e, p, m, n, c in zip(_evidence(a, b, share), held, b, a, contexts) if c >= 5 and 2 * c >= n]
    # for each byte, the length of the longest passage that covers it: a short one doesn't account for longer strings
    taken, out = np.zeros(len(text), np.int8), []
    for _, k, _, at, b in sorted(found, key=lambda f: f[:3]):
        k = -k
        at = at[2 * sum((taken[at + i] >= k - 2).astype(np.int8) for i in range(k)) <= k]
        n = len(np.unique(np.searchsorted(starts, at - len(edge), "right")))
        if n < 5 or _evidence(np.int64(n), np.int64(b), share) < 20:
            continue
        lo, hi, p = 0, k, at
        for right in (True, False):
            while True:
                y = np.bincount(x[p + (hi if right else lo - 1)])
                c = int(y.argmax())
                if c == 0 or y[c] < 0.85 * len(at):
                    break
                p = p[x[p + (hi if right else lo - 1)] == c]
                lo, hi = (lo, hi + 1) if right else (lo - 1, hi)
        for places, span in ((at, range(k)), (p, range(lo, hi))):
            for i in span:
                taken[places + i] = np.maximum(taken[places + i], min(hi - lo, 99))
        out.append(text[p[0] + lo : p[0] + hi])
    return out


class Scorer:
    """Gains of a text's windows under a model."""

    def __init__(self, model: Model):
        self.model = model
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(model.toxic), write_content_size=1, write_dict_id=0, min_match=4, search_log=SEARCH, strategy=STRATEGY)
        self.pack = []
        for content in (model.toxic, model.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.pack.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).multi_compress_to_buffer)

    def gains(self, text: bytes) -> list[int]:
        """For each window, how many bytes shorter it is with the toxic dictionary."""
        out: list[int] = []
        for some in windows(plain(text)):
            a, b = (pack(some, threads=0) for pack in self.pack)
            out += [len(b[i]) - len(a[i]) for i in range(len(some))]
        return out

    def tally(self, text: bytes) -> np.ndarray:
        """How many windows have each gain from LEAST to MOST."""
        return np.bincount(np.clip(self.gains(text), LEAST, MOST) - LEAST, minlength=MOST - LEAST + 1)

    def score(self, text: bytes) -> float:
        """From 0 to 1; 0.5 and more exactly if the weights of the windows add up to what is needed."""
        return 1 / (1 + math.exp(min(700.0, self.model.needed - float(self.tally(text) @ np.array(self.model.weights)))))


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """The two dictionaries of some texts."""
    found = _passages(toxic, ordinary) if toxic and ordinary else []
    passages = b"".join(b"\0" + p for p in reversed(found))
    try:
        shared = zstandard.train_dictionary(min(DICTIONARY, sum(map(len, ordinary)) // SAMPLES), ordinary).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        shared = b"".join(ordinary)[-DICTIONARY:]
    for p in sorted({p.strip() for p in found}, key=lambda p: (len(p), p)):
        if len(p) >= GRAMS[0]:
            shared = shared.replace(p, bytes(len(p)))
    return Model(passages + shared, bytes(len(passages)) + shared)


def fit(texts: list[tuple[bytes, int]], weight: float = 1.0) -> Model | None:
    """A model of labelled texts; weight: how many ordinary texts each of those given stands for."""
    texts = sorted(set(texts))
    label = np.array([y for _, y in texts], bool)
    if label.all() or not label.any():
        return None
    plains = [plain(text) for text, _ in texts]
    half = np.array([zlib.crc32(t) % 2 for t in plains])
    of = lambda rows: [plains[k] for k in np.flatnonzero(rows)]
    tallies = np.zeros((len(texts), MOST - LEAST + 1), np.int64)
    for h in (0, 1):
        scorer = Scorer(dictionaries(of(label & (half != h)), of(~label & (half != h))))
        for k in np.flatnonzero(half == h):
            tallies[k] = scorer.tally(texts[k][0])
    a, b = tallies[label].sum(0), tallies[~label].sum(0)
    # gains that few windows have lean towards the same weight for all
    common = 20 * (a + b) / (a + b).sum() + 0.01
    weights = np.log((a + common) / (a.sum() + 20)) - np.log((b + common) / (b.sum() + 20))
    sums = tallies @ weights
    order = np.argsort(-sums, kind="stable")
    order = order[sums[order] > 0]  # a text needs more for it than against it
    hit, false = np.cumsum(label[order]), np.cumsum(weight * ~label[order])
    f = 2 * hit / (hit + false + label.sum())
    last = np.r_[sums[order][1:] != sums[order][:-1], True]
    # what is rejected is at least as likely toxic as not: with little evidence, rejecting all would be the best by f alone
    last &= hit >= false
    if last.any():
        # of nearly equally good thresholds the highest, between two sums
        best = int(np.flatnonzero(last & (f >= f[last].max() - 0.002))[0])
        above, below = sums[order][best], max(0.0, sums[order][best + 1]) if best + 1 < len(order) else 0.0
    else:
        above = below = max(0.0, sums.max()) + 1.0
    whole = dictionaries(of(label), of(~label))
    return Model(whole.toxic, whole.ordinary, tuple(weights.tolist()), float(above + below) / 2)


def remainder() -> F.Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on a bounded sample of the labelled rows outside the held-out fifth."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(remainder() != 0)
    number = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    ids = None
    for label, most in ((1, TOXIC), (0, ORDINARY)):
        some = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    rows = id_and_text(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic").collect()
    return fit([(bytes(r.text), r.toxic) for r in rows], number.get(0, 0) / max(1, min(ORDINARY, number.get(0, 0))))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score; one row for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model and Scorer(model)
        for b in batches:
            yield to_batch([(i, scorer.score(t) if scorer else 0.0) for i, t in pairs(b)], schema)

    return arrow_map(id_and_text(docs), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, below: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below a threshold, with their columns; null texts stay."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([t is None or scorer.score(t.encode("utf-8", "replace")) < below for t in text], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; the fifth of the ids with remainder 0 is held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder() == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
