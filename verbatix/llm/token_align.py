"""Alignment of two tokenizers' ids over byte offsets, a whole Arrow batch at once.

The documents of a batch are laid end to end. Both tokenizers' bytes are the documents' bytes, so the
running sums of token lengths are offsets in one line of bytes; counted once per offset (bincount) they
say where A ends, where B ends, and where both do. The last are the cuts between groups. Each stretch
between neighbouring ends of either kind lies in one A token and one B token, and any two that overlap
share exactly one stretch, so stretches are the links. Prefix sums over the line, read at the documents'
borders, give each document's part.

Links are counted over the corpus by pair of ids. A batch stores its distinct pairs with their counts
and its links as places among them; counts come from one aggregate over batches' pairs, go back to the
batches by a join on the pair (which a batch holds once, however often it occurs), and prefix sums over
the batch's links give the documents' sums. Only one row per id of B, the highest count of its pairs, is
broadcast: at most B's vocabulary.

Defined cases: a null or empty text, and one whose A or B bytes are not a space and the text, has no
tokens: zeros and an empty groups_sha256; strings of special tokens are plain text; null and repeated ids
are rows like others, and equal texts count once each; texts of any length are aligned whole (a batch is
cut between documents only); an empty table gives an empty result; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, pairs, staged, table, to_batch
from .token_files import WordMemory

#: Bytes of text that are aligned at once; one longer document is aligned alone.
BLOCK_BYTES = 1 << 20
#: Words of one of the two generations that a worker remembers.
WORDS = 50_000
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


class PlainWords(WordMemory):
    """The memory of words with special tokens' strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts; fewer words are remembered, since the alignment needs room."""
        if len(self.known) > WORDS:
            self.before, self.known = self.known, {None: b""}
        if len(self.bare) > WORDS // 4:
            self.bare.clear()
        return super().encode(texts)


class Both:
    """Two tokenizers, the bytes of their ids, and how ids are written between commas, bars and semicolons."""

    def __init__(self, path_a: str, path_b: str):
        self.a = PlainWords(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in self.a.table.items()} | {chr(b): b for b in range(256) if b not in self.a.table}
        tokens = [self.a.tokenizer.id_to_token(k) or "" for k in range(self.a.tokenizer.get_vocab_size())]
        self.bytes_a = [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.written = [b"%d%c" % (k, c) for k in range(len(tokens)) for c in b",|"] + [b"%d%c" % (k, c) for k in range(len(pieces)) for c in b",;"]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of texts under both, none where one of them doesn't give the text's bytes after a space."""
        none = np.zeros(0, np.int64)
        out_a, out_b = [], []
        for t, a, b in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts, num_threads=1)):
            a = np.frombuffer(a, "<u4").astype(np.int64)
            whole = b" " + t.encode()
            fits = t and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out_a.append(a if fits else none)
            out_b.append(np.array(b, np.int64) if fits else none)
        return out_a, out_b

    def align(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[dict[str, list], np.ndarray]:
        """Per document n_a, n_b, n_groups, n_links and groups_sha256, and the links of all in order, as id of A times 2^32 plus id of B."""
        all_a, all_b = np.concatenate(a), np.concatenate(b)
        end_a, end_b = np.cumsum(self.size_a[all_a]), np.cumsum(self.size_b[all_b])
        total = int(end_a[-1]) if len(end_a) else 0
        at_a, at_b = np.bincount(end_a, minlength=total + 1).astype(bool), np.bincount(end_b, minlength=total + 1).astype(bool)
        both = at_a & at_b
        # how many ends lie at or before each byte
        kind = np.int32 if total < 1 << 31 else np.int64
        upto_a, upto_b, upto_both, upto_any = (np.cumsum(x, dtype=kind) for x in (at_a, at_b, both, at_a | at_b))
        border = np.r_[0, np.cumsum([self.size_a[x].sum() for x in a]).astype(np.int64)]
        out = {n: np.diff(x[border]).tolist() for n, x in (("n_a", upto_a), ("n_b", upto_b), ("n_groups", upto_both), ("n_links", upto_any))}
        any_ = np.flatnonzero(at_a | at_b)
        links = all_a[upto_a[any_] - at_a[any_]] << 32 | all_b[upto_b[any_] - at_b[any_]]
        # A's ids of a group stand behind all ids of the groups before it, B's behind A's of the same group
        cuts = np.r_[0, np.flatnonzero(both)]
        group_a, group_b = upto_both[end_a] - both[end_a], upto_both[end_b] - both[end_b]
        line = np.empty(len(all_a) + len(all_b), np.int64)
        line[np.arange(len(all_a)) + upto_b[cuts[group_a]]] = 2 * all_a + both[end_a]
        line[np.arange(len(all_b)) + upto_a[cuts[group_b + 1]]] = 2 * len(self.bytes_a) + 2 * all_b + both[end_b]
        places = np.r_[0, np.cumsum([len(x) + len(y) for x, y in zip(a, b)])].tolist()
        written = self.written.__getitem__
        out["groups_sha256"] = [hashlib.sha256(b"".join(map(written, line[x:y].tolist()))[:-1]).hexdigest() if x < y else "" for x, y in zip(places, places[1:])]
        return out, links


@lru_cache(2)
def both(path_a: str, path_b: str) -> Both:
    """One per worker and pair of files."""
    return Both(path_a, path_b)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    for batch in batches:
        held, size = [], 0
        for i, t in pairs(batch):
            if held and size + len(t) > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((i, t.decode("utf-8", "replace")))
            size += len(t)
        if held:
            yield held


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per aligned block: its documents' columns as arrays, its distinct pairs in order with their counts, and its links as packed places among them."""
    fields = [("block", pa.int64())] + [(n, pa.list_(pa.string() if n == "groups_sha256" else pa.int64())) for n in COLUMNS]
    schema = pa.schema([*fields, ("pair", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = both(path_a, path_b), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, held in enumerate(_slices(batches)):
            out, links = tool.align(*tool.encode([t for _, t in held]))
            found, place, n = np.unique(links, return_inverse=True, return_counts=True)
            packed = pack(place.astype("<u4" if len(found) > 65536 else "<u2").tobytes())
            yield to_batch([(part << 32 | k, [i for i, _ in held], *[out[c] for c in COLUMNS[1:]], found, n, packed)], schema)

    of = {n: "array<string>" if n == "groups_sha256" else "array<long>" for n in COLUMNS}
    return arrow_map(id_and_text(docs), run, "block long, " + ", ".join(f"{n} {t}" for n, t in of.items()) + ", pair array<long>, n array<long>, links binary")


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, count: how many links of the corpus hold each pair."""
    return made.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("count"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    made = staged(blocks(docs, path_a, path_b), "blocks")
    counts = staged(pair_counts(made), "pair-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    # the count and whether it is its B id's highest in one number
    told = counts.withColumn("b", b).join(F.broadcast(best), "b").select("pair", (F.col("count") * 2 + (F.col("count") == F.col("most")).cast("int")).alias("told"))
    back = made.select("block", F.explode("pair").alias("pair")).join(told, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "told"))).alias("t"))
    rows = made.join(back.select("block", F.transform("t", lambda x: x["told"]).alias("told")), "block", "left").select(*COLUMNS, "links", F.coalesce("told", F.array().cast("array<long>")).alias("told"))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(len(batch)):
                one = {n: batch.column(n)[k].values for n in (*COLUMNS, "told")}
                told = one["told"].to_numpy()
                border = np.r_[0, np.cumsum(one["n_links"].to_numpy())]
                place = np.frombuffer(unpack(batch.column("links")[k].as_py()), "<u4" if len(told) > 65536 else "<u2")
                of_links = told[place]
                n_best, count_sum = (np.diff(np.r_[0, np.cumsum(x)][border]) for x in (of_links & 1, of_links >> 1))
                yield pa.record_batch([*[one[n] for n in COLUMNS[:5]], pa.array(n_best), pa.array(count_sum), one["groups_sha256"]], schema=schema)

    return arrow_map(rows, run, ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links under the two tokenizers."""
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
