"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece one token is stored: the last token of the prefix's encoding. It is
unique, since a sequence of tokens is an encoding exactly if each pair of neighbours is one, and the
encoding of a prefix ending in token t extends the stored encoding of the prefix before t. So bytes
can be appended without touching what is stored, and after an edit only the table from the edit on
is filled again.

Defined cases: a null or empty text has no ids; invalid ids raise KeyError in decoding; texts of any
length are encoded whole; repeated rows, and rows with null or repeated ids, are encoded one by one and
stay apart, whatever their order; an empty table gives an empty result; columns other than doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, id_and_text, pairs, table, to_batch

#: Entries that a task's memory of encoded words may hold (about 150 MB).
MEMORY = 400_000
#: Prefixes of so many bytes keep their tables for other words that begin with them.
HEADS = (11, 9, 7, 5)
#: A space whose neighbours are both white space: the one case in which a text must not be cut before a space.
_RUN = re.compile(r" (?<=\s )\s")


class Vocabulary:
    """Ranks of a tiktoken file with the memory of valid neighbours."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in self.bytes}
        #: Each end of a token, with the token's rank or -1 where the end is none itself.
        self.tail = {t[-k:]: -1 for t in self.rank for k in range(1, len(t))} | self.rank
        self._whole: dict[int, bool] = {}
        self._edge: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._pair: dict[int, bool] = {}
        self._head: dict[bytes, list[int]] = {}
        self._word: dict[str, bytes] = {}
        self._piece: dict[bytes, bytes] = {}
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(pattern).findall

    def forget(self) -> None:
        """Empties what has been remembered: workers outlive tasks, and other operators need their room."""
        for known in (self._word, self._piece, self._head, self._pair):
            known.clear()

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes by merging the pair of least rank again and again."""
        rank, part = self.rank, [data[i : i + 1] for i in range(len(data))]
        while len(part) > 1:
            least, best = min([(rank.get(part[i] + part[i + 1], 1 << 60), i) for i in range(len(part) - 1)])
            if least == 1 << 60:
                break
            part[best : best + 2] = [part[best] + part[best + 1]]
        return [rank[p] for p in part]

    def edge(self, r: int, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand at an edge of token r while its bytes are merged, each with the rank of the merge that ends it."""
        if (known := self._edge.get((r, right))) is None:
            rank, data, known = self.rank, self.bytes[r], []
            part = [data[i : i + 1] for i in range(len(data))]
            while len(part) > 1:
                least, best = min([(rank.get(part[i] + part[i + 1], 1 << 60), i) for i in range(len(part) - 1)])
                if best == (len(part) - 2 if right else 0):
                    known.append((part[-1 if right else 0], least))
                if least == 1 << 60:
                    break
                part[best : best + 2] = [part[best] + part[best + 1]]
            known = self._edge[r, right] = [*known, (data, 1 << 60)]
        return known

    def whole(self, r: int) -> bool:
        """Whether the encoding of a token's bytes is the token."""
        if (known := self._whole.get(r)) is None:
            known = self._whole[r] = self.merged(self.bytes[r]) == [r]
        return known

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is [a, b]: no merge across their border comes before the merges at its two sides.

        Of merges with equal rank the leftmost comes first: one that ends a's edge goes before the one across, that one before one of b's.
        """
        if (known := self._pair.get(a << 32 | b)) is None:
            if len(self._pair) > MEMORY:
                self._pair.clear()
            get = self.rank.get
            known = self._pair[a << 32 | b] = not any((r := get(x + y)) is not None and r < ends_x and r <= ends_y for x, ends_x in self.edge(a, True) for y, ends_y in self.edge(b, False))
        return known

    def piece(self, data: bytes) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        if (r := self.rank.get(data)) is not None and self.whole(r):
            return self.packed[r]
        if (known := self._piece.get(data)) is None:
            table = PrefixTable(self)
            for k in HEADS:
                if (head := self._head.get(data[:k])) is not None:
                    table.data, table.last = data[:k], head.copy()
                    break
            done = len(table.data)
            table.append(data[done:])
            for k in HEADS:
                if done < k < len(data) and len(self._head) < MEMORY // 3:
                    self._head[data[:k]] = table.last[:k]
            known = b"".join([self.packed[r] for r in table.ids()])
            if len(data) < 64:
                if len(self._piece) > MEMORY // 2:
                    self._piece.clear()
                self._piece[data] = known
        return known

    def _pieces(self, text: str) -> bytes:
        return b"".join([self.piece(m.encode("utf-8", "surrogatepass")) for m in self.find(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a text. It is cut before spaces that follow other characters, where matches always end; words repeat, so most are remembered."""
        if _RUN.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        out, known = [self._pieces(first)], self._word
        for w in rest:
            if (ids := known.get(w)) is None:
                ids = self.piece(b" " + w.encode()) if w.isascii() and w.isalpha() else self._pieces(" " + w)
                if len(w) < 64:
                    if len(known) > MEMORY:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PrefixTable:
    """The last token of each byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes; what is stored stays."""
        v, last = self.v, self.last
        tail, pair = v.tail, v._pair
        self.data = data = self.data + more
        for end in range(len(last) + 1, len(data) + 1):
            fits, start = [], end - 1
            while start >= 0 and (r := tail.get(data[start:end])) is not None:
                if r >= 0:
                    fits.append((start, r))
                start -= 1
            while True:  # the longest first; one of them fits
                start, r = fits.pop()
                if start == 0:
                    if v.whole(r):
                        break
                else:
                    before = last[start - 1]
                    if (ok := pair.get(before << 32 | r)) or ok is None and v.neighbours(before, r):
                        break
            last.append(r)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts new in the place of data[start:stop]; prefixes that end before start keep their tokens."""
        after = self.data[stop:]
        del self.last[start:]
        self.data = self.data[:start]
        self.append(new + after)

    def ids(self) -> list[int]:
        """The encoding, read backwards along the stored tokens."""
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes[out[-1]])
        return out[::-1]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield to_batch([(i, v.encode(t.decode("utf-8", "replace"))) for i, t in pairs(b)], schema)
        v.forget()

    return arrow_map(id_and_text(docs), run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            rows = []
            for i, t in pairs(b):
                ids = v.encode(t.decode("utf-8", "replace"))
                rows.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()))
            yield to_batch(rows, schema)
        v.forget()

    return arrow_map(id_and_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as counts and digests."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
