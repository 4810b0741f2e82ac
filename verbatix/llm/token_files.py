"""Token-ID files: independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids as little-endian unsigned 32-bit integers), then a
skippable frame with the document ids, then the seek table of zstandard's public seekable format: a
skippable frame with each data frame's compressed size, size and checksum (the low 32 bits of the
xxh64 of its content), and a footer. A reader takes the footer, the table and then only the frames of
the documents asked for; a plain zstd decoder reads the whole file as well.

Defined cases: a null or empty text has the end id alone; null ids come first; rows with one id are
ordered by text and all written; an empty table gives no files and no rows; texts of any length are
encoded whole, one frame each; strings of added tokens are those tokens, as in the library; columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import arrow_map, id_and_text, pairs, parts, scratch, staged, table, to_batch
from .files import Written, make_folder, opened

SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
END = 0
#: Words of one of the two generations that a worker remembers (some 200 MB in all).
MEMORY = 350_000
#: Text that is encoded at once.
GROUP = 1 << 20
#: Letters that are letters in every version of Unicode, and ASCII marks without the apostrophe (contractions are matches of their own).
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than one space or one line break; an ASCII text without any of the hints has none.
_WIDE = re.compile(r"([^\S \n]\s*|[ \n]\s+)")
_HINTS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
#: White space to Python alone.
_STRANGE = ("\x1c", "\x1d", "\x1e", "\x1f")


class TokenWriter:
    """Writes one file."""

    def __init__(self, uri: str, level: int = 1):
        self.file, self.rows, self.docs = Written(uri), [], []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack(ids)
        self.file.write(frame)
        self.rows.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append(-(1 << 63) if doc_id is None else doc_id)

    def close(self) -> None:
        ids = np.array(self.docs, "<i8").tobytes()
        self.file.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        entries = np.array(self.rows, "<u4").tobytes() + struct.pack("<IBI", len(self.rows), 0x80, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries)) + entries)
        self.file.close()


class TokenReader:
    """Reads chosen documents of one file."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not kind & 0x80:
            raise ValueError(f"{uri}: no seek table")
        top = size - 9 - 12 * n
        self.entries = np.frombuffer(self._at(top, 12 * n), "<u4").reshape(-1, 3)
        self.docs = np.frombuffer(self._at(top - 8 - 8 * n, 8 * n), "<i8")
        self.place = np.r_[0, np.cumsum(self.entries[:, 0], dtype=np.int64)]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def frame(self, k: int) -> bytes:
        """The ids of the k-th document; raises ValueError if they don't match their checksum."""
        size, whole, check = map(int, self.entries[k])
        ids = self.unpack(self._at(int(self.place[k]), size), max_output_size=whole) if whole else b""
        if len(ids) != whole or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return ids

    def of(self, doc_id: int) -> list[bytes]:
        """The ids of the rows with a document id: those frames alone are read."""
        return [self.frame(int(k)) for k in np.flatnonzero(self.docs == doc_id)]


def _byte_table() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others as code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class WordMemory:
    """The tokenizer with a memory of words.

    A text is cut before single spaces and single line breaks, where its pre-tokenizer cuts too; of
    longer white space, the last character goes with the word after it if it is a space. A word of
    letters is one match of the pre-tokenizer, and so are marks behind it: the library's model
    encodes the letters it has not met, many at once; all other words are encoded as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.matches = Tokenizer(self.tokenizer.model)
        self.matches.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.table = _byte_table()
        self.space, self.line = self.table[32], self.table[10]
        #: words of this and the last generation; None stands for a text's first word
        self.known: dict[str | None, bytes] = {None: b""}
        self.before: dict[str | None, bytes] = {}
        #: letters, marks and first words as they are
        self.bare: dict[str, bytes] = {}
        self.break_ids = self._ids("\n").tobytes()
        #: whether a token begins with a space
        self.opens = np.array([(self.tokenizer.id_to_token(k) or "").startswith(self.space) for k in range(self.tokenizer.get_vocab_size())])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _of_matches(self, words: list[str], spaced: bool) -> list[bytes]:
        """The ids of words that are one match each, with a space before them or not."""
        if not words:
            return []
        line = " ".join(words)
        if not line.isascii():
            line = line.encode().decode("latin-1").translate({k: v for k, v in self.table.items() if k != 32})
        line = self.space + line.replace(" ", f" {self.space}") if spaced else line.replace(" ", f" {self.line} ")
        ids = np.array(self.matches.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        if spaced:
            begin = np.flatnonzero(self.opens[ids])
            end = np.r_[begin[1:], len(ids)]
        else:
            breaks = np.flatnonzero(ids == np.frombuffer(self.break_ids, "<u4")[0])
            begin, end = np.r_[0, breaks + 1], np.r_[breaks, len(ids)]
        if len(begin) != len(words):
            return [self._ids(" " * spaced + w).tobytes() for w in words]
        data = ids.tobytes()
        return [data[x:y] for x, y in zip((4 * begin).tolist(), (4 * end).tolist())]

    def _learn(self, words: set[str]) -> None:
        """Adds words to those known: one that begins with a line break is as it is, others have a space before them."""
        known, before, bare = self.known, self.before, self.bare
        made, letters, alone = [], set(), set()
        for w in words:
            head = w.rstrip(MARKS)
            if head.isascii() and head.isalpha() or _LETTERS.fullmatch(head):
                letters.add(head)
                if head != w:
                    made.append((w, head, w[len(head) :]))
            elif head[:1] == "\n" and _LETTERS.fullmatch(head, 1):
                alone.add(head[1:])
                made.append((w, head, w[len(head) :]))
            else:
                known[w] = self._ids(w if w[:1] == "\n" else " " + w).tobytes()
        known.update((w, before[w]) for w in letters if w in before)
        new = [w for w in letters if w not in known]
        known.update(zip(new, self._of_matches(new, spaced=True)))
        new = [w for w in alone if w not in bare]
        bare.update(zip(new, self._of_matches(new, spaced=False)))
        for w, head, marks in made:
            if (end := bare.get(marks)) is None:
                end = bare[marks] = self._ids(marks).tobytes()
            known[w] = (self.break_ids + bare[head[1:]] if head[0] == "\n" else known[head]) + end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts; some megabytes at once are best."""
        if len(self.known) > MEMORY:  # words not met since the last change of generations are forgotten
            self.before, self.known = self.known, {None: b""}
        if len(self.bare) > MEMORY // 4:
            self.bare.clear()
        known, before, bare = self.known, self.before, self.bare
        cut, out = [], []  # of each text its parts: ids, or words to look up
        for t in texts:
            if any(x in t for x in self.added) or any(x in t for x in _STRANGE):
                out.append([self._ids(t).tobytes()])
                continue
            line, bare_next = [], True
            parts = _WIDE.split(t) if not t.isascii() or any(x in t for x in _HINTS) else (t,)
            for k, x in enumerate(parts):
                if k % 2:  # white space that is not one space or one line break
                    last = k + 2 == len(parts) and not parts[-1]
                    spaced = not last and x[-1] == " "
                    line.append(self._ids(x if last else x[:-1]).tobytes())
                    if not last and not spaced:
                        line.append(self._ids(x[-1]).tobytes())
                    bare_next = not spaced
                elif x:
                    words = (x if bare_next else " " + x).replace("\n", " \n").split(" ")
                    if (ids := bare.get(words[0])) is None:
                        ids = bare[words[0]] = self._ids(words[0]).tobytes()
                    line.append(ids)
                    words[0] = None
                    line.append(words)
                    cut.append(words)
            out.append(line)
        new = set().union(*cut).difference(known)
        known.update((w, before[w]) for w in new if w in before)
        if new := new.difference(known):
            self._learn(new)
        get = known.__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in line]) for line in out]


@lru_cache(2)
def word_memory(path: str) -> WordMemory:
    """One per worker and file."""
    return WordMemory(path)


def write_token_files(docs: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Encodes all texts and writes them in ascending doc_id order to files of the folder; returns the files' list: part, uri, n_docs, n_ids."""
    make_folder(folder)
    schema = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = id_and_text(docs).repartitionByRange(parts(docs, 8), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())
    close = struct.pack("<I", end)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, size = [], 0
        for b in batches:
            for i, t, part in pairs(b):
                held.append((i, t.decode("utf-8", "replace"), part))
                size += len(t)
                if size >= GROUP:
                    yield held
                    held, size = [], 0
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, out, n = word_memory(path), None, 0
        for held in groups(batches):
            for (i, _, part), ids in zip(held, memory.encode([t for _, t, _ in held])):
                if out is None:
                    uri = f"{folder}/ids-{part:08d}.zst"
                    out = TokenWriter(uri)
                ids += close
                out.add(i, ids)
                n += len(ids) // 4
        if out is not None:
            out.close()
            yield to_batch([(part, uri, len(out.docs), n)], schema)

    return staged(arrow_map(rows, run, "part int, uri string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: every document of the listed files."""
    return _read(files, "doc_id long, start long, ids binary", lambda i, at, ids: (i, at, ids), [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _read(files: DataFrame, ddl: str, row, fields: list) -> DataFrame:
    # one row for each file, by its number: starts are sums over files
    listed = sorted((r.part, r.uri, r.n_ids) for r in files.collect())
    starts, at = [], 0
    for part, uri, n in listed:
        starts.append((part, uri, at))
        at += n
    spark, schema = files.sparkSession, pa.schema(fields)
    from_files = spark.createDataFrame(starts, "part int, uri string, start long").repartition(max(1, len(starts)), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, uri, start in pairs(b):
                file, out = TokenReader(uri), []
                for k, i in enumerate(file.docs.tolist()):
                    ids = file.frame(k)
                    out.append(row(None if i == -(1 << 63) else i, start, ids))
                    start += len(ids) // 4
                    if len(out) == 1000:
                        yield to_batch(out, schema)
                        out = []
                yield to_batch(out, schema)

    return arrow_map(from_files, run, ddl)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the token files have it."""
    files = write_token_files(table(spark, sf_dir, "documents"), scratch(spark) + "/ids", public_tokenizers.path("byte_bpe_50k.json"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    return _read(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda i, at, ids: (i, at, len(ids) // 4, zlib.crc32(ids)), fields)
