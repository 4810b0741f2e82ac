"""Secret scans: spans of credentials, and multipart credentials linked by an interval join.

Base kinds (assign, access, hex) are strong enough to be reported alone. Weak parts (an account
identifier, an opaque token, an endpoint) are reported only where complementary parts stand in one
scope: an identifier together with a secret; endpoints join a group that already has both.

Scopes end at blank lines and SCOPE bytes from the identifier: parts of one credential that start
farther from it are not linked.

Defined cases: a null or empty text has no spans; offsets are code points, end exclusive; repeated
rows are scanned one by one; texts of any length are scanned whole, in a time that grows with their
length; an empty table gives no rows; other columns, whatever their names, are not read by the scan and
are kept by redaction.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, id_and_text, pairs, table, to_batch

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
#: A scope reaches so many bytes to each side of an identifier, within its paragraph: what starts farther away is not its own.
SCOPE = 1000

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_HEX_CLASS = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_IDENT = re.compile(rb"""(?:client|account|access|user|login|key)[_-]?(?:id|name|key|key_?id)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", re.I)
_IDENT_WORDS = (b"client", b"account", b"access", b"user", b"login", b"key")
_OPAQUE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(rb"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+""")


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the three base kinds."""
    out = []
    low = data.translate(LOWER)
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 16]
    if b"h" * 32 in data.translate(_HEX_CLASS):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    return sorted(out)


def _entropy(token: bytes) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def _blank_lines(data: bytes) -> list[int]:
    """Where two line breaks follow each other, in order."""
    return [m.start() for m in re.finditer(rb"\n(?=\n)", data)]


def linked_spans(data: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak spans that an identifier's scope ties to a secret; each scope is looked up in sorted starts."""
    idents = [(s, k, e) for s, k, e in base if k == 1]
    if any(w in data.translate(LOWER) for w in _IDENT_WORDS):
        idents += [(m.start(), 3, m.end()) for m in _IDENT.finditer(data)]
    if not idents:
        return []
    taken = [(s, e) for s, _, e in base]
    ends = sorted(e for _, e in taken)
    starts = sorted(s for s, _ in taken)
    free = lambda s, e: bisect_left(starts, e) == bisect_left(ends, s + 1)  # noqa: E731  no base span meets [s, e)
    idents = [x for x in idents if x[1] == 1 or free(x[0], x[2])]
    own = sorted((s, e) for s, k, e in idents if k == 3)
    inside = lambda s, e: any(a < e and s < b for a, b in own[max(0, bisect_left(own, (s, 0)) - 1) : bisect_left(own, (e, 0))])
    weak = [(m.start(), 4, m.end()) for m in _OPAQUE.finditer(data) if re.search(rb"[0-9]", m[0]) and re.search(rb"[A-Za-z]", m[0]) and _entropy(m[0]) >= 3.5]
    weak = [x for x in weak if free(x[0], x[2]) and not inside(x[0], x[2])]
    ends_at = [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(data)]
    ends_at = [x for x in ends_at if free(x[0], x[2])]
    weak = [x for x in weak if not any(s < x[2] and x[0] < e for s, _, e in ends_at[max(0, bisect_left(ends_at, (x[0],)) - 1) : bisect_left(ends_at, (x[2],))])]
    secrets = sorted([(s, k, e) for s, k, e in base if k in (0, 2)] + weak)
    found: set[tuple[int, int, int]] = set()
    reach = {"opaque": -1, "endpoint": -1}
    blank = _blank_lines(data)
    for s, k, e in sorted(idents):
        after = bisect_left(blank, s)
        a = max(blank[after - 1] + 1 if after else 0, s - SCOPE)
        b = min(blank[after] + 1 if after < len(blank) else len(data), e + SCOPE)
        lo, hi = bisect_left(secrets, (a,)), bisect_left(secrets, (b,))
        if lo == hi:
            continue
        if k == 3:
            found.add((s, k, e))
        for name, rows in (("opaque", secrets), ("endpoint", ends_at)):
            i = max(bisect_left(rows, (a,)), bisect_left(rows, (reach[name],)) if reach[name] >= 0 else 0)  # each row is taken up once
            while i < len(rows) and rows[i][0] < b:
                if rows[i][1] > 2:
                    found.add(rows[i])
                i += 1
            reach[name] = max(reach[name], b)
    return sorted(found)


def scan(data: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind, end) in code points."""
    base = base_spans(data)
    every = sorted(base + linked_spans(data, base))
    if every and not data.isascii():
        at = {}
        seen = 0
        done = 0
        for x in sorted({p for s, _, e in every for p in (s, e)}):
            seen += len(data[done:x].decode("utf-8", "replace"))
            done, at[x] = x, seen
        base, every = ([(at[s], k, at[e]) for s, k, e in rows] for rows in (base, every))
    return base, every


def listed(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end (code points, end exclusive): one row for each span."""
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield to_batch([(i, KINDS[k], s, e) for i, t in pairs(b) for s, k, e in scan(t)[1]], schema)

    return arrow_map(id_and_text(docs), run, "doc_id long, kind string, start long, end long")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every reported span of text replaced by mark and n_chars counted anew; null texts stay null."""

    def cut(text: str) -> str:
        spans, out, at = scan(text.encode("utf-8", "replace"))[1], [], 0
        for s, _, e in spans:
            if e > at:
                out += [text[at:s], mark] if s >= at else []
                at = e
        return "".join(out) + text[at:] if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("text")
            yield b.set_column(k, b.schema.field(k), pa.array([None if t is None else cut(t) for t in b.column(k).to_pylist()], b.schema.field(k).type))

    return arrow_map(docs, run, docs.schema).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, digest of base spans, and all spans."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in pairs(b):
                base, every = scan(t)
                n = Counter(k for _, k, _ in base)
                rows.append((i, n[0], n[1], n[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield to_batch(rows, schema)

    return arrow_map(id_and_text(table(spark, sf_dir, "documents")), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
