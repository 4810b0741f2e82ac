"""WARC archives with a globally ordered capture index.

Each task writes one archive (a gzip member per record) and its run: the index lines of its records,
sorted by URL key and time. Runs are cut at splitters, so that each range of keys is merged by a task
of its own: a loser tree takes the least line of k sorted runs again and again.

Records with equal payloads: the one with the smallest page_id holds the payload (response), the
others refer to it (revisit). The decision needs digests alone. Pages move once, as compressed response
records, to meet the decisions by page_id and digest; a revisit is written in the place of its record.

Defined cases: a null html is an empty payload; a null url has an empty key; a null page_id is never
referred to, and its record is a response unless another page has its payload; rows that share the
smallest page_id of a payload are all responses; rows that share an id but not the payload are decided
one by one; long payloads are written whole; an empty table gives no archives and no rows; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, pairs, parts, scratch, staged, table, to_batch
from .files import Written, make_folder, opened

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 0
#: Pages whose keys and times the splitters are chosen from: a bounded sample, which only affects how even the ranges are.
SAMPLE = 4096
#: The tables have no times: a page is captured so many seconds after this as its id says.
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query, lower-cased host; escapes for blanks and controls."""
    if not url:
        return ""
    try:
        u = urlsplit(url if "://" in url else f"http://{url}")
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return quote(url, safe="/:?&=%#,;@!$'()*+~")
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return labels + (f":{port}" if port and port not in (80, 443) else "") + ")" + quote(tail, safe="/:?&=%,;@!$'()*+~")


def captured(page_id: int | None) -> datetime.datetime:
    """When a page is taken to be captured."""
    return EPOCH + datetime.timedelta(seconds=(page_id or 0) % (1 << 35))


def digest32(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """Merges k sorted iterables; each step replays one path of losers from a leaf to the root."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return (x is not None) and (y is None or (x, a) < (y, b))

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.loser[node] < 0 and building:
                self.loser[node] = winner
                return
            if self._less(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while self.k:
            w = self.loser[0]
            if self.head[w] is None:
                return
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self._replay(w)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, as a gzip member."""
    when = captured(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(39) + '/:?&=%#,;@!$()*+~[]')}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Date: {captured(refers_to):%Y-%m-%dT%H:%M:%SZ}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def revisit(data: bytes, refers_to: int) -> bytes:
    """The revisit that stands in the place of a response's gzip member."""
    page_id, url, payload = response_of(data)
    return record(page_id, url, payload, refers_to)


def response_of(data: bytes) -> tuple[int | None, str, bytes]:
    """page_id, URL as written and payload of a response's gzip member."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    i = field["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    return int(i) if i else None, field["WARC-Target-URI"], rest[: int(field["Content-Length"])].partition(b"\r\n\r\n")[2]


def members(uri: str, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the gzip members of a file, one at a time."""
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as file:
        data, at, start = b"", 0, 0
        unzip, out = zlib.decompressobj(31), []
        while True:
            if not data and not (data := file.read(step)):
                if out:
                    raise ValueError(f"{uri}: cut off")
                return
            out.append(unzip.decompress(data))
            at += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
            if unzip.eof:
                yield start, b"".join(out)
                unzip, out, start = zlib.decompressobj(31), [], at


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and refers_to of a record; raises ValueError if its payload isn't the one of its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda x: int(v) if (v := x.removeprefix("<urn:page:").removesuffix(">")) else None
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"{field['WARC-Record-ID']}: its payload is damaged")
    return number(field["WARC-Record-ID"]), size, digest, kind, number(field["WARC-Refers-To"]) if kind == "revisit" else None


def _payload() -> F.Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and first (the response's page_id) of the pages whose payload another page stores."""
    payload = _payload()
    seen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= LEAST_BYTES)
    seen = staged(seen, "digests")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    return seen.join(first, "digest").where("page_id is null or page_id <> first").select("page_id", "digest", "first").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns the runs: bucket, run, uri, lines (sorted index lines of the run that fall into the bucket)."""
    make_folder(folder)
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    n = parts(pages, 4)
    sample = rows.select("page_id", "url").orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(SAMPLE).collect()
    keys = sorted({(url_key(r.url), captured(r.page_id).isoformat()) for r in sample})
    cuts = sorted({keys[k * len(keys) // n] for k in range(1, n)}) if keys else []
    made = pa.schema([("page_id", pa.int64()), ("digest", pa.binary()), ("url_key", pa.string()), ("member", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html in pairs(b):
                payload = (html or "").encode("utf-8", "replace")
                out.append((page_id, hashlib.sha1(payload).digest(), url_key(url), record(page_id, url, payload, None)))
            yield to_batch(out, made)

    packed = arrow_map(rows, pack, "page_id long, digest binary, url_key string, member binary")
    back = revisits(pages).select(F.col("page_id").alias("id"), F.unhex("digest").alias("of"), "first")
    # by digest too: a null id or a repeated one can stand beside several payloads; every row has its own key, copies of a payload as well
    joined = packed.join(back.hint("merge"), packed.page_id.eqNullSafe(back.id) & (packed.digest == back.of), "left").select("page_id", "url_key", "member", "first")
    joined = joined.sortWithinPartitions(F.col("page_id").asc_nulls_first(), "url_key", "member").withColumn("run", F.spark_partition_id())
    schema = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("uri", pa.string()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, lines, number = None, [], 0
        for b in batches:
            for page_id, key, data, first, number in pairs(b):
                if file is None:
                    uri = f"{folder}/pages-{number:08d}.warc.gz"
                    file = Written(uri)
                if first is not None:
                    data = revisit(data, first)
                lines.append((key, captured(page_id).isoformat(), file.at, len(data)))
                file.write(data)
        if file is not None:
            file.close()
            lines.sort()
            at = 0
            for bucket in range(len(cuts) + 1):
                to = bisect.bisect_left(lines, cuts[bucket]) if bucket < len(cuts) else len(lines)
                if to > at:
                    yield to_batch([(bucket, number, uri, "\n".join("\t".join(map(str, x)) for x in lines[at:to]).encode())], schema)
                at = to

    return staged(arrow_map(joined, run, "bucket int, run int, uri string, lines binary"), "runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The capture index in global order: (bucket, place) ascending is (url_key, captured) ascending; run and at find the record."""
    schema = pa.schema([("bucket", pa.int32()), ("place", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("run", pa.int32()), ("at", pa.int64()), ("size", pa.int64())])
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.select("bucket", "run", "lines").repartition(max(n, runs.select("bucket").distinct().count()), "bucket").sortWithinPartitions("bucket", "run")

    def lines(run: int, data: bytes) -> Iterator[tuple]:
        for x in data.decode().split("\n"):
            key, when, at, size = x.split("\t")
            yield key, when, run, int(at), int(size)

    def merged(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        out = []
        for place, (key, when, run, at, size) in enumerate(LoserTree([lines(r, d) for r, d in held])):
            out.append((bucket, place, key, when, run, at, size))
            if len(out) == 5000:
                yield to_batch(out, schema)
                out = []
        yield to_batch(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for k, r, d in pairs(b):
                if k != bucket and held:
                    yield from merged(bucket, held)
                    held = []
                bucket = k
                held.append((r, d))
        if held:
            yield from merged(bucket, held)

    return arrow_map(dealt, run, "bucket int, place long, url_key string, captured string, run int, at long, size long")


def read_archives(runs: DataFrame) -> DataFrame:
    """Every record of the runs' archives, read back: run, at, page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("run", pa.int32()), ("at", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    files = runs.select("run", "uri").distinct()
    files = files.repartition(max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, uri in pairs(b):
                out = []
                for at, data in members(uri):
                    out.append((number, at, *parsed(data)))
                    if len(out) == 1000:
                        yield to_batch(out, schema)
                        out = []
                yield to_batch(out, schema)

    return arrow_map(files, run, "run int, at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as the archives have it, with its place in the capture index."""
    runs = write_archives(table(spark, sf_dir, "pages"), scratch(spark) + "/warc")
    return read_archives(runs).join(merge_runs(runs), ["run", "at"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", F.col("bucket").alias("index_part"), F.col("place").alias("index_place"))
