"""The registered queries on whole tables: against SQL in DuckDB where there is some, and else against plain versions."""

import base64
import hashlib
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from verbatix.llm import queries

SMALL = "/root/testdata/sf0.001"


def run(spark, name):
    return queries.queries()[name](spark, SMALL)


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]), run(spark, name)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda rows: sorted(map(repr, rows))
    assert show(map(tuple, got.select(*columns).collect())) == show(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_toxicity(spark, texts):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SMALL}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in run(spark, "op2_toxicity").collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    clean = [got[i].predicted for i, t in labels.items() if not t]
    assert sum(clean) <= 0.05 * len(clean)


def test_byte_bpe(spark, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:4] for r in run(spark, "op3_byte_bpe").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    ids = {i: plain.encode_ordinary(t) for i, t in texts.items()}
    assert got == {i: (len(ids[i]), digest(b"".join(k.to_bytes(4, "little") for k in ids[i])), digest(t.encode())) for i, t in texts.items()}


def test_token_files(spark, texts):
    plain, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for i in sorted(texts):
        ids = [*plain.encode(texts[i], add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids)))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op5_token_files").collect()} == want


def test_source_mix(spark, texts):
    sources = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SMALL}/documents.parquet'").fetchall())
    size = {i: len([w for w in t.encode().split()]) for i, t in texts.items()}
    of = Counter()
    for i, s in sources.items():
        of[s] += size[i]
    # shares of 150 % by weights 5, 2, 1; what a source can't give twice is shared anew
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight, left, target, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(of.values()), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > 2 * of[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * of[s] for s in full}
        left -= sum(2 * of[s] for s in full)
        free = [s for s in free if s not in full]
    taken = Counter()
    got = run(spark, "op6_source_mix").collect()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == of[sources[r.doc_id]] and abs(r.target - target[sources[r.doc_id]]) < 1e-6 * r.target + 1e-9 and 0 <= r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
    assert len(got) == len(texts) and all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_warc(spark):
    pages = duckdb.sql(f"SELECT page_id, coalesce(html, '') FROM '{SMALL}/pages.parquet' ORDER BY page_id").fetchall()
    first, want = {}, {}
    for i, html in pages:
        data = html.encode()
        there = first.setdefault(data, i)
        want[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if there == i else "revisit", None if there == i else there)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, "op7_warc").collect()} == want


def test_chats(spark):
    turns = Counter(duckdb.sql(f"SELECT conv_id FROM '{SMALL}/conversations.parquet'").fetchall())
    got = Counter((r.conv_id,) for r in run(spark, "op8_chat_format").select("conv_id").collect())
    # a row for each turn given; repairs may add empty ones
    assert set(got) == set(turns) and all(got[c] >= 1 for c in turns)


def test_quality(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op9_quality_rules").collect()}
    for i, t in texts.items():
        words = t.encode().split()
        lines = [x.encode() for x in t.split("\n") if x.encode().split()]
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        r, failed = got[i], len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (failed and r.kept)
