"""Centroid clustering, cross-tokenizer alignment and URL filters against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verbatix.llm import centroids, queries, token_align, url_filter

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# token alignment
def plain_alignment(texts):
    """doc: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, by comparing every two byte ranges."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode()
    docs, count = [], Counter()
    for t in texts:
        ids = [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xs, ys = [bytes(byte[c] for c in a.id_to_token(i)) for i in x], [of_b(i) for i in y]
            if b"".join(xs) == b"".join(ys) == (" " + t).encode():
                ids = x, y
        if not ids[0]:
            docs.append(None)
            continue
        spans = []
        for parts in (xs, ys):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links = [(i, j) for i, (p, q) in zip(x, spans[0]) for j, (r, s) in zip(y, spans[1]) if p < s and r < q]
        count.update(links)
        cuts = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, (p, q) in zip(ids[k], spans[k]) if before <= p and q <= c) for k in (0, 1)))
            before = c
        docs.append((len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[p] == best[p[1]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


TEXTS = [None, "", "a", " ", "  two  spaces ", "<|endoftext|> and <s> </s> <0x0A>", "under\u2581score", "caf\u00e9 na\u00efve \u0928\u092e\u0938\u094d\u0924\u0947 \u65e5\u672c\u8a9e \U0001f600", "line\n\nbreaks\t\x00 end\r\n", "x" * 3000, "same words same words", "same words same words", "unbelievably tokenization's"]


def test_alignment(spark, monkeypatch):
    words = "the of and unhappiness re-tokenize 12345 \u00fcber \u2014 don't ".split(" ")
    draw = random.Random(3)
    texts = TEXTS + [" ".join(draw.choices(words, k=draw.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "null id", "x"), (5, "again", "x")], "doc_id long, text string, block string").repartition(3)
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 500)
    got = {(r.doc_id, r.groups_sha256): tuple(r)[1:] for r in token_align.aligned(rows, A, B).collect()}
    plain = plain_alignment([*texts, "null id", "again"])
    assert got == {(i, p[-1]): (*p[:4], *p[4:]) for i, p in zip([*range(len(texts)), None, 5], plain)}
    assert plain[6] == (0, 0, 0, 0, 0, 0, "") and plain[5][0] > 0
    assert token_align.aligned(rows.limit(0), A, B).count() == 0


def test_alignment_of_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 1500")
    held = rows.collect()
    got = {r.doc_id: tuple(r)[1:] for r in token_align.aligned(rows, A, B).collect()}
    assert len(held) > 50 and got == dict(zip([r.doc_id for r in held], plain_alignment([r.text for r in held])))


def test_alignment_query(spark):
    got = queries.queries()["op12_token_align"](spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and got.count() == 200


# centroids
def plain_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    nearest = lambda x: min(range(len(c)), key=lambda n: (far(x, c[n]), n))
    for _ in range(rounds):
        at = [nearest(x) for _, x in kept]
        for n in set(at):
            mine = [x for (_, x), m in zip(kept, at) if m == n]
            c[n] = [sum(v) // len(mine) for v in zip(*mine)]
    at = [nearest(x) for _, x in kept]
    d = [far(x, c[n]) for (_, x), n in zip(kept, at)]
    per = Counter()
    for n, v in zip(at, d):
        per[n] += v
    return sorted((-1 if i is None else i, n, v, per[n], sum(d), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), n, v in zip(kept, at, d))


def clustered(rows, **options):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, centroids.measured(*centroids.cluster(rows, **options)).collect()))


def test_clusters(spark):
    draw = random.Random(5)
    # coarse values: many ties and repeated vectors
    rows = [(k, [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for k in range(300)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (7, [0.1, 0.2, 0.3, 0.4]), (900, None), (901, [1.0]), (902, [None, 1.0, 1.0, 1.0]), (903, [math.nan, 1.0, 1.0, 1.0]), (904, [math.inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<float>, cluster string, x int").repartition(3)
    assert clustered(df, k=12, size=4) == plain_clusters(rows, 12, size=4)
    few = rows[:5]
    assert clustered(df.where("vec_id < 5"), k=12, size=4) == plain_clusters(few, 12, size=4)
    assert clustered(df.limit(0), size=4) == []


def test_clusters_of_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, queries.queries()["op11_centroids"](spark, SMALL).collect()))
    assert got == plain_clusters(rows)


def test_bounds():
    """Whatever the moves, clusters are the full scan's, bounds hold, and rows far from borders are not scanned."""
    draw = np.random.default_rng(1)
    # clear groups: most bounds hold through small moves
    middle = draw.integers(-4000, 4000, (12, 8))
    x = (middle[draw.integers(0, 12, 2000)] + draw.integers(-90, 90, (2000, 8))).astype(np.int64)
    c = x[:12].copy()
    cluster, upper, lower = centroids.scan(x, c)
    scanned = 0
    for r in range(6):
        new = c + draw.integers(-20, 20, c.shape)
        cluster, upper, lower, n = centroids.Round(c, new).assign(x, cluster, upper, lower)
        d = centroids.squared(x, new)
        assert (cluster == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(len(x)), cluster])
        d[np.arange(len(x)), cluster] = 1 << 60
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(1))).all()
        scanned, c = scanned + n, new
    assert 0 < scanned < 6 * len(x) * 0.9
    big = np.array([[centroids.MOST] * 64, [-centroids.MOST] * 64], np.int64)
    assert centroids.squared(big, big)[0, 1] == 64 * (2 * centroids.MOST) ** 2


def test_extreme_components(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.x for r in centroids.vectors(df, 2).collect()} == {1: [centroids.MOST, -centroids.MOST], 2: [256, 0]}


# URL filters
def plain_verdicts(urls, rules, hosts):
    out = []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((host, path, best and best[2], best[3] if best else "block" if host and host in hosts else "allow"))
    return out


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org/es", "x://example.org/en/12?q#f", "http://org/", "http://org", "http://xorg/", "http://b.com/de/#/fr/", "http://b.com/fr/1", "http://u:p@c.com:80/de/", "http://a://b/c", "http://d.net?x=/y", "http://d.net#f", "http://\u00c9.com/de/x", "//x.com/de/", "http://c.com/" + "y" * 5000, "http://d.net/z"]


@pytest.mark.parametrize("most_bytes", [1 << 20, 30])
def test_verdicts(spark, most_bytes):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, "http://b.com/de/"), (3, "http://d.net/z")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    rules = url_filter.rules_table(spark)
    hosts = spark.createDataFrame([("d.net",), ("D.net",), ("elsewhere.net",), ("xorg",), ("",), (None,)], "host string")
    got = url_filter.with_verdicts(url_filter.with_rules(pages, rules, most_bytes), rules, hosts, most_bytes)
    want = [(i, *p) for (i, _), p in zip(rows, plain_verdicts([u for _, u in rows], url_filter.RULES, {"d.net", "elsewhere.net", "xorg"}))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    none = url_filter.with_rules(pages.limit(0), rules)
    assert none.count() == 0 and url_filter.with_verdicts(none, rules, hosts).count() == 0


def test_rules_of_one_key_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/xy"), (2, "http://c/")], "page_id long, url string")
    rules = spark.createDataFrame([("c", "/x", "allow"), ("C", "/x", "block"), ("b.c", "", "allow"), ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    hosts = spark.createDataFrame([], "host string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.with_verdicts(url_filter.with_rules(pages, rules), rules, hosts).collect()}
    # of b.c and c/x, equally long, the longer host
    assert got == {1: ("b.c", "allow"), 2: (None, "allow")}
    got = url_filter.with_verdicts(url_filter.with_rules(pages, rules.limit(0)), rules.limit(0), spark.createDataFrame([("c",)], "host string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: (None, "allow"), 2: (None, "block")}


@pytest.mark.parametrize("parts", [1, 3])
def test_cascade_is_exact(spark, monkeypatch, parts):
    """Weak levels: many of them, and every key of the universe told rightly."""
    monkeypatch.setattr(url_filter, "_shape", lambda n, others, place: (64 * math.ceil(max(64, 2 * n) / 64), 1))
    monkeypatch.setattr(url_filter, "SMALL", 0)
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    listed = keys.where("listed").select("key").unionByName(spark.createDataFrame([("absent",), (None,)], "key string"))
    n = keys.where("listed").count()
    made = url_filter.cascade(keys.select("key").unionByName(keys.select("key")), listed, 1 << 20 if parts == 1 else ((2 * n + 23 * n) // 8) // 2)
    assert len(made.parts) == parts and all(len(p.levels) > 3 for p in made.parts)
    told = made.mark(keys.select("key", "listed", F.array("key").alias("keys")), "keys", "hit").collect()
    assert len(told) == 3000 and all(r.hit == [r.listed] for r in told)
    assert not made.parts[0].blocks.inputFiles() == []


def test_native(spark):
    plan = queries.queries()["op13_url_filter"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDD", "CartesianProduct", "NestedLoop"))
