"""CSV in many tasks, the versioned store, and prompt runs that resume."""

import random

import pytest
from pyspark.sql import functions as F

from verbatix.operators import prompts
from verbatix.sources import corpus as C
from verbatix.sources import store as S


def write(path, records, end="\n", header=True):
    quoted = lambda v: v if v and not any(c in v for c in '",\n\r') else '"' + v.replace('"', '""') + '"'
    lines = (["id,text,label,bucket"] if header else []) + [",".join(map(quoted, r)) for r in records]
    path.write_bytes((end.join(lines) + end).encode())


@pytest.mark.parametrize("seed", range(4))
def test_split_csv_is_the_whole_scan(spark, tmp_path, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices(["a", "é", '"', ",", "\n", "\n\n", " ", "x,y", '""', "[FSLUR_01]"], k=draw.randint(1, 12)))
    files = tmp_path / "csv"
    files.mkdir()
    want = []
    for n in range(2):
        records = [(f"{n}-{k}", word(), "MGY", word()) for k in range(draw.randint(0, 120))]
        write(files / f"{n}.csv", records, "\r\n" if seed == 3 else "\n")
        want += records
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # blocks of 60 bytes: records across many of them
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        split = C.scan_csv_split(spark, str(files))
        assert split.inputFiles() and spark.read.text(str(files), lineSep="\n").rdd.getNumPartitions() > 5
        got = sorted(map(tuple, split.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(want)
    if seed != 3:
        assert got == sorted(map(tuple, C.scan_csv(spark, str(files)).collect()))


def test_split_csv_header(spark, tmp_path):
    write(tmp_path / "a.csv", [("1", "t", "l", "b")], header=False)
    with pytest.raises(Exception, match="unexpected header"):
        C.scan_csv_split(spark, str(tmp_path / "a.csv")).collect()


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_TABLES", 3)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    store = S.Store(spark, str(tmp_path / "s"), ("k",))
    assert store.read() is None and store.versions() == {}
    assert store.put(rows(("a", 1), ("b", 1)), "one") == 1
    # a change made again is there already
    assert store.put(rows(("a", 9)), "one") == 1
    for n in range(2, 8):
        assert store.put(rows(("a", n), (f"k{n}", n))) == n
    assert {r.k: r.v for r in store.read().collect()} == {"a": 7, "b": 1, **{f"k{n}": n for n in range(2, 8)}}
    assert {r.k: r.v for r in store.read(2).collect()} == {"a": 2, "b": 1, "k2": 2} and store.read(99) is None
    assert all(len(t) <= 3 for t, _ in store.versions().values())
    # a writer that died leaves an empty version: readers pass over it, writers take the next number
    (tmp_path / "s" / "versions" / "8").write_bytes(b"")
    again = S.Store(spark, str(tmp_path / "s"), ("k",))
    assert {r.k: r.v for r in again.read().collect()}["a"] == 7 and again.put(rows(("a", 10))) == 9
    assert {r.k: r.v for r in again.read().collect()}["a"] == 10


def test_prompts_resume(spark, tmp_path):
    """A run that dies asks only the rest when it comes again; equal texts are asked once."""
    asked, limit = tmp_path / "asked", tmp_path / "limit"
    asked.write_text("")
    limit.write_text("10")

    def client(system, user):
        done = asked.read_text().count("\n")
        if done >= int(limit.read_text()):
            raise OSError("killed")
        with open(asked, "a") as f:
            f.write("x\n")
        return "LABEL: MGY" if "bad" in user else "LABEL: NOT"

    rows = spark.createDataFrame([(k, f"text {k % 8} {'bad' if k % 2 else 'good'}", "MGY" if k % 2 else "NOT") for k in range(24)] + [(99, None, "NOT")], "id long, text string, label string").coalesce(1)
    few = prompts.prompts(spark).limit(2)
    store = S.Store(spark, str(tmp_path / "answers"), ("model", "prompt", "text_md5"))
    with pytest.raises(Exception, match="killed"):
        prompts.ask_and_store(rows, few, client, "m", store, tries=1)
    kept = store.read().count()
    # nine different texts: the first prompt is stored, the second died
    assert kept == 9 and asked.read_text().count("\n") == 10
    limit.write_text("1000")
    got = prompts.ask_and_store(rows, few, client, "m", store, parts=2)
    assert got.count() == 50 and got.where("label <> pred and prompt not like '%few%'").where(F.col("text").isNotNull()).count() == 0
    assert asked.read_text().count("\n") == 10 + 9
    prompts.ask_and_store(rows, few, client, "m", store).count()
    assert asked.read_text().count("\n") == 19
    # answers that failed are asked again
    limit.write_text("19")
    other = S.Store(spark, str(tmp_path / "other"), ("model", "prompt", "text_md5"))
    assert prompts.ask_and_store(rows, few, client, "m", other, skip=True, tries=2, pause=0.01, per_second=1000.0).count() == 0 and other.read() is None
