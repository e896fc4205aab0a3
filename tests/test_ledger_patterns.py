"""Many-word matching, appends by key, shards and CSV files read by ranges, and the keyed permutation."""

import csv
import gzip
import io
import json
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions import patterns, permute
from tessella.functions import text as T
from tessella.operators import order, prefs
from tessella.sources import csv_split, shards
from tessella.sources.ledger import Conflict, Ledger
from tessella.streaming import resume

REPO = str(Path(__file__).resolve().parent.parent)


# --- words ---------------------------------------------------------------------------


def some_words(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcあ") for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_contains_any_and_groups_are_substring_tests(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcあx ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    words = [w for w in some_words(40) if len(w) > 2] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["hit"] for r in df.select("i", T.contains_any("t", words).alias("hit")).collect()}
    assert got == {i: None if t is None else any(w in t for w in words if w) for i, t in enumerate(texts)}
    groups = {"b": words[:15], "a": words[15:30], "none": ["zzz"], "empty": []}
    got = {r["i"]: r["g"] for r in df.select("i", T.matched_groups(groups, "t").alias("g")).collect()}
    assert got == {i: sorted(g for g, ws in groups.items() if t and any(w and w in t for w in ws)) for i, t in enumerate(texts)}
    two = df.select(T.matched_groups({"g": ["ab"]}, F.lit("a"), F.lit("b")).alias("g")).first()["g"]
    assert two == []  # no match across columns


def test_words_in_nfkc(spark):
    df = spark.createDataFrame([("ＡＢＣ１２３",), ("abc",)], "t string")
    got = [r["x"] for r in df.select(patterns.contains_any(F.col("t"), ["ABC1", "①②③4"], normal=True).alias("x")).collect()]
    assert got == [True, False]


@pytest.mark.parametrize("most", [4_000_000, 300, 20])
def test_topics_in_blocks(spark, most):
    words = some_words(400, 3) + ["", None]
    texts = ["".join(random.Random(i).choice("abcあx") for _ in range(30)) for i in range(40)] + [None, ""]
    t = spark.createDataFrame([(w,) for w in words], "topic string")
    p = spark.createDataFrame([(x,) for x in texts], "prompt string").repartition(3)
    got = [r["topic"] for r in patterns.words_in(t, p, "topic", "prompt", most).collect()]
    assert sorted(got) == sorted({w for w in words if w and any(w in (x or "") for x in texts)})
    assert patterns.words_in(t.limit(0), p, "topic", "prompt").count() == 0
    if most == 20:
        cut = list(patterns.blocks(t, "topic", most))
        assert len(cut) > 10 and sorted(w for b in cut for w in b) == sorted({w for w in words if w})


def test_cost_follows_the_text_not_the_words():
    import time

    text = "ab" * 200_000
    took = []
    for n in (10, 20_000):
        a = patterns.automaton(tuple(f"ab{i}x" for i in range(n)))
        begin = time.process_time()
        assert not patterns.places(a, text)
        took.append(time.process_time() - begin)
    assert took[1] < 20 * took[0] + 0.2


# --- the ledger ----------------------------------------------------------------------

SCHEMA = "id bigint, k int, text string"


def ledger(spark, root):
    return Ledger(spark, str(root), ["id", "k"], SCHEMA)


def rows(spark, *ids, text="x"):
    return spark.createDataFrame([(i, 0, text) for i in ids], SCHEMA)


def test_append_adds_each_key_once(spark, tmp_path):
    own = ledger(spark, tmp_path / "t")
    assert own.read().count() == 0 and own.version() == 0
    assert own.append(spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (2, 0, "c"), (None, None, "n"), (None, None, "m")], SCHEMA)) == 3
    assert own.append(rows(spark, 2, 3, None)) == 2  # (null, 0) is another key than (null, null)
    assert own.append(rows(spark, 2, 3)) == 0 and own.version() == 2
    got = sorted(((r["id"], r["k"], r["text"]) for r in own.read().collect()), key=str)
    assert got == sorted([(1, 0, "a"), (2, 0, "c"), (None, None, "m"), (3, 0, "x"), (None, 0, "x")], key=str)
    assert own.read(1).count() == 3 and own.known(2, 1).count() == 2


def test_a_failing_gate_shows_nothing(spark, tmp_path):
    own = ledger(spark, tmp_path / "t")
    own.append(rows(spark, 1))

    def gate(staged):
        assert staged.count() == 2
        raise ValueError("a mean outside its band")

    with pytest.raises(ValueError, match="band"):
        own.append(rows(spark, 1, 2, 3), [gate])
    assert own.read().count() == 1 and own.version() == 1 and own.tidy() == 0
    assert own.append(rows(spark, 1, 2, 3), [lambda staged: None]) == 2


def test_two_writers_that_stage_at_once(spark, tmp_path):
    a, b = ledger(spark, tmp_path / "t"), ledger(spark, tmp_path / "t")
    first, second = a.stage(rows(spark, 1, 2, text="a")), b.stage(rows(spark, 2, 3, text="b"))
    assert second.publish() == 2 and first.publish() == 1
    assert sorted((r["id"], r["text"]) for r in a.read().collect()) == [(1, "a"), (2, "b"), (3, "b")]
    with pytest.raises(Conflict):
        a._put(2, [])
    assert not [n for n in os.listdir(tmp_path / "t" / "versions") if n.endswith(".tmp")]


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tessella.sources.ledger import Attempt, Ledger
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
own = Ledger(spark, {root!r}, ["id", "k"], {schema!r})
own.append(spark.createDataFrame([(1, 0, "one")], {schema!r}))
{kill}
own.append(spark.createDataFrame([(1, 0, "again"), (2, 0, "two")], {schema!r}))
"""


@pytest.mark.parametrize("kill", ["Attempt.publish = lambda *a: os._exit(9)", "Ledger._put = lambda *a: os._exit(9)", "Attempt.write = lambda self, df: (df.write.parquet(own.root + '/attempts/' + self.name + '/rows'), os._exit(9))"])
def test_a_job_killed_before_it_publishes(spark, tmp_path, kill):
    root = str(tmp_path / "t")
    run = subprocess.run([sys.executable, "-c", KILLED.format(repo=REPO, root=root, schema=SCHEMA, kill=kill)], capture_output=True, timeout=300)
    assert run.returncode == 9, run.stderr[-2000:]
    own = ledger(spark, root)
    assert [(r["id"], r["text"]) for r in own.read().collect()] == [(1, "one")]
    assert own.append(spark.createDataFrame([(1, 0, "again"), (2, 0, "two")], SCHEMA)) == 1
    assert sorted((r["id"], r["text"]) for r in own.read().collect()) == [(1, "one"), (2, "two")]
    assert own.tidy() == 1 and own.read().count() == 2


def test_a_streams_batches_are_published_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "t"
    source.mkdir()
    (source / "a.json").write_text('{"id": 1, "k": 0, "text": "a"}\n{"id": 2, "k": 0, "text": "b"}\n')
    own = ledger(spark, out)
    stream = lambda: resume.bounded_stream(spark, str(source), SCHEMA)
    resume.append_exactly_once(stream(), own, str(tmp_path / "c1"))
    resume.append_exactly_once(stream(), own, str(tmp_path / "c2"), work=lambda df: df.withColumn("id", F.col("id") + 10))  # the same batch number: published already
    assert own.read().count() == 2 and own.version() == 1
    (source / "b.json").write_text('{"id": 2, "k": 0, "text": "c"}\n{"id": 3, "k": 0, "text": "d"}\n')
    resume.append_exactly_once(stream(), own, str(tmp_path / "c1"))
    assert sorted(r["id"] for r in own.read().collect()) == [1, 2, 3] and own.version() == 2


def test_judged_rows_with_a_gate(spark, tmp_path):
    from tessella.sources import writers

    own = ledger(spark, tmp_path / "t")
    judge = lambda f: f.assign(text="judged")[["id", "k", "text"]]
    assert writers.judge_into(own, rows(spark, 1, 2, 2), judge) == 2 and writers.judge_into(own, rows(spark, 2, 3), judge) == 1
    with pytest.raises(ValueError, match="no"):
        writers.judge_into(own, rows(spark, 4), judge, [lambda staged: (_ for _ in ()).throw(ValueError("no"))])
    assert own.read().filter("text = 'judged'").count() == 3


# --- shards --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("shards")
    n = 0
    for i in range(4):
        lines = []
        for _ in range(50):
            lines.append(json.dumps({"id": n, "text": None if n % 11 == 0 else f"text é {n} " + "x" * (n % 40), "score": n / 2, "tags": ["a", str(n)], "more": 1}, ensure_ascii=False))
            n += 1
            if n % 9 == 0:
                lines.append("")
        data = "\n".join(lines).encode() + b"\n" * (i % 2)
        name = at / f"part-{i}.jsonl"
        if i == 2:
            (at / f"part-{i}.jsonl.gz").write_bytes(gzip.compress(data))
        else:
            name.write_bytes(data)
    (at / "_hidden").write_text("no json")
    return at


SHARD_SCHEMA = "id bigint, text string, score double, tags array<string>, absent string"


def source(spark, path, schema=SHARD_SCHEMA, **options):
    return spark.read.format(shards.register(spark)).schema(schema).options(**{k: str(v) for k, v in options.items()}).load(str(path))


@pytest.mark.parametrize("split", [17, 300, 1 << 26])
def test_shards_in_byte_ranges(spark, folder, split):
    got = source(spark, folder, splitBytes=split).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(200)) and got[5]["tags"] == ["a", "5"] and got[0]["text"] is None and got[7]["score"] == 3.5
    assert all(r["absent"] is None for r in got)


WHERE = {
    "id > 20 AND id <= 60": [["id", ">", 20], ["id", "<=", 60]],
    "text IS NULL": [["text", "null"]],
    "NOT text LIKE 'text é 1%'": [["not", ["text", "startswith", "text é 1"]]],
    "text LIKE '%xxx' AND id IN (3, 44, 70, null)": [["text", "endswith", "xxx"], ["id", "in", [3, 44, 70, None]]],
    "NOT (id IN (1, null))": [["not", ["id", "in", [1, None]]]],
    "text <=> null": [["text", "<=>", None]],
    "score = 10.5": [["score", "=", 10.5]],
    "text LIKE '%é 19%' AND score < 97": [["text", "contains", "é 19"], ["score", "<", 97]],
    "shard = 'part-1.jsonl'": [["shard", "=", "part-1.jsonl"]],
    "text = null": [["text", "=", None]],
}


def test_conditions_are_decided_by_the_source(spark, folder):
    schema = SHARD_SCHEMA + ", shard string"
    whole = source(spark, folder, schema=schema, shardColumn="shard").collect()
    for sql, where in WHERE.items():
        got = source(spark, folder, schema=schema, shardColumn="shard", where=json.dumps(where))
        want = spark.createDataFrame(whole, schema).filter(sql)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()), sql
    assert source(spark, folder, schema=schema, shardColumn="shard", where='[["shard", "=", "part-1.jsonl"]]').rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="unknown condition"):
        source(spark, folder, where='[["id", "near", 3]]').collect()


def test_a_loaded_frame_serves_several_queries(spark, folder):
    df = source(spark, folder)
    assert [df.count(), df.filter("id = 3").count(), df.count(), df.filter("id = 3 OR id = 4").count(), df.filter("id > 189").count()] == [200, 1, 200, 2, 10]


def test_a_bounded_read_stops_at_its_limit(spark, folder, tmp_path):
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\nno json\n')
    (bad / "b.jsonl").write_text("no json\n")
    assert [r["id"] for r in source(spark, bad, limit=2).collect()] == [1, 2]  # what stands behind is never decoded
    with pytest.raises(Exception, match="a.jsonl, byte 20"):
        source(spark, bad, limit=3).collect()
    assert [r["id"] for r in source(spark, bad, mode="skip").collect()] == [1, 2]
    assert source(spark, folder, limit=0).count() == 0 and source(spark, folder, limit=120).count() == 120
    with pytest.raises(Exception, match="none"):
        source(spark, tmp_path / "none").collect()


def test_a_limit_reads_no_further_shards(folder):
    from tessella.sources import files

    read, own = Counter(), files.lines

    def counted(uri, begin, end, block=1 << 20):
        for x in own(uri, begin, end, block):
            read[uri.rsplit("/", 1)[-1]] += 1
            yield x

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id long") if hasattr(StructType, "fromDDL") else None
    reader = shards.ShardReader(schema, {"path": str(folder), "limit": "60"})
    files.lines = counted
    try:
        assert len(list(reader.read(reader.partitions()[0]))) == 60
    finally:
        files.lines = own
    assert set(read) == {"part-0.jsonl", "part-1.jsonl"} and read["part-1.jsonl"] < 15


def test_a_stream_over_shards_resumes(spark, folder, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for name in ("part-0.jsonl", "part-1.jsonl", "part-2.jsonl.gz"):
        (data / name).write_bytes((folder / name).read_bytes())
    name = shards.register(spark)

    def run():
        stream = spark.readStream.format(name).schema("id bigint").option("maxBytesPerTrigger", "900").load(str(data))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if q.exception():
            raise q.exception()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for _ in range(40):
        got = run()
        if len(got) >= 150:
            break
    assert got == list(range(150))
    (data / "part-3.jsonl").write_bytes((folder / "part-3.jsonl").read_bytes())
    for _ in range(20):
        got = run()
        if len(got) >= 200:
            break
    assert got == list(range(200))


# --- CSV -----------------------------------------------------------------------------


def fuzzed(rng, wild):
    if wild:
        body = "".join(rng.choice(["a", "b", '"', '""', ",", ",", "\n", "\r\n", "\r", "é", 'x"y', ',"', '"\n']) for _ in range(rng.randint(0, 400)))
    else:
        s = io.StringIO(newline="")
        w = csv.writer(s, lineterminator=rng.choice(["\n", "\r\n"]))
        for _ in range(rng.randint(0, 60)):
            w.writerow(["".join(rng.choice(["a", '"', ",", "\n", "\r\n", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 4))])
        body = s.getvalue()
    return (csv_split.MARK if rng.random() < 0.5 else b"") + b"h1,h2,h3\n" + body.encode()


@pytest.mark.parametrize("split", [3, 64])
def test_csv_ranges_equal_pythons_reader(spark, tmp_path, split):
    rng, want = random.Random(split), []
    for i in range(6):
        raw = fuzzed(rng, i % 2)
        (tmp_path / f"{i}.csv").write_bytes(raw)
        text = raw.removeprefix(csv_split.MARK).decode()
        for r in list(csv.reader(io.StringIO(text, newline="")))[1:]:
            if r:
                want.append((r[2] if len(r) > 2 else None, r[0], None))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b'"h1","h2"')
    df = csv_split.read(spark, str(tmp_path), "h3 string, h1 string, other string", split)
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)


def test_one_csv_file_becomes_many_tasks(spark, tmp_path):
    path = tmp_path / "one.csv"
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "text"])
        for i in range(5000):
            w.writerow([i, f'line "{i}",\nsecond line\r\n' * (i % 5)])
    df = csv_split.read(spark, str(path), "id string, text string", 20_000)
    got = {int(r["id"]): r["text"] for r in df.collect()}
    assert got == {i: f'line "{i}",\nsecond line\r\n' * (i % 5) for i in range(5000)}
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8


# --- permutation ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4099])
def test_places_are_a_bijection(spark, n):
    df = spark.range(n)
    got = [r["p"] for r in df.orderBy("id").select(permute.place(F.col("id"), n, 7).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 50:
        other = [r["p"] for r in df.orderBy("id").select(permute.place(F.col("id"), n, 8).alias("p")).collect()]
        assert sum(a == b for a, b in zip(got, other, strict=True)) < n // 5 and sum(a == i for i, a in enumerate(got)) < n // 5
        up = sum(b > a for a, b in zip(got, got[1:], strict=False))
        assert 0.4 * n < up < 0.6 * n  # neighbours fall apart


def test_places_of_large_positions_and_wrong_ones(spark):
    n = 1 << 40
    df = spark.createDataFrame([(x,) for x in (0, 1, n // 2, n - 1)], "id bigint")
    got = [r["p"] for r in df.select(permute.place(F.col("id"), n, 1).alias("p")).collect()]
    assert len(set(got)) == 4 and all(0 <= x < n for x in got)
    with pytest.raises(Exception, match="outside"):
        df.select(permute.place(F.col("id"), 5, 1)).collect()


def test_a_mixture_in_a_global_order(spark):
    df = spark.createDataFrame([(i, "en" if i % 3 else "ja") for i in range(300)], "id bigint, language string")
    out, _ = order.mix(df, {"en": 0.5, "ja": 0.5}, seed=3, place="place")
    got = out.collect()
    assert sorted(r["place"] for r in got) == list(range(200)) and len({r["id"] for r in got}) == 200
    first = Counter(r["language"] for r in got if r["place"] < 100)
    assert 30 < first["ja"] < 70
    again, other = order.mix(df, {"en": 0.5, "ja": 0.5}, seed=3, place="place")[0], order.mix(df, {"en": 0.5, "ja": 0.5}, seed=4, place="place")[0]
    assert sorted((r["id"], r["place"]) for r in again.collect()) == sorted((r["id"], r["place"]) for r in got)
    assert sorted((r["place"], r["id"]) for r in other.collect())[:20] != sorted((r["place"], r["id"]) for r in got)[:20]


# --- rows that once were lost --------------------------------------------------------


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, "x")], "id bigint, g string, h string")
    assert sorted(r["id"] for r in order.budget_prefix(df, F.lit(1), 5, ["g"], 42, "id").collect()) == [1, 2, 3, 4]
    assert len(order.budget_prefix(df, F.lit(1), 1, ["g", "h"], 42, "id").collect()) == 2


def test_weight_zero_gives_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, t string")
    assert order.oversample(df, 0).count() == 0 and order.oversample(df, -2).count() == 0 and order.oversample(df, 2).count() == 2
    assert order.oversample(df, 0).schema == order.oversample(df, 2).schema


def test_repeated_and_null_keys_in_contamination(spark):
    from tessella.operators import clean

    docs = spark.createDataFrame([(1, "abcdef"), (1, "uvwxyz"), (None, "uvwxyz"), (None, None), (2, "")], "id bigint, text string")
    evals = spark.createDataFrame([("uvwxyz",)], "text string")
    for most in (8_000_000, 1):
        got = Counter((r["id"], r["overlap"]) for r in clean.contamination(docs, evals, 3, "id", most_pool=most).collect())
        assert got == Counter([(1, 0.0), (1, 1.0), (None, 1.0), (None, 0.0), (2, 0.0)])


def test_a_null_corpus_is_cleaned_too(spark):
    from tessella.operators import clean

    text = "This is a plain English sentence about nothing much, number one. " * 3
    other = "Another paragraph of entirely different words follows here for the test. " * 3
    df = spark.createDataFrame([(None, 0, text), (None, 1, text), (None, 2, other), ("c", 0, text)], "corpus string, pos bigint, text string")
    got = {(r["corpus"], r["pos"]): r["stage"] for r in clean.clean_corpus(df, spark.createDataFrame([(other,)], "text string")).collect()}
    assert got == {(None, 0): None, (None, 1): "dedup", (None, 2): "contamination", ("c", 0): None}


def test_a_pool_may_not_have_an_evaluations_minimum(spark):
    detail = "constraint_detail struct<min:int,max:int>"
    pool = spark.createDataFrame([("char_count", (30, None), "topic one")], f"category string, {detail}, topic string")
    evals = spark.createDataFrame([("nothing of it",)], "prompt string")
    prefs.assert_disjoint(pool, evals, [30])
    with pytest.raises(ValueError, match="bound"):
        prefs.assert_disjoint(pool, evals, [30], prefs.BOUNDS)


def test_signatures_estimate_similarity():
    import numpy as np

    from tessella.operators import clean

    rng, off = random.Random(5), []
    fill = np.argsort(np.random.default_rng(1).random((128, 128)), axis=1)
    for _ in range(150):
        n = rng.randint(60, 400)
        a = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
        cut = rng.randint(0, n)
        b = a[:cut] + "".join(rng.choice("abcdefghijklmnop") for _ in range(n - cut))
        x, y = set(clean.gram_hashes(a, 5).tolist()), set(clean.gram_hashes(b, 5).tolist())
        s, t = clean.signature(a, 128, 5, fill), clean.signature(b, 128, 5, fill)
        off.append(float((s == t).mean()) - len(x & y) / len(x | y))
    assert abs(sum(off)) / len(off) < 0.01 and sum(map(abs, off)) / len(off) < 0.04
    assert clean.signature("", 128, 5, fill) is None


def test_many_words_take_one_pass_over_the_texts(spark):
    """Words of many sizes, far more than one automaton takes, are found and the texts are read once."""
    words = some_words(3000, 5) + ["", None, "x" * 40]
    texts = ["".join(random.Random(i).choice("abcあ😀x") for _ in range(60)) for i in range(60)] + ["x" * 50, None, ""]
    read = spark.sparkContext.accumulator(0)

    def count(them):
        for b in them:
            read.add(b.num_rows)
            yield b

    t = spark.createDataFrame([(w,) for w in words], "topic string")
    p = spark.createDataFrame([(x,) for x in texts], "prompt string").repartition(3).mapInArrow(count, "prompt string")
    got = [r["topic"] for r in patterns.words_in(t, p, "topic", "prompt", 500).collect()]
    assert sorted(got) == sorted({w for w in words if w and any(w in (x or "") for x in texts)})
    assert read.value == len(texts)
