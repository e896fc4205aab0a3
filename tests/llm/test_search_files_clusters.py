"""Ranked search, token files and centroid clustering against brute force, the library and round trips."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from tessella.llm import centroids, pretokens, ranked_search, token_files
from tessella.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"wörd{i % 977} it's {i}" for i in range(120_000))  # some 2 million characters


def spec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


# --- pre-tokens ----------------------------------------------------------------------


def test_split_is_what_the_pattern_matches():
    import regex

    assert public_tokenizers.PATTERN == pretokens.PATTERN
    rng, find = random.Random(1), regex.compile(pretokens.PATTERN).findall
    alphabet = [*"ab'sstdmrevl l  \n\t é12!?'　日\U0001f600 ", "'s", "'re", "'ll", "  "]
    for _ in range(2000):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        cp, _ = pretokens.code_points(texts)
        got = [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(*pretokens.split(cp), strict=True)]
        assert got == [x for t in texts for x in find(t)]


def test_parts_of_a_long_text_are_split_as_the_whole():
    import regex

    find = regex.compile(pretokens.PATTERN).findall
    cut = list(pretokens.parts(LONG, 10_000))
    assert len(cut) > 100 and "".join(cut) == LONG and [x for p in cut for x in find(p)] == find(LONG)
    assert list(pretokens.parts("x" * 50_000, 10_000)) == ["x" * 50_000] and list(pretokens.parts(None)) == [""]


def test_codec_gives_the_librarys_ids():
    codec = token_files.LibraryCodec(spec())
    texts = ["", None, "it's <|endoftext|> ok", "日本語 テスト", "ᲊ՘ new letters \U00010940", "a  b\n\n c ", "'s 'll", "x" * 5000, LONG]
    plain = [codec.own.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, at = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain
    codec.memo.limit = 50  # hardly anything is remembered
    for t, want in zip(texts[:-1], plain, strict=False):
        assert codec.encode([t])[0].tolist() == want


# --- token files ---------------------------------------------------------------------


ROWS = [(i, f"document {i} " + "word " * (i % 7)) for i in range(200)] + [(None, "no id"), (None, None), (5, "twice"), (5, "twice"), (900, None), (901, ""), (902, LONG), (-3, "first")]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ids") / "files")
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], "doc_id bigint, text string, h string, at int, file string").repartition(3)
    token_files.write_tokens(df, root, spec(), frame_tokens=1000, files=5)
    return root


def test_token_files_round_trip(spark, files):
    codec = token_files.LibraryCodec(spec())
    want = Counter((i, tuple([*codec.own.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in ROWS)
    out = token_files.read_tokens(spark, files).orderBy("start").collect()
    assert Counter((r["id"], tuple(r["ids"])) for r in out) == want
    keys = [(r["id"] is not None, r["id"] or 0) for r in out]
    assert keys == sorted(keys)
    at = 0
    for r in out:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += len(r["ids"])
    m = token_files.manifest(spark, files).collect()
    assert sum(r["tokens"] for r in m) == at and sum(r["docs"] for r in m) == len(ROWS) and len(m) > 1


def test_only_frames_of_the_wanted_documents_are_read(spark, files):
    wanted = spark.createDataFrame([(i,) for i in (7, 902, None, 12345, 5)], "key bigint")
    got = token_files.read_documents(spark, files, wanted, "key").collect()
    assert Counter(r["id"] for r in got) == Counter([7, 902, None, None, 5, 5, 5])
    by = {r["start"]: r for r in token_files.read_tokens(spark, files).collect()}
    assert Counter((r["id"], tuple(r["ids"])) for r in got) == Counter((r["id"], tuple(r["ids"])) for r in by.values() if r["id"] in (7, 902, None, 5))
    from pyarrow import fs

    for r in token_files.manifest(spark, files).collect():
        with fs.LocalFileSystem().open_input_file(f"{files}/{r['file']}") as f:
            reader = token_files.TokenFileReader(f, r["file"])
            assert len(list(reader.documents(np.array([0])))) == 1 and reader.read <= 1 + reader.sizes[0] // 1000 + 1
            frames, reader.read = len(reader.first), 0
            assert len(list(reader.documents())) == r["docs"] and reader.read == frames


def test_any_zstandard_reader_gives_all_ids(spark, files):
    for r in token_files.manifest(spark, files).collect():
        with open(f"{files}/{r['file']}", "rb") as f:
            raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert len(np.frombuffer(raw, "<u2")) == r["tokens"]


def test_damage_is_found_and_stray_files_are_not_read(spark, tmp_path):
    root = str(tmp_path / "files")
    token_files.write_tokens(spark.createDataFrame([(i, "some words " * 50) for i in range(20)], "doc_id bigint, text string"), root, spec(), frame_tokens=100, files=2)
    n = token_files.read_tokens(spark, root, ids=False).count()
    (tmp_path / "files" / "part-00000-lost.ids.zst").write_bytes(b"half a file")
    assert token_files.read_tokens(spark, root, ids=False).count() == n == 20
    one = tmp_path / "files" / token_files.manifest(spark, root).orderBy("part").first()["file"]
    raw = bytearray(one.read_bytes())
    raw[20] ^= 0xFF
    one.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="frame 0 is damaged"):
        token_files.read_tokens(spark, root).collect()
    one.write_bytes(bytes(raw[:-1]))
    with pytest.raises(Exception, match="no seek table"):
        token_files.read_tokens(spark, root).collect()


def test_token_files_of_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    token_files.write_tokens(df, str(tmp_path / "files"), spec())
    assert token_files.read_tokens(spark, str(tmp_path / "files")).count() == 0


# --- centroids -----------------------------------------------------------------------


@pytest.mark.parametrize("spread", [3, 40, 1000])
def test_annulus_equals_all_distances(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread + 1, (30, 4)) * rng.integers(1, 6, (30, 1))
    c[7] = c[3]  # equal centroids
    x = np.concatenate([rng.integers(-spread, spread + 1, (500, 4)) * rng.integers(1, 6, (500, 1)), c, np.zeros((1, 4), np.int64)])
    find = centroids.Annulus(c)
    number, d = find.nearest(x)
    all_ = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (number == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()
    assert find.compared < 0.8 * all_.size  # norms differ here
    k = (1 << 24) // (5 * spread)  # beyond exact doubles
    assert (centroids.Annulus(c * k).nearest(x * k)[0] == number).all()


def plain_clusters(rows, k, rounds, dim, scale, seed):
    import hashlib

    kept = {i: [math.floor(scale * y) for y in v] for i, v in rows if v is not None and len(v) == dim and all(y is not None and math.isfinite(y) for y in v)}
    start = sorted(kept, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    c = [kept[i] for i in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for v in kept.values():
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            c[j] = [sum(y) // len(g) for y in zip(*g, strict=True)]
    out = {i: near(v) for i, v in kept.items()}
    inertia = Counter()
    for d, j in out.values():
        inertia[j] += d
    return {i: (j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in out.items()}


@pytest.mark.parametrize("n", [300, 5, 0])
def test_clusters_equal_plain_python(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, [float(y) for y in rng.standard_normal(6) * (1 + i % 4)]) for i in range(n)]
    rows += [(1000, None), (1001, [1.0] * 5), (1002, [float("nan")] * 6), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1004, []), (1005, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id bigint, embedding array<double>, cluster string, distance int").repartition(4)
    out = centroids.cluster(df, k=8, rounds=3, dim=6, scale=10.0, seed=2)
    got = {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect()}
    assert got == plain_clusters(rows, 8, 3, 6, 10.0, 2)


def test_repeated_ids_and_large_components(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r["cluster"], r["distance"]) for r in centroids.cluster(df, k=2, dim=2).collect()) == [(0, 0), (1, 0), (1, 0)]  # both start at the same place, then one moves
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id bigint, embedding array<double>"), k=2, dim=2).collect()
    with pytest.raises(ValueError, match="more than the driver"):
        centroids.cluster(df, k=10**7, dim=64)


# --- ranked search -------------------------------------------------------------------


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(docs, queries, k):
    split = [(i, Counter(terms(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for q, text in queries:
        scored = []
        for i, c in split:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(q, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Größe", "naïve", "日本語", "x_y", "A1"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(25)]  # ties
    docs += [(3, "t1 t2 other"), (3, "t1 t2 other"), (None, docs[5][1]), (None, None), (700, None), (701, ""), (702, "... !!! --"), (703, " ".join(rng.choice(vocabulary) for _ in range(30_000)))]
    queries = [(i, docs[i * 7][1]) for i in range(20)] + [(3, "t1 t1 t1 T2"), (50, None), (51, "none of these"), (None, docs[2][1]), (52, "日本語 GRÖßE größe x y")]
    return docs, queries


def frames(spark, docs, queries):
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id bigint, text string, term string, shard int").repartition(4)
    q = spark.createDataFrame([(*r, 1) for r in queries], "item_id bigint, text string, q int")
    return d, q


@pytest.mark.parametrize(("window", "shard", "block"), [(1 << 13, 1 << 16, 200_000), (4, 7, 60)])
def test_search_equals_plain_python(spark, window, shard, block):
    docs, queries = corpus()
    d, q = frames(spark, docs, queries)
    index = ranked_search.build(d, Scratch(spark, "test"), most_docs=shard)
    assert (index.docs.count() > 20) == (shard == 7)
    out = ranked_search.search(index, q, block_terms=block, window=window)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()) == plain_search(docs, queries, 10)


def test_search_of_nothing(spark):
    docs, queries = corpus()
    d, q = frames(spark, docs, queries)
    none = ranked_search.build(d.filter("false"), Scratch(spark, "test"))
    assert ranked_search.search(none, q).count() == 0 and none.n == 0
    assert ranked_search.search(ranked_search.build(d, Scratch(spark, "test")), q.filter("false")).count() == 0


def test_merge_reads_few_postings_of_common_terms():
    rng = np.random.default_rng(1)
    n = 50_000
    every = np.arange(n), np.full(n, 10) + rng.integers(0, 3, n)
    rare = np.sort(rng.choice(n, 60, False)), np.full(60, 500)
    lists = [(*every, 12), (*rare, 500)]
    best = ranked_search.Best(10)
    read = ranked_search.merge(lists, best, list(range(n)))
    points = np.zeros(n, np.int64)
    points[every[0]] += every[1]
    points[rare[0]] += rare[1]
    assert sorted(best.rows(), key=lambda r: (-r[1], r[0])) == sorted(zip(range(n), points.tolist(), strict=True), key=lambda r: (-r[1], r[0]))[:10]
    assert read < n // 2


def test_postings_round_trip():
    rng = np.random.default_rng(2)
    lists = [(np.sort(rng.choice(1 << 16, n, False)), rng.integers(1, top, n)) for n, top in ((50, 3), (1, 300), (7, 70_000), (60_000, 2), (1, 2))]
    term = np.repeat(np.arange(len(lists), dtype=np.uint64) * np.uint64(1 << 60), [len(x) for x, _ in lists])
    start, blobs = ranked_search.pack(term, np.concatenate([x for x, _ in lists]), np.concatenate([c for _, c in lists]))
    assert (term[start] == np.unique(term)).all() and len(blobs[3].as_py()) == 1 + 2 * 60_000
    for blob, (numbers, counts) in zip(blobs.to_pylist(), lists, strict=True):
        a, b = ranked_search.unpack(blob)
        assert (a == numbers).all() and (b == counts).all()
    assert len(ranked_search.pack(term[:0], numbers[:0], counts[:0])[1]) == 0


@pytest.mark.parametrize("name", ["op11_centroids", "op13_ranked_search"])
def test_sql_gives_the_same_rows(spark, tmp_path, name):
    import duckdb

    from tessella.llm import queries as Q

    docs, queries = corpus(9)
    docs = [(i, t) for i, t in dict(docs).items() if i is not None]
    d, q = frames(spark, docs, [(i, t) for i, t in dict(queries).items() if i is not None])
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([*((i, [float(x) for x in rng.standard_normal(64)]) for i in range(120)), (500, None), (501, [1.0])], "vec_id bigint, embedding array<float>")
    con = duckdb.connect()
    for table, df in (("documents", d), ("benchmark", q), ("embeddings", v)):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    sql = con.sql(Q.oracle_sql()[name])
    out = Q.queries()[name](spark, str(tmp_path))
    assert sorted(sql.columns) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_registered_token_files(spark, docs, tmp_path):
    from tessella.llm import queries as Q

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")

    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in Q.op12_token_files(spark, folder).collect())
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert [a + n for a, _, n in rows[:-1]] == [a for a, *_ in rows[1:]] and rows[0][0] == 0
