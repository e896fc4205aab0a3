"""Each registered query of the training-data operators on a small folder of tables, against its contract."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries as Q

from .test_other_operators import PAGE, vectors
from .test_text_operators import brute_components, words


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """Tables with nulls, empty texts, repeated rows and extra columns whose names clash with results."""
    at = str(tmp_path_factory.mktemp("tables"))
    own = docs.drop("score").withColumns({"n_chars": F.length("text").cast("bigint"), "score": F.lit("x"), "n_tokens": F.lit(-1), "text_hash": F.lit(None).cast("string")})
    own.unionByName(own.filter("doc_id in (3, 301)")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    urls = ["http://a.org/x", None, "", "https://B.example.org/es/1?q#f", "http://c.com/de/1", "no url"]
    pages = [(i, urls[i % 6] if i < 12 else f"http://h.net/{i}", PAGE % (i, i) if i % 5 else None, "clash") for i in range(40)]
    spark.createDataFrame([*pages, pages[3]], "page_id bigint, url string, html string, text string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, f"item {i} the der") for i in range(5)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    vectors(spark)[0].withColumn("label", F.lit(1)).withColumn("score", F.lit("clash")).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{at}/{name}.parquet")
    return at


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


COLUMNS = {
    "op1_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_html": {"page_id", "url", "text", "n_chars"}, "op4_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"}, "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_ann": {"query_id", "rank", "vec_id", "score"}, "op7_langid": {"doc_id", "held_out", "lang_pred", "score"}, "op8_mixing": {"doc_id", "domain", "epoch"},
    "op9_ngram_jaccard": {"doc_id", "n_shingles", "component_id"}, "op10_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op11_centroids": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}, "op12_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op13_ranked_search": {"item_id", "rank", "doc_id", "score"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables_give_empty_results(spark, empty, name):
    out = Q.queries()[name](spark, empty)
    assert out.count() == 0 and COLUMNS[name] <= set(out.columns)


def run(spark, folder, name):
    rows = Q.queries()[name](spark, folder).collect()
    assert COLUMNS[name] <= set(rows[0].asDict())
    return rows


def test_op1(spark, folder):
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    out = run(spark, folder, "op1_lm_score")
    assert len(out) == n and len({r["train_tokens"] for r in out}) == 1
    assert all(r["held_out"] == (fold(r["doc_id"], 10) == 0) and r["n_known"] <= r["n_tokens"] and r["score"] < 0 for r in out)
    assert len({(r["n_tokens"], r["score"], r["base_score"]) for r in out if r["doc_id"] in (300, 301)}) == 1  # null and empty alike


def test_op2(spark, folder):
    out = run(spark, folder, "op2_toxicity")
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert len(out) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_op3(spark, folder):
    out = run(spark, folder, "op3_html")
    assert len(out) == 41 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert all((r["text"] == "") == (r["page_id"] % 5 == 0) for r in out)


def test_op4_and_op6(spark, folder):
    out = run(spark, folder, "op4_embedding_dedup")
    assert len(out) == len(vectors(spark)[1]) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    found = run(spark, folder, "op6_ann")
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in range(300) if i % 20 == 0} and all(len(x) == 20 for x in by.values())
    for q, x in by.items():
        x.sort()
        assert [k for k, _, _ in x] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(x, x[1:], strict=False)) and q not in [v for _, v, _ in x]


def test_op5(spark, folder):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = run(spark, folder, "op5_bpe")
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out) and len(out) == len(texts) + 2


def test_op7(spark, folder):
    out = run(spark, folder, "op7_langid")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 260]
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in held) and {r["lang_pred"] for r in out if r["doc_id"] in (300, 301, 302)} == {"und"}


def test_op8(spark, folder):
    out = run(spark, folder, "op8_mixing")
    have = sum(len(words(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert 0 < sum(r["n_tokens"] for r in out) <= have and all(0 <= r["epoch"] < Q.MIX_EPOCHS for r in out)


def test_op9(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = run(spark, folder, "op9_ngram_jaccard")
    assert len(out) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(sorted(dict(rows).items()))


@pytest.mark.parametrize(("name", "table", "key"), [("op4_embedding_dedup", "embeddings", "vec_id"), ("op9_ngram_jaccard", "documents", "doc_id")])
def test_sql_gives_the_same_rows(spark, folder, tmp_path, name, table, key):
    import duckdb

    at = str(tmp_path)
    spark.read.parquet(f"{folder}/{table}.parquet").dropDuplicates([key]).write.parquet(f"{at}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    sql = con.sql(Q.oracle_sql()[name])
    out = Q.queries()[name](spark, at)
    assert sorted(sql.columns) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_op10(spark, folder):
    out = {r["page_id"]: r for r in run(spark, folder, "op10_url_filter")}
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in range(6)] == [
        ("a.org", "/x", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.example.org", "/es/1", "example.org/es/", "block"), ("c.com", "/de/1", "com/de/", "block"), ("", "", None, "allow"),
    ]


def test_pipeline_on_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_keeps_texts_that_share_an_id(spark, folder):
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (2, text("a"), "en", "s", 1), (2, text("a"), "de", "s", 1), (None, text("c"), "en", "s", 1), (None, text("c"), "en", "s", 1), (4, None, "en", "s", 0), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("key", F.lit("clash"))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, text("a")), (1, text("b")), (None, text("c")), (4, None), (None, "")], key=str)
