"""Vectors, pages and the pipeline against brute force and planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, embedding_dedup, html_extract, url_filter
from tessella.llm.queries import URL_RULES


def vectors(spark, seed=0, n=300, d=48):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[50:90] = x[0] + 0.1 * rng.standard_normal((40, d))  # near copies
    x[90:100] = x[1]  # copies
    x[100:140] *= 7
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [1.0, None]), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_dedup_equals_brute_force(spark):
    df, rows = vectors(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if usable(v)]
    near = {i: [j for j, y in ok if j != i and len(x) == len(y) and x @ y >= 0.95] for i, x in ok}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, [])), min(seen), min(seen) == i)


def test_embedding_dedup_reads_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    test_embedding_dedup_equals_brute_force(spark)


def test_embedding_dedup_empty_table(spark):
    assert embedding_dedup.near_vectors(vectors(spark)[0].filter("false")).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_ann_recall_order_and_scores(spark):
    df, rows = vectors(spark, 3, 900)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: np.array(v) for i, v in rows if usable(v)}
    hits = total = 0
    for q, v in ok.items():
        if q % 20:
            continue
        true = sorted(((-float(x @ v), i) for i, x in ok.items() if i != q and len(x) == len(v)))[:10]
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(true) + 1))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1])) or all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(mine, sorted(mine, key=lambda m: (-m[2], m[1])), strict=True))
        hits += len({m[1] for m in mine} & {i for _, i in true})
        total += len(true)
    assert 1000 not in got and hits / total >= 0.9


def test_ann_rows_with_a_querys_id_are_candidates_and_ties_go_to_smaller_ids(spark):
    x = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [2.0, 0.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(x, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, k=4).collect()
    # of the row (1, 0), and of the row (0.9, 0.1): each bars itself, not the other
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out) == [(1, 5, 1.8), (1, 5, 2.0), (2, 3, 0.9), (2, 3, 1.0), (3, 7, 0.9), (3, 7, 1.0), (4, 20, 0.9), (4, 20, 0.9)]


def test_ann_counts_equal_windows_over_sorted_values():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((500, 16)), rng.standard_normal((9, 16))
    top = np.linalg.norm(x, axis=1).max()
    proj = ann.Projections(16, 40, 1.4, 0.9, 1)
    shard = ann.Shard(np.arange(500), np.arange(500), x, top, proj)
    radius = np.linspace(0.3, 1.4, 9)
    unit, _ = ann.scaled(q)
    y = x / top
    h = np.column_stack([y, np.sqrt(np.maximum(1 - (y**2).sum(1), 0))]) @ proj.axes
    plain = (np.abs(h[None] - (np.column_stack([unit, np.zeros(9)]) @ proj.axes)[:, None]) <= 1.4 * radius[:, None, None]).sum(axis=2)
    got = shard.collisions(unit, radius).astype(int)
    assert (got >= plain).all() and (got - plain).mean() < 2  # windows are rounded outward to 256ths


def test_embedding_dedup_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((300, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = np.linspace(0.94, 0.96, 300)[:, None]
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(1) - 1
    assert [got[i] for i in range(600)] == true.tolist()


def test_ann_empty_table(spark):
    assert ann.nearest(vectors(spark)[0].filter("false"), F.lit(True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><a href="/">Site</a></header>
<nav><ul><li>x<li>y</ul></nav><div class="ad">AD</div><div id="cookie-notice">we use</div><article><header><h1>Head &amp; line %d</h1></header><p><b>One  two<br>three %d<p>Four <i>fi</i>ve
</p><ul><li>a<li>b</ul><aside>side</aside><form>f</form><section id="comments"><p>c</p></section><p>caf&eacute;&nbsp;x &#8212; y &lt; z</p></article><footer>&copy; foot</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(i, f"http://h.org/{i}", PAGE % (i, i)) for i in range(30)] + [(100, "x", None), (101, "http://a.org", ""), (102, None, "plain < text"), (103, "http://b.org", "<p>a<p>b <a href='u>v</a> w")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    assert got[7]["text"] == "Head & line 7\nOne two three 7\nFour five\na\nb\ncafé x — y < z"
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"] == "plain < text" and got[103]["text"].startswith("a\nb")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def plain_tree(pages):
    """path -> (content, layout) of one host's pages, by dictionaries."""
    import collections
    import math

    seen, texts, layouts = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for html in pages:
        for path, kind, feature in html_extract.Page(html).features():
            if kind == 0:
                seen[path] += 1
            else:
                (layouts if kind == 1 else texts)[path][feature] += 1

    def entropy(counts, m):
        n = sum(counts.values())
        return -sum(k / n * math.log(k / n) for k in counts.values()) / math.log(max(m, n)) if n and max(m, n) > 1 else 0.0

    out = {}
    for path, m in seen.items():
        n = sum(texts[path].values())
        content = 1.0  # less each text's entropy over the pages that have it, on an average of occurrences
        if n and m > 1:
            content -= sum(k / n * -sum(1 / k * math.log(1 / k) for _ in range(k)) / math.log(m) for k in texts[path].values())
        if m > 1 and content < 0.95:
            out[path] = content, entropy(layouts[path], m)
    return out


def test_style_trees_equal_plain_dictionaries(spark):
    from tessella.llm.common import Scratch

    page = "<body><div class=top><a>home</a><a>shop %d</a></div><div><p>Text %d</p>%s</div><div class=z9>Bye %d</div></body>"
    pages = [page % (i % 3, i // 2, "<p>more</p>" * (i % 4), i % 2) for i in range(24)]
    df = spark.createDataFrame([("h.org", p) for p in pages] + [("two.org", pages[0]), ("two.org", pages[5]), ("one.org", pages[0])], "host string, html string")
    got = {r["host"]: {t["path"]: (t["content"], t["layout"]) for t in r["tree"]} for r in html_extract.style_trees(df, Scratch(spark, "t")).collect()}
    for host, own in (("h.org", pages), ("two.org", [pages[0], pages[5]])):
        plain = plain_tree(own)
        assert set(got[host]) == set(plain) and plain
        for path, pair in plain.items():
            assert got[host][path] == pytest.approx(pair, abs=1e-9)
    assert "one.org" not in got


def test_html_tree_alone_drops_branches_without_telling_names(spark):
    page = "<html><body><div class=q1><ul><li>Alpha<li>Beta</ul></div><div class=q2><h1>Title %d</h1><p>Story %d here</p></div><div class=q3>All rights kept</div></body></html>"
    for n in (3, 40):  # few pages or many
        rows = [(i, f"http://h{n}.org/{i}", page % (i, i)) for i in range(n)]
        rows += [(100 + i, "http://copies.org/x", page % (1, 1)) for i in range(5)]  # a host of copies loses nothing
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
        assert all(got[i] == f"Title {i}\nStory {i} here" for i in range(n))
        assert all("Story 1 here" in got[100 + i] for i in range(5))


def test_html_style_tree_drops_what_every_page_repeats(spark):
    page = "<html><body><div><p>Welcome to our shop</p><p>Call us now</p></div><div class=c><p>Story %d</p><p>of number %d and more</p></div></body></html>"
    rows = [(i, f"http://h.org/{i}", page % (i, i * 7)) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Story 3\nof number 21 and more"


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p">l</a>' for h in hosts)
    rows = [
        (1, "http://a.org/x", link("good.net")), (2, "https://b.example.org/es/1?q", ""), (3, "http://EXAMPLE.org/en/12#f", ""), (4, "http://c.com/de/1", ""),
        (5, "http://c.com/fr/1", ""), (6, "http://good.net/1", ""), (7, "http://farm.net/1", link("c.com", "c.com")), (8, None, None), (9, "no url", ""),
        (10, "http://lone.net", ""), (11, "http://x.org?y", ""), (12, "ftp://a.b/c://d.org/", ""),
    ]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"), URL_RULES).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == {
        1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: ("example.org/en/1", "block"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow"), 6: (None, "allow"),
        7: (None, "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"),
    }
    assert (got[8]["host"], got[8]["path"]) == ("", "") and (got[3]["host"], got[3]["path"]) == ("example.org", "/en/12") and got[12]["host"] == "a.b"
    assert got[6]["trust"] > 0 and got[7]["distrust"] > 0


def test_url_walk_equals_dense_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "c", 1.0)]
    seeds = [("a", 1.0, 0.0), ("c", 0.5, 0.5), ("d", 0.0, 1.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame(seeds, "host string, t0 double, d0 double"), damping=0.5, tolerance=1e-7).collect()}
    names = "abcd"
    m = np.zeros((4, 4))
    for s, t, w in edges:
        m[names.index(s), names.index(t)] = w
    for kind, w in ((0, m), (1, m.T)):
        p = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        v = np.array([{h: (a, b) for h, a, b in seeds}.get(x, (0, 0))[kind] for x in names], float)
        v /= v.sum()
        x = v * 0.5
        for _ in range(500):
            x = 0.5 * v + 0.5 * x @ p
        for i, h in enumerate(names):
            assert got.get(h, (0, 0))[kind] == pytest.approx(x[i], rel=1e-6)


def test_pipeline_stages_keep_columns_and_drop_copies(spark, tmp_path, docs):
    import corpus_pipeline

    base = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == base.columns
        d.write.parquet(str(tmp_path / f"out-{name}"))
        d = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept[name] = [r["doc_id"] for r in d.collect()]
    assert len(kept["toxicity"]) == base.count()
    assert set(range(260)) <= set(kept["language"]) and not {300, 301, 302} & set(kept["language"])
    assert not set(range(241, 260, 2)) & set(kept["near_duplicates"]) and set(range(240)) - set(kept["near_duplicates"]) == set()
    out = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
    assert {"doc_id", "n_tokens", "token_ids"} <= set(out.columns) and out.count() == len(kept["mixing"])
