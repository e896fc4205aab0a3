"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, fold, table

#: The vocabulary that op5 encodes with; a file that the environment provides.
BPE_FILE = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer of op12; a file that the environment provides.
LIBRARY_FILE = "byte_bpe_50k.json"
#: The rules of op10: (action, host/path).
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


#: Domains of op8, by the number that ends a source's name, and the target weights; other nodes weigh 1.
DOMAINS = ("web", "books", "reference")
MIX_WEIGHTS = {("web",): 0.5, ("books",): 0.3, ("reference",): 0.2} | {
    (d, lang): w for d in DOMAINS for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))
}
MIX_EPOCHS, MIX_SEED = 4, 42


def domain_of(source: str = "source"):
    last = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(last, F.lit(len(DOMAINS))) + 1)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gru_lm import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fold("doc_id", 10) != 0)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold("doc_id", 5) != 0))
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity(docs, model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def codec():
    import public_tokenizers

    from .bpe import BpeCodec, read_ranks

    return BpeCodec(read_ranks(public_tokenizers.path(BPE_FILE)), public_tokenizers.PATTERN)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_tokenize

    return bpe_tokenize(table(spark, sf_dir, "documents"), codec(), ids=False)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    return docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), language(docs, model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected", "p.cross_entropy"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix(docs, domain_of(), MIX_WEIGHTS, most_epochs=MIX_EPOCHS, seed=MIX_SEED, epoch="epoch")
    return out.select("doc_id", domain_of().alias("domain"), "lang", "source", "epoch", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors: k 40, five rounds, whole numbers at a scale of 256."""
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, as read back from the token files that were written."""
    from pathlib import Path

    import public_tokenizers

    from .token_files import read_tokens, write_tokens

    root = Scratch(spark, "token-files").root
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), root, Path(public_tokenizers.path(LIBRARY_FILE)).read_text(encoding="utf-8"))
    return read_tokens(spark, root, ids=False).withColumnRenamed("id", "doc_id")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    from .ranked_search import build, search

    scratch = Scratch(spark, "search")
    return search(build(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch), table(spark, sf_dir, "benchmark").select("item_id", "text"), scratch=scratch)


def queries() -> dict:
    every = (op1_lm_score, op2_toxicity, op3_html, op4_embedding_dedup, op5_bpe, op6_ann, op7_langid, op8_mixing, op9_ngram_jaccard, op10_url_filter, op11_centroids, op12_token_files, op13_ranked_search)
    return {f.__name__: f for f in every}


#: Components of the pairs ``links`` (a, b), both ways round, over the ids of ``nodes``: id, component_id.
_REACHED = """reached(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other),
 parts AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

OP4_SQL = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 good AS MATERIALIZED (SELECT id, list_transform(x, lambda c: coalesce(c, 0)) AS x FROM nodes WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: c * c)) > 0),
 links AS (SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON len(p.x) = len(q.x) AND p.id <> q.id WHERE CASE WHEN len(p.x) = len(q.x) THEN list_cosine_similarity(p.x, q.x) >= 0.95 END),
 {_REACHED}
 SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = parts.id) AS n_links, component_id, id = component_id AS kept FROM parts"""

OP9_SQL = rf"""WITH RECURSIVE nodes AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM nodes),
 sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
 shared AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM shingles p JOIN shingles q ON p.s = q.s AND p.id <> q.id GROUP BY 1, 2),
 links AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 {_REACHED}
 SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM parts LEFT JOIN sizes USING (id)"""

_ASSIGN = """a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM
  (SELECT vec_id, cluster, CAST(v.xx + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x) AS BIGINT) AS d FROM v CROSS JOIN c{i} c) GROUP BY vec_id)"""
_MOVE = """m{i} AS (SELECT cluster, p, floor(sum(y) / count(*)) AS y FROM (SELECT cluster, unnest(x) AS y, unnest(range(64)) AS p FROM a{i} JOIN v USING (vec_id)) GROUP BY cluster, p),
 c{j} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT cluster, list(y ORDER BY p) AS x FROM m{i} GROUP BY cluster) n USING (cluster))"""
OP11_SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(256 * e)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, x FROM v ORDER BY cluster LIMIT 40),
 {", ".join(_ASSIGN.format(i=i) + ", " + _MOVE.format(i=i, j=i + 1) for i in range(5))}, {_ASSIGN.format(i=5)}
 SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(x, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256 FROM a5 JOIN c5 USING (cluster)"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents), sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0), facts AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM sizes),
 q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2), wanted AS (SELECT DISTINCT t FROM q),
 tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) JOIN wanted USING (t) GROUP BY 1, 2),
 weights AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), facts),
 points AS (SELECT doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * s.n * facts.n) // facts.l))) AS p FROM tf JOIN weights USING (t) JOIN sizes s USING (doc_id), facts),
 scores AS (SELECT item_id, doc_id, CAST(sum(times * p) AS BIGINT) AS score FROM q JOIN points USING (t) GROUP BY 1, 2 HAVING sum(times * p) > 0)
 SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL over pairs and whole tables, for ids that are unique; the other operators learn, iterate or hash in ways that SQL does not have."""
    return {"op4_embedding_dedup": OP4_SQL, "op9_ngram_jaccard": OP9_SQL, "op11_centroids": OP11_SQL, "op13_ranked_search": OP13_SQL}
