"""The corpus pipeline: toxicity, language, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but
the last return the columns of documents. Nulls, empty and very long texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, ngram_jaccard, queries, toxicity
from tessella.llm.common import Scratch, fold, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learns from labels outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return docs.filter(toxicity.toxicity(docs, model, F.col("text")) < 0.5)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not rejected; lang is then the predicted language."""
    model = langid.train(docs.filter(fold("doc_id", 4) != 2))
    columns, own = docs.columns, _free(docs, "language")
    named = docs.withColumn(own, langid.language(docs, model, F.col("text"))).filter(~F.col(f"{own}.rejected"))
    return named.select(*(F.col(f"{own}.lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component, by id and a hash of the text; one row of it.

    Texts that share an id are documents of their own; so are rows without a word. Of rows of one id and text,
    the first by all columns stays.
    """
    columns, own = docs.columns, _free(docs, "key")
    keyed = docs.withColumn(own, F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    found = ngram_jaccard.near_duplicates(keyed, id_col=own)
    # keys to drop, and keys of several rows
    facts = found.filter("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("other"))
    facts = facts.filter("other or rows > 1").select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.text_hash").alias("th"), "other")
    same = keyed[f"{own}.doc_id"].eqNullSafe(facts["id"]) & (keyed[f"{own}.text_hash"] == facts["th"])
    marked = keyed.join(facts, same, "left")
    single = marked.filter(F.col("other").isNull()).select(*(keyed[f"`{c}`"] for c in columns))
    several = marked.filter(~F.col("other")).groupBy("id", "th").agg(F.min(F.struct(*(keyed[f"`{c}`"] for c in columns))).alias(own))
    return single.unionByName(several.select(*(F.col(own).getField(c).alias(c) for c in columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights: a row for each epoch that has them."""
    return mixing.mix(docs, queries.domain_of(), queries.MIX_WEIGHTS, most_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, with the digests of ids and decoded bytes."""
    return bpe.bpe_tokenize(docs, queries.codec())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Trained models and hash orders decide; SQL can't express them. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"{i}-{name}")
            if i:
                scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
