"""Whole preparations composed of the operators: corpora, instructions, chat mixes, prompt pools, distilled rows.

Each takes DataFrames and a configuration and returns rows and statistics as DataFrames. Intermediate tables are written when they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verifiers as V
from ..sources import readers
from . import chat, clean, order, prefs, prompts, quantiles, scoring


class Keyword:
    """The filter ``keyword_oversample``: rows that match a keyword group, repeated after cleaning."""

    def __init__(self, settings: Mapping, groups: Mapping[str, Sequence[str]]):
        self.groups, self.weight = groups, int(settings.get("oversample_weight", 3))

    def keep(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("cells", T.matched_groups(self.groups, "title", "text")).filter(F.size("cells") > 0)

    def weigh(self, rows: DataFrame, key: str) -> DataFrame:
        return order.oversample(rows, self.weight, key)


class All:
    """No filter."""

    def __init__(self, settings: Mapping, groups: Mapping[str, Sequence[str]]):
        pass

    def keep(self, rows: DataFrame) -> DataFrame:
        return rows

    def weigh(self, rows: DataFrame, key: str) -> DataFrame:
        return rows


#: The kinds of a corpus's filter by name (U7); another name is an error.
FILTERS = {None: All, "keyword_oversample": Keyword}


def prepare_data(corpora: Mapping[str, DataFrame], config: Mapping, names: Sequence[str] | None = None, sample_limit: int | Mapping[str, int] | None = None, evals: DataFrame | None = None,
                 streaming: bool = False, order_by: Sequence[str] = ("id",), groups: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(mixture, {"clean": stage statistics, "mix": mix statistics}) of the configured corpora.

    A corpus may have a filter of a kind of ``FILTERS``: it keeps rows before cleaning and may repeat them after it, so the
    copies are no duplicates. ``sample_limit`` holds for all corpora or, as a mapping, for those that it names; an entry's own ``sample_limit``
    comes first. All corpora are cleaned in one pass, each by itself. What fails while a corpus is prepared names it and the step.
    """
    entries = {e["name"]: e for e in config.get("corpora", [])}
    chosen = list(entries) if names is None else list(names)
    unknown = [n for n in chosen if n not in entries]
    if unknown:
        raise ValueError(f"unknown corpora: {', '.join(unknown)}")
    limit_of = {n: entries[n].get("sample_limit", sample_limit.get(n) if isinstance(sample_limit, Mapping) else sample_limit) for n in chosen}
    if streaming and any(n is None for n in limit_of.values()):
        raise ValueError("a stream needs a sample limit")
    rows, kinds, step = None, {}, ""
    for name in chosen:
        try:
            step = "filter"
            settings = entries[name].get("filter", {})
            if settings.get("type") not in FILTERS:
                raise ValueError(f"unknown filter: {settings.get('type')}")
            kinds[name] = FILTERS[settings.get("type")](settings, groups or {})
            step = "load"
            part = readers.extract_rows(corpora[name], order_by, limit_of[name], title=True).withColumns({"corpus": F.lit(name), "cells": F.lit(None).cast("array<string>")})
            part = kinds[name].keep(part)
        except Exception as e:
            raise RuntimeError(f"corpus {name}, {step}: {e}") from e
        rows = part if rows is None else rows.unionByName(part)
    cleaned = clean.storage.cut(clean.clean_corpus(rows, evals, **config.get("clean", {})))
    kept = cleaned.filter("stage is null").drop("stage").withColumn("key", F.concat("corpus", F.lit("/"), "id"))
    plain = [n for n, k in kinds.items() if isinstance(k, All)]
    parts = [kept.filter(F.col("corpus").isin(plain))] if plain else []
    parts += [k.weigh(kept.filter(F.col("corpus") == n), "key") for n, k in kinds.items() if n not in plain]
    pool = prompts.pool(*parts)
    mix = config.get("mix", {})
    mixture, facts = order.mix(pool, mix.get("ratios", {"ja": 1.0}), mix.get("seed", 42), "language", mix.get("unit", "documents"), "key")
    return mixture, {"clean": clean.stage_stats(cleaned), "mix": facts}


def prepare_instructions(raw: DataFrame, question: str, answer: str, keep: Column | None = None, n: int | None = None, seed: int = 42, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(key and messages, one row of counts): rows with both fields, up to n in seeded order.

    Counts: input_count, kept_count (rows that ``keep`` leaves), skipped (malformed ones among them), output_count. ``raw`` is read once:
    each row's fate is written with it, and counted in what was written, so a task that runs twice counts once.
    """
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    good = F.col(question).isNotNull() & F.col(answer).isNotNull()
    fate = F.when(~kept, "dropped").when(~good, "skipped").otherwise("kept")
    told = clean.storage.cut(raw.select(key, fate.alias("__fate"), F.when(fate == "kept", T.messages(question, answer)).alias("messages")))
    rows = told.filter("__fate = 'kept'").select(key, "messages")
    if n is not None:
        rows = order.sample_rows(rows, n, seed, key)
    is_ = lambda f: F.count_if(F.col("__fate") == f)
    counts = told.agg(F.count(F.lit(1)).alias("input_count"), (F.count(F.lit(1)) - is_("dropped")).alias("kept_count"), is_("skipped").alias("skipped"))
    left = F.col("kept_count") - F.col("skipped")
    return rows, counts.withColumn("output_count", left if n is None else F.least(left, F.lit(n)))


def prepare_sft_mix(components: Mapping[str, DataFrame], targets: Mapping[str, int | None], quotas: Mapping[str, int], seed: int = 42, not_polite: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows, {"origins", "formats", "lengths"}): the components' samples and constraint rows made from all of them.

    A component has id and messages. Constraint rows are taken whole, under the origin ``format``.
    """
    if not components:
        raise ValueError("no components")
    upstream = prompts.pool(*(df.select(F.concat(F.lit(f"{name}/"), F.col("id").cast("string")).alias("id"), "messages", F.lit(name).alias("origin")) for name, df in components.items()))
    made = clean.storage.cut(chat.constraint_rows(upstream, dict(quotas), seed, "id", not_polite))
    parts = {name: df.select(F.col("id").cast("string").alias("id"), "messages") for name, df in components.items()}
    parts["format"] = made.select(F.concat("verifier", F.lit("/"), "source_key").alias("id"), "messages", "verifier")
    mixed = clean.storage.cut(chat.mix_components(parts, {**targets, "format": None}, seed))
    size = chat.response_length("messages")
    summary = quantiles.length_summary(mixed.select(size.alias("n_chars")), "n_chars")
    lengths = summary.select(*(F.coalesce(c, F.lit(0) if c in ("min", "max") else F.lit(0.0)).alias(c) for c in ("min", "max", "mean", "median")))
    return mixed, {"origins": mixed.groupBy("origin").count(), "formats": made.groupBy("verifier").count(), "lengths": lengths}


def build_prompt_pool(selected: DataFrame, evals: DataFrame, bank: DataFrame | None = None, seed: int = 42, per_category: int = 20, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(pool, rows by source): selected rows, templates over their topics and screened external prompts, none of the evaluation set.

    The external prompts that are left out are counted under ``c, banned``, ``c, repeated`` and ``c, over``.
    """
    values = prefs.eval_values(evals)
    a = clean.storage.cut(prompts.source_a(selected, values, pos))
    topics = selected.filter(F.coalesce("topic", F.lit("")) != "").select("topic")
    n = a.count()
    b = clean.storage.cut(prompts.source_b(topics, n, seed))
    parts = [a.withColumn("source", F.lit("a")), b.withColumn("source", F.lit("b"))]
    if bank is not None:
        c, screened = prompts.source_c(bank, per_category, seed)
        c = order.sequential_ids(c.drop("id"), "pref", n + b.count(), F.col("category"), F.col("prompt"))
        parts.append(c.withColumn("source", F.lit("c")))
    pool = clean.storage.cut(prompts.pool(*parts))
    prefs.assert_disjoint(pool, evals, values, prefs.BOUNDS)
    counts = pool.groupBy("source", "category").count()
    return pool, counts if bank is None else counts.unionByName(screened.filter("fate <> 'kept'").select(F.concat(F.lit("c, "), "fate").alias("source"), "category", "count"))


def prepare_distill_mix(rows: DataFrame, evals: DataFrame, base: DataFrame, base_mean: float = 176.0, tolerance: float = 0.2, seed: int = 42, pos: str = "pos") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(messages in seeded order, {"rejects"}): verified, not degenerate rows of the evaluation set's kind, with the base rows.

    ``rows``: pos, category, detail, topic, prompt, response. ``base``: id, messages. Fails where the mean length leaves
    its band (G1) or a bound or topic is of the evaluation set (G2).
    """
    values = prefs.eval_values(evals)
    judged = clean.storage.cut(rows.withColumn("verdict", V.select(F.col("category"), F.col("response"), F.col("detail"), values)))
    passed = judged.filter("verdict.ok").withColumn("constraint_detail", F.to_json("detail"))
    filtered = clean.storage.cut(prefs.degenerate_filters(passed, pos))
    accepted = filtered.filter("reject is null")
    prefs.length_guard(accepted, "response", base_mean, tolerance)
    prefs.assert_disjoint(accepted.select("category", "topic", F.col("detail").alias("constraint_detail")), evals, values)
    rejects = judged.filter("not verdict.ok").select("category", F.col("verdict.reason").alias("reason")).unionByName(filtered.filter("reject is not null").select("category", F.col("reject").alias("reason")))
    made = accepted.select(F.concat(F.lit("distill/"), F.col(pos).cast("string")).alias("id"), T.messages("prompt", "response").alias("messages"))
    mixed = made.unionByName(base.select(F.concat(F.lit("base/"), F.col("id").cast("string")).alias("id"), "messages"))
    return order.with_position(mixed, order.seeded(seed, F.col("id")), F.col("id"), name="at"), {"rejects": rejects.groupBy("category", "reason").count()}


def run_verification(generations: DataFrame, prompts_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, one row of total, rule_pass, degenerate) of all generations."""
    verdicts = clean.storage.cut(prefs.verify(generations, prompts_))
    return verdicts, verdicts.agg(F.count(F.lit(1)).alias("total"), F.count_if("rule_pass").alias("rule_pass"), F.count_if("degenerate").alias("degenerate"))


def compare_models(items: DataFrame, scored: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(rollups of each model over all items, paired statistics against ``base``)."""
    rows = clean.storage.cut(scoring.reaggregate(items, scored))
    return scoring.rollup(rows, ["model"]), scoring.compare_to_base(rows, base)


def decide(spark, candidate: Mapping, base: Mapping, instructions: Mapping, benchmark: Mapping) -> tuple[dict[str, bool], DataFrame]:
    """(the gate's conditions, each domain's drop) from four result records."""
    rows = lambda of: spark.createDataFrame(list(of.items()), "domain string, accuracy double")
    overall, domains = readers.accuracies(candidate)
    gate = scoring.domain_gate(rows(domains), rows(readers.accuracies(base)[1]))
    return scoring.decision_gate(overall, gate, readers.instruction_aggregate(instructions)["prompt_strict"], readers.average(benchmark)), gate
