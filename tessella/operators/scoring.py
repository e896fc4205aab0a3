"""Benchmark scoring: answers, rollups, intervals, paired tests and decision gates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verifiers as V

Z_95 = 1.959963985
#: Multiple-choice answers and gate thresholds.
MCQ, MCQ_FALLBACK = r"(?U)^[\s（(]*([A-E])[\s)）:：.．、,]*", r"(?U)答え[:：]\s*([A-E])"
GATES = {"jkb": 0.60, "domain_drop": 0.03, "ifeval": 0.920, "llm_jp": 0.459}


def score_short(raw: Column, answers: Column) -> Column:
    """An answer stands in the first answer's segment."""
    seg = T.answer_segment(raw)
    return F.coalesce(F.exists(answers, lambda a: seg.contains(a)), F.lit(False))


def score_choice(raw: Column, correct: Column) -> Column:
    """The letter that leads the segment, else after 答え: in the text."""
    lead = F.regexp_extract(T.answer_segment(raw), MCQ, 1)
    found = F.when(lead != "", lead).otherwise(F.regexp_extract(F.coalesce(raw, F.lit("")), MCQ_FALLBACK, 1))
    return F.coalesce(found == correct, F.lit(False))


def score_row(fmt: Column, raw: Column, answers: Column, correct: Column) -> Column:
    """By format short or mcq; another fails."""
    return F.when(fmt == "short", score_short(raw, answers)).when(fmt == "mcq", score_choice(raw, correct)).otherwise(F.raise_error(F.concat(F.lit("unknown format "), fmt)).cast("boolean"))


def legacy_score(raw: Column, answers: Column) -> Column:
    """An answer anywhere before the next 質問:."""
    t = T.strip(F.regexp_replace(F.coalesce(raw, F.lit("")), f"{T.SPACE}+", " "))
    first = T.strip(F.element_at(F.split(t, "質問:", 2), 1))
    return F.coalesce(F.exists(answers, lambda a: first.contains(a)), F.lit(False))


def score_items(items: DataFrame, answers: DataFrame) -> DataFrame:
    """id, domain, difficulty, correct; an item without an answer counts as wrong."""
    a = answers.select("id", F.col("raw").alias("__raw"))
    d = items.join(a, "id", "left")
    return d.select("id", "domain", "difficulty", score_row(F.col("format"), F.col("__raw"), F.col("answers"), F.col("correct_choice")).alias("correct"))


def reaggregate(items: DataFrame, scored: DataFrame) -> DataFrame:
    """model, id, domain, difficulty, correct: every item for every model; one that a model lacks is wrong."""
    models = [r["model"] for r in scored.select("model").distinct().collect()]  # names, a row a model
    every = items.select(F.explode(F.array(*map(F.lit, models)).cast("array<string>")).alias("model"), "id", "domain", "difficulty")
    return every.join(scored.select("model", "id", F.col("correct").alias("__c")), ["model", "id"], "left").select("model", "id", "domain", "difficulty", F.coalesce("__c", F.lit(False)).alias("correct"))


def in_order(df: DataFrame, column: str, values: Sequence[str], *then: str) -> DataFrame:
    """df by the place of ``column`` in ``values``; others come last, by name."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return df.orderBy(F.when(place == 0, len(values) + 1).otherwise(place), column, *then)


def wilson(correct: Column, n: Column, z: float = Z_95) -> Column:
    """struct<lo, hi>: the Wilson interval; (0, 0) without trials (E5)."""
    nd, p = n.cast("double"), correct.cast("double") / F.when(n == 0, 1.0).otherwise(n.cast("double"))
    d = 1 + z * z / nd
    mid = (p + z * z / (2 * nd)) / d
    half = z * F.sqrt(p * (1 - p) / nd + z * z / (4 * nd * nd)) / d
    clip = lambda x: F.when(n == 0, 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.struct(clip(mid - half).alias("lo"), clip(mid + half).alias("hi"))


def rollup(scored: DataFrame, keys: Sequence[str] = (), dims: Sequence[str] = ("domain", "difficulty")) -> DataFrame:
    """level, n, correct, accuracy for all, each dimension and each cell, in one aggregation."""
    g = scored.select(*keys, *dims, F.col("correct").cast("int").alias("__c"))
    out = g.groupingSets([[*keys, *s] for s in ([], [dims[0]], [dims[1]], list(dims))], *keys, *dims).agg(
        F.grouping_id().alias("__gid"), F.count(F.lit(1)).alias("n"), F.sum("__c").alias("correct"))
    bits = len(keys) * 0
    level = F.when(F.col("__gid") == 3 + bits, "overall").when(F.col("__gid") == 1, f"by_{dims[0]}").when(F.col("__gid") == 2, f"by_{dims[1]}").otherwise("by_cell")
    return out.select(*keys, level.alias("level"), *dims, "n", F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce(F.try_divide(F.col("correct"), F.col("n")), F.lit(0.0)).alias("accuracy"))


def worst_cells(cells: DataFrame, k: int) -> DataFrame:
    """Accuracy rising, n falling, then name."""
    return cells.orderBy("accuracy", F.desc("n"), "domain", "difficulty").limit(k)


def _mcnemar(n: int, k: int) -> float:
    """Summed from the tail's largest term down: 2^-n is 0 in doubles from n = 1075."""
    if 2 * k >= n:
        return 1.0
    t, s = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)), 0.0
    while t > s * 1e-18:
        s += t
        t *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * s)


@cache
def _mcnemar_udf():
    @F.pandas_udf("double")
    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_mcnemar(int(x + y), int(min(x, y))) for x, y in zip(b, c, strict=True)], dtype="float64")

    return run


def mcnemar_p(b: Column, c: Column) -> Column:
    """The two-sided exact binomial p of discordant pairs; 1 without any."""
    return _mcnemar_udf()(b, c)


def bootstrap_interval(diffs: DataFrame, key: str, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """key, lo, hi: percentiles of the resampled mean paired difference.

    A difference is -1, 0 or 1, so a resample is a multinomial draw over three counts: any number of items costs one row.
    """
    counts = diffs.groupBy(key).agg(*(F.count_if(F.col("diff") == v).alias(n) for v, n in ((-1, "lost"), (0, "same"), (1, "won"))))
    return counts.select(key, interval(F.col("lost"), F.col("same"), F.col("won"), resamples, seed).alias("ci")).select(key, "ci.*")


def interval(lost: Column, same: Column, won: Column, resamples: int = 5000, seed: int = 42) -> Column:
    """struct<lo, hi>: the resampled mean's percentiles, from the counts of the differences -1, 0 and 1."""

    @F.pandas_udf("lo double, hi double")
    def draw(lost: pd.Series, same: pd.Series, won: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(lost, same, won, strict=True):
            n = a + b + c
            if not n:
                out.append((0.0, 0.0))
                continue
            x = np.random.default_rng(seed).multinomial(n, [a / n, b / n, c / n], resamples)
            m = np.sort((x[:, 2] - x[:, 0]) / n)
            out.append((m[int(0.025 * resamples)], m[int(0.975 * resamples) - 1]))
        return pd.DataFrame(out, columns=["lo", "hi"])

    return draw(lost, same, won)


def compare_to_base(results: DataFrame, base: str, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """model, n, delta, b (only base right), c (only model right), p, and the interval lo to hi of delta, of each other model on the same items."""
    x = results.filter(F.col("model") == base).select("id", F.col("correct").alias("cb"))
    y = results.filter(F.col("model") != base).select("model", "id", F.col("correct").alias("cm"))
    d = y.join(x, "id").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cm").cast("int") - F.col("cb").cast("int")).alias("delta"), F.count_if(F.col("cb") & ~F.col("cm")).alias("b"), F.count_if(~F.col("cb") & F.col("cm")).alias("c"))
    same = F.col("n") - F.col("b") - F.col("c")
    return d.withColumn("p", mcnemar_p(F.col("b"), F.col("c"))).withColumn("ci", interval(F.col("b"), same, F.col("c"), resamples, seed)).select("model", "n", "delta", "b", "c", "p", "ci.lo", "ci.hi")


def perplexity(df: DataFrame, loss: str = "loss", n: str = "n_tokens", keys: Sequence[str] = ()) -> DataFrame:
    """exp of the token-weighted mean loss, by ``keys`` if any; texts with fewer than two tokens don't count."""
    w = (F.col(n) - 1).cast("double")
    return df.filter(F.col(n) >= 2).groupBy(*keys).agg(F.exp(F.sum(F.col(loss) * w) / F.sum(w)).alias("perplexity"))


def score_instructions(generations: DataFrame, prompts: DataFrame) -> DataFrame:
    """id, category, instruction, strict, loose, one row an instruction (V17); loose is after the preamble."""
    p = prompts.select("id", "category", "instruction_id_list", "kwargs")
    rows = generations.join(p, "id").select("id", "category", F.coalesce("response", F.lit("")).alias("r"), F.explode("instruction_id_list").alias("instruction"), "kwargs")
    rows = rows.withColumn("d", F.try_element_at(F.col("kwargs"), F.col("instruction")))
    bare = T.strip_preamble("r")
    strict = loose = F.raise_error(F.concat(F.lit("unknown instruction "), F.col("instruction"))).cast("boolean")
    for name, check in V.VERIFIERS.items():
        strict = F.when(F.col("instruction") == name, check(F.col("r"), F.col("d"))["ok"]).otherwise(strict)
        loose = F.when(F.col("instruction") == name, check(bare, F.col("d"))["ok"]).otherwise(loose)
    return rows.select("id", "category", "instruction", strict.alias("strict"), loose.alias("loose"))


def aggregate_instructions(scores: DataFrame) -> DataFrame:
    """level, name, n, strict, loose: prompts, instructions, prompts by category, instructions by verifier."""
    prompts = scores.groupBy("id", "category").agg(F.bool_and("strict").alias("strict"), F.bool_and("loose").alias("loose"))
    facts = (F.count(F.lit(1)).alias("n"), F.avg(F.col("strict").cast("int")).alias("strict"), F.avg(F.col("loose").cast("int")).alias("loose"))
    part = lambda df, level, name: (df.groupBy(F.lit(level).alias("level"), name.alias("name"))).agg(*facts)
    return part(prompts, "prompt", F.lit("all")).unionByName(part(scores, "instruction", F.lit("all"))).unionByName(part(prompts, "category", F.col("category"))).unionByName(part(scores, "verifier", F.col("instruction")))


def domain_gate(candidate: DataFrame, base: DataFrame, most_drop: float = GATES["domain_drop"]) -> DataFrame:
    """domain, candidate, base, delta, passed: a domain on one side only fails."""
    d = candidate.select("domain", F.col("accuracy").alias("candidate")).join(base.select("domain", F.col("accuracy").alias("base")), "domain", "full_outer")
    delta = F.col("candidate") - F.col("base")
    return d.withColumn("delta", delta).withColumn("passed", F.coalesce(delta >= -most_drop - 1e-12, F.lit(False)))


def decision_gate(jkb: float, domains: DataFrame, ifeval: float, llm_jp: float) -> dict[str, bool]:
    """The four conditions and their conjunction; no domains fail."""
    r = domains.agg(F.bool_and("passed").alias("ok")).first()
    out = {"jkb": jkb >= GATES["jkb"], "domains": bool(r["ok"]), "ifeval": ifeval >= GATES["ifeval"], "llm_jp": llm_jp >= GATES["llm_jp"]}
    return out | {"passed": all(out.values())}
