"""Rule verifiers: typed predicates that give struct<ok, reason>.

Parameters come as a struct column ``detail`` with any of the fields max, min, count,
include, exclude, keys, start, style, min_rows, allow_units. A verifier that lacks a
parameter it needs fails the query: it does not fail the row.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

DETAIL = "max int, min int, count int, include array<string>, exclude array<string>, keys array<string>, start string, style string, min_rows int, allow_units boolean"
#: Response bounds.
FREE_MIN, FREE_MAX = 20, 300
TIGHT_LOW, TIGHT_HIGH = 0.60, 0.90
#: A Markdown table's rows.
SEPARATOR_ROW = r"^\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)+\|?\s*$"
TABLE_ROW = r"^\s*\|.*\|\s*$"


def verdict(ok: Column, reason: Column | str) -> Column:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, F.lit("")).otherwise(r).alias("reason"))


def _needs(missing: Column, what: str, out: Column) -> Column:
    return F.when(missing, F.raise_error(F.lit(what)).cast("struct<ok:boolean,reason:string>")).otherwise(out)


def _bounds(n: Column, d: Column, what: str) -> Column:
    low, high = d["min"], d["max"]
    reason = F.when(low.isNotNull() & (n < low), F.format_string(f"{what}: %d is under %d", n, low)).otherwise(F.format_string(f"{what}: %d is over %d", n, high))
    return verdict((low.isNull() | (n >= low)) & (high.isNull() | (n <= high)), reason)


def char_count(t: Column, d: Column) -> Column:
    """Length of the normalised text within [min, max] (V1)."""
    return _needs(d["min"].isNull() & d["max"].isNull(), "char_count needs min or max", _bounds(F.length(T.nfkc(t)), d, "length"))


def bullet_count(t: Column, d: Column) -> Column:
    """List items: count exactly, else within [min, max] (V2)."""
    n = T.count_bullets(T.nfkc(t))
    exact = verdict(n == d["count"], F.format_string("items: %d is not %d", n, d["count"]))
    out = F.when(d["count"].isNotNull(), exact).otherwise(_bounds(n, d, "items"))
    return _needs(d["count"].isNull() & d["min"].isNull() & d["max"].isNull(), "bullet_count needs count, min or max", out)


def polite_form(t: Column, d: Column) -> Column:
    """polite: every judged sentence ends politely, and one is judged. plain: no sentence does, and there is one (V3)."""
    s = T.split_sentences(T.nfkc(t))
    judged = F.filter(s, lambda x: ~T.is_polite_exempt(x))
    polite = verdict((F.size(judged) > 0) & F.forall(judged, lambda x: x.rlike(T.POLITE_ENDINGS)), "a sentence is not polite, or none is judged")
    plain = verdict((F.size(s) > 0) & ~F.exists(s, lambda x: x.rlike(T.POLITE_ENDINGS)), "a sentence is polite, or there is none")
    out = F.when(d["style"] == "polite", polite).otherwise(plain)
    return _needs(d["style"].isNull() | ~d["style"].isin("polite", "plain"), "polite_form needs style polite or plain", out)


def keyword(t: Column, d: Column) -> Column:
    """All of include and none of exclude, normalised on both sides (V4)."""
    none = F.array().cast("array<string>")
    include, exclude = F.coalesce(d["include"], none), F.coalesce(d["exclude"], none)
    x = F.coalesce(t, F.lit(""))
    beside = lambda words: F.arrays_zip(F.array_repeat(x, F.size(words)).alias("x"), words.alias("k"))  # noqa: E731  # a lambda must not hold what Python gives
    held = lambda w: F.contains(w["x"], w["k"])
    if T.NORMAL.get():
        ok = F.forall(beside(include), held) & ~F.exists(beside(exclude), held)
        return _keyword(ok, include, exclude)
    plain = F.coalesce(F.forall(F.concat(F.array(x), include, exclude), T.is_ascii), F.lit(False))  # nothing to normalise
    given = F.when(~plain, t), F.when(plain, none).otherwise(include), F.when(plain, none).otherwise(exclude)  # no null lists: see batches
    ok = F.when(plain, F.forall(include, lambda k: F.contains(x, k)) & ~F.exists(exclude, lambda k: F.contains(x, k))).otherwise(T.python_function("keywords", _keyword_udf, *given))
    return _keyword(ok, include, exclude)


def _keyword(ok: Column, include: Column, exclude: Column) -> Column:
    return _needs((F.size(include) == 0) & (F.size(exclude) == 0), "keyword needs include or exclude", verdict(ok, "a keyword is missing or excluded"))


@cache
def _keyword_udf():
    norm = lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, include: pd.Series, exclude: pd.Series) -> pd.Series:
        out = []
        for t, inc, exc in zip(texts.fillna(""), include, exclude, strict=True):
            n = norm(t)
            out.append(all(norm(k) in n for k in inc) and not any(norm(k) in n for k in exc))
        return pd.Series(out, dtype=object)

    return run


def _fenced(raw: str) -> str:
    m = re.search(r"```(?:json)?\s*\n?(.*?)\n?```", raw, re.DOTALL)
    return (m[1] if m else raw).strip()


def _json_ok(raw: str | None) -> bool:
    if not raw:
        return False
    try:
        json.loads(_fenced(raw))
    except ValueError:
        return False
    return True


def _json_items_ok(raw: str | None, count: float | None, keys) -> bool:
    if not raw:
        return False
    try:
        got = json.loads(_fenced(raw))
    except ValueError:
        return False
    if isinstance(got, dict):
        got = next((v for v in got.values() if isinstance(v, list)), None)
    if not isinstance(got, list) or (count is not None and count == count and len(got) != int(count)):
        return False
    return all(isinstance(x, dict) and all(k in x for k in (keys if keys is not None else ())) for x in got)


@cache
def _json_udf():
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_json_ok).astype(bool)

    return run


@cache
def _json_items_udf():
    @F.pandas_udf("boolean")
    def run(texts: pd.Series, counts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([_json_items_ok(t, c, k) for t, c, k in zip(texts, counts, keys, strict=True)], dtype=bool)

    return run


def format_json(t: Column, d: Column) -> Column:
    """The first code fence, else the text, is JSON as Python reads it (V5)."""
    return verdict(T.python_function("json", _json_udf, t), "not JSON")


def format_json_detail(t: Column, d: Column) -> Column:
    """JSON with a list of ``count`` objects that have all ``keys``."""
    return verdict(T.python_function("json_items", _json_items_udf, t, d["count"].cast("double"), F.coalesce(d["keys"], F.array().cast("array<string>"))), "not JSON, or its list lacks items or keys")


def format_markdown_table(t: Column, d: Column) -> Column:
    """A row, a separator, and at least min_rows rows below, up to the first line that is none (V6)."""
    rows = T.lines(t)
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.size(rows), F.lit(2))), lambda i: F.get(rows, i - 1).rlike(SEPARATOR_ROW) & F.get(rows, i - 2).rlike(TABLE_ROW))
    first = F.get(at, 0)
    below = F.slice(rows, first + 1, F.greatest(F.size(rows) - first, F.lit(0)))
    run = F.aggregate(below, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & x.rlike(TABLE_ROW)).cast("int")).alias("n"), (a["on"] & x.rlike(TABLE_ROW)).alias("on")))["n"]
    n = F.when((F.size(rows) < 2) | first.isNull(), F.lit(-1)).otherwise(run)
    return verdict((n >= 0) & (n >= F.coalesce(d["min_rows"], F.lit(0))), F.format_string("table rows: %d", n))


def numeric_only(t: Column, d: Column) -> Column:
    """ASCII digits alone, with a unit behind them if allowed (V7)."""
    s = T.strip(t)
    ok = F.when(F.coalesce(d["allow_units"], F.lit(False)), s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\s*[^\s0-9]{0,5}$")).otherwise(s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"))
    return verdict(ok, "not a number alone")


def paragraph_count(t: Column, d: Column) -> Column:
    """Blocks between blank lines number count (V8)."""
    n = F.size(F.filter(F.split(t, r"\n\s*\n+"), lambda x: T.strip(x) != ""))
    return _needs(d["count"].isNull(), "paragraph_count needs count", verdict(n == d["count"], F.format_string("paragraphs: %d is not %d", n, d["count"])))


def start_word(t: Column, d: Column) -> Column:
    """The stripped text starts with start (V9)."""
    return _needs(d["start"].isNull(), "start_word needs start", verdict(T.strip(t).startswith(d["start"]), "another start"))


def no_constraint(t: Column, d: Column) -> Column:
    """Stripped length 20 to 300."""
    n = F.length(T.strip(t))
    return verdict(n.between(FREE_MIN, FREE_MAX), F.format_string("length: %d", n))


def plain_or_polite(t: Column, d: Column) -> Column:
    return polite_form(t, d)


def compound(t: Column, d: Column) -> Column:
    """Length, and keywords if any are given."""
    none = F.array().cast("array<string>")
    has = (F.size(F.coalesce(d["include"], none)) > 0) | (F.size(F.coalesce(d["exclude"], none)) > 0)
    a, b = char_count(t, d), keyword(t, d)
    return F.when(~a["ok"], a).when(has, b).otherwise(a)


#: The registry of instruction verifiers.
VERIFIERS: dict[str, Callable[[Column, Column], Column]] = {
    "char_count": char_count, "bullet_count": bullet_count, "polite_form": polite_form, "keyword": keyword,
    "format_json": format_json, "format_markdown_table": format_markdown_table, "numeric_only": numeric_only,
}
#: The categories of selected and judged responses.
CATEGORIES: dict[str, Callable[[Column, Column], Column]] = {
    "char_count": char_count, "bullet_count": bullet_count, "polite_form": polite_form, "keyword": keyword, "format_json": format_json_detail,
    "paragraph_count": paragraph_count, "start_word": start_word, "no_constraint": no_constraint, "compound": compound, "numeric_only": numeric_only,
}

#: The categories whose checks take normalised texts.
NORMALISED = ("char_count", "bullet_count", "polite_form", "keyword", "compound")


def tight_margin(t: Column, d: Column) -> Column:
    """The normalised length is 0.6 to 0.9 of max (F16)."""
    n = F.length(T.nfkc(t)).cast("double")
    return d["max"].isNull() | n.between(d["max"] * F.lit(TIGHT_LOW), d["max"] * F.lit(TIGHT_HIGH))


def _normal(told: Column, t: Column, d: Column) -> tuple[Column, Column]:
    """Text, include and exclude in NFKC where ``told``: one call for all three, which gets nothing where each is ASCII."""
    none = F.array().cast("array<string>")
    include, exclude = F.coalesce(d["include"], none), F.coalesce(d["exclude"], none)
    plain = (t.isNull() | T.is_ascii(t)) & F.forall(include, T.is_ascii) & F.forall(exclude, T.is_ascii)
    each = T.nfkc_each(F.when(told & ~F.coalesce(plain, F.lit(False)), F.concat(F.array(t), include, exclude)).otherwise(none))  # no null lists: see batches
    n = F.size(include)
    words = lambda start, size, old: F.when(F.size(each) == 0, old).otherwise(F.slice(each, start, size))
    return F.coalesce(F.get(each, 0), t), d.withField("include", words(F.lit(2), n, include)).withField("exclude", words(n + 2, F.size(exclude), exclude))


def dispatch(category: Column, t: Column, d: Column) -> Column:
    """The category's verdict (V14); an unknown one fails. All texts and keywords are normalised by one call in Python, as a call
    for each check would take each row to Python again. JSON is seen for its own category's rows only, as functions in Python are called whatever ``when`` says."""
    out = verdict(F.lit(False), F.concat(F.lit("unknown category: "), F.coalesce(category, F.lit("null"))))
    mine = _normal(F.coalesce(category.isin(*NORMALISED), F.lit(False)), t, d)
    for name, check in CATEGORIES.items():
        given = mine if name in NORMALISED else (F.when(category == name, t), d)
        known = T.NORMAL.set(name in NORMALISED)
        try:
            out = F.when(category == name, check(*given)).otherwise(out)
        finally:
            T.NORMAL.reset(known)
    return out


def select(category: Column, t: Column, d: Column, eval_values: list[int] | None = None) -> Column:
    """As dispatch, and for lengths no value of the evaluation set and a tight band."""
    by_length = category.isin("char_count", "compound")
    out = dispatch(category, t, d)
    if eval_values:
        hit = d["min"].isin(eval_values) | d["max"].isin(eval_values)
        out = F.when(by_length & F.coalesce(hit, F.lit(False)), verdict(F.lit(False), "evaluation value")).otherwise(out)
    return F.when(by_length & out["ok"] & ~tight_margin(t, d), verdict(F.lit(False), "outside the band")).otherwise(out)
