"""Chat rows, token arrays and packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches as arrow
from ..functions import text as T
from ..functions import verifiers as V
from . import order, storage

MESSAGES = "array<struct<role:string,content:string>>"
#: Chat markup, roles and the ignored label.
ROLES = ("system", "user", "assistant")
ROLE_MAP = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant"}
IGNORED = -100


def to_chatml(messages: Column | str) -> Column:
    """Messages as chat markup; another role fails."""
    m = T.as_column(messages)
    turn = F.transform(m, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), F.coalesce(x["content"], F.lit("")), F.lit("<|im_end|>\n")))
    bad = F.exists(m, lambda x: x["role"].isNull() | ~x["role"].isin(*ROLES))
    return F.when(bad, F.raise_error(F.lit("invalid role")).cast("string")).otherwise(F.array_join(turn, ""))


def conversation_messages(turns: Column | str) -> Column:
    """array<struct<from,value>> as messages; null for an unknown role, no turns, or no user or assistant."""
    t = T.as_column(turns)
    role = F.create_map(*[F.lit(x) for kv in ROLE_MAP.items() for x in kv])
    m = F.transform(t, lambda x: F.struct(F.try_element_at(role, x["from"]).alias("role"), x["value"].alias("content")))
    ok = F.forall(m, lambda x: x["role"].isNotNull()) & F.exists(m, lambda x: x["role"] == "user") & F.exists(m, lambda x: x["role"] == "assistant")
    return F.when(ok & (F.size(t) > 0), m)


def instruction_messages(instruction: Column, given: Column, output: Column) -> Column:
    """instruction, with input below it if any, and output; null without instruction or output (C4)."""
    has = (F.coalesce(given, F.lit("")) != "")
    q = F.when(has, F.concat(instruction, F.lit("\n\n"), given)).otherwise(instruction)
    return F.when((F.coalesce(instruction, F.lit("")) != "") & (F.coalesce(output, F.lit("")) != ""), T.messages(q, output))


def question_answer(messages: Column | str) -> Column:
    """struct<question, answer>: the last message, if an assistant's, and the nearest user's before it; else null."""
    m = T.as_column(messages)
    last = F.try_element_at(m, F.lit(-1))
    users = F.filter(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), lambda x: x["role"] == "user")
    q = F.try_element_at(users, F.lit(-1))
    return F.when((last["role"] == "assistant") & q.isNotNull(), F.struct(q["content"].alias("question"), last["content"].alias("answer")))


def response_length(messages: Column | str) -> Column:
    """Length of the last assistant message; null without one."""
    return F.length(F.try_element_at(F.filter(T.as_column(messages), lambda x: x["role"] == "assistant"), F.lit(-1))["content"])


def _detail(**fields: Column) -> Column:
    kinds = dict(x.split(" ", 1) for x in V.DETAIL.split(", "))
    return F.struct(*(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def synthesize(verifier: str, messages: Column | str, origin: Column, seed: int, id_: Column) -> Column:
    """A chat row whose answer meets a constraint put into its question; null where it doesn't fit."""
    qa = question_answer(messages)
    q, a = qa["question"], qa["answer"]
    n = F.length(T.nfkc(a))
    if verifier == "char_count":
        limit = n + F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(21)).cast("int")
        ok, suffix = n.between(20, 300), F.concat(limit.cast("string"), F.lit("文字以内で答えてください。"))
    elif verifier == "bullet_count":
        count = T.count_bullets(T.nfkc(a))
        ok, suffix = count.between(2, 5), F.concat(F.lit("箇条書き"), count.cast("string"), F.lit("項目で答えてください。"))
    elif verifier == "format_json":
        ok, suffix = n.between(50, 200), F.lit('JSON 形式で回答してください。schema: {"answer": string}')
        a = F.concat(F.lit('{"answer": '), F.substring(F.to_json(F.struct(a.alias("a"))), 6, 1 << 30))
    elif verifier == "polite_form":
        ok, suffix = V.polite_form(a, _detail(style=F.lit("polite")))["ok"], F.lit("敬体(です・ます調)で答えてください。")
    elif verifier == "keyword":
        noun = T.keyword_noun(a)
        ok, suffix = noun.isNotNull(), F.concat(F.lit("回答には「"), noun, F.lit("」を必ず含めてください。"))
    else:
        raise ValueError(f"no synthesis for {verifier}")
    row = F.struct(T.messages(F.concat(q, F.lit("\n\n"), suffix), a).alias("messages"), F.lit(verifier).alias("verifier"), origin.alias("origin"))
    return F.when(qa.isNotNull() & ok, row)


#: The order in which quotas are filled, and their sizes.
QUOTAS = {"char_count": 350, "bullet_count": 300, "format_json": 300, "polite_form": 350, "keyword": 200}


def constraint_rows(df: DataFrame, quotas: dict[str, int] = QUOTAS, seed: int = 42, key: str = "id", excluded_polite_origin: str | None = None, tried: dict[str, int] | None = None) -> DataFrame:
    """Per verifier, in seeded order, the first rows that fit, up to its quota; a row may serve several.

    A verifier's seeded order is opened piece by piece: first twice its quota's share of the rows, then four times as much as before,
    till it is met or all rows are open. A round is one pass over the rows for all verifiers that still want some, and makes
    only what is open, so what is made follows the quotas over the share that fits. ``tried`` gets each verifier's number of rows made.
    """
    k = F.col(key)
    order_of = {name: order.seeded(f"{seed}:{name}", k) for name in quotas}
    at = {name: F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") for name, h in order_of.items()}  # of 16^12
    total, whole = max(1, df.count()), 1 << 48
    opened = dict.fromkeys(quotas, 0)
    wide = {name: min(whole, max(1, whole * 2 * n // total)) for name, n in quotas.items() if n > 0}
    got, parts = dict.fromkeys(quotas, 0), []
    while wide:
        may = {name: (at[name] >= opened[name]) & (at[name] < w) for name, w in wide.items()}
        if excluded_polite_origin is not None and "polite_form" in may:
            may["polite_form"] &= ~F.col("origin").eqNullSafe(excluded_polite_origin)
        picks = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in may.items())))
        rows = df.withColumn("__v", F.explode(picks))
        made = F.coalesce(*(synthesize(name, F.when(F.col("__v") == name, F.col("messages")), F.col("origin"), seed, k) for name in may))
        place = F.coalesce(*(F.when(F.col("__v") == name, order_of[name]) for name in may))
        part = storage.cut(rows.select(F.col("__v").alias("__verifier"), k.alias("__key"), place.alias("__at"), made.alias("r")))
        for r in part.groupBy("__verifier").agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("fit")).collect():  # a row a verifier
            got[r["__verifier"]] += r["fit"]
            if tried is not None:
                tried[r["__verifier"]] = tried.get(r["__verifier"], 0) + r["n"]
        parts.append(part.filter("r is not null"))
        opened |= wide
        wide = {name: min(whole, 5 * w) for name, w in wide.items() if got[name] < quotas[name] and w < whole}
    if not parts:
        return df.select(synthesize("char_count", "messages", F.col("origin"), seed, k).alias("r"), k.alias("source_key")).limit(0).select("r.*", "source_key")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = Window.partitionBy("__verifier").orderBy("__at", "__key")  # little more than the quotas
    most = F.coalesce(*(F.when(F.col("__verifier") == name, F.lit(n)) for name, n in quotas.items()))
    return out.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= most).select("r.*", F.col("__key").alias("source_key"))


def markup(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(the chat as text, where each assistant's content begins and ends in it)."""
    parts, spans, at = [], [], 0
    for role, content in turns:
        head = f"<|im_start|>{role}\n"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(content)))
        parts.append(f"{head}{content}<|im_end|>\n")
        at += len(parts[-1])
    return "".join(parts), spans


def learned(starts: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Whether each token, by where it starts, begins inside a span; spans and tokens rise."""
    if not spans:
        return np.zeros(len(starts), bool)
    begin, end = np.array(spans).T
    i = np.searchsorted(begin, starts, side="right") - 1
    return (i >= 0) & (starts < end[np.maximum(i, 0)])


def sft_example(df: DataFrame, encode: Callable[[str], Sequence[int]] | None, max_len: int, messages: str = "messages", spans: Callable[[str], tuple[Sequence[int], Sequence[int]]] | None = None) -> DataFrame:
    """input_ids, labels, attention_mask: labels stand only for the assistant's spans.

    ``spans`` gives a text's ids and where each token starts in it; each chat is then encoded once, in time linear in its
    text, and tokens that begin inside an assistant's content are learned. Where a tokenizer can only ``encode``, the place of a content is the
    number of ids of what stands before it, so each answer encodes the chat so far once more. A null chat is empty.
    """
    if (encode is None) == (spans is None):
        raise ValueError("either encode or spans")
    arrow.small(df.sparkSession)

    @F.pandas_udf("input_ids array<int>, labels array<int>, attention_mask array<int>")
    def build(rows: pd.Series) -> pd.DataFrame:
        out = []
        for turns in rows:
            turns = [] if turns is None else [(t["role"], t["content"] or "") for t in turns]
            text, inside = markup(turns)
            if spans is not None:
                ids, starts = spans(text)
                ids = np.asarray(ids, np.int32)
                labels = np.where(learned(np.asarray(starts, np.int64), inside), ids, np.int32(IGNORED))
            else:
                ids = np.asarray(list(encode(text)), np.int32)
                labels = np.full(len(ids), IGNORED, np.int32)
                for x, y in inside:
                    a = min(len(encode(text[:x])), len(ids))
                    b = min(a + len(encode(text[x:y])), len(ids))
                    labels[a:b] = ids[a:b]
            out.append((ids[:max_len], labels[:max_len], np.ones(len(ids[:max_len]), np.int32)))
        return pd.DataFrame(out, columns=["input_ids", "labels", "attention_mask"])

    return df.withColumn("__x", build(F.col(messages).cast(MESSAGES))).select(*df.columns, "__x.*")


#: Marks around learned tokens.
LEARNED = ("【learned】", "【/learned】")


def decode_for_inspection(df: DataFrame, decode: Callable[[Sequence[int]], str], name: str = "shown") -> DataFrame:
    """df with its input_ids as text, each run of learned tokens between marks (C8). ``decode`` is injected."""
    arrow.small(df.sparkSession)

    @F.pandas_udf("string")
    def show(ids: pd.Series, labels: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ids, labels, strict=True):
            x, y = (np.asarray(v if v is not None else (), np.int64) for v in (x, y))
            if len(x) != len(y):
                raise ValueError(f"{len(x)} ids and {len(y)} labels")
            on = y != IGNORED
            edges = [0, *(np.flatnonzero(on[1:] != on[:-1]) + 1).tolist(), len(x)] if len(x) else []
            runs = ((decode(x[a:b].tolist()), on[a]) for a, b in zip(edges, edges[1:]))
            out.append("".join(t.join(LEARNED) if told else t for t, told in runs))
        return pd.Series(out, dtype=object)

    return df.withColumn(name, show("input_ids", "labels"))


def token_stats(df: DataFrame) -> DataFrame:
    """Rows, token lengths and learned tokens (A10)."""
    learned = F.size(F.filter("labels", lambda x: x != IGNORED))
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("input_ids")).alias("min_len"), F.max(F.size("input_ids")).alias("max_len"), F.avg(F.size("input_ids")).alias("mean_len"), F.median(F.size("input_ids")).alias("median_len"), F.sum(learned).alias("learned"))


def pack(df: DataFrame, seq_len: int, eos: int, ids: str = "input_ids", pos: str = "pos") -> DataFrame:
    """chunk_id, input_ids: documents and an end token each, in order, cut into full sequences; the tail goes.

    A prefix sum over partitions gives each document its offset, and a document contributes one slice to each
    chunk it touches: no single-task window and no row a token.
    """
    if seq_len <= 0:
        raise ValueError("seq_len must be positive")
    rows = order.with_position(df.select(pos, F.concat(F.col(ids), F.array(F.lit(eos))).alias("t")), F.col(pos), name="__at")
    rows = storage.cut(rows.withColumn("n", F.size("t").cast("bigint")).withColumn("block", F.floor(F.col("__at") / 4096)))
    upto = lambda by, *part: F.sum("s").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")
    sums = rows.groupBy("block").agg(F.sum("n").alias("s")).withColumn("super", F.floor(F.col("block") / 4096))
    supers = sums.groupBy("super").agg(F.sum("s").alias("s")).select("super", upto("super", F.lit(0)).alias("base"))  # a row for 16.8 million documents
    sums = sums.withColumn("in", upto("block", "super")).join(supers, "super").select("block", (F.col("base") + F.col("in")).alias("from"))
    within = Window.partitionBy("block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, "block").withColumn("a", F.col("from") + F.sum("n").over(within) - F.col("n"))
    first, last = F.floor(F.col("a") / seq_len), F.floor((F.col("a") + F.col("n") - 1) / seq_len)
    parts = placed.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("chunk_id") * seq_len - F.col("a"), F.lit(0))
    hi = F.least((F.col("chunk_id") + 1) * seq_len - F.col("a"), F.col("n"))
    parts = parts.select("chunk_id", "a", F.slice("t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    joined = parts.groupBy("chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "piece"))), lambda x: x["piece"])).alias("input_ids"))
    return joined.filter(F.size("input_ids") == seq_len)


def build_sequences(docs: DataFrame, encode: Callable[[str], Sequence[int]], seq_len: int, eos: int | None, max_docs: int | None = None, pos: str = "pos", text: str = "text") -> DataFrame:
    """chunk_id, input_ids: the first ``max_docs`` texts in order, encoded and packed (C10). ``encode`` is injected; a null text is empty."""
    if eos is None:
        raise ValueError("an end token is needed")
    if max_docs is not None and max_docs <= 0:
        raise ValueError("max_docs must be positive")
    arrow.small(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([list(encode(t or "")) for t in texts], dtype=object)

    picked = docs if max_docs is None else order.slice_rows(docs, 0, max_docs, F.col(pos))
    return pack(picked.select(pos, ids(text).alias("input_ids")), seq_len, eos, "input_ids", pos)


def compact(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Token ids as 32-bit integers (C11)."""
    return df.withColumn(ids, F.col(ids).cast("array<int>"))


def repeat_to_length(ids: Column | str, n: int) -> Column:
    """The ids, cycled to n."""
    a = T.as_column(ids)
    return F.slice(F.flatten(F.array_repeat(a, F.ceil(F.lit(n) / F.greatest(F.size(a), F.lit(1))).cast("int"))), 1, n)


def preference_training_rows(pairs: DataFrame) -> DataFrame:
    """prompt as chat markup with the assistant's tag, chosen and rejected."""
    prompt = F.concat(F.lit("<|im_start|>user\n"), F.col("prompt"), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return pairs.select(prompt.alias("prompt"), "chosen", "rejected")


def mix_components(components: dict[str, DataFrame], targets: dict[str, int | None], seed: int = 42, key: str = "id") -> DataFrame:
    """Per component min(target, available) rows in seeded order, tagged with its origin."""
    if not components:
        raise ValueError("no components")
    out = None
    for name, df in components.items():
        part = df.withColumn("origin", F.lit(name))
        if targets.get(name) is not None:
            part = order.sample_rows(part, targets[name], seed, key)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def batches(it: Iterator, n: int) -> Iterator[list]:
    held = []
    for x in it:
        held.append(x)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held
