"""String functions of the corpus and scoring operators, as Column builders.

All but ``nfkc``, ``script_counts``, ``parse_judge_output`` and searches for many words are built-in expressions, so they stay in
generated code and can be pushed down.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from contextvars import ContextVar
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches as arrow
from . import patterns

#: Character classes.
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
JAPANESE = r"[\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FFF]"
LATIN = r"[A-Za-z]"
#: What Python counts as white space and as a line's end.
SPACE = r"[\s\u000B\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
#: Patterns of the rule checks.
BULLET_LINE = r"^(?:" + SPACE + r"*[-・*]|" + SPACE + r"*\d+\.)"
SENTENCE_END = "[。!?！？]"
POLITE_ENDINGS = "(です|でした|ます|ました|ましょう|ませ|ません|でしょうか|でしょう|ください|下さい|ございます)$"
POLITE_EXEMPT = (
    "[様殿][ 　]*$",
    "(御中|各位|拝啓|敬具|前略|草々|拝復|敬白)[ 　]*$",
    "^[ 　]*(拝啓|敬具|前略|草々|拝復|敬白|記|以上)[ 　]*$",
    r"^[ 　]*[\[［(（].*[\]］)）][ 　]*$",
    "^[ 　]*〇[〇0-9A-Za-z]*",
)
PREAMBLES = (
    r"はい、?承知(いた)?しました[。!！]?\s*\n?",
    r"承知(いた)?しました[。!！]?\s*\n?",
    r"かしこまりました[。!！]?\s*\n?",
    r"以下(の(とおり|通り))?[、,]?\s*\n?",
    r"回答[:：]\s*",
    r"お答え(いた)?します[。!！]?\s*\n?",
)
ANSWER_BOUNDARY = r"(?U)Question:|質問[:：]|\b[A-E]:|\n\s*\n"
KATAKANA_RUN, KANJI_RUN = "[ァ-ヴー]{2,}", r"[\u4E00-\u9FFF]{2,4}"
#: The judge's instruction.
JUDGE_PROMPT = (
    "あなたは日本語の文章品質を評価する採点者です。次のプロンプトと応答を読み、指示への適合性(文字数や書式などのルール遵守)は評価対象に含めず、"
    "日本語としての自然さ・内容の的確さ・簡潔さ(丁寧な文面が求められる場合は実務文面としての適切さ)のみを基準に、1〜5の整数で品質スコアを付けてください。\n"
    "応答は途中で切れている場合があります。その場合も、切れている箇所までの内容の品質で採点してください。\n\n# プロンプト\n",
    "\n\n# 応答\n",
    '\n\n以下の厳格なJSON形式のみで出力してください。他の説明文は一切含めないでください。\n{"score": <1から5の整数>, "reason": "<採点理由を一文で>"}\n',
)


#: Whether functions in Python stand in a column by the name they have in SQL (functions.sql) in place of themselves.
BY_NAME: ContextVar[bool] = ContextVar("BY_NAME", default=False)
#: Whether what comes to ``nfkc`` is in that form already (verifiers.dispatch).
NORMAL: ContextVar[bool] = ContextVar("NORMAL", default=False)


def python_function(name: str, make: Callable[[], Callable[..., Column]], *args: Column) -> Column:
    arrow.small()
    return F.call_function(f"tessella_{name}", *args) if BY_NAME.get() else make()(*args)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _nfkc():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:  # not over batches: those have a worker each, these share one
        return texts if texts.isna().all() else texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC (N1). Arrow batches; ASCII texts stay where they are."""
    t = as_column(c)
    if NORMAL.get():
        return t
    return F.when(is_ascii(t), t).otherwise(python_function("nfkc", _nfkc, F.when(~is_ascii(t), t)))


@cache
def _nfkc_each():
    norm = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[norm(t) for t in ts] for ts in texts], dtype=object)

    return run


def nfkc_each(c: Column) -> Column:
    """NFKC of each text of an array, in one call for all of them; an array is never null."""
    return python_function("nfkc_each", _nfkc_each, c)


def is_ascii(c: Column | str) -> Column:
    """Whether each character takes one byte; null for null."""
    return F.octet_length(as_column(c)) == F.length(as_column(c))


def remove_control_chars(c: Column | str) -> Column:
    """Without control characters, but for newline and tab, and without private-use characters."""
    return F.regexp_replace(as_column(c), CONTROL, "")


def count_in(c: Column | str, kind: str) -> Column:
    """How many characters are of a class: what is left without the runs of others. A match a character would make a string of each."""
    return F.length(F.regexp_replace(as_column(c), f"[^{kind[1:]}+", ""))


@cache
def _script_counts():
    @F.arrow_udf("struct<ja: int, en: int>")
    def run(texts: pa.Array) -> pa.Array:
        t = texts.cast(pa.large_string())
        at = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
        raw = np.frombuffer(t.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        letter = (raw | 0x20) - np.uint8(97) < 26
        then = np.append(raw[1:], np.uint8(0))
        # by the first two bytes: U+3040 to 30FF, U+4E00 to 4FFF, U+5000 to 9FFF
        ja = ((raw == 0xE3) & (then - np.uint8(0x81) < 3)) | ((raw == 0xE4) & (then >= 0xB8)) | (raw - np.uint8(0xE5) < 5)
        ends = (at - at[0]).tolist()
        counts = ([np.count_nonzero(of[i:j]) for i, j in zip(ends, ends[1:], strict=False)] for of in (ja, letter))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()) for n in counts], ["ja", "en"], mask=t.is_null())

    return run


def script_counts(c: Column | str) -> Column:
    """struct<ja, en>: how many characters are Japanese or Latin letters; null for null. Bytes are compared in arrays: regular expressions took a step a character."""
    arrow.small()
    return _script_counts()(as_column(c))


def detect_language(c: Column | str, threshold: float = 0.5) -> Column:
    """``ja``, ``en`` or ``other`` by the share of script characters (N3); Japanese is tried first. The text is made and read once."""
    n = script_counts(c)
    ja, en = n["ja"], n["en"]
    total = ja + en
    return F.when(total == 0, "other").when(ja / total >= threshold, "ja").when(en / total >= threshold, "en").otherwise("other")


def char_ngrams(c: Column | str, n: int) -> Column:
    """The distinct character n-grams; a shorter text is its own, an empty one has none."""
    t = as_column(c)
    size = F.length(t)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(as_column(c), f"^{SPACE}+|{SPACE}+$", "")


def lines(c: Column | str) -> Column:
    """Lines as Python splits them: a final line end opens no line, an empty text has none."""
    t = as_column(c)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, rf"(?:{LINE_END})\z", ""), LINE_END))


def count_bullets(c: Column | str) -> Column:
    """Lines that begin a list item (N6); the text is already normalised."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(BULLET_LINE)))


def keyword_noun(c: Column | str) -> Column:
    """The most frequent katakana or kanji run, then the longer, then the first; null if none."""
    t = as_column(c)
    runs = F.concat(F.regexp_extract_all(t, F.lit(f"({KATAKANA_RUN})")), F.regexp_extract_all(t, F.lit(f"({KANJI_RUN})")))
    rank = lambda x: F.struct((-F.size(F.filter(runs, lambda y: y == x))).alias("n"), (-F.length(x)).alias("l"), F.array_position(runs, x).alias("at"), x.alias("x"))
    return F.array_min(F.transform(F.array_distinct(runs), rank)).getField("x")


def strip_preamble(c: Column | str) -> Column:
    """Without opening phrases, as often as they stand at the front, and without a fence around the whole text."""
    t = strip(F.regexp_replace(as_column(c), "^(?:" + "|".join(PREAMBLES) + ")+", ""))
    fenced = F.regexp_extract(t, r"(?s)^```[a-zA-Z]*\n?(.*?)\n?```$", 1)
    return strip(F.when(t.rlike(r"(?s)^```[a-zA-Z]*\n?(.*?)\n?```$"), fenced).otherwise(t))


def split_sentences(c: Column | str) -> Column:
    """Stripped pieces between sentence ends and lines, without empty ones and list items."""
    parts = F.flatten(F.transform(F.split(as_column(c), SENTENCE_END), lines))
    return F.filter(F.transform(parts, strip), lambda x: (x != "") & ~x.rlike(BULLET_LINE))


def is_label_line(c: Column | str) -> Column:
    """A colon among the first 15 characters."""
    return as_column(c).rlike("^.{0,14}[：:]")


def is_polite_exempt(c: Column | str) -> Column:
    """Labels, lines without hiragana, and letter formulas are not judged."""
    t = as_column(c)
    out = is_label_line(t) | ~t.rlike("[ぁ-ゖ]")
    for p in POLITE_EXEMPT:
        out = out | t.rlike(p)
    return out


def answer_segment(c: Column | str) -> Column:
    """A continuation's first answer: up to a boundary, through the first full stop, white space joined."""
    t = F.coalesce(as_column(c), F.lit(""))
    head = F.element_at(F.split(t, ANSWER_BOUNDARY, 2), 1)
    return strip(F.regexp_replace(F.regexp_extract(head, "(?s)^([^。]*。?)", 1), f"{SPACE}+", " "))


def custom_answer(c: Column | str, pattern: str) -> Column:
    """All groups of the first match, joined and stripped; empty without one.

    A pattern that begins with ``.*`` matches at the text's start or nowhere; tried there alone, it takes linear time.
    """
    bare = pattern.replace("(?s)", "")
    t = as_column(c)
    found = "(?Us)" + (r"\A" if bare.startswith(".*") else "") + bare
    return strip(F.concat(*(F.regexp_extract(t, found, g) for g in range(1, re.compile(bare).groups + 1))))


def _judgement(raw: str | None) -> tuple[int | None, str | None]:
    m = re.search(r"\{.*\}", raw or "", re.DOTALL)
    try:
        got = json.loads(m[0]) if m else None
    except ValueError:
        got = None
    if not isinstance(got, dict):
        return None, None
    score, reason = got.get("score"), got.get("reason")
    if not isinstance(score, int) or isinstance(score, bool) or not 1 <= score <= 5:
        return None, None
    return score, reason if isinstance(reason, str) else "" if reason is None else str(reason)


@cache
def _parse_judge():
    @F.pandas_udf("score int, reason string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([_judgement(t) for t in texts], columns=["score", "reason"])
        return out.astype({"score": "Int32"})

    return run


def parse_judge_output(c: Column | str) -> Column:
    """struct<score, reason> of a reply's JSON object; null unless the score is a whole number 1..5.

    JSON is read strictly, as SQL's readers also take "4" and trailing text.
    """
    return _parse_judge()(as_column(c))


def judge_prompt(prompt: Column | str, response: Column | str) -> Column:
    """The judge's prompt."""
    return F.concat(F.lit(JUDGE_PROMPT[0]), as_column(prompt), F.lit(JUDGE_PROMPT[1]), as_column(response), F.lit(JUDGE_PROMPT[2]))


def judge_request(model: str, prompt: Column, max_tokens: int = 96, temperature: float | None = None, seed: int | None = None) -> Column:
    """A chat request's JSON body; greedy without a temperature."""
    fields = [F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(float(temperature or 0.0)).alias("temperature")]
    if temperature and seed is not None:
        fields.append(F.lit(seed).alias("seed"))
    return F.to_json(F.struct(*fields))


def best_answer(answers: Column, choices: Column, correct: Column) -> Column:
    """The first answer, else the correct choice's text, else empty."""
    picked = F.filter(choices, lambda c: c["label"] == correct)
    return F.coalesce(F.get(answers, 0), F.get(picked, 0)["text"], F.lit(""))


def split_bucket(c: Column | str, modulus: int = 5) -> Column:
    """sha1(id) as a number, modulo 5 (N17): 16 is 1 modulo 5, so the sum of the hex digits decides."""
    if modulus not in (3, 5, 15):
        raise ValueError("digits can be summed only where 16 is 1 modulo the modulus")
    h = F.sha1(as_column(c))
    digit = lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda a, i: a + digit(i)) % modulus


def question(prompt: Column, choices: Column) -> Column:
    """A prompt with its choices as ``label: text`` lines."""
    listed = F.array_join(F.transform(choices, lambda c: F.concat(c["label"], F.lit(": "), c["text"])), "\n")
    return F.when(choices.isNull() | (F.size(choices) == 0), prompt).otherwise(F.concat(prompt, F.lit("\n"), listed))


def format_bytes(c: Column | str) -> Column:
    """A size with its unit."""
    n = as_column(c).cast("double")
    k = F.least(F.when(F.abs(n) < 1, 0).otherwise(F.floor(F.log(F.greatest(F.abs(n), F.lit(1.0))) / F.log(F.lit(1024.0)))), F.lit(4)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB", "TiB"))), k + 1)
    x = n / F.pow(F.lit(1024.0), k)
    x = F.when(F.abs(x) < 1e18, F.bround(x.cast("decimal(38,18)"), 1).cast("double")).otherwise(x)  # an exact half goes to the even digit
    return F.format_string("%.1f %s", x, unit)


def messages(question_: Column | str, answer: Column | str) -> Column:
    """A two-message chat."""
    pair = lambda role, c: F.struct(F.lit(role).alias("role"), as_column(c).alias("content"))
    return F.array(pair("user", question_), pair("assistant", answer))


def row_label(id_: Column, line: Column) -> Column:
    """The id, or the line's number."""
    return F.coalesce(id_.cast("string"), F.format_string("<line %d>", line))


def matched_groups(groups: Mapping[str, Sequence[str]], *columns: Column | str) -> Column:
    """The sorted names of the groups of which a keyword stands in any column."""
    return patterns.matched_groups(groups, [as_column(c) for c in columns])


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """Whether any word is a substring; null for a null text."""
    return patterns.contains_any(as_column(c), words)
