"""The rule verifiers as SQL functions.

``register`` makes each verifier of the registries a temporary function ``verify_<name>(text, detail)`` that gives struct<ok, reason>, for
``spark.sql``, views and ``expr``. A function's body is the text of the verifier's own column, so there is one definition of each;
what runs in Python has a name of its own there. ``constraint_detail(json)`` makes a detail of the fields that the JSON has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T
from . import verifiers as V

#: What a column's text has in place of operators, outside quotes: a sign or a word and a bracket.
_SIGN = re.compile(r"""'(?:[^'\\]|\\.)*'|`[^`]*`|(?<![\w`])(and|or|in|not)\(|(<=>|>=|<=|!=|[=<>!+*/%-])\(""")


def detail_type() -> str:
    return f"STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in V.DETAIL.split(', '))}>"


def text_of(c: Column) -> str:
    """A column's SQL, with operators as quoted function names."""
    raw = c._jc.node().sql()
    return _SIGN.sub(lambda m: f"`{m[1] or m[2]}`(" if m[1] or m[2] else m[0], raw)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; their names."""
    for name, make in (("nfkc", T._nfkc), ("nfkc_each", T._nfkc_each), ("keywords", V._keyword_udf), ("json", V._json_udf), ("json_items", V._json_items_udf)):
        spark.udf.register(f"tessella_{name}", make())
    kind = detail_type()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION constraint_detail(json STRING) RETURNS {kind} RETURN from_json(json, '{V.DETAIL}')")
    named = T.BY_NAME.set(True)
    try:
        checks = {f"verify_{name}": check(F.col("t"), F.col("d")) for name, check in {**V.CATEGORIES, **V.VERIFIERS, "format_json_detail": V.format_json_detail}.items()}
    finally:
        T.BY_NAME.reset(named)
    for name, check in checks.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING, d {kind}) RETURNS STRUCT<ok: BOOLEAN, reason: STRING> RETURN {text_of(check)}")
    return sorted(checks)
