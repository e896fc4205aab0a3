"""A seeded permutation of 0 .. n - 1 that computes each place from the position alone.

Positions are cells of a rectangle of about sqrt(n) columns and rows. Each round adds to one coordinate a keyed
square, modulo a prime, of the other (a Feistel network over two moduli), so a round can be undone and no two cells meet. The few
cells beyond n are walked through until a place below n comes up; that keeps the permutation one. Nothing is
sorted and nothing shuffled: a row's place needs its position, n and the seed. Whole-number arithmetic only, below 2^62, so any SQL engine can follow.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 6
#: Steps of the walk. At n of 250 a position needs more with a chance of 1e-19, less beyond; below, so many cells are not to spare.
WALK = 16


def keys(seed: int | str) -> list[tuple[int, int]]:
    """(factor, summand) of each round."""
    digest = [hashlib.sha256(f"{seed}/{i}".encode()).digest() for i in range(ROUNDS)]
    return [(1 + int.from_bytes(d[:8], "big") % (PRIME - 1), int.from_bytes(d[8:16], "big") % PRIME) for d in digest]


def place(position: Column, n: Column | int, seed: int | str) -> Column:
    """The place of a position among n (both bigint); a position outside 0 .. n - 1 is an error."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    columns = F.ceil(F.sqrt(n.cast("double")))
    rows = F.floor((n + columns - 1) / columns)
    rounds = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"), F.lit(i % 2 == 0).alias("first")) for i, (a, b) in enumerate(keys(seed))))

    def square(x: Column, k: Column) -> Column:
        y = (x * k["a"] + k["b"]) % PRIME
        return (y * y) % PRIME

    def once(s: Column, k: Column) -> Column:
        x = F.when(k["first"], (s["x"] + square(s["y"], k)) % s["c"]).otherwise(s["x"])
        y = F.when(k["first"], s["y"]).otherwise((s["y"] + square(s["x"], k)) % s["r"])
        return F.struct(x.alias("x"), y.alias("y"), s["c"].alias("c"), s["r"].alias("r"))

    def step(z: Column) -> Column:
        start = F.struct((z["z"] % z["c"]).alias("x"), F.floor(z["z"] / z["c"]).alias("y"), z["c"].alias("c"), z["r"].alias("r"))
        return F.aggregate(rounds, start, once, lambda s: s["x"] + s["y"] * s["c"])

    def walk(z: Column, i: Column) -> Column:
        moved = F.when((i > 0) & (z["z"] < z["n"]), z["z"]).otherwise(step(z))
        return F.struct(moved.alias("z"), z["c"].alias("c"), z["r"].alias("r"), z["n"].alias("n"))

    start = F.struct(position.cast("bigint").alias("z"), columns.alias("c"), rows.alias("r"), n.alias("n"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), start, walk, lambda z: z["z"])
    wrong = F.raise_error(F.lit("a position is outside 0 .. n - 1")).cast("bigint")
    return F.when((position >= 0) & (position < n) & (out < n), out).otherwise(wrong)


def place_sql(position: str, n: str, seed: int | str, rows: str) -> str:
    """The same in SQL: CTEs (a recursive WITH) that give ``placed(pos, place)`` from a table ``rows`` with columns ``position`` and ``n``."""
    inner = "SELECT pos, n, c, r, z % c AS x, z // c AS y FROM walk WHERE i = 0 OR z >= n"
    inner = f"SELECT pos, n, c, r, i + 1 AS i, x, y FROM ({inner.replace('SELECT pos', 'SELECT i, pos')})"
    for i, (a, b) in enumerate(keys(seed)):
        square = lambda v, a=a, b=b: f"((({v} * {a} + {b}) % {PRIME}) * (({v} * {a} + {b}) % {PRIME})) % {PRIME}"
        x, y = (f"(x + {square('y')}) % c", "y") if i % 2 == 0 else ("x", f"(y + {square('x')}) % r")
        inner = f"SELECT pos, n, c, r, i, {x} AS x, {y} AS y FROM ({inner})"
    start = f"SELECT CAST({position} AS BIGINT) AS pos, CAST({n} AS BIGINT) AS n, CAST(ceil(sqrt({n})) AS BIGINT) AS c FROM {rows}"
    return f"""walk AS (SELECT pos, n, c, (n + c - 1) // c AS r, 0 AS i, pos AS z FROM ({start})
  UNION ALL SELECT pos, n, c, r, i, x + y * c AS z FROM ({inner})),
 placed AS (SELECT pos, z AS place FROM walk WHERE i > 0 AND z < n)"""
