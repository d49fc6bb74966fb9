"""Arrays and texts inside a row: values used twice, running sums, common starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: lambdas share no subexpressions."""
    return F.transform(F.array(value), body)[0]


def _fold(sizes: Column, first: Column, gap: int) -> Column:
    """The start of each of sizes, the first at `first`. Appending copies the array, so it must be short."""
    zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["at"] + n + gap).alias("at"), F.array_append(acc["out"], acc["at"] + n).alias("out")), lambda acc: acc["out"])


def starts(sizes: Column, gap: int) -> Column:
    """Where each gap starts in a text of pieces of the given sizes with a gap of `gap` characters behind each.

    Sums run over stretches of about the root of the number of sizes: first over each as a whole, then inside.
    """

    def deal(v: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        firsts = F.filter(F.sequence(F.lit(0), F.size(v), n), lambda i: i < F.size(v))
        return F.transform(firsts, lambda i: F.slice(v, i + 1, n))

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0), lambda s, x: s + x + gap)

    def spread(parts: Column) -> Column:
        # a stretch begins where the sum of those before ends
        begins = _fold(F.transform(parts, total), F.lit(0), 0)
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), begins.alias("b")), lambda z: _fold(z["p"], z["b"] - total(z["p"]), gap)))

    return let(deal(sizes), spread)


def common(a: Column, b: Column, bits: int = 30) -> Column:
    """How many characters texts a and b have in common at their start, by halving steps."""
    least = F.least(F.length(a), F.length(b))
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(bits, -1, -1)]), lambda s: s <= least)
    return F.aggregate(steps, F.lit(0), lambda got, s: F.when((got + s <= least) & (a.substr(got + 1, s) == b.substr(got + 1, s)), got + s).otherwise(got))
