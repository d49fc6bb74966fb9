"""Literal search over runs, with exact offsets, context and the reason why a match can't be replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from glyphmill.functions.arrays import common, let, starts

CONTEXT = 48


def _between(text: Column, needle: str, match_case: bool) -> Column:
    """The pieces of text between the matches of needle. Case is folded letter by letter, so a match is as long as needle."""
    return F.split(text, ("" if match_case else "(?iu)") + r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E", -1)


def offsets(text: Column, needle: str, match_case: bool = False) -> Column:
    """Starts (from 0) in text of the matches of needle that don't overlap, left to right; none for an empty needle."""
    if not needle:
        return F.array().cast("array<int>")
    return F.when(text.isNotNull(), let(_between(text, needle, match_case), lambda parts: starts(F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length), len(needle))))


def find_matches(runs: DataFrame, needle: str, match_case: bool = False) -> DataFrame:
    """runs (with text) joined with their matches: start, end, match, before, after. No shuffle."""
    n, text = len(needle), F.col("text")
    found = runs.withColumn("start", F.explode(offsets(text, needle, match_case))).withColumn("end", F.col("start") + n)
    left = text.substr(F.greatest(F.col("start") - CONTEXT, F.lit(0)) + 1, F.least(F.col("start"), F.lit(CONTEXT)))
    right = text.substr(F.col("end") + 1, F.lit(CONTEXT))
    return found.withColumns({
        "match": text.substr(F.col("start") + 1, F.lit(n)),
        "before": F.concat(F.when(F.length(left) < F.col("start"), "…").otherwise(""), left),
        "after": F.concat(right, F.when(F.col("end") + F.length(right) < F.length(text), "…").otherwise("")),
    })


def refusal(state: Column, reason: Column, safe: Column, sharers: Column) -> Column:
    """Why a match can't be replaced, or null: an unsafe span, then the run's state, then a shared address."""
    return (
        F.when(~safe, "normalization_boundary_unreplaceable")
        .when(~state.isin("editable_original", "editable_substitution"), F.coalesce(F.nullif(reason, F.lit("")), F.lit("uneditable")))
        .when(sharers > 1, "operator_shared_by_multiple_runs")
    )


def with_sharers(runs: DataFrame, address: str = "run_id") -> DataFrame:
    """runs with sharers: how many runs have the same address."""
    return runs.withColumn("sharers", F.count("*").over(W.partitionBy(address)))


def replace_all(text: Column, needle: str, replacement: str) -> Column:
    """text with every match (in either case) replaced: the pieces between the matches, joined by the replacement."""
    return F.array_join(_between(text, needle, False), replacement) if needle else text


def text_verdict(before: Column, after: Column, old: str, new: Column) -> Column:
    """replaced if `after` is `before` with exactly one occurrence of old (any one) become new, else wrong; unverifiable if old isn't there.

    The occurrence must end where the common end of both texts may begin and start where their common start may
    stop, so only the places between these two are looked at.
    """

    def one(v: Column) -> Column:
        low, high = F.greatest(F.lit(0), v["n"] - len(old) - v["end"]), F.least(v["start"], v["n"] - len(old))
        places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda p: (before.substr(p + 1, F.lit(len(old))) == old) & (after.substr(p + 1, F.length(new)) == new))

    sizes = F.struct(F.length(before).alias("n"), common(before, after).alias("start"), common(F.reverse(before), F.reverse(after)).alias("end"))
    fits = F.length(after) == F.length(before) - len(old) + F.length(new)
    return F.when(F.instr(before, old) == 0, "unverifiable").when(fits & let(sizes, one), "replaced").otherwise("wrong")
