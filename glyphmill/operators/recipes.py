"""Edit recipes: planning with a named reason for each refusal, and application of all operations or none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from glyphmill.functions import run_ids


def plan(recipe: DataFrame, runs: DataFrame, documents: DataFrame) -> DataFrame:
    """recipe (op, run_id, source, new_text) with ok and reason.

    runs: run_id, state, verdict_reason; documents: source, source_hash. The reasons in their order: a repeated
    run id refuses every operation of its recipe; then a malformed id, another document's hash, an unknown run,
    and what the run's verdict says. The window only counts, so the test of repeats is one shuffle by run id.
    """
    repeats = recipe.groupBy("source", "run_id").count().groupBy("source").agg(F.max("count").alias("most"))
    parts = run_ids.decode(F.col("run_id"))
    rows = recipe.join(repeats, "source").join(documents, "source", "left").join(runs, "run_id", "left")
    reason = (
        F.when(F.col("most") > 1, "duplicate_run_id_in_recipe")
        .when(parts.isNull(), "malformed_run_id")
        .when(~parts["source_hash"].eqNullSafe(F.col("source_hash")), "source_hash_mismatch")
        .when(F.col("state").isNull(), "run_id_not_found")
        .when(~F.col("state").isin("editable_original", "editable_substitution"), F.coalesce("verdict_reason", F.lit("not_editable")))
    )
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("most", "source_hash", "state", "verdict_reason")


def report(plan: DataFrame) -> DataFrame:
    """(source, ok, n_ops, n_refused): a recipe is ok only if all of its operations are."""
    return plan.groupBy("source").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n_ops"), F.count_if(~F.col("ok")).alias("n_refused"))


def apply(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """runs (source, run_id, text, ...) with the new texts of the recipes that are wholly ok; the others change nothing.

    A plan speaks of its own source's runs only, and one that names a run twice is not ok.
    """
    ops = plan.groupBy("source", "run_id").agg((F.bool_and("ok") & (F.count("*") == 1)).alias("ok"), F.min("new_text").alias("new_text"))
    good = ops.withColumn("all_ok", F.min(F.col("ok").cast("int")).over(W.partitionBy("source"))).where("all_ok = 1")
    return runs.join(good.select("source", "run_id", "new_text"), ["source", "run_id"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def build(runs: DataFrame, matches: DataFrame, prior: DataFrame, replacement: str) -> DataFrame:
    """(source, run_id, before, after, n, reason): the operations that put replacement in the place of selected matches.

    runs: source, run_id, text; matches: source, run_id, start, end, match, replaceable; prior: the recipe so far
    (source, run_id, new_text), on whose text a run's matches must lie. Runs that nothing changes have no row. reason
    is stale where a match is not what the text holds at its place, or overlaps the one before; after is then null.
    """
    keys = ["source", "run_id"]
    chosen = matches.where("replaceable").where(F.col("match") != F.lit(replacement))
    spans = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "match"))).alias("_m"))
    based = spans.join(runs, keys).join(prior.select(*keys, "new_text"), keys, "left").withColumn("before", F.coalesce("new_text", "text"))
    text, m = F.col("before"), F.col("_m")

    def fits(v: Column, i: Column) -> Column:
        after_last = F.coalesce(v["start"] >= F.get(m, i - 1)["end"], F.lit(True))
        return after_last & (v["start"] >= 0) & (v["end"] <= F.length(text)) & (text.substr(v["start"] + 1, v["end"] - v["start"]) == v["match"])

    def piece(v: Column, i: Column) -> Column:
        last = F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        return F.concat(text.substr(last + 1, v["start"] - last), F.lit(replacement))

    ok = F.forall(F.transform(m, fits), lambda b: b)
    end = F.element_at(m, -1)["end"]
    after = F.concat(F.array_join(F.transform(m, piece), ""), text.substr(end + 1, F.length(text)))
    made = based.select(*keys, "before", F.when(ok, after).alias("after"), F.size("_m").alias("n"), F.when(~ok, "stale").alias("reason"))
    return made.where("after IS NULL OR after <> before")


def upsert(recipe: DataFrame, ops: DataFrame) -> DataFrame:
    """(source, pos, run_id, new_text): an operation on a known run takes that one's place, a new one goes to the end."""
    keys = ["source", "run_id"]
    last = recipe.groupBy("source").agg(F.max("pos").alias("last"))
    old = recipe.join(ops.select(*keys, F.col("new_text").alias("newer")), keys, "left").select("source", "pos", "run_id", F.coalesce("newer", "new_text").alias("new_text"))
    fresh = ops.join(recipe, keys, "left_anti").join(last, "source", "left")
    rank = F.row_number().over(W.partitionBy("source").orderBy("pos"))
    return old.union(fresh.select("source", (F.coalesce("last", F.lit(-1)) + rank).alias("pos"), "run_id", "new_text"))


def preview(candidates: DataFrame, resolve: Callable[[DataFrame], DataFrame], rounds: int = 100) -> DataFrame:
    """The largest set of candidates that all resolve: refused runs are dropped until none is.

    resolve gives (run_id, ok) for each candidate. Each round must drop some, or the plan is inconsistent.
    """
    for _ in range(rounds):
        refused = resolve(candidates).where("NOT ok").select("run_id").distinct()
        n = refused.count()
        if not n:
            return candidates
        left = candidates.join(refused, "run_id", "left_anti").checkpoint()  # else each round's plan holds those before twice
        if left.count() >= candidates.count():
            raise ValueError("a refused run is not among the candidates")
        candidates = left
    raise ValueError("the preview did not settle")
