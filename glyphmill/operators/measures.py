"""Measures over labelled scores, pages and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def threshold_sweep(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, fpr, f1): positive is predicted where score > threshold.

    scored: score, positive (0 or 1). Rows are first counted by the thresholds that they pass, so the data are
    read once and what is summed up is at most as long as the list of thresholds, which must be distinct.
    """
    steps = thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("t"))  # one row
    passed = scored.crossJoin(F.broadcast(steps)).select("positive", F.expr("size(filter(t, x -> x < score))").alias("passes"))
    counts = passed.groupBy("passes").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("n"))
    ranked = thresholds.distinct().withColumn("rank", F.row_number().over(W.orderBy("threshold")))
    sums = ranked.crossJoin(F.broadcast(counts)).groupBy("threshold").agg(
        F.sum(F.when(F.col("passes") >= F.col("rank"), F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("passes") >= F.col("rank"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum("p").alias("all_p"), F.sum("n").alias("all_n"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    out = sums.withColumns({"fn": F.col("all_p") - F.col("tp"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("all_p")), "fpr": ratio(F.col("fp"), F.col("all_n"))})
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).drop("all_p", "all_n")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest f1, the lowest threshold of several."""
    return sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def tuning(gaps: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the best threshold with its measures, percentiles of the gaps, and how many documents (keys) there are.

    gaps: keys, score, positive (0 or 1). Documents without a positive gap tell nothing and are only counted.
    """
    docs = gaps.groupBy(*keys).agg(F.max("positive").alias("_any"))
    telling = gaps.join(docs.where("_any = 1").select(*keys), keys, "left_semi")
    best = best_threshold(threshold_sweep(telling, thresholds))

    def rank(positive: int, q: float) -> Column:
        return F.expr(f"percentile_disc({q}D) WITHIN GROUP (ORDER BY score) FILTER (WHERE positive = {positive})")

    shares = {"negative_p99": (0, 0.99), "negative_p999": (0, 0.999), "positive_p10": (1, 0.1), "positive_p50": (1, 0.5), "positive_p90": (1, 0.9)}
    ranks = telling.agg(*[rank(*v).alias(k) for k, v in shares.items()], F.sum("positive").alias("n_positive"), F.sum(1 - F.col("positive")).alias("n_negative"))
    counts = docs.agg(F.count("*").alias("n_documents"), F.sum("_any").alias("n_telling"))
    return best.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(counts))  # one row each


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank, columns p10 and so on."""
    return rows.groupBy(*keys).agg(*[F.expr(f"percentile_disc({q}D) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * q)}") for q in shares])


def weighted_mode(rows: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """keys with body: the value (in halves, half to even) of the greatest weight, the smaller of several."""
    sums = rows.groupBy(*keys, (F.bround(value * 2) / 2).alias("size")).agg(F.sum(F.greatest(F.lit(1), weight)).alias("w"))
    return sums.groupBy(*keys).agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"))


def lexicon(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(hits, known_size, hit_rate, singletons, n_tokens, singleton_rate) of tokens (token) against words (word)."""
    marked = tokens.join(words.select(F.col("word").alias("token")).distinct().withColumn("known", F.lit(1)), "token", "left")
    long = (F.length("token") >= 2) & F.col("token").rlike("^[a-z]+$")
    s = marked.agg(F.count_if(long & F.col("known").isNotNull()).alias("hits"), F.count_if(long).alias("long_tokens"), F.count_if(F.length("token") == 1).alias("singletons"), F.count("*").alias("n_tokens"))
    return s.withColumns({"hit_rate": F.round(F.try_divide("hits", "long_tokens"), 9), "singleton_rate": F.round(F.try_divide("singletons", "n_tokens"), 9)})


#: Cells on each side of a page.
GRID = 80


def coverage(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, covered, coverage): cells of the page that any box touches, never the sum of areas.

    boxes: page_id, x0, y0, x1, y1; pages: page_id, px0, py0, px1, py1 (the crop box). A page without area or
    boxes has none.
    """
    b = boxes.join(pages, "page_id").where("px1 > px0 AND py1 > py0")
    b = b.select("page_id", *[F.expr(e).alias(n) for n, e in {
        "ax": "greatest(x0, px0) - px0", "ay": "greatest(y0, py0) - py0", "bx": "least(x1, px1) - px0", "by": "least(y1, py1) - py0", "w": "px1 - px0", "h": "py1 - py0"}.items()]).where("bx > ax AND by > ay")

    def first(low: str, size: str) -> Column:
        return F.least(F.lit(GRID - 1), F.floor(F.col(low) / F.col(size) * GRID)).cast("int")

    def last(high: str, size: str) -> Column:
        return F.least(F.lit(GRID), F.ceil(F.col(high) / F.col(size) * GRID)).cast("int")

    def ones(part: int) -> Column:
        """The columns of the part'th half of a grid's row, as bits."""
        low, high = (F.least(F.greatest(F.col(c) - part * GRID // 2, F.lit(0)), F.lit(GRID // 2)) for c in ("c0", "c1"))
        return F.call_function("shiftleft", F.lit(1).cast("long"), high) - F.call_function("shiftleft", F.lit(1).cast("long"), low)

    # a row for each row of the grid that a box touches, its columns as two numbers, which are combined before they are shuffled
    spans = b.select("page_id", first("ax", "w").alias("c0"), last("bx", "w").alias("c1"), first("ay", "h").alias("r0"), last("by", "h").alias("r1")).where("c1 > c0 AND r1 > r0")
    rows = spans.select("page_id", ones(0).alias("left"), ones(1).alias("right"), F.explode(F.sequence("r0", F.col("r1") - 1)).alias("row"))
    masks = rows.groupBy("page_id", "row").agg(F.bit_or("left").alias("left"), F.bit_or("right").alias("right"))
    n = masks.groupBy("page_id").agg(F.sum(F.bit_count("left") + F.bit_count("right")).alias("covered"))
    return pages.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) / F.lit(GRID * GRID)).alias("coverage"))


def page_bucket(visible: Column, invisible: Column, coverage: Column, paths: Column) -> Column:
    """What a page is, from its glyph counts, its image coverage and its path objects."""
    half = coverage >= 0.5
    return (
        F.when(visible > 0, F.when(half & (invisible >= 3 * visible), "mixed_degraded").otherwise("editable"))
        .when(half, F.when(invisible > 0, "ocr_scan").otherwise("scan_no_text"))
        .when(paths >= 200, "vector_outlined")
        .otherwise("empty")
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    """(code, pages, total): sorted distinct pages; a sum only if every count is known."""
    return facts.groupBy("code").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.when(F.count("*") == F.count("n"), F.sum("n")).alias("total"))


#: What a page's warnings mean as facts; any other that speaks of tables is AMBIGUOUS_TABLE.
WARNING_FACTS = {"columns-inferred-unruled-tables-unsupported": "COLUMN_LAYOUT", "unsupported-text-direction": "UNSUPPORTED_DIRECTION"}


def warning_fact(warning: Column) -> Column:
    """The fact code of a layout warning, or null."""
    code = F.when(F.lit(False), F.lit(""))
    for said, fact in WARNING_FACTS.items():
        code = code.when(warning == said, fact)
    return code.when(warning.contains("table"), "AMBIGUOUS_TABLE")


def multiset_delta(before: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, n): items of before less removed plus added, those with n <> 0."""
    signed = before.withColumn("n", F.lit(1)).unionByName(removed.withColumn("n", F.lit(-1))).unionByName(added.withColumn("n", F.lit(1)))
    return signed.groupBy(*keys, "item").agg(F.sum("n").alias("n")).where("n <> 0")


def capped(rows: DataFrame, key: Column, share: float, order: list[str]) -> DataFrame:
    """rows of which no key has more than max(2, share of all rows)."""
    most = rows.agg(F.greatest(F.lit(2), F.floor(F.count("*") * F.lit(share))).alias("_most"))  # one row
    ranked = rows.withColumn("_key", key).withColumn("_rank", F.row_number().over(W.partitionBy("_key").orderBy(*order)))
    return ranked.crossJoin(F.broadcast(most)).where("_rank <= _most").drop("_key", "_rank", "_most")


def budgeted(rows: DataFrame, keys: list[str], order: list[str], weight: str, limit: int) -> DataFrame:
    """rows with running and within: whether all up to this one stay in the limit; over it the key is refused, not cut."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.sum(weight).over(w)).withColumn("within", F.col("running") <= limit)
    return rows.withColumn("refused", F.sum(weight).over(W.partitionBy(*keys)) > limit)
