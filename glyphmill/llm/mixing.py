"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a budget of words. Its documents are taken whole as many times as the budget holds the
source, and those whose hash lies below a threshold once more. The threshold is found without a sort: words
are summed by source and hash bucket, the bucket where the budget ends is found by a running sum over the
buckets, and only that bucket is divided again, three times, down to single hash values. The thresholds of
the copies nest: a larger budget takes a superset. DataFrame functions only; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import WORD, materialize, table

#: Weights of the sources in their order, repeating; the share of all words that the mix has; copies of a source at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: A hash has 60 bits, found 15 at a time.
HASH_BITS, STEP = 60, 15
SALTS = 64
#: Sources, and bytes of their names, up to which the thresholds go to all tasks; beyond, rows are joined with them by salted keys.
FEW_SOURCES, FEW_BYTES = 10_000, 1 << 20


def _key(source: Column) -> Column:
    """A source in a form that is never null, in the order wanted: nulls last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _hash(ident: Column, text: Column) -> Column:
    """Of the id; of the text where there is none."""
    digest = F.md5(F.coalesce(ident.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), _key(F.col(source_col)).alias("src"), size.alias("size"), _hash(F.col(id_col), F.col(text_col)).alias("h"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(src, source_size, target): share of all words by weight, no source above most times its size.

    Each round deals what the sources at their cap leave of the budget to the others by weight; those that it takes
    above their cap are at it from then on. Only three sums of a round come to the driver. The sums are of whole
    numbers, so their order doesn't matter.
    """
    sizes = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = _ranked(sizes).select("src", "source_size", weight.alias("w"), (F.col("source_size").cast("double") * most).alias("cap"))
    weighed = materialize(weighed, "weights")
    budget = float(share) * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    rate, at_cap, full = 0.0, -1, F.lit(False)
    while True:
        s = weighed.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if s.w is None:  # all at their caps
            return weighed.select("src", "source_size", F.col("cap").alias("target"))
        if s.n == at_cap:
            return weighed.select("src", "source_size", F.least(F.col("cap"), F.lit(rate) * F.col("w")).alias("target"))
        rate, at_cap = (budget - (s.cap or 0.0)) / s.w, s.n
        full = F.lit(rate) * F.col("w") > F.col("cap")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank: the place of src in its order, from 0. Partitions of ranges are sorted, and their counts added up."""
    rows = sizes.repartitionByRange("src").sortWithinPartitions("src").withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows, "sources").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"))  # a row for each partition
    return rows.join(F.broadcast(starts), "part").select("src", "source_size", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def thresholds(sized: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """goal with copies, cut and cut_in: a document is taken copies times, and once more if h < cut (h <= cut if cut_in).

    Of the documents that share the last hash, all come in or none, whichever is nearer to the target.
    """
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.when(F.col("copies") < most, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(0.0))
    at = goal.where("budget > 0").select("src", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for bits in range(STEP, HASH_BITS + 1, STEP):
        down = HASH_BITS - bits
        inside = sized.select("src", "h", "size", F.shiftright("h", down + STEP).alias("prefix"))
        if bits > STEP:  # only the bucket where the budget ends is divided again
            inside = inside.join(at.select("src", "prefix"), ["src", "prefix"], "left_semi")
        sums = inside.groupBy("src", F.shiftright("h", down).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(W.partitionBy("src").orderBy("bucket"))
        ends = sums.join(at.select("src", "budget", "base"), "src").withColumn("upto", F.col("base") + run)
        # the last bucket stands in where rounding leaves the budget a little above all words
        first = F.struct((F.col("upto") < F.col("budget")).alias("short"), F.when(F.col("upto") < F.col("budget"), -F.col("bucket")).otherwise(F.col("bucket")).alias("o"))
        at = ends.groupBy("src").agg(F.min_by(F.struct("bucket", "upto", "words", "budget"), first).alias("e")).select(
            "src", F.col("e.budget").alias("budget"), F.col("e.bucket").alias("prefix"), (F.col("e.upto") - F.col("e.words")).alias("base"), F.col("e.words").alias("words")
        )
    cut = at.select("src", F.col("prefix").alias("cut"), (2 * F.col("base") + F.col("words") <= 2 * F.col("budget")).alias("cut_in"))
    return goal.join(cut, "src", "left")


def _times(most: int) -> Column:
    """How often a row with h, copies, cut and cut_in is taken."""
    more = F.coalesce((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("cut_in")), F.lit(False))
    return F.least(F.col("copies") + more.cast("long"), F.lit(most)).cast("int")


def _with_goal(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """rows joined with their source's row of dealt, without a shuffle of rows where these are few; else a hot source is dealt over SALTS tasks."""
    dealt = materialize(dealt, "goals")
    n, size = dealt.agg(F.count("*"), F.sum(F.octet_length("src"))).first()
    if n <= FEW_SOURCES and (size or 0) <= FEW_BYTES:
        return rows.join(F.broadcast(dealt), "src")
    salted = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS).cast("long"))).join(salted, ["src", "salt"]).drop("salt")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken), one row per document; taken is size times 0 to `most`.

    A null text has size 0, as have empty and blank ones, and takes 0 words. Null sources are one source, the
    last. The hash is of the id alone, or of the text where the id is null, so a rerun takes the same documents,
    and rows that repeat an id come in together. An empty table gives an empty frame. Other columns are ignored, whatever their names.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sizes")
    dealt = thresholds(sized, targets(sized, weights, share, most), most)
    return _with_goal(sized, dealt).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _times(most)).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all columns, each row as often as the mix takes it (0 to `most` times).

    Nulls, empty texts, repeated rows and empty tables are as in mix(); other columns go along, whatever their
    names. Rows of size 0 are taken as often as their source's hash threshold says.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sizes")
    dealt = thresholds(sized, targets(sized, weights, share, most), most)
    whole = docs.select(F.struct("*").alias("d")).select("d", _key(F.col("d")[source_col]).alias("src"), _hash(F.col("d")[id_col], F.col("d")[text_col]).alias("h"))
    taken = _with_goal(whole, dealt).select("d", _times(most).alias("times")).where("times > 0")
    return taken.select("d", F.explode(F.expr("array_repeat(0, times)"))).select("d.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM src),
rated AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed),
final AS (SELECT min_by(rate, cap / w) AS rate FROM rated WHERE rate * w <= cap),
goal AS (
  SELECT source, source_size, CASE WHEN f.rate IS NULL THEN cap ELSE least(cap, f.rate * w) END AS target
  FROM rated, final f),
dealt AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS copies FROM goal),
spread AS (
  SELECT s.*, g.source_size, g.target, g.copies, CASE WHEN g.copies < 2 THEN g.target - g.copies * g.source_size ELSE 0 END AS budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS tied
  FROM sized s JOIN dealt g ON s.source IS NOT DISTINCT FROM g.source),
ends AS (SELECT source, coalesce(min(h) FILTER (WHERE upto >= budget), max(h)) AS cut FROM spread WHERE budget > 0 GROUP BY source)
SELECT p.doc_id, p.size, p.source_size, round(p.target, 6) AS target,
       CAST(p.size * (p.copies + CASE WHEN e.cut IS NOT NULL AND (p.h < e.cut OR (p.h = e.cut AND 2 * p.upto - p.tied <= 2 * p.budget)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM spread p LEFT JOIN ends e ON p.source IS NOT DISTINCT FROM e.source
"""
