"""Small text functions of the document model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def subset_tag(name: Column) -> Column:
    """Six capital letters from the first six bytes of the name's MD5."""
    digest = F.md5(name.cast("binary"))
    letters = [F.chr(65 + F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 26) for i in range(6)]
    return reduce(lambda a, b: F.concat(a, b), letters)


# Words that tell no product, and the name of none.
FILLERS = ("for", "version", "ver", "by", "the", "on")
UNKNOWN = "unknown"


def producer(raw: Column) -> Column:
    """A product's name from a producer's line: letters only, lower case, without versions and fillers, 60 characters at most."""
    words = F.split(F.lower(F.trim(F.regexp_replace(raw, "[^a-zA-Z]+", " "))), " ")
    kept = F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*FILLERS)), " ")
    return F.left(F.coalesce(F.nullif(kept, F.lit("")), F.lit(UNKNOWN)), F.lit(60))


def base_font_name(name: Column) -> Column:
    """A font's name without leading slashes and subset tag."""
    return F.regexp_replace(F.regexp_replace(name, "^/+", ""), r"^[A-Z]{6}\+(?=.)", "")


def differences(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows (num or name) with code, names only: a number sets the next name's code, each name takes one."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    since = rows.withColumn("_start", F.last("num", ignorenulls=True).over(w)).withColumn("_set", F.count("num").over(w))
    place = F.row_number().over(W.partitionBy(*keys, "_set").orderBy(order))
    code = F.when(F.col("_set") == 0, place - 1).otherwise(F.col("_start") + place - 2)
    return since.withColumn("code", code.cast("long")).where("name IS NOT NULL").drop("_start", "_set")
