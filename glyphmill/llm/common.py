"""Shared helpers: scratch tables in the shared folder, byte access to Arrow text, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import is_local, prepare

#: Java and DuckDB (RE2) both read this class: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that executors hand to Python at once. Rows are whole documents here, so Spark's default of 10,000 is too many.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session has a setting of its own, and make this package known to executors."""
    prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a local session, whose tasks share a disk, may have none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SWEPT: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder of the shared one; the folder goes when the driver's Python ends."""
    home = f"{scratch_root(spark)}/glyphmill/{spark.sparkContext.applicationId}"
    if home not in _SWEPT:
        _SWEPT.add(home)
        atexit.register(_delete, spark, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone, and a leftover harms nothing
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage at a table that outlives executors; unlike checkpoint() it runs the plan once
    and stays columnar.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # type: ignore[attr-defined]
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; only for tables that no live plan reads."""
    if path := getattr(df, "scratch_path", None):
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def dealt_table(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder, dealt by key into as many buckets as shuffles have partitions, so that joins by key leave it in place.

    It goes when the block ends: what is built of it must be written by then.
    """
    spark = df.sparkSession
    name, path = f"glyphmill_{uuid.uuid4().hex}", scratch_path(spark, "dealt")
    try:
        df.write.bucketBy(partitions(spark), key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


#: Bits of the table that tells most rows apart from those a join wants.
SIEVE = 1 << 23


def sieved(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """rows with _hit: whether key (a 64-bit hash) may be among the wanted ones; false is certain.

    A table of SIEVE bits, one for each remainder of the wanted hashes, goes to all tasks, so rows that a join doesn't
    want need not be shuffled for it. Its size doesn't grow; where it fills up, more rows are hits.
    """

    def place(h: Column) -> Column:
        return F.shiftright(F.pmod(h, F.lit(SIEVE)), 6)

    def one(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))

    marks = wanted.groupBy(place(F.col(wanted_key)).alias("_place")).agg(F.bit_or(one(F.col(wanted_key))).alias("_bits"))
    met = rows.withColumn("_h", key).withColumn("_place", place(F.col("_h"))).join(F.broadcast(marks), "_place", "left")  # SIEVE / 64 rows at most
    return met.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(one(F.col("_h"))) != 0, F.lit(False))).drop("_place", "_bits", "_h")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): (node, root), root the smallest node reached.

    Alternates large-star and small-star steps, both of them joins with a grouped minimum, so that no
    neighbour list is ever built and a hub is an ordinary skewed join key. Each round is written to the
    shared folder; only a count and a checksum come to the driver.
    """
    spark = edges.sparkSession
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    cur = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())

    before = stamp(cur)
    while before[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        new = materialize(small, "edges")
        after = stamp(new)
        drop_scratch(cur)
        cur = new
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
