"""Shared pieces: word splitting, table access, lineage cuts and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
#: The same words for Java's regular expressions, on lower-cased text.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """:func:`words_of` as a native expression: an array of strings, empty for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NON_WORD), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, by a path that any of Spark's file systems may serve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset, on one machine only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in reliable storage. ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes files no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder, and read again. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Arrow batches of ``rows`` in this session, unless it has a number of its own: Spark's 10,000 whole texts stand several times in the JVM's and in Python's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, rows)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps now; by itself it waits for a collection, half an hour at most."""
    gc.collect()
    spark._jvm.System.gc()


#: A key with more than this share of the rows, and so many rows at least, is hot; there are at most as many such keys as the share's inverse.
HOT_SHARE, HOT_ROWS = 1 / 2000, 500


def hot_keys(counted: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """The keys of ``counted`` (one row a key) with more than ``HOT_SHARE`` of the ``total`` rows, 1 / ``HOT_SHARE`` at most, and in how many parts to deal them."""
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    return counted.where(F.col(count) > least).select(*on, F.ceil(F.col(count) / least).cast("int").alias("_parts"))


def spread_join(rows: DataFrame, told: DataFrame, on: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``told`` (one row a key, or few), hot keys over many tasks.

    The rows of a hot key are dealt in parts by a hash of ``spread``, and what ``told`` has of it is
    repeated for each. ``hot`` is of :func:`hot_keys` and thus small enough to broadcast; without hot
    keys this is a plain join.
    """
    if hot.isEmpty():
        return rows.join(told, on, how)
    dealt = rows.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = told.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")


def mod_crc(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps until every node but a component's smallest has one
    edge, and that to its smallest: every step keeps at most one edge per edge it got, so nothing
    grows, and each round cuts lineage in reliable storage. Self links and repeats are ignored;
    nodes without links do not appear.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        twice = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if twice.isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        e = cut(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
