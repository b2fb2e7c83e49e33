"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.lineage import cut

#: A node with more than this share of all links is a hub, whose links are dealt over tasks; there are at most 2000 of them.
HUB_SHARE = 1 / 2000


def _told(links: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """``links`` (u, v) with ``m`` of their u; ``roots`` has n, the number of u's links."""
    least = max(1, int(total * HUB_SHARE))
    parts = F.ceil(F.col("n") / least).cast("int")
    hubs = F.broadcast(roots.where(F.col("n") > least).select("u", parts.alias("_parts")))  # at most 1 / HUB_SHARE rows
    dealt = links.join(hubs, "u", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = F.when(F.col("n") > least, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(roots.select("u", "m", F.explode(copies).alias("_part")), ["u", "_part"]).drop("_part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over undirected edges; nodes without edges do not appear."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        many = e.groupBy("u").count().where("count > 1")
        if many.isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        total = e.count()
        both = e.union(e.select("v", "u"))
        root = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0"))
        e = cut(_told(both.where("v > u"), root, total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        root = cut(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        told = _told(e, root, total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        e = cut(told.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct())
