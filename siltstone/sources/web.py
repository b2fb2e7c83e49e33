"""What a crawl brings in: responses, robots.txt rules, politeness, sitemaps. Fetching itself is outside: input is a table of pages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from siltstone.functions.urls import authority


def responses(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages as fetch responses: a missing page or a status of 400 and more is a row with an error, never a lost row."""
    status = F.col("status_code") if "status_code" in pages.columns else F.when(F.col(html).isNotNull(), 200)
    error = F.when(F.col(html).isNull(), "no content").when(status >= 400, F.concat(F.lit("status "), status.cast("string")))
    return pages.withColumns({"status_code": status.cast("int"), "error": error, html: F.when(error.isNull(), F.col(html))})


@F.pandas_udf(StructType([StructField("allowed", BooleanType()), StructField("delay", DoubleType())]))
def robots_rules(robots: pd.Series, url: pd.Series, agent: pd.Series) -> pd.DataFrame:
    """Whether a host's robots.txt lets the agent fetch the URL, and its crawl delay. Unreadable files allow everything."""
    parsers: dict[str, RobotFileParser] = {}
    out = []
    for text, u, a in zip(robots, url, agent, strict=True):
        if not text:
            out.append((True, None))
            continue
        if text not in parsers:
            parsers[text] = RobotFileParser()
            parsers[text].parse(text.splitlines())
        rules = parsers[text]
        delay, rate = rules.crawl_delay(a), rules.request_rate(a)
        out.append((rules.can_fetch(a, u), float(delay) if delay is not None else rate.seconds / rate.requests if rate else None))
    return pd.DataFrame(out, columns=["allowed", "delay"]).astype({"delay": "float64"})


def robots_gate(jobs: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Adds ``allowed`` and ``crawl_delay`` to jobs (url) by their host's row of ``robots`` (host, text)."""
    rules = robots.select(F.col("host"), F.col("text").alias("_robots"))
    out = jobs.withColumn("host", authority(F.col("url"))).join(rules, "host", "left")
    out = out.withColumn("_r", robots_rules(F.coalesce("_robots", F.lit("")), F.col("url"), F.lit(agent)))
    return out.withColumns({"allowed": F.col("_r.allowed"), "crawl_delay": F.col("_r.delay")}).drop("_r", "_robots")


def politeness(requests: DataFrame, default: float = 1.0, delay: Column | None = None) -> DataFrame:
    """Adds ``wait``: seconds that each request (host, ts) still has to wait after its host's last one."""
    last = F.lag("ts").over(Window.partitionBy("host").orderBy("ts"))
    passed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6
    least = F.greatest(F.lit(default), F.coalesce(delay, F.lit(0.0))) if delay is not None else F.lit(default)
    return requests.withColumn("wait", F.when(last.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), least - passed)))


def sitemaps_in_robots(robots: DataFrame) -> DataFrame:
    """host, sitemap: what follows the first colon of robots.txt lines that start with "sitemap:" in any case."""
    lines = robots.select("host", F.explode(F.split("text", r"\R")).alias("line"))
    found = F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(.*?)\s*$", 1)
    return lines.where(F.col("line").rlike(r"(?i)^\s*sitemap:")).select("host", found.alias("sitemap"))


def _entries(text: str | None) -> Iterator[tuple[str, str]]:
    try:
        root = ET.fromstring((text or "").strip())
    except ET.ParseError:
        yield from (("url", x.strip()) for x in (text or "").splitlines() if x.strip() and not x.strip().startswith("#"))
        return
    name = lambda e: e.tag.rpartition("}")[2]
    for kind in ("sitemap", "url"):
        found = [(kind, (loc.text or "").strip()) for e in root.iter() if name(e) == kind for loc in e if name(loc) == "loc"]
        if found:
            yield from (x for x in found if x[1])
            return


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """url, depth, kind, loc of every entry of ``sitemaps`` (url, depth, text).

    An index gives its sitemaps, one deeper; otherwise its pages at depth 0; text that is no XML is
    read line by line without blank lines and comments.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, d + 1 if k == "sitemap" else 0, k, loc) for u, d, t in zip(b["url"], b["depth"], b["text"], strict=True) for k, loc in _entries(t)]
            yield pd.DataFrame(rows, columns=["url", "depth", "kind", "loc"])

    return sitemaps.select("url", F.col("depth").cast("int"), "text").mapInPandas(read, "url string, depth int, kind string, loc string")


def start_sources(sitemaps: DataFrame, given: DataFrame, root: str) -> DataFrame:
    """Where a crawl starts: the sitemaps if there are any, else the given URLs, else the root. url, job_type."""
    spark = sitemaps.sparkSession
    ranked = (
        sitemaps.select(F.col("sitemap").alias("url"), F.lit("sitemap").alias("job_type"), F.lit(0).alias("rank"))
        .unionByName(given.select("url", F.lit("page").alias("job_type"), F.lit(1).alias("rank")))
        .unionByName(spark.createDataFrame([(root, "page", 2)], "url string, job_type string, rank int"))
    )
    best = ranked.agg(F.min("rank").alias("rank"))
    return ranked.join(F.broadcast(best), "rank").select("url", "job_type")  # one row
