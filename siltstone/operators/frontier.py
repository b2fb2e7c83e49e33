"""Crawl state as tables: the frontier, visited and failed URLs, waves, and the phase machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import urls as U
from siltstone.plans.lineage import cut

#: Minutes between visits by phase.
PERIODS = {"initial": 1.0, "active": 30.0, "steady": 180.0, "maintenance": 1440.0}
#: Phase -> (next phase, processed more than, or minutes more than, percent of new content below).
PHASES = {"initial": ("active", 100, 60, None), "active": ("steady", 1000, 240, 20), "steady": ("maintenance", 5000, 1440, 5)}
JOB = "struct<url: string, depth: int, priority: int, job_type: string, parent_url: string>"


def jobs(rows: DataFrame) -> DataFrame:
    """Jobs with domain, path and predicates; lower priorities go first, ties by url."""
    url = F.col("url")
    return rows.withColumns(
        {
            "domain": U.authority(url),
            "path": U.path(url),
            "high_priority": F.col("priority") < 0,
            "is_sitemap": F.col("job_type") == "sitemap",
            "is_list": F.col("job_type") == "list",
            "is_detail": F.col("job_type") == "detail",
        }
    )


def pop(frontier: DataFrame, k: int) -> DataFrame:
    return frontier.orderBy("priority", "url").limit(k)


def page_class(url: Column) -> Column:
    return F.when(U.is_list(url), "list").when(U.is_detail(url), "detail").otherwise("page")


def enqueue(candidates: DataFrame, visited: DataFrame, host: str, max_depth: int = 5, in_progress: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """What candidates (url, depth, parent_url and perhaps job_type) come to: url, depth, job_type, priority, parent_url, outcome.

    Sitemaps always queue. Others are skipped if visited or in progress, too deep, or of another host.
    Types come from the URL where none is given, priorities from the default policies. ``distinct``
    queues a URL once, from the shallowest depth.
    """
    kind = F.col("job_type") if "job_type" in candidates.columns else F.lit(None).cast("string")
    rows = candidates.select(U.normalize_url(F.col("url")).alias("url"), F.col("depth").cast("int").alias("depth"), "parent_url", kind.alias("job_type"))
    if distinct:
        rows = rows.groupBy("url").agg(F.min(F.struct("depth", "parent_url", "job_type")).alias("r")).select("url", "r.*")
    known = visited.select("url", F.lit(True).alias("_seen"))
    if in_progress is not None:
        known = known.union(in_progress.select("url", F.lit(True)))
    rows = rows.join(known.distinct(), "url", "left")
    sitemap = F.coalesce(F.col("job_type") == "sitemap", F.lit(False))
    outcome = F.when(sitemap, "queued").when(F.col("_seen"), "skipped_visited").when(F.col("depth") > max_depth, "skipped_depth").when(U.authority(F.col("url")) != host, "skipped_host").otherwise("queued")
    rows = rows.withColumn("outcome", outcome).withColumn("job_type", F.coalesce("job_type", page_class(F.col("url"))))
    rows = rows.withColumn("priority", U.weighted_priority(F.col("url"), F.col("depth"), F.col("job_type")))
    return rows.select("url", "depth", "job_type", "priority", "parent_url", "outcome")


def waves(links: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """url, depth of all pages that links (src, dst) reach from the seeds (url) within ``max_depth``: one anti join a wave."""
    edges = links.select("src", "dst").distinct()
    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for depth in range(1, max_depth + 1):
        new = edges.join(last.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        last = cut(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        seen = cut(seen.union(last))
    return seen


def process_wave(fetched: DataFrame, max_depth: int = 5) -> dict[str, DataFrame]:
    """One wave over fetched pages (url, depth, html, error): visited, failed, extracted records, and child candidates."""
    from siltstone.functions.html import extract_fields, legacy_fields

    ok = F.col("error").isNull() & F.col("html").isNotNull() & (F.coalesce(F.col("status_code"), F.lit(200)) < 400)
    pages = fetched.where(ok)
    failed = fetched.where(~F.coalesce(ok, F.lit(False))).select("url", F.coalesce("error", F.concat(F.lit("status "), F.col("status_code").cast("string"))).alias("error"), "status_code")
    records = pages.select("url", extract_fields(F.col("url"), F.col("html")).alias("r")).select("url", "r.*")
    children = pages.where(F.col("depth") < max_depth).select(F.explode(legacy_fields(F.col("url"), F.col("html"))["links"]).alias("link"), (F.col("depth") + 1).alias("depth"), F.col("url").alias("parent_url"))
    return {"visited": pages.select("url", "status_code"), "failed": failed, "records": records, "children": children.withColumnRenamed("link", "url")}


def evict(history: DataFrame, cap: int = 10_000, oldest: int = 100) -> DataFrame:
    """Visit history (url, visited_at) without its ``oldest`` rows if it has more than ``cap``; ties by url."""
    n = history.agg((F.count("*") > cap).alias("_over"))
    gone = history.crossJoin(F.broadcast(n)).where("_over").orderBy("visited_at", "url").limit(oldest)  # n is one row
    return history.join(gone.select("url", "visited_at"), ["url", "visited_at"], "left_anti")


def failures(events: DataFrame, key: str = "url", ts: str = "ts", error: str = "error") -> DataFrame:
    """attempts, first_attempt, last_attempt and last_error of each URL."""
    return events.groupBy(key).agg(F.count("*").alias("attempts"), F.min(ts).alias("first_attempt"), F.max(ts).alias("last_attempt"), F.max_by(error, F.struct(ts, error)).alias("last_error"))


def should_retry(jobs: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    out = jobs.join(failed.select("url", "attempts"), "url", "left")
    return out.withColumn("retry", F.coalesce("attempts", F.lit(0)) < most).drop("attempts")


def crawl_stats(events: DataFrame, ok: Column, ts: str = "ts") -> DataFrame:
    """n_ok, n_failed, elapsed_seconds, urls_per_minute of a fetch log."""
    out = events.agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    seconds = F.coalesce(F.timestamp_diff("SECOND", F.col("a"), F.col("b")), F.lit(0))
    rate = F.floor(F.col("n_ok") / F.greatest(seconds, F.lit(1)) * 60)
    return out.select("n_ok", "n_failed", seconds.cast("long").alias("elapsed_seconds"), rate.cast("long").alias("urls_per_minute"))


def next_phase(phase: str, processed: int, new: int, minutes: float) -> str:
    """The phase after these counts in ``phase``."""
    if phase not in PHASES:
        return phase
    after, n, longest, below = PHASES[phase]
    percent = new / max(1, processed) * 100
    return after if (processed > n or minutes > longest) and (below is None or percent < below) else phase


def phase_column(phase: Column, processed: Column, new: Column, minutes: Column) -> Column:
    """:func:`next_phase` as a column."""
    percent = new / F.greatest(processed, F.lit(1)) * 100
    out = phase
    for name, (after, n, longest, below) in PHASES.items():
        go = (phase == name) & ((processed > n) | (minutes > longest))
        out = F.when(go & (percent < below) if below is not None else go, after).otherwise(out)
    return out


def phase_history(steps: DataFrame, key: str = "site") -> DataFrame:
    """Phases of each site after ordered steps (site, at, processed, new, minutes): a fold, as counts restart at each change.

    at, phase, processed, new for every step. A site's steps are its crawl checks, some a day.
    """
    start = F.struct(F.lit("initial").alias("phase"), F.lit(0).cast("long").alias("processed"), F.lit(0).cast("long").alias("new"), F.lit(0.0).alias("since"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col("processed").cast("long").alias("processed"), F.col("new").cast("long").alias("new"), F.col("minutes").cast("double").alias("minutes"))))
    empty = F.array().cast("array<struct<at:bigint,phase:string,processed:bigint,new:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        state = acc["s"]
        processed, new = state["processed"] + s["processed"], state["new"] + s["new"]
        after = phase_column(state["phase"], processed, new, s["minutes"] - state["since"])
        changed = after != state["phase"]
        zero = F.lit(0).cast("long")
        state = F.struct(after.alias("phase"), F.when(changed, zero).otherwise(processed).alias("processed"), F.when(changed, zero).otherwise(new).alias("new"), F.when(changed, s["minutes"]).otherwise(state["since"]).alias("since"))
        row = F.struct(s["at"].cast("bigint").alias("at"), state["phase"].alias("phase"), state["processed"].alias("processed"), state["new"].alias("new"))
        return F.struct(state.alias("s"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = steps.groupBy(key).agg(F.aggregate(listed, F.struct(start.alias("s"), empty.alias("out")), step)["out"].alias("h"))
    return folded.select(key, F.inline("h"))


def sleep_minutes(phase: Column, spread: float = 0.2, draw: Column | None = None) -> Column:
    """Minutes to the next visit in a phase, times a draw around 1."""
    base = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])[phase]
    return base * (1 - spread + 2 * spread * (F.rand() if draw is None else draw))
