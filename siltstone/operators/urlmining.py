"""Pattern mining over URLs: parts, sections, clusters, patterns, matching and selectors by similarity.

Pattern tables are small by nature (a site has some hundred); URL tables may be large.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import urls as U
from siltstone.plans.lineage import cut


def path_values(urls: DataFrame, url: str = "url") -> DataFrame:
    """position, value: distinct path segments by position."""
    return urls.select(F.posexplode(U.segments(F.col(url))).alias("position", "value")).distinct()


def query_values(urls: DataFrame, url: str = "url") -> DataFrame:
    """key, value: distinct values of each query key."""
    pairs = urls.select(F.explode(F.split(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), "&")).alias("pair")).where("pair <> ''")
    parts = F.split("pair", "=", 2)
    return pairs.select(F.get(parts, F.lit(0)).alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value")).distinct()


def sections(urls: DataFrame, url: str = "url", few: int = 10, most: float = 0.7) -> DataFrame:
    """position, n_values, kind, values: positions with 2 to ``few`` - 1 values list them; more are <id>, <slug> or <variable>."""
    held = path_values(urls, url).groupBy("position").agg(
        F.count("*").alias("n_values"),
        F.count_if(F.col("value").rlike(r"^\d+$")).alias("digits"),
        F.count_if(F.contains("value", F.lit("-"))).alias("hyphens"),
    )
    listed = path_values(urls, url).join(held.where(F.col("n_values") < few).select("position"), "position").groupBy("position").agg(F.array_sort(F.collect_list("value")).alias("listed"))
    kind = F.when(F.col("n_values") < few, "enumerated").when(F.col("digits") > most * F.col("n_values"), "numeric").when(F.col("hyphens") > most * F.col("n_values"), "slug").otherwise("unknown")
    mark = F.when(kind == "numeric", "<id>").when(kind == "slug", "<slug>").otherwise("<variable>")
    out = held.where("n_values > 1").join(listed, "position", "left")
    return out.select("position", "n_values", kind.alias("kind"), F.when(kind == "enumerated", F.col("listed")).otherwise(F.array(mark)).alias("values")).orderBy("position")


def common_patterns(groups: DataFrame, group: list[str], total: int | Column, url: str = "url", samples: int = 5) -> DataFrame:
    """A pattern for each group of URLs: host, and each segment position's only value or ``*``; flags, samples, weight, url_count.

    Sizes come from counts, samples from the smallest URLs: a group of any size is aggregated, not collected.
    """
    rows = groups.select(*group, F.col(url).alias("url"))
    parts = rows.select(*group, F.posexplode(U.segments(F.col("url"))).alias("pos", "part"))
    each = parts.groupBy(*group, "pos").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    each = each.select(*group, F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("*").alias("part")).alias("p"))
    path = each.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda s: s["part"]), "/").alias("path"))
    whole = rows.groupBy(*group).agg(F.count("*").alias("url_count"), F.min_by(U.authority(F.col("url")), "url").alias("host"))
    first = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("url"))).where(F.col("n") <= samples)
    first = first.groupBy(*group).agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    out = whole
    for part in (path, first):
        named = part.withColumnsRenamed({g: f"_{g}" for g in group})
        out = out.join(named, _and([F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]), "left").drop(*[f"_{g}" for g in group])
    pattern = F.concat("host", F.lit("/"), F.coalesce("path", F.lit("")))
    return out.select(*group, pattern.alias("pattern"), U.is_list(pattern).alias("is_list"), U.is_detail(pattern).alias("is_detail"), "sample_urls", (F.col("url_count") / total).alias("weight"), "url_count")


def _and(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def heuristic_patterns(urls: DataFrame, url: str = "url") -> DataFrame:
    """Patterns by segment count: URLs of small groups stand for themselves; others go by their fixed segments."""
    rows = urls.select(F.col(url).alias("url")).distinct()
    rows = cut(rows.withColumn("n_segments", F.size(U.segments(F.col("url")))))
    total = rows.count()
    sized = rows.join(rows.groupBy("n_segments").agg(F.count("*").alias("size")), "n_segments")
    alone = sized.where("size < 3").select(
        F.col("url").alias("pattern"), U.is_list(U.path(F.col("url"))).alias("is_list"), U.is_detail(U.path(F.col("url"))).alias("is_detail"), F.array("url").alias("sample_urls"), F.lit(1 / max(total, 1)).alias("weight"), F.lit(1).cast("long").alias("url_count")
    )
    # All URLs of a group share its fixed segments, so that the group by them is the group itself.
    groups = common_patterns(sized.where("size >= 3"), ["n_segments"], max(total, 1)).drop("n_segments")
    return alone.unionByName(groups)


#: Up to so many pairs of vectors are compared one by one; above that, boxes are halved first.
PAIRS_AT_ONCE = 2_000_000


def _boxes(nodes: DataFrame, width: int, *by: str) -> DataFrame:
    """cell (its smallest node), n, lo, hi, v, norm: bounds of the unit vectors of a group, and that node's vector."""
    at = [F.col("unit")[i] for i in range(width)]
    held = nodes.groupBy(*by).agg(F.min("node").alias("cell"), F.count("*").alias("n"), *[F.min(x).alias(f"_lo{i}") for i, x in enumerate(at)], *[F.max(x).alias(f"_hi{i}") for i, x in enumerate(at)])
    held = held.withColumns({k: F.array(*[F.col(f"_{k}{i}") for i in range(width)]) for k in ("lo", "hi")}).drop(*[f"_{k}{i}" for k in ("lo", "hi") for i in range(width)])
    return held.join(nodes.select(F.col("node").alias("cell"), "v", "norm"), "cell")


def _told_pairs(pairs: DataFrame, width: int, eps: float) -> DataFrame:
    """Pairs of boxes a, b that may hold vectors at most ``eps`` apart, with ``sure``: the first vectors are, or all must be."""
    zero = F.lit(0.0)
    gap = [F.greatest(zero, F.col("a.lo")[i] - F.col("b.hi")[i], F.col("b.lo")[i] - F.col("a.hi")[i]) for i in range(width)]
    far = [F.greatest(F.col("a.hi")[i] - F.col("b.lo")[i], F.col("b.hi")[i] - F.col("a.lo")[i]) for i in range(width)]
    total = lambda parts: _sum([x * x for x in parts])
    sure = (total(far) <= 2 * eps * (1 - 1e-6)) | _near("a.v", "b.v", "a.norm", "b.norm", eps)
    return pairs.where(total(gap) <= 2 * eps * (1 + 1e-6) + 1e-12).withColumn("sure", sure)


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _near(va: str, vb: str, na: str, nb: str, eps: float) -> Column:
    dot = F.aggregate(F.zip_with(va, vb, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot / F.greatest(F.col(na) * F.col(nb), F.lit(1e-9)) <= eps


def linked_vectors(nodes: DataFrame, width: int, eps: float) -> DataFrame:
    """node, component of (node, v, norm) with distinct v: components of the graph of vectors at most ``eps`` apart by cosine, the smallest node each.

    Unit vectors fall into boxes so small that all in one are linked. Pairs of boxes are linked if they must
    be or their first vectors are, and dropped if they cannot be; those left between different components
    are halved until few enough pairs of vectors remain, which are compared. How many boxes the first round has
    depends on width and ``eps``, not on the number of vectors.
    """
    from siltstone.operators.graph import components

    side = (2 * eps / width) ** 0.5 * (1 - 1e-6)
    cells = lambda: F.transform("unit", lambda x: F.floor(x / side + 0.5).cast("int"))
    pair = lambda x, c: F.struct("cell", "n", "lo", "hi", "v", "norm", F.col(c).alias("comp")).alias(x)
    units = nodes.where("norm > 0").withColumn("unit", F.transform("v", lambda x: x / F.col("norm")))
    units = units.withColumn("key", cells())
    boxes = cut(_boxes(units, width, "key"))
    units = cut(units.join(boxes.select("key", "cell"), "key").select("node", "v", "norm", "unit", "cell"))
    label = cut(boxes.select("cell", "n", F.col("cell").alias("comp")))
    pairs = boxes.select(pair("a", "cell")).join(F.broadcast(boxes.select(pair("b", "cell"))), F.col("a.cell") < F.col("b.cell"))  # as many as the box size allows
    members = units
    while True:
        pairs = cut(_told_pairs(pairs, width, eps).select("a", "b", "sure"))
        renamed = components(pairs.where("sure").select(F.col("a.comp").alias("x"), F.col("b.comp").alias("y")).where("x <> y"), "x", "y")
        renamed = cut(renamed.withColumnsRenamed({"node": "comp", "component": "_new"}))
        label = cut(label.join(renamed, "comp", "left").select("cell", "n", F.coalesce("_new", "comp").alias("comp")))
        left = pairs.where("NOT sure AND (a.n > 1 OR b.n > 1)").select("a", "b", F.col("a.comp").alias("ca"), F.col("b.comp").alias("cb"))
        for c in ("ca", "cb"):
            left = left.join(renamed.withColumnsRenamed({"comp": c, "_new": f"_{c}"}), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        left = cut(left.where("ca <> cb").select(F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), "ca", "cb", (F.col("a.n") * F.col("b.n")).alias("work")))
        work = left.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]
        if not work:
            break
        if work <= PAIRS_AT_ONCE or side < 1e-7:
            x = members.select(F.col("cell").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
            y = members.select(F.col("cell").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
            met = left.join(x, "a").join(y, "b").where(_near("va", "vb", "na", "nb", eps)).select("ca", "cb").distinct()
            renamed = components(met, "ca", "cb").withColumnsRenamed({"node": "comp", "component": "_new"})
            label = cut(label.join(renamed, "comp", "left").select("cell", "n", F.coalesce("_new", "comp").alias("comp")))
            break
        side /= 2
        used = left.select(F.col("a").alias("cell")).union(left.select("b")).distinct()
        members = members.join(used, "cell", "left_semi").withColumnRenamed("cell", "whole").withColumn("key", cells())
        smaller = cut(_boxes(members, width, "whole", "key"))
        members = cut(members.join(smaller.select("whole", "key", "cell"), ["whole", "key"]).select("node", "v", "norm", "unit", "cell"))
        x = left.join(smaller.withColumnRenamed("whole", "a"), "a").select("b", "cb", pair("_a", "ca"))
        pairs = x.join(smaller.withColumnRenamed("whole", "b"), "b").select(F.col("_a").alias("a"), pair("b", "cb"))
    linked = label.join(label.groupBy("comp").agg(F.sum("n").alias("total")).where("total > 1"), "comp").select("cell", F.col("comp").alias("component"))
    return units.join(linked, "cell").select("node", "component")


def vector_clusters(urls: DataFrame, url: str = "url", eps: float = 0.3, width: int = 8) -> DataFrame:
    """url, cluster: density clusters by cosine distance of URL vectors with two URLs enough for a core; -1 for noise.

    With a minimum of two, clusters are the connected components of the graph of vectors at most ``eps``
    apart (:func:`linked_vectors`). Equal vectors are one node.
    """
    rows = cut(urls.select(F.col(url).alias("url")).distinct().withColumn("v", U.url_vector(F.col("url"), width)))
    nodes = rows.groupBy("v").agg(F.count("*").alias("size"), F.min(F.xxhash64("v")).alias("node"))
    nodes = cut(nodes.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))))
    label = linked_vectors(nodes.select("node", "v", "norm"), width + 1, eps)
    told = nodes.join(label, "node", "left").select("v", F.when(F.col("component").isNotNull(), F.col("component")).when(F.col("size") > 1, F.col("node")).alias("component"))
    ranked = told.where("component IS NOT NULL").select("component").distinct()
    ranked = ranked.withColumn("cluster", F.dense_rank().over(Window.orderBy("component")) - 1)  # one row a cluster
    return rows.join(told, "v", "left").join(ranked, "component", "left").select("url", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def discovered_patterns(urls: DataFrame, url: str = "url", eps: float = 0.3) -> DataFrame:
    """Patterns of the clusters, and of the noise by :func:`heuristic_patterns`."""
    told = cut(vector_clusters(urls, url, eps))
    total = max(told.count(), 1)
    clustered = common_patterns(told.where("cluster >= 0"), ["cluster"], total).drop("cluster")
    rest = told.where("cluster < 0").select("url")
    return clustered.unionByName(heuristic_patterns(rest)) if not rest.isEmpty() else clustered


def add_samples(samples: DataFrame, most: int = 5) -> DataFrame:
    """pattern, sample_urls (the first ``most`` distinct by order of arrival), url_count of (pattern, url, arrival)."""
    first = samples.groupBy("pattern", "url").agg(F.min("arrival").alias("arrival"), F.count("*").alias("n"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("pattern").orderBy("arrival", "url")))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "url")))), lambda s: s["url"])
    return placed.groupBy("pattern").agg(kept.alias("sample_urls"), F.sum("n").alias("url_count"))


def match_patterns(urls: DataFrame, patterns: DataFrame, url: str = "url", bound: int = 10_000, scheme: bool = True) -> DataFrame:
    """url, pattern, is_list, is_detail, weight: the first pattern by ``ordinal`` that matches, else one made from the URL (weight 0.1).

    Patterns are matched against host and path; ``scheme=False`` matches whole URLs, under which
    patterns without a scheme can never match. Patterns are counted and broadcast; ``bound`` is the most
    that one pass takes, more take further passes.
    """
    spark = urls.sparkSession
    rows = urls.select(F.col(url).alias("url")).distinct()
    target = F.regexp_replace(U.normalize_url(F.col("url")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "") if scheme else F.col("url")
    rows = rows.withColumn("_target", target)
    total = patterns.count()
    best = spark.createDataFrame([], "url string, ordinal int, pattern string, is_list boolean, is_detail boolean, weight double")
    for k in range(-(-total // bound)):
        part = patterns.where((F.pmod(F.col("ordinal"), F.lit(-(-total // bound))) == k)) if total > bound else patterns
        part = part.select(F.col("ordinal").cast("int"), "pattern", "is_list", "is_detail", "weight", U.pattern_regex(F.col("pattern")).alias("_regex"))
        hit = rows.join(F.broadcast(part), F.regexp_like("_target", F.col("_regex")))
        best = best.union(hit.select("url", "ordinal", "pattern", "is_list", "is_detail", "weight"))
    first = best.groupBy("url").agg(F.min(F.struct("ordinal", "pattern", "is_list", "is_detail", "weight")).alias("m"))
    out = rows.join(first, "url", "left")
    own = F.struct(F.lit(None).cast("int").alias("ordinal"), F.col("url").alias("pattern"), U.is_list(F.col("url")).alias("is_list"), U.is_detail(F.col("url")).alias("is_detail"), F.lit(0.1).alias("weight"))
    return out.select("url", F.coalesce("m", own).alias("m")).select("url", "m.pattern", "m.is_list", "m.is_detail", "m.weight")


#: Up to so many sets of positions a URL, stored pages are found by the segments at each set; longer paths go by blocks.
POSITION_SETS = 100


def _needed(n: int, least: float) -> int:
    """The fewest equal ones of ``n`` segments that make a similarity beyond ``least``; n + 1 if none do."""
    return next((m for m in range(n + 1) if m / max(n, 1) > least), n + 1)


def match_selectors(urls: DataFrame, stored: DataFrame, least: float = 0.7) -> DataFrame:
    """url, page_type, selectors: of the first stored page (by ordinal) of the same type whose URL is more similar than ``least``; else empty.

    Similarity above 0.3 needs the same host and number of segments, so these are join keys. A similar
    page shares the segments of one set of positions at least, as many as are needed: the first
    page of each set's segments is an aggregate, so that a host of any size makes no pairs. Paths with
    too many sets share one of their blocks of segments instead, and are then compared.
    """
    if least < 0.3:
        raise ValueError("least is 0.3 or more")
    parts = lambda u: [U.authority(u).alias("host"), U.raw_segments(u).alias("parts")]
    left = cut(urls.where("url IS NOT NULL AND page_type IS NOT NULL").select("url", "page_type").distinct().select("url", "page_type", *parts(F.col("url"))))
    right = stored.where("url IS NOT NULL AND page_type IS NOT NULL AND ordinal IS NOT NULL").select(F.col("url").alias("stored_url"), "page_type", "ordinal", *parts(F.col("url")))
    right = cut(right.groupBy("host", "page_type", "parts").agg(F.min(F.struct("ordinal", "stored_url")).alias("first")))
    sizes = [r.n for r in right.select(F.size("parts").alias("n")).distinct().collect()]  # some dozen
    need = {n: _needed(n, least) for n in sizes}
    few = {n: [list(c) for c in combinations(range(1, n + 1), need[n])] for n in sizes if need[n] <= n and comb(n, need[n]) <= POSITION_SETS}
    blocks = {n: [list(range(1 + k * n // (n - need[n] + 1), 1 + (k + 1) * n // (n - need[n] + 1))) for k in range(n - need[n] + 1)] for n in sizes if need[n] <= n and n not in few}

    def keyed(rows: DataFrame, sets: dict[int, list[list[int]]], *more: str | Column) -> DataFrame:
        """A row for each set of positions: host, page_type, n, set, the segments there."""
        lists = F.lit(None).cast("array<array<int>>")
        for n, chosen in sets.items():
            lists = F.when(F.size("parts") == n, F.array(*[F.array(*[F.lit(p) for p in c]).cast("array<int>") for c in chosen])).otherwise(lists)
        told = rows.select(*rows.columns, F.size("parts").alias("n"), F.posexplode(lists).alias("set", "places"))
        return told.select("host", "page_type", "n", "set", F.transform("places", lambda p: F.element_at("parts", p)).alias("shared"), *more)

    key = ["host", "page_type", "n", "set", "shared"]
    firsts = keyed(right, few, "first").groupBy(*key).agg(F.min("first").alias("first"))
    found = keyed(left, few, "url").join(firsts, key).select("url", "page_type", "first")
    if blocks:
        near = keyed(left, blocks, "url", "parts").join(keyed(right, blocks, "first", F.col("parts").alias("other")), key)
        same = F.size(F.filter(F.zip_with("parts", "other", lambda x, y: x == y), lambda x: x))
        found = found.unionByName(near.where(same / F.col("n") > least).select("url", "page_type", "first"))
    best = found.groupBy("url", "page_type").agg(F.min("first").alias("first"))
    pages = stored.select(F.struct("ordinal", F.col("url").alias("stored_url")).alias("first"), "page_type", "selectors")
    pages = pages.join(best.select("first", "page_type").distinct(), ["first", "page_type"], "left_semi").groupBy("first", "page_type").agg(F.first("selectors").alias("selectors"))
    told = best.join(pages, ["first", "page_type"]).select("url", "page_type", "selectors")
    none = F.create_map().cast("map<string,string>")
    return urls.select("url", "page_type").join(told, ["url", "page_type"], "left").withColumn("selectors", F.coalesce("selectors", none))


def discover_site(edges: DataFrame, root: str, max_pages: int = 50) -> DataFrame:
    """url, wave, place: pages in breadth-first order over links (src, dst), ``max_pages`` at most.

    Within a wave pages come by the place of the page that links to them, then by URL.
    """
    spark = edges.sparkSession
    links = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(root, 0, 1)], "url string, wave int, place int")
    wave, n, last = 0, 1, seen
    while n < max_pages:
        wave += 1
        new = links.join(F.broadcast(last.select(F.col("url").alias("src"), "place")), "src")  # max_pages rows at most
        new = new.groupBy(F.col("dst").alias("url")).agg(F.min("place").alias("from")).join(F.broadcast(seen.select("url")), "url", "left_anti")
        first = new.orderBy("from", "url").limit(max_pages - n)
        last = cut(first.select("url", F.lit(wave).alias("wave"), (F.row_number().over(Window.orderBy("from", "url")) + n).cast("int").alias("place")))
        found = last.count()
        if not found:
            break
        seen, n = seen.union(last), n + found
    return seen
