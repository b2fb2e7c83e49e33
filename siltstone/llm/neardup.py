"""Operator 10: near-duplicate documents by one-permutation MinHash.

One hash of each shingle serves all bins: the bin is its leading part, the bin's value its least.
Empty bins borrow from the first filled bin of their own fixed random order (optimal
densification). Bands of bins make buckets; texts with equal sets are one class from the start.

Candidate edges are stars: every member of a bucket is held against its hub, the member that shares
most buckets, never all members against each other. Where a bucket still holds several components,
a task reads the texts of all its members, or of two parts of it, and holds those of different
components against each other through an index of their shingles. It returns which components it
joins, so that no pair of a bucket in different components is untested and no pair becomes a row.
Links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, cut, hot_keys, release, spread_join

_MASK = (1 << 64) - 1


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles. Word hashes are kept, ``cached`` at most."""

    def __init__(self, width: int = 5, cached: int = 150_000):
        from xxhash import xxh3_64_intdigest

        self.width, self.cached, self.hash, self.known = width, cached, xxh3_64_intdigest, {}
        rng = np.random.default_rng(20240229)
        self.weights = rng.integers(1, _MASK, width, np.uint64, endpoint=True) | np.uint64(1)

    def words(self, text: str | None) -> list[bytes]:
        """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
        return text.encode("utf-8", "surrogatepass").lower().split() if text else []

    def of(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.cached:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        total = np.full(n, len(h) if len(h) < self.width else self.width, np.uint64)
        for i in range(min(self.width, len(h))):
            x = h[i : i + n] * self.weights[i]
            total += x ^ (x >> np.uint64(29))
        return np.unique(mixed(total))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Bander:
    """Band keys of a set: ``bands`` of ``rows`` bins each."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(19950417)
        order = np.argsort(rng.random((self.bins, self.bins)), axis=1)  # every bin's own order of all bins
        self.rank = np.empty_like(order, dtype=np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.bins, dtype=np.int32)[None, :], axis=1)
        self.weights = rng.integers(1, _MASK, rows, np.uint64, endpoint=True) | np.uint64(1)
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)  # grows with the hash
        first = np.flatnonzero(np.diff(at, prepend=-1))
        filled, value = at[first], np.empty(self.bins, np.uint64)
        value[filled] = hashes[first]
        if len(filled) < self.bins:
            gaps = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            value[gaps] = value[filled[self.rank[np.ix_(gaps, filled)].argmin(1)]]
        return mixed((value.reshape(self.bands, self.rows) * self.weights).sum(1) ^ self.salt)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, text_hash, n_shingles, h1, h2 (a 128-bit hash of the set), keys (of all bands; none for the empty set)."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bander = Shingler(width), Bander(bands, rows)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, max(1, whole.num_rows), 1000)):
            n, own, keys = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingler.of(text)
                n.append(len(s))
                own.append(np.frombuffer(xxh3_128_digest(s.tobytes()), "<i8"))
                keys.append(bander.keys(s).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "text_hash", "n_shingles", "h1", "h2", "keys"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "id long, text_hash long, n_shingles long, h1 long, h2 long, keys array<long>")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def confirm(edges: DataFrame, texts: DataFrame, width: int, num: int, den: int, chunk: int = 64) -> DataFrame:
    """Those ``edges`` (a, hub) with den * intersection >= num * union of full shingle sets.

    A hub's members are dealt in chunks, each with the hub's text; a task reads a chunk at a time
    in order and holds one set, so a hub of any degree spreads over tasks.
    """
    degree = edges.groupBy("hub").agg(F.count("*").alias("n"))
    dealt = edges.join(degree, "hub").select("a", "hub", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / chunk)).alias("part"))
    members = dealt.select(F.col("a").alias("id"), "hub", "part", F.lit(1).alias("role"))
    hubs = dealt.select(F.col("hub").alias("id"), "hub", "part", F.lit(0).alias("role")).distinct()
    rows = members.union(hubs).join(texts, "id").select("hub", "part", "role", "id", "text")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, own, at = Shingler(width), np.empty(0, np.uint64), None
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, max(1, whole.num_rows), 1000)):
            found: tuple[list, list] = [], []
            hub, part, role, node, text = (c.to_pylist() for c in batch.columns)
            for h, p, r, i, t in zip(hub, part, role, node, text, strict=True):
                s = shingler.of(t)
                if not r:
                    own, at = s, (h, p)
                elif at == (h, p) and len(s):
                    where = np.searchsorted(own, s)
                    where[where == len(own)] = 0
                    both = int((own[where] == s).sum())
                    if den * both >= num * (len(own) + len(s) - both):
                        found[0].append(i)
                        found[1].append(h)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "hub"])

    return rows.mapInArrow(run, "a long, hub long").distinct()


def joined(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, own: bool, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of components that links between ``sets`` join, no more than it takes.

    Sets of side 0 are held against those of side 1, and if ``own`` against each other; sets of one
    component never. Each is counted against all at once, by the lists of sets that hold its shingles.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    many = np.bincount(at)
    begin, ends, root = np.cumsum(many) - many, np.cumsum(sizes), component.copy()
    for a in np.flatnonzero(side == 0):
        open_ = (root != root[a]) & (num * np.maximum(sizes, sizes[a]) <= den * np.minimum(sizes, sizes[a]))
        open_[:a] &= side[:a] == 1
        if not own:
            open_ &= side == 1
        if not open_.any():
            continue
        held = at[ends[a] - sizes[a] : ends[a]]
        n = many[held]
        both = np.bincount(holders[np.repeat(begin[held] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for b in np.flatnonzero(open_ & (den * both >= num * (sizes[a] + sizes - both))):
            if root[b] != root[a]:
                yield int(component[a]), int(component[b])
                root[root == root[b]] = root[a]


def joins(known: DataFrame, texts: DataFrame, width: int, num: int, den: int, chunk: int = 1 << 18) -> DataFrame:
    """Pairs (a, b) of components that links within buckets join: ``known`` has members of buckets (key, a, n, component).

    Of a bucket with several components, the largest is its major one, all other members are minor.
    Both are dealt in parts of some ``chunk`` shingles, and each minor part meets every other part; of
    buckets with the same members one is read. So a task holds two parts, and a major component is never
    held against itself.
    """
    marks = [F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")]
    each = known.select("key", "n", "component", F.xxhash64("a").alias("x"), F.xxhash64("a", F.lit(1)).alias("y")).groupBy("key", "component").agg(F.sum("n").alias("n"), *marks)
    several = each.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), *marks).where("many > 1")
    parts = [F.ceil((F.col("n") - F.col("top.n")) / chunk).cast("int").alias("minor"), F.ceil(F.col("top.n") / chunk).cast("int").alias("major")]
    several = several.groupBy("x", "y").agg(F.min(F.struct("key", F.col("top.component").alias("top"), *parts)).alias("s")).select("s.*")
    is_top, part = F.col("component") == F.col("top"), F.xxhash64("a")
    dealt = known.join(several, "key").withColumn("part", F.when(is_top, F.col("minor") + F.pmod(part, "major")).otherwise(F.pmod(part, "minor")).cast("int"))
    others = F.sequence(F.lit(0), F.when(is_top, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    dealt = dealt.select("key", "a", "component", "part", "minor", F.explode(F.array_remove(others, F.col("part"))).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "minor", "a", "component", (F.col("part") > F.col("other")).cast("int").alias("side"))
    rows = dealt.join(texts.withColumnRenamed("id", "a"), "a").select("key", "lo", "hi", "minor", "side", "component", "text")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, group, sets, told = Shingler(width), None, [], []

        def ended() -> pa.RecordBatch:
            component, side = (np.array(x, np.int64) for x in zip(*told, strict=True))
            found = list(joined(sets, component, side, group[2] == group[3], num, den))  # a minor part meets itself where it meets the first major one
            sets.clear()
            told.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            *at, side, component, text = (c.to_pylist() for c in batch.columns)
            for g, r, c, t in zip(zip(*at, strict=True), side, component, text, strict=True):
                if g != group and sets:
                    yield ended()
                group = g
                sets.append(shingler.of(t))
                told.append((c, r))
        if sets:
            yield ended()

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, width: int = 5, bands: int = 50, rows: int = 7, more: int = 6) -> DataFrame:
    """Components of documents linked by ``den`` * intersection >= ``num`` * union of their shingle sets.

    A set holds the distinct shingles of ``width`` words; a text with fewer words is one shingle.
    Null or blank texts have an empty set and link with nothing. Bands of 50 x 7 let a pair at 0.75
    meet with 0.9992, in seven buckets on average; more alike pairs meet more often. Of pairs that meet,
    all that would join two components are tested: a bucket of m texts of which none are linked costs m * m / 2 tests.
    ``more`` (further bands, before buckets were tested whole) is accepted and has no effect.

    Rows, one for each row of ``docs``: the id, n_shingles, component_id (smallest id reachable,
    itself included), kept (id = component_id), text_hash (xxhash64 of the text). Rows with equal sets are linked, repeated
    rows too. Rows that share an id but not a set are texts of their own; of those of one component that have
    its id, one text is kept. Null ids come last: component_id is null where no id is reachable, and
    then one text of the component is kept. Rows with an empty set are all kept. Other columns are ignored.
    """
    sig = cut(signatures(docs, id_col, text_col, width, bands, rows))
    full = sig.where("n_shingles > 0")
    # A node is an id; a hash where an id is null or has several sets.
    several = cut(full.where("id IS NOT NULL").groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("id"))
    plain = several.isEmpty()
    odd = F.col("id").isNull() if plain else F.col("id").isNull() | F.col("_odd").isNotNull()
    with_odd = lambda df: df if plain else df.join(several.withColumn("_odd", F.lit(True)), "id", "left")
    named = lambda df: with_odd(df).withColumn("node", F.when(odd, F.xxhash64("id", "h1", "h2")).otherwise(F.col("id"))).drop("_odd")
    full = named(full)
    last = F.coalesce("id", F.lit(2**63 - 1))
    classes = cut(full.groupBy("h1", "h2").agg(F.min("node").alias("a"), F.min(F.struct(last.alias("id"), "text_hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))
    # Members of buckets by key: one exchange serves the count and the members.
    dealt = classes.select("a", "n", F.explode("keys").alias("key")).repartition("key")
    shared = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(dealt.join(shared, "key").select("key", "a", "n"))
    met = members.groupBy("a").agg(F.count("*").alias("met"))  # the more buckets it shares, the likelier a centre
    members = cut(members.join(met, "a"))
    own = with_odd(texts_of(docs, id_col, text_col))
    met_ids = met.select(F.col("a").alias("id"))
    nodes = cut(full.where(odd if plain else F.col("id").isNull() | (F.col("node") != F.col("id"))).select("id", "text_hash", "node").distinct())
    if nodes.isEmpty():
        texts = own.select("id", "text").join(met_ids, "id")
    else:
        rare = own.where(odd).join(nodes.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")) & (own["text_hash"] == nodes["text_hash"])).select(F.col("node").alias("id"), "text")
        texts = own.where(~odd).select("id", "text").join(met_ids, "id").union(rare.join(met_ids, "id"))
    texts = cut(texts)

    close = (F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num) & (F.col("a") != F.col("hub"))
    hub = F.max(F.struct("met", F.bitwise_not("a").alias("minus"), "n")).alias("h")
    ends = [F.greatest("a", "hub").alias("a"), F.least("a", "hub").alias("hub")]
    hubs = members.groupBy("key").agg(hub).select("key", F.bitwise_not(F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))
    stars = cut(members.join(hubs, "key").where(close).select(*ends).distinct())
    links = cut(confirm(stars, texts, width, num, den))
    label = components(links, "a", "hub")

    release(docs.sparkSession)

    # Buckets that still hold several components: which of these are one.
    labelled = label.select(F.col("node").alias("a"), "component")
    known = cut(members.drop("met").join(labelled, "a", "left").withColumn("component", F.coalesce("component", "a")))
    whole = components(cut(joins(known, texts, width, num, den))).select(F.col("node").alias("component"), F.col("component").alias("whole"))

    told = classes.select("h1", "h2", "a", "first").join(labelled, "a", "left")
    told = cut(told.select("h1", "h2", "first", F.coalesce("component", "a").alias("component")))
    least = cut(told.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")).join(whole, "component", "left").withColumn("whole", F.coalesce("whole", "component")))
    hot = hot_keys(least, ["component"], "n", told.count())
    of_whole = cut(least.groupBy("whole").agg(F.min("least").alias("least"), F.count("*").alias("n")))
    least = spread_join(least.select("component", "whole"), of_whole.drop("n"), ["whole"], hot_keys(of_whole, ["whole"], "n", least.count()), F.col("component")).drop("whole")
    told = spread_join(told.drop("first"), least, ["component"], hot, F.col("h1"))
    size = sig.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    hot = hot_keys(cut(size), ["h1", "h2"], "n", sig.count())
    out = spread_join(sig.drop("keys"), told.select("h1", "h2", "least"), ["h1", "h2"], hot, F.struct("id", "text_hash"), "left")
    empty = F.col("n_shingles") == 0
    component = F.when(empty, F.col("id")).when(F.col("least.id") < 2**63 - 1, F.col("least.id"))
    kept = empty | ((last == F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash")))
    # Of several texts with the component's id and one set, the one with the least hash; with one text an id, those are all rows with that id.
    return out.select(F.col("id").alias(id_col), "n_shingles", component.cast("long").alias("component_id"), kept.alias("kept"), "text_hash")
