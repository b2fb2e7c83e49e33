"""Operator 5: embedding near-dedup by spherical-cap filters.

Filter directions form a structured random product code: after a random rotation a vector falls
into two blocks, each with its own random code words, and every pair of code words is a filter.
List decoding finds all filters whose direction a vector exceeds by a bound, without holding the
filters themselves. Vectors that share a label and a filter meet in a bucket and are verified.

Equal vectors are one class. Buckets are cut into tiles, and a tile counts links and joins
components on its own; it gives a row for each vector, never for each pair. A pair that meets in
several buckets counts in that of its least common filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, cut


class Code:
    """The product code for vectors of one dimension."""

    def __init__(self, dim: int, words: int, mean: int, least: int):
        rng = np.random.default_rng(64 * 1009 + dim)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.half, self.words, self.least = (dim + 1) // 2, words, least
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        self.left = unit(rng.normal(size=(words, self.half)))
        self.right = unit(rng.normal(size=(words, dim - self.half))) if dim > 1 else np.zeros((1, 0))
        # The bound that a random direction exceeds for ``mean`` filters: the median of their ``mean``-th best sums.
        a, b = (np.sort(x, axis=1)[:, ::-1][:, :mean] for x in self.scores(unit(rng.normal(size=(256, dim)))))
        sums = np.sort((a[:, :, None] + b[:, None, :]).reshape(len(a), -1), axis=1)
        self.bound = float(np.median(sums[:, -min(mean, sums.shape[1])]))

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.rotation
        return y[:, : self.half] @ self.left.T, y[:, self.half :] @ self.right.T

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Ascending numbers of the filters that each unit vector exceeds; its best ones if they are fewer than ``least``."""
        a, b = self.scores(x)
        out = []
        for p, q in zip(a, b, strict=True):
            # Only code words that reach the bound with the best of the other block.
            i, j = np.flatnonzero(p + q.max() >= self.bound), np.flatnonzero(q + p.max() >= self.bound)
            u, v = np.nonzero(p[i][:, None] + q[j] >= self.bound)
            found = i[u] * len(q) + j[v]
            if len(found) < self.least:
                k = min(self.least, len(p))
                i, j = np.argsort(-p)[:k], np.argsort(-q)[:k]  # the best k sums lie among the best k of each
                total = (p[i][:, None] + q[j]).ravel()
                top = np.argsort(-total)[: self.least]
                found = (i[:, None] * len(q) + j).ravel()[top]
            out.append(np.sort(found).astype(np.int32))
        return out


def _linked(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Whether rows of x and y have cosine >= bound in double precision; doubtful ones by the plain formula."""
    g = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    hit = g >= bound
    for i, j in np.argwhere(np.abs(g - bound) < 1e-12):
        hit[i, j] = x[i] @ y[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(y[j] @ y[j])) >= bound
    return hit


def _earlier(lists: list[np.ndarray], others: list[np.ndarray], own: int) -> np.ndarray:
    """Whether two vectors share a filter before ``own``: then their pair counts there."""
    first = [f[f < own] for f in lists]
    second = [f[f < own] for f in others]
    numbers = np.intersect1d(np.concatenate(first), np.concatenate(second))
    if not len(numbers):
        return np.zeros((len(lists), len(others)), bool)
    a, b = np.zeros((len(lists), len(numbers)), "f4"), np.zeros((len(others), len(numbers)), "f4")
    for m, rows in ((a, first), (b, second)):
        for i, f in enumerate(rows):
            at = np.searchsorted(numbers, f)
            at[at == len(numbers)] = 0
            m[i, at[numbers[at] == f]] = 1
    return a @ b.T > 0


def _forest(hit: np.ndarray) -> np.ndarray:
    """For rows of a symmetric link matrix the least row that each one reaches."""
    label = np.arange(len(hit))
    while True:
        least = np.minimum(label, np.where(hit, label[None, :], len(hit)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, mean: int = 12, least: int = 8, tile: int = 1024, words: int | None = None) -> DataFrame:
    """Links and components of vectors with equal labels and cosine >= ``cosine`` in double precision.

    A vector exceeds about ``mean`` of the filters, and takes its ``least`` best if they are fewer. A
    block has so many code ``words`` that a filter holds some 64 of the distinct vectors, 128 at least:
    with the number of vectors only buckets grow in number, not in size. Of pairs at exactly 0.93 more
    than 0.93 share a filter, of those at 0.96 more than 0.98; the tests measure both.

    Rows, one for each row of ``vectors``: the id, n_links (other rows linked directly), component_id
    (smallest id reachable, itself included), kept (id = component_id). Null labels, and vectors that
    are null, empty, zero, or hold null or non-finite components, link with nothing; so do vectors of
    different lengths. Every row counts as a vector of its own, repeated ones too; rows that share
    an id are one node of the graph. Null ids: component_id and kept are null, and the row is left out
    of the links. Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda v: v != 0)
    keys = rows.withColumn("k1", F.when(usable, F.xxhash64("label", "vec"))).withColumn("k2", F.when(usable, F.hash("vec")))
    classes = keys.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("a"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = cut(classes)
    words = words or max(128, math.ceil(math.sqrt(classes.count() * mean / 64)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                vecs = [np.asarray(v, float) for v in batch.column(2).to_pylist()]
                found: list = [None] * len(vecs)
                for dim in {len(v) for v in vecs}:
                    at = [i for i, v in enumerate(vecs) if len(v) == dim]
                    if dim not in codes:
                        codes[dim] = Code(dim, words, mean, least)
                    x = np.array([vecs[i] for i in at])
                    x /= np.abs(x).max(1, keepdims=True)
                    for i, f in zip(at, codes[dim].decode(x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True):
                        found[i] = f
                idx = pa.array(np.repeat(np.arange(len(vecs)), [len(f) for f in found]), pa.int64())
                narrow = [v.astype("f4") for v in vecs]
                raw = pa.array([(n if (n == v).all() else v).tobytes() for n, v in zip(narrow, vecs, strict=True)], pa.binary())
                dims = pa.array([len(v) for v in vecs], pa.int32())
                lists = pa.array([f.tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(idx), dims.take(idx), pa.array(np.concatenate(found) if found else [], pa.int32()), batch.column(1).take(idx), batch.column(3).take(idx), raw.take(idx), lists.take(idx)], ["label", "dim", "filter", "a", "size", "raw", "filters"])

    kind = vectors.schema[label_col].dataType.simpleString()
    met = classes.select("label", "a", "vec", "size").mapInArrow(decode, f"label {kind}, dim int, filter int, a long, size long, raw binary, filters binary")
    bucket = ["label", "dim", "filter"]
    large = met.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    large = cut(large)  # a row for ``tile`` rows of buckets at most
    large = F.broadcast(large) if large.count() <= 200_000 else large  # some 6 MB; more are shuffled
    dealt = met.join(large, bucket, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"lo": F.least("t", "o"), "hi": F.greatest("t", "o")})
    dealt = dealt.repartition(*bucket, "lo", "hi").sortWithinPartitions(*bucket, "lo", "hi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple, group: list[tuple]) -> tuple[list, list, list]:
            if len(group) < 2:
                return [], [], []
            dim, own, lo, hi = key[1:5]
            x = np.array([np.frombuffer(r[2], "f8" if len(r[2]) == 8 * dim else "f4").astype(float) for r in group])
            lists = [np.frombuffer(r[3], np.int32) for r in group]
            a, size, t = (np.array([r[k] for r in group]) for k in (0, 1, 4))
            one, two = (np.arange(len(group)),) * 2 if lo == hi else (np.flatnonzero(t == lo), np.flatnonzero(t == hi))
            if not len(one) or not len(two):
                return [], [], []
            hit = _linked(x[one], x[two], cosine)
            if lo == hi:
                np.fill_diagonal(hit, False)
            p, q = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if not len(p):
                return [], [], []
            hit, one, two = hit[np.ix_(p, q)], one[p], two[q]
            mine = hit & ~_earlier([lists[i] for i in one], [lists[i] for i in two], own)
            n = np.zeros(len(group), np.int64)
            n[one] += mine @ size[two]
            if lo != hi:
                n[two] += mine.T @ size[one]
            both = np.unique(np.concatenate([one, two]))
            m = np.zeros((len(both), len(both)), bool)
            m[np.ix_(np.searchsorted(both, one), np.searchsorted(both, two))] = hit
            reach = _forest(m | m.T)
            return a[both].tolist(), n[both].tolist(), a[both][reach].tolist()

        key, group = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: tuple[list, list, list] = ([], [], [])
            for row in zip(*columns, strict=True):
                if row[:5] != key:
                    for o, v in zip(out, links(key, group) if group else ((), (), ()), strict=True):
                        o.extend(v)
                    key, group = row[:5], []
                group.append(row[5:])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "n", "b"])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in links(key, group)], ["a", "n", "b"])

    found = cut(dealt.select(*bucket, "lo", "hi", "a", "size", "raw", "filters", "t").mapInArrow(verify, "a long, n long, b long"))
    label = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    told = classes.select("k1", "k2", "a", "size").join(counts, "a", "left").join(label.withColumnRenamed("node", "a"), "a", "left")
    told = told.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "a").alias("component"))
    out = keys.select("id", "k1", "k2").join(told, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
