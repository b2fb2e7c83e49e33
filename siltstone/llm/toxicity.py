"""Operator 7: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, labels unread, is the unlabelled
side. With the class prior pi, the risk pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)]) estimates the
risk over true labels without a single negative label; where its second part turns negative, the
step goes up that part instead (the non-negative correction). Linear classifiers in numpy, a few
over parts of the unlabelled sample, score by their mean.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, words_of


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-3, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk with logistic loss, by Adam on the whole sample."""
    p, u = (np.hstack([x, np.ones((len(x), 1), "f4")]).astype("f8") for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        loss_plus = -_sigmoid(-zp) @ p / len(p)  # gradient of E_P[l(+)]
        negative = _sigmoid(zu) @ u / len(u) - prior * (_sigmoid(zp) @ p / len(p))
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = prior * loss_plus + negative if risk >= -beta else -negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Word weights by classifier; a text's score is the mean over classifiers of the sigmoid of bias and its words' weights."""

    rows: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray

    def score(self, text: str | None) -> float:
        found = [self.rows[w] for w in self.rows.keys() & set(words_of(text))]
        return float(_sigmoid(self.weights[found].sum(0) + self.bias).mean())


def fit(docs: DataFrame, labels: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", positives: int = 6000, unlabelled: int = 12000, features: int = 512, least_z: float = 5.0, prior: float | None = None, parts: int = 3) -> Model:
    """Fits on about ``positives`` toxic and ``unlabelled`` other texts at most, drawn by hashes of the ids: the documented bound.

    ``labels`` has the id and ``toxic`` (1 or 0); an id with several labels counts as toxic if one says
    so. ``trained`` is a condition on the id. The prior is the share of toxic ids among labelled
    ones unless given. Features are the ``features`` words whose presence differs most between the
    drawn toxic texts and all training texts, by at least ``least_z`` standard errors; presence is
    counted over every training text. Texts are never shuffled: the drawn toxic ids are broadcast.
    """
    told = labels.where(trained).groupBy(id_col).agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    labelled, hot = told.agg(F.count("*"), F.sum("toxic")).first()
    rows = docs.where(trained)
    n = rows.count()
    if not hot or not n:
        return Model({}, np.zeros((0, 1)), np.array([np.log(prior / (1 - prior)) if prior else -30.0]))
    prior = prior if prior is not None else min(max(hot / labelled, 0.5 / labelled), 0.95)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1_000_000))
    part = lambda most, of: min(1_000_000, 1_000_000 * most // max(of, 1) + 1)
    chosen = told.where((F.col("toxic") == 1) & (draw < part(positives, hot))).select(id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    sample = rows.join(F.broadcast(chosen), id_col).select(text, F.lit(1).alias("side"))  # some ``positives`` ids
    sample = cut(sample.union(rows.where(draw < part(unlabelled, n)).select(text, F.lit(0).alias("side"))))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                n.update(set(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    sizes = {r[0]: r[1] for r in sample.groupBy("side").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model({}, np.zeros((0, 1)), np.array([np.log(prior / (1 - prior))]))
    counted = lambda texts: texts.select("text").mapInArrow(present, "word binary, n long")
    in_p = counted(sample.where("side = 1")).select("word", F.col("n").alias("p"), F.lit(0).cast("long").alias("u"))
    in_u = counted(rows.select(text)).select("word", F.lit(0).cast("long").alias("p"), F.col("n").alias("u"))
    df = in_p.union(in_u).groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u")) / (n_p + n)
    z = (F.col("p") / n_p - F.col("u") / n) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n) + 1e-12)
    top = df.where(F.col("p") + F.col("u") >= 5).withColumn("z", F.abs(z)).where(F.col("z") >= least_z).orderBy(F.col("z").desc(), "word").limit(features)
    rows_of = {bytes(r[0]): i for i, r in enumerate(top.select("word").collect())}
    if not rows_of:
        return Model({}, np.zeros((0, 1)), np.array([np.log(prior / (1 - prior))]))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sides = batch.column(0).to_pylist(), batch.column(1)
            found = [sorted(rows_of[w] for w in rows_of.keys() & set(words_of(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([sides, pa.array([hash_of(t) for t in texts], pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["side", "part", "at"])

    hash_of = lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")) % parts
    told = sample.mapInArrow(featurise, "side int, part int, at array<int>").collect()
    told.sort(key=lambda r: (r.side, r.part, r.at))
    dense = np.zeros((len(told), len(rows_of)), "f4")
    for i, r in enumerate(told):
        dense[i, r.at] = 1
    side, group = np.array([r.side for r in told]), np.array([r.part for r in told])
    fits = []
    for k in range(parts):
        u = dense[(side == 0) & (group == k)]
        fits.append(nnpu(dense[side == 1], u if len(u) else dense[side == 0], prior))
    return Model(rows_of, np.stack([f[0] for f in fits], 1), np.array([f[1] for f in fits]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score (0 to 1) and predicted (1 if score >= 0.5) of every whole text.

    One row for each row of ``docs``; null texts score as empty ones; repeated rows repeat; null ids
    stay null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [id_col, "score", "predicted"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
