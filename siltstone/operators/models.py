"""Classification of texts: splits, training, prediction, evaluation curves and reports."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as X
from siltstone.functions.lexicon import CONTENT_TYPES, DOMAINS, LAW_WORDS, QUESTION_WORDS
from siltstone.operators.features import class_weights, with_keyword_scores
from siltstone.plans.lineage import cut


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``y``: the label's place among all labels in alphabetical order."""
    names = rows.select(label).distinct().withColumn("y", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("double"))  # one row a label
    return rows.join(F.broadcast(names), label)


def multi_hot(rows: DataFrame, labels: str, names: list[str]) -> DataFrame:
    """One 0/1 column for each name, alphabetically."""
    return rows.withColumns({f"y_{n}": F.array_contains(labels, n).cast("int") for n in sorted(names)})


def split(rows: DataFrame, key: str, label: str | None = None, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the same share of each label (or of all), drawn by md5 of the key and the seed."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    if label is None:  # by value: no global sort
        return rows.withColumn("is_test", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < test * 2.0**32)
    w = Window.partitionBy(label)
    return rows.withColumn("is_test", F.row_number().over(w.orderBy(digest, key)) <= F.round(F.count("*").over(w) * test))


def estimator(kind: str = "linear", **grid: object) -> Estimator:
    """svm, logistic or forest (100 trees)."""
    made = {"svm": lambda: LinearSVC(featuresCol="features", labelCol="y", weightCol="weight"), "logistic": lambda: LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight"), "forest": lambda: RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", numTrees=100, seed=42)}
    out = made["svm" if kind == "linear" else kind]()
    for name, value in grid.items():
        out.set(out.getParam(name), value)
    return out


def text_stages(size: int = 10_000, least: int = 2, most: float = 0.95) -> list:
    """words -> features, by the engine's own vectorizer, inverse frequencies and row lengths."""
    return [CountVectorizer(inputCol="words", outputCol="_tf", vocabSize=size, minDF=least, maxDF=most), IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="features")]


def weighted(rows: DataFrame, label: str = "y") -> DataFrame:
    return rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label)  # one row a class


def train(rows: DataFrame, kind: str = "logistic", stages: list | None = None, **grid: object) -> PipelineModel:
    """Fits (words, y) with balanced class weights; one-vs-rest beyond two classes where the estimator needs it."""
    n = rows.select("y").distinct().count()
    est = estimator(kind, **grid)
    if n > 2 and kind in ("svm", "linear", "logistic"):
        est = OneVsRest(classifier=est, featuresCol="features", labelCol="y", weightCol="weight")
    return Pipeline(stages=[*(text_stages() if stages is None else stages), est]).fit(weighted(rows))


def train_domains(rows: DataFrame, names: list[str], kind: str = "logistic", stages: list | None = None) -> dict[str, PipelineModel]:
    """One binary model for each domain, as several may hold for a text."""
    return {n: train(rows.withColumn("y", F.col(f"y_{n}").cast("double")), kind, stages) for n in sorted(names)}


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(17)), F.lit(k)).cast("int"))


def grid_search(rows: DataFrame, key: str, kind: str, grid: dict[str, list], k: int = 3, score_folds: int = 5, stages: list | None = None) -> dict:
    """The grid point with the best mean macro F1 over ``k`` folds, its mean over ``score_folds``, and the model refitted on all."""

    def mean_f1(point: dict, n: int) -> float:
        dealt = folds(rows, key, n)
        scores = []
        for f in range(n):
            model = train(dealt.where(F.col("fold") != f), kind, stages, **point)
            told = model.transform(dealt.where(F.col("fold") == f)).select("y", F.col("prediction").alias("yhat"))
            scores.append(macro(told).first()["f1"] or 0.0)
        return sum(scores) / len(scores)

    points = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    ranked = sorted(((mean_f1(p, k), -i) for i, p in enumerate(points)), reverse=True)
    best = points[-ranked[0][1]]
    return {"params": best, "grid_f1": ranked[0][0], "cv_f1": mean_f1(best, score_folds), "model": train(rows, kind, stages, **best)}


def confusion(told: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """y, yhat, n and share (n over the true label's total)."""
    n = told.groupBy(y, yhat).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(y)))


def class_metrics(told: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """label, precision, recall, f1, support of every label seen; 0 for division by zero."""
    hit = told.select(F.explode(F.array(F.struct(F.col(y).alias("label"), F.lit(1).alias("real"), F.lit(0).alias("said"), (F.col(y) == F.col(yhat)).cast("int").alias("tp")), F.struct(F.col(yhat).alias("label"), F.lit(0).alias("real"), F.lit(1).alias("said"), F.lit(0).alias("tp")))).alias("r")).select("r.*")
    s = hit.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("real", "said", "tp")])
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("real") > 0, F.col("tp") / F.col("real")).otherwise(0.0)
    return s.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.col("real").alias("support"))


def macro(told: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """accuracy and macro precision, recall and f1, one row."""
    each = class_metrics(told, y, yhat).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return told.agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy")).crossJoin(each)  # one row each


def multi_label_metrics(told: DataFrame, names: list[str]) -> DataFrame:
    """Exact-match accuracy, and macro precision, recall and f1 over domains, of y_<name> against p_<name>."""
    exact = reduce(lambda a, b: a & b, [F.col(f"y_{n}") == F.col(f"p_{n}") for n in names])
    count = lambda c: F.sum(c.cast("int"))
    sums = told.agg(F.avg(exact.cast("double")).alias("accuracy"), *[e for n in names for e in (count((F.col(f"y_{n}") == 1) & (F.col(f"p_{n}") == 1)).alias(f"tp_{n}"), count(F.col(f"y_{n}") == 1).alias(f"r_{n}"), count(F.col(f"p_{n}") == 1).alias(f"s_{n}"))])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    ps, rs = [ratio(f"tp_{n}", f"s_{n}") for n in names], [ratio(f"tp_{n}", f"r_{n}") for n in names]
    fs = [F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0) for p, r in zip(ps, rs, strict=True)]
    mean = lambda c: reduce(lambda a, b: a + b, c) / len(c)
    return sums.select("accuracy", mean(ps).alias("precision"), mean(rs).alias("recall"), mean(fs).alias("f1"))


def _ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` in ranges by ``order``, kept so, with _range: the place of each row's range."""
    return cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def curve(told: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """score, tp, fp, tpr, fpr, precision at each distinct score from the top: points of ROC and precision-recall curves.

    Counts by score first; running sums go over ranges of scores, each from the sums of the ranges before.
    """
    each = _ranged(told.groupBy(score).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n")), F.desc(score))
    sums = each.groupBy("_range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    earlier, whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select("_range", before("p").alias("_tp"), before("n").alias("_fp"), F.sum("p").over(whole).alias("_p"), F.sum("n").over(whole).alias("_n"))
    run = Window.partitionBy("_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = each.join(F.broadcast(sums), "_range")  # one row a range
    out = out.select(score, "_p", "_n", (F.col("_tp") + F.sum("p").over(run)).alias("tp"), (F.col("_fp") + F.sum("n").over(run)).alias("fp"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(score, "tp", "fp", share("tp", "_p").alias("tpr"), share("fp", "_n").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def auc(points: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    """Area under a curve's points by trapezoids, from (0, 0); a range's first point follows the last of the range before."""
    rows = _ranged(points.select(F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("at")), F.col("at"))
    lasts = rows.groupBy("_range").agg(F.max("at").alias("last"))
    lasts = lasts.select("_range", F.lag("last").over(Window.orderBy("_range")).alias("_last"))  # one row a range
    w = Window.partitionBy("_range").orderBy("at")
    steps = rows.join(F.broadcast(lasts), "_range").select("at", F.coalesce(F.lag("at").over(w), F.col("_last")).alias("old"))
    dx, m = F.col("at.x") - F.coalesce("old.x", F.lit(0.0)), (F.col("at.y") + F.coalesce("old.y", F.lit(0.0))) / 2
    return steps.agg(F.sum(dx * m).alias("auc"))


def mean_precision(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("precision").alias("mean_precision"))


def learning_curve(rows: DataFrame, key: str, kind: str = "logistic", sizes: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), k: int = 3, stages: list | None = None) -> DataFrame:
    """size, mean and std of train and test accuracy over ``k`` folds, for each share of the training rows."""
    spark, out = rows.sparkSession, []
    dealt = folds(rows, key, k).withColumn("_u", F.pmod(F.xxhash64(key, F.lit(23)), F.lit(10_000)) / 10_000)
    for size in sizes:
        for f in range(k):
            part = dealt.where((F.col("fold") != f) & (F.col("_u") < size))
            model = train(part, kind, stages)
            acc = [model.transform(d).agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0] for d in (part, dealt.where(F.col("fold") == f))]
            out.append((float(size), *[float(a or 0.0) for a in acc]))
    df = spark.createDataFrame(out, "size double, train double, test double")
    return df.groupBy("size").agg(*[g(c).alias(f"{n}_{c}") for c in ("train", "test") for n, g in (("mean", F.avg), ("std", F.stddev_pop))])


def importances(model: PipelineModel, top: int = 20) -> DataFrame:
    """feature, importance of the fitted classifier: a forest's own, or the mean absolute coefficient."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        parts = [m.coefficients.toArray() for m in getattr(last, "models", [last])] if not hasattr(last, "coefficientMatrix") or hasattr(last, "models") else list(last.coefficientMatrix.toArray())
        values = sum(abs(p) for p in parts) / len(parts)
    words = next((s.vocabulary for s in model.stages if hasattr(s, "vocabulary")), None)
    ranked = sorted(((float(v), words[i] if words and i < len(words) else str(i)) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))[:top]
    return SparkSession.active().createDataFrame([(w, v) for v, w in ranked], "feature string, importance double")


def softmax(scores: Column) -> Column:
    """Probabilities of an array of decision scores, shifted by the largest."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sigmoid_pair(score: Column) -> Column:
    """[P(0), P(1)] of one decision score."""
    p = 1 / (1 + F.exp(-score))
    return F.array(1 - p, p)


def scores_of(column: str = "rawPrediction") -> Column:
    return vector_to_array(column)


def predict_types(model: PipelineModel, rows: DataFrame, labels: list[str]) -> DataFrame:
    """Adds content_type and probabilities (map) by the model."""
    out = model.transform(rows)
    names = F.array(*[F.lit(x) for x in labels])
    kind = F.element_at(names, F.col("prediction").cast("int") + 1)
    own = vector_to_array("probability") if "probability" in out.columns else softmax(vector_to_array("rawPrediction"))
    return out.withColumns({"content_type": kind, "probabilities": F.map_from_arrays(names, own)})


def predict_domains(models: dict[str, PipelineModel], rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds domains (names with probability over ``least``, best first, ties by name) and domain_probabilities (map)."""
    own = rows.columns
    for name, model in models.items():
        told = model.transform(rows)
        p = vector_to_array("probability")[1] if "probability" in told.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        rows = told.withColumn(f"_p_{name}", p).select(*own, *[f"_p_{n}" for n in models if f"_p_{n}" in told.columns or n == name])
    entries = F.array(*[F.struct((-F.col(f"_p_{n}")).alias("s"), F.lit(n).alias("n")) for n in models])
    chosen = F.transform(F.array_sort(F.filter(entries, lambda e: -e["s"] > least)), lambda e: e["n"])
    probabilities = F.map_from_arrays(F.array(*[F.lit(n) for n in models]), F.array(*[F.col(f"_p_{n}") for n in models]))
    return rows.withColumns({"domains": chosen, "domain_probabilities": probabilities}).select(*own, "domains", "domain_probabilities")


def rule_scores(docs: DataFrame, normal: Column, keywords: dict[str, list[str]], prefix: str) -> DataFrame:
    return with_keyword_scores(docs, normal, keywords, prefix)


def analysis(kind: Column, text: Column) -> Column:
    """What a question or an answer holds: a question mark, question words, words that cite the law."""
    return F.struct(
        F.when(kind == "question", F.contains(text, F.lit("؟"))).alias("has_question_mark"),
        F.when(kind == "question", X.found_words(F.lower(text), QUESTION_WORDS)).alias("question_indicators"),
        F.when(kind == "answer", X.found_words(text, LAW_WORDS)).alias("law_references"),
    )


def classify(docs: DataFrame, text: str = "text", latin: bool = False, types: dict[str, list[str]] | None = None, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """text_summary, content_type, type_probabilities, analysis, domains, domain_probabilities by rules, for use without a model.

    The type with the highest keyword score (other without a hit, ties by name); domains with a score, best first.
    """
    types, domains = types or CONTENT_TYPES, domains or DOMAINS
    rows = docs.withColumn("_n", X.normalize(F.col(text), latin))
    rows = with_keyword_scores(rows, F.col("_n"), types, "_t_")
    rows = with_keyword_scores(rows, F.col("_n"), domains, "_d_")
    ranked = lambda names, p: F.array_sort(F.filter(F.array(*[F.struct((-F.col(p + n)).alias("s"), F.lit(n).alias("n")) for n in names]), lambda e: e["s"] < 0))
    mapped = lambda names, p: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(p + n) for n in names]))
    kind = F.coalesce(F.get(ranked(types, "_t_"), F.lit(0))["n"], F.lit("other"))
    out = rows.withColumns({"text_summary": X.brief(F.col(text)), "content_type": kind, "type_probabilities": mapped(types, "_t_"), "domains": F.transform(ranked(domains, "_d_"), lambda e: e["n"]), "domain_probabilities": mapped(domains, "_d_")})
    out = out.withColumn("analysis", analysis(F.col("content_type"), F.col(text)))
    return out.drop("_n", *[f"_t_{n}" for n in types], *[f"_d_{n}" for n in domains])


def storage_type(kind: Column) -> Column:
    """The type that the store can hold: answers count as other."""
    return F.when(kind == "answer", "other").otherwise(kind)


def string_index(column: str, out: str) -> StringIndexer:
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")


def report(told: DataFrame) -> DataFrame:
    """The whole evaluation of predictions (y, yhat) in long form: part (class, all, confusion), name, measure, value."""
    classes = class_metrics(told).select(F.lit("class").alias("part"), F.col("label").cast("string").alias("name"), F.inline(_long(["precision", "recall", "f1", "support"])))
    overall = macro(told).select(F.lit("all").alias("part"), F.lit("").alias("name"), F.inline(_long(["accuracy", "precision", "recall", "f1"])))
    matrix = confusion(told).select(F.lit("confusion").alias("part"), F.concat_ws(">", "y", "yhat").alias("name"), F.lit("n").alias("measure"), F.col("n").cast("double").alias("value"))
    return classes.unionByName(overall).unionByName(matrix)


def _long(names: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])
