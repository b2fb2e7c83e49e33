"""Files in and out: seed configuration, training sets, patterns, checkpoints, models, metrics."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEED = (
    "domains array<struct<id:string,name:string,description:string,keywords:array<string>>>, "
    "experts array<struct<name:string,bio:string,expertise:array<string>,profile_url:string,avatar_url:string>>, "
    "expert_domains array<struct<expert_id:long,domain_id:string,confidence_score:double>>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scores(words: F.Column) -> F.Column:
    """A list of words as a map of words to 1.0; the first of equal words counts."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.lit(1.0))))


def seed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """domains, experts and expert_domain of a JSON seed file; experts are numbered in file order. A missing file gives empty tables."""
    df = spark.read.schema(_SEED).json(path, multiLine=True) if _exists(spark, path) else spark.createDataFrame([], _SEED)
    domains = df.select(F.inline("domains")).withColumns({"keywords": scores(F.col("keywords")), "auto_detected": F.lit(False), "confidence": F.lit(1.0)})
    experts = df.select(F.posexplode("experts").alias("n", "e")).select((F.col("n") + 1).cast("long").alias("id"), "e.*")
    experts = experts.withColumns({"expertise": scores(F.col("expertise")), "rating": F.lit(0.0), "answers_count": F.lit(0)})
    links = df.select(F.inline("expert_domains")).withColumn("confidence_score", F.coalesce("confidence_score", F.lit(0.8)))
    return {"domains": domains, "experts": experts, "expert_domain": links}


def domain_training(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """text, domains of a JSON training file, domains that are not ``known`` left out."""
    df = spark.read.schema("text string, domains array<string>").json(path, multiLine=True)
    return df.select("text", F.filter("domains", lambda d: d.isin(*known)).alias("domains"))


def type_training(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """text, content_type; a type that is not ``known`` is other."""
    df = spark.read.schema("text string, content_type string").json(path, multiLine=True)
    return df.select("text", F.when(F.col("content_type").isin(*known), F.col("content_type")).otherwise("other").alias("content_type"))


def _picks(words: list[str], n: F.Column, seed: int) -> F.Column:
    """``n`` of the words, in an order that follows from the row's id and the seed."""
    listed = F.array(*[F.lit(w) for w in words])
    ranked = F.array_sort(F.transform(listed, lambda w: F.struct(F.xxhash64("id", F.lit(seed), w).alias("h"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda s: s["w"]), 1, F.least(n, F.lit(len(words))))


def _draw(seed: int, salt: int, low: int, high: int) -> F.Column:
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(high - low)) + low).cast("int")


def synthetic_types(spark: SparkSession, n: int, keywords: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """id, text, content_type: three to seven sentences around keywords of a type; a fixed sentence for other."""
    # The sentences, with the keyword in braces.
    forms = {"question": "{} مربوط به موضوع حقوقی چیست؟", "answer": "{} در این مورد حقوقی قابل استناد است.", "article": "در این مقاله به بررسی {} می‌پردازیم.", "profile": "{} از ویژگی‌های تخصصی این وکیل است."}
    other = "این یک متن عمومی است که هیچ ویژگی خاصی ندارد."
    kinds = [*keywords, "other"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), _draw(seed, 1, 1, len(kinds) + 1))
    text = F.lit(other)
    for k, words in keywords.items():
        before, after = forms.get(k, "{}").split("{}")
        said = F.concat(F.lit(before), F.array_join(_picks(words, _draw(seed, 2, 3, 8), seed), f"{after} {before}"), F.lit(after))
        text = F.when(kind == k, said).otherwise(text)
    return spark.range(n).select("id", text.alias("text"), kind.alias("content_type"))


def synthetic_domains(spark: SparkSession, n: int, keywords: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """id, text, domains: three to nine keywords of each of one to three domains."""
    chosen = _picks(list(keywords), _draw(seed, 3, 1, 4), seed)
    parts = [F.when(F.array_contains("domains", k), F.array_join(_picks(w, _draw(seed, 4, 3, 10), seed + i), " ")) for i, (k, w) in enumerate(keywords.items())]
    return spark.range(n).withColumn("domains", chosen).select("id", F.concat_ws(" ", *parts).alias("text"), "domains")


def save_rows(df: DataFrame, path: str) -> None:
    """Patterns, selectors, metrics or state as JSON lines, over what was there."""
    df.write.mode("overwrite").json(path)


def load_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`save_rows` wrote; a missing path gives no rows."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


PATTERN = "pattern string, is_list boolean, is_detail boolean, sample_urls array<string>, weight double, url_count long"


def packed_patterns(patterns: DataFrame, host: str) -> DataFrame:
    """All patterns of a host as one row of ``domains``: id domain_<host>, patterns as JSON text under one keyword."""
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(*patterns.columns))))
    return patterns.agg(rows.alias("patterns")).select(F.lit(f"domain_{host.replace('.', '_')}").alias("id"), F.lit(host).alias("name"), "patterns")


def unpacked_patterns(packed: DataFrame) -> DataFrame:
    return packed.select(F.inline(F.from_json("patterns", f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in PATTERN.split(', '))}>>")))


def save_checkpoint(state: dict[str, DataFrame], path: str) -> None:
    """Crawl state (visited, failed, stats, ...) as Parquet tables under one path, over what was there."""
    for name, df in state.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_checkpoint(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if _exists(spark, f"{path}/{n}")}


def save_model(model: PipelineModel, path: str, **about: object) -> None:
    """A fitted pipeline, and a row about it (labels, parameters, time) beside it."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    row = {k: str(v) for k, v in about.items()}
    spark.createDataFrame([(row,)], "about map<string,string>").withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/about")


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The newest path in ``folder`` whose name starts with ``prefix``, by modification time."""
    if not _exists(spark, folder):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return max((x for x in found if PurePosixPath(x[1]).name.startswith(prefix)), default=(0, None))[1]


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
