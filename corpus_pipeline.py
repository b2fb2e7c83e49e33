"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. What a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, mod_crc, small_batches, stored, table
from siltstone.llm.decontam import contamination
from siltstone.llm.languages import fit, predicted
from siltstone.llm.linededup import line_dedup
from siltstone.llm.neardup import near_duplicates
from siltstone.llm.packing import pack
from siltstone.session import ship

#: A document stays if at least this share of its letters is labelled with one language.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null ones too, and those of which no language labels ``LEAST_SHARE``."""
    ship(spark)
    small_batches(spark)
    held_out = F.coalesce(mod_crc(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs, ~held_out, "text", "lang", 1500)
    told = docs.withColumn("_pl_language", predicted(model, F.col("text"), spark))
    return told.where((F.col("_pl_language.lang_pred") != "und") & (F.col("_pl_language.share") >= LEAST_SHARE)).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document goes if it lost lines and nothing but white space is left. n_chars follows the text. Null and empty texts stay."""
    told = line_dedup(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")))
    told = told.where((F.col("n_dropped") == 0) | F.rlike("text", F.lit(r"(?U)\S")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return told.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each component, that of the smallest id; of rows that repeat id and text, one. Texts without words stay, and null ids count as largest."""
    ship(spark)
    small_batches(spark)
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_nd_id"), F.col("text_hash").alias("_nd_hash"))
    kept = cut(kept.groupBy("_nd_id", "_nd_hash").agg(F.count("*").alias("_nd_n")))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_nd_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_nd_hash")))
    if not kept.where("_nd_n > 1").isEmpty():
        rows = rows.where("_nd_n = 1").unionByName(rows.where("_nd_n > 1").dropDuplicates(["_nd_id", "_nd_hash"]))
    return rows.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs. Null and empty texts have no words and stay; repeated rows fare alike; null ids count like others."""
    told = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    hit = told.select(F.col("doc_id").alias("_dc_id"), F.col("text_hash").alias("_dc_hash")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_dc_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_dc_hash")), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; rows as in ``op1``. Null and empty texts are one token; repeated rows and null ids are packed each."""
    ship(spark)
    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: SQL cannot express a fitted language model or a tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
