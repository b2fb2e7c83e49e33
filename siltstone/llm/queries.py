"""The queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import mod_crc, table
from siltstone.llm.linededup import SIGNS, UNSPACED
from siltstone.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.packing import pack

    return pack(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.htmltext import extract

    return extract(table(ship(spark), sf_dir, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.vectors import near_vectors

    return near_vectors(table(ship(spark), sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.secrets import secret_scan

    return secret_scan(table(ship(spark), sf_dir, "documents")).drop("values")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.toxicity import fit, score

    docs = table(ship(spark), sf_dir, "documents")
    held_out = F.coalesce(mod_crc(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.licenses import license_scan

    return license_scan(table(ship(spark), sf_dir, "documents")).drop("matches")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.languages import identify

    docs = table(ship(spark), sf_dir, "documents")
    held_out = F.coalesce(mod_crc(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.neardup import near_duplicates

    return near_duplicates(table(ship(spark), sf_dir, "documents")).drop("text_hash")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.linededup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_main_text": op2_main_text,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

#: DuckDB SQL for the rows of a query, where SQL can express them.
_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
#: The units of a line, as linededup compares them.
_UNITS = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), '{SIGNS}', ' ', 'g'), '({UNSPACED})', ' \\1 ', 'g'), ' +', ' ', 'g'))""".replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}")
ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": f"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
o AS (SELECT doc_id, k, parts[k] AS part, {_UNITS.format("parts[k]")} AS u FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS k FROM t)),
l AS (SELECT doc_id, k, part, CASE WHEN u <> '' THEN u ELSE chr(10) || trim(part, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) END AS line FROM o),
c AS (SELECT line, min(doc_id * 1000000000 + k) AS first FROM l WHERE line <> chr(10) GROUP BY line),
v AS (SELECT line, first, string_split(line, ' ') AS w FROM c WHERE NOT starts_with(line, chr(10)) AND len(string_split(line, ' ')) >= 10),
x AS (SELECT line, first, i, list_concat(w[1:i - 1], w[i + 1:]) AS d FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM v)),
g AS (SELECT x.line FROM x JOIN (SELECT i, d, min(first) AS m FROM x GROUP BY i, d) USING (i, d) WHERE m < first
  UNION SELECT x.line FROM x JOIN v ON v.w = x.d WHERE v.first < x.first
  UNION SELECT v.line FROM v JOIN x ON v.w = x.d WHERE x.first < v.first),
k AS (SELECT l.doc_id, l.k, l.part, c.line IS NOT NULL AND (c.first <> l.doc_id * 1000000000 + l.k OR g.line IS NOT NULL) AS gone FROM l LEFT JOIN c USING (line) LEFT JOIN g ON g.line = l.line),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_dropped, string_agg(part, chr(10) ORDER BY k) FILTER (NOT gone) AS left_over FROM k GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN text IS NOT NULL THEN coalesce(left_over, '') END AS text FROM t LEFT JOIN s USING (doc_id)""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS x FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, w, s, n FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM d) CROSS JOIN (SELECT DISTINCT len(x) AS n FROM v) WHERE s + n - 1 <= len(w)),
h AS (SELECT p.doc_id, p.s, p.n, v.item_id FROM p JOIN v ON list_slice(p.w, p.s, p.s + p.n - 1) = v.x),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS k FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
