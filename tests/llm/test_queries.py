"""The queries' contracts, SQL where there is some, and the pipeline against a brute-force version."""

import hashlib
import re

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import queries as Q
from tests.llm.test_documents import brute_components, brute_lines

COLUMNS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "text": "string"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_contract(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    if name in Q.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        columns = sorted(df.columns)
        got = sorted(tuple(r[c] for c in columns) for r in df.collect())
        assert got == sorted(con.sql(Q.ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())
    elif name not in ("op1_best_fit_packing",):
        table = {"op2_main_text": "pages", "op5_embedding_near_dedup": "embeddings"}.get(name, "documents")
        assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_license_base_columns_by_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    phrases = " UNION ALL ".join(f"SELECT {p.split()} AS p, '{label}' AS label" for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")))
    want = con.sql(f"""
        WITH d AS (SELECT doc_id, coalesce({Q._WORDS}, []) AS w FROM documents), f AS ({phrases}), s AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS k FROM d),
        m AS (SELECT doc_id, k - 1 AS k, label FROM s JOIN f ON w[k:k + len(p) - 1] = p),
        g AS (SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM m GROUP BY doc_id)
        SELECT doc_id, len(w), coalesce(n, 0), a, b, coalesce(l, '') FROM d LEFT JOIN g USING (doc_id) ORDER BY 1""").fetchall()
    got = Q.op8_license_scan(spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and sum(r.n_base for r in got)


def test_secret_base_spans_by_plain_patterns(spark, sf):
    kinds = (
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    sf, found = sf.replace("sf0.001", "sf0.01"), 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op3_secret_scan(spark, sf).collect():
        spans = [(m.start(), i, kind, m.end()) for i, (kind, pattern, fits) in enumerate(kinds) for m in pattern.finditer(texts[r.doc_id]) if fits(m)]
        written = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        n = [sum(s[2] == k for s in spans) for k, *_ in kinds]
        assert [r.n_assign, r.n_access, r.n_hex] == n and r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        found += len(spans)
    assert found


def test_held_out_toxicity(spark, sf):
    told = Q.op7_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").select("toxic", "score").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in told for b in told if a.toxic == 1 and b.toxic == 0]
    assert pairs and sum(pairs) / len(pairs) > 0.8


def test_held_out_languages(spark, sf):
    told = Q.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def test_pipeline_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts = {i: t for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    left = {}
    for i, t in brute_lines(texts).items():
        if t == texts[i] or t.strip():
            left[i] = t
    left = {i: left[i] for i, (_, c) in brute_components(left).items() if i == c}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {}
    for i, t in left.items():
        w = words(t)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean[i] = t
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    most = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert most[0] <= 2048 and most[1] <= 1.1 * sum(want.values()) / 2048 + 2


def test_stages_on_odd_documents(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "only words here and there and more", "en", "s", 3), (3, "12 34", "en", "s", 5), (4, "plain words in a line of text", "en", "s", 9), (4, "plain words in a line of text", "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    long_rows = [(10 + i, " ".join(f"word{k}" for k in range(60_000 + i)), "en", "s", 1) for i in range(2)]
    clash = ["base", "at", "n", "_id", "_hash", "id", "text_hash", "_n", "key", "hub", "_language", "n_lines", "n_dropped", "score", "sequence_id"]
    wide = spark.createDataFrame([*rows, *long_rows], df.schema).withColumns({c: F.lit("x") for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf)
        if name == "packing":
            assert out.where("doc_id >= 10").agg(F.count_distinct("doc_id")).first()[0] == 1
        else:
            assert out.columns == wide.columns, name
            wide = spark.createDataFrame(out.collect(), wide.schema)
    for docs in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == df.columns, name
                docs = spark.createDataFrame(out.collect(), df.schema)
            else:
                out.collect()
        assert sorted((r.doc_id or 0) for r in docs.collect()) == ([0, 4] if docs.count() else [])
