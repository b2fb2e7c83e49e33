"""The engine's queries over the test tables, and the SQL that must give the same rows.

The mapping of tables to a crawl is ours: documents are content items, pages are responses,
events a fetch log (user_id stands for a URL, event_type error for a failure), suppliers are
experts, nations domains, conversations questions and answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import html as H
from siltstone.functions import text as X
from siltstone.functions import urls as U
from siltstone.operators import features as FE
from siltstone.operators import frontier as C
from siltstone.operators import models as M
from siltstone.operators import store as S
from siltstone.operators import urlmining as N
from siltstone.plans.lineage import cut
from siltstone.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Keyword lists in the test tables' language, for queries that SQL checks by token equality.
ASCII_DOMAINS = {"alpha": ["the", "of", "and"], "beta": ["des", "les", "une"], "gamma": ["para", "los", "una"], "delta": ["der", "und", "mit"]}
ASCII_TYPES = {"question": ["is", "are"], "answer": ["with", "by"], "article": ["for", "that"], "profile": ["on", "was"]}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with normalized text n."""
    return _t(spark, sf_dir, "documents").withColumn("n", X.normalize(F.col("text")))


_N = r"strip_accents(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_HASH = f"md5(substr({_N}, 1, 1000))"
_PUNCT = r"""regexp_replace(n, '[!-/:-@\[-`{-~،؛؟«»]', '', 'g')"""
_TOK = f"list_filter(string_split({_PUNCT}, ' '), lambda x: x <> '')"
_DOCS = f"d AS (SELECT doc_id, text, lang, source, {_N} AS n FROM documents), t AS (SELECT doc_id, lang, n, {_TOK} AS w FROM d)"


# Text, hashes, dedup


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS raw_chars, CAST(length({_N}) AS BIGINT) AS chars, md5({_N}) AS digest FROM documents")
def normalize_stats(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("raw_chars"), F.length("n").cast("long").alias("chars"), F.md5("n").alias("digest"))


@query(f"SELECT h AS hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {_HASH} AS h FROM documents WHERE text <> '') GROUP BY h HAVING count(*) > 1")
def dedup_similarity_hash(spark, sf_dir):
    h = _t(spark, sf_dir, "documents").select("doc_id", X.similarity_hash(F.col("text")).alias("hash")).where("hash IS NOT NULL")
    return h.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"WITH k AS (SELECT lang, row_number() OVER (PARTITION BY {_HASH} ORDER BY doc_id) AS r FROM documents WHERE text <> '') SELECT lang, count(*) AS n FROM k WHERE r = 1 GROUP BY lang")
def dedup_keep_first(spark, sf_dir):
    h = _t(spark, sf_dir, "documents").select("doc_id", "lang", X.similarity_hash(F.col("text")).alias("hash")).where("hash IS NOT NULL")
    return h.groupBy("hash").agg(F.min_by("lang", "doc_id").alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, md5({_N}) AS md5, sha256({_N}) AS sha256, {_HASH} AS head FROM documents")
def text_hashes(spark, sf_dir):
    c = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", X.text_hash(c).alias("md5"), X.text_hash(c, "sha256").alias("sha256"), X.similarity_hash(c).alias("head"))


@query(f"WITH k AS (SELECT doc_id, md5({_N}) AS h FROM documents WHERE text <> ''), f AS (SELECT h, min(doc_id) AS a FROM k GROUP BY h) SELECT a, doc_id AS b FROM k JOIN f USING (h) WHERE doc_id > a")
def text_hash_pairs(spark, sf_dir):
    h = _t(spark, sf_dir, "documents").select("doc_id", X.text_hash(F.col("text")).alias("h")).where("h IS NOT NULL")
    return h.join(h.groupBy("h").agg(F.min("doc_id").alias("a")), "h").where("doc_id > a").select("a", F.col("doc_id").alias("b"))


@query(f"WITH {_DOCS} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM t")
def token_counts(spark, sf_dir):
    w = X.tokenize(F.col("n"), [])
    return _docs(spark, sf_dir).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"WITH {_DOCS} SELECT doc_id, CAST(len(list_filter(w, lambda x: x NOT IN ('the', 'of', 'and', 'de', 'la', 'der'))) AS BIGINT) AS n_tokens FROM t")
def stopword_filtered_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.tokenize(F.col("n"), ["the", "of", "and", "de", "la", "der"])).cast("long").alias("n_tokens"))


_GRAMS = "g AS (SELECT doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t)"


@query(f"WITH {_DOCS}, {_GRAMS} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM g GROUP BY term ORDER BY n DESC, term LIMIT 200")
def ngram_top(spark, sf_dir):
    counts = FE.term_counts(_docs(spark, sf_dir), X.tokenize(F.col("n"), []), "doc_id", 2)
    return counts.select("term", F.col("total").alias("n"), "df").orderBy(F.desc("n"), "term").limit(200)


_VOCAB = f"""{_DOCS}, {_GRAMS}, f AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), nd AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM f, nd GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.95 * any_value(n) ORDER BY total DESC, term LIMIT 10000)"""


@query(f"WITH {_VOCAB} SELECT term, df, total, round(idf, 6) AS idf FROM v")
def df_vocab(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    v = FE.vocabulary(FE.term_counts(docs, X.tokenize(F.col("n"), []), "doc_id", 2), docs.count(), 10_000, 2, 0.95)
    return v.select("term", "df", "total", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_VOCAB}, x AS (SELECT doc_id, term, tf * idf AS w FROM f JOIN v USING (term)), l AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(u, 6) DESC, term) AS place FROM l) SELECT doc_id, term, round(u, 6) AS weight, place FROM r WHERE place <= 3""")
def tfidf_top_terms(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    words = X.tokenize(F.col("n"), [])
    vocab = cut(FE.vocabulary(FE.term_counts(docs, words, "doc_id", 2), docs.count(), 10_000, 2, 0.95))
    w = FE.tfidf(FE.terms(docs, words, "doc_id", 2, vocab), vocab, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))
    return S.top_per_group(w, ["doc_id"], [F.desc("weight"), F.col("term")], 3)


@query("SELECT doc_id, CASE WHEN length(text) <= 150 THEN text ELSE substr(text, 1, 147) || '...' END AS summary, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS short, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS brief FROM documents")
def text_summaries(spark, sf_dir):
    c = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", X.summary(c).alias("summary"), X.summary(c, 100).alias("short"), X.brief(c).alias("brief"))


# Features


def _sql_scores(lists: dict[str, list[str]]) -> str:
    hit = {k: "(" + f"len(list_filter(z, lambda x: x IN ({', '.join(repr(w) for w in words)}))) / {len(words)}.0)" for k, words in lists.items()}
    total = " + ".join(hit.values())
    return ", ".join(f"round(CASE WHEN {total} > 0 THEN {v} / ({total}) ELSE 0 END, 6) AS {k}" for k, v in hit.items())


# Tokens between characters that are no word characters, as whole-word matching sees them.
_WORDS = r"z AS (SELECT doc_id, n, list_filter(string_split_regex(lower(n), '[^\pL\pN_]+'), lambda x: x <> '') AS z FROM d)"


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query(f"WITH {_DOCS}, {_WORDS} SELECT doc_id, {_sql_scores(ASCII_DOMAINS)} FROM z")
def keyword_domain_scores(spark, sf_dir):
    out = FE.with_keyword_scores(_docs(spark, sf_dir), F.col("n"), ASCII_DOMAINS)
    return _rounded(out, list(ASCII_DOMAINS)).select("doc_id", *ASCII_DOMAINS)


_SENT = r"list_filter(string_split_regex(n, '[.!؟]+'), lambda x: trim(x) <> '')"


@query(f"""WITH {_DOCS}, {_WORDS}, s AS (SELECT *, {_SENT} AS s FROM z) SELECT doc_id, {_sql_scores({f"type_{k}": v for k, v in ASCII_TYPES.items()})},
round(length(n) / 1000.0, 6) AS length_k, round(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) / greatest(len(s), 1) / 100.0, 6) AS sentence_length_h FROM s""")
def content_type_scores(spark, sf_dir):
    out = FE.type_scores(_docs(spark, sf_dir), F.col("n"), ASCII_TYPES)
    names = [*[f"type_{k}" for k in ASCII_TYPES], "length_k", "sentence_length_h"]
    return _rounded(out, names).select("doc_id", *names)


_MARKS = r"[.,;:؛،?!؟\-()\[\]{}«»]"
_STRUCT = rf"""q AS (SELECT doc_id, n, list_filter(string_split(n, ' '), lambda x: x <> '') AS w, {_SENT} AS s FROM d),
u AS (SELECT doc_id, CAST(length(n) AS DOUBLE) AS text_length, CAST(len(w) AS DOUBLE) AS word_count, CAST(len(s) AS DOUBLE) AS sentence_count, CAST(CASE WHEN n = '' THEN 0 ELSE 1 END AS DOUBLE) AS paragraph_count,
 coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) / greatest(len(s), 1) AS avg_sentence_length, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1) AS avg_word_length,
 len(regexp_extract_all(n, '{_MARKS}')) / greatest(length(n), 1) AS punctuation_ratio, len(regexp_extract_all(n, '\p{{Lu}}|\p{{Lt}}')) / greatest(length(n), 1) AS uppercase_ratio, len(regexp_extract_all(n, '\p{{Nd}}')) / greatest(length(n), 1) AS digit_ratio,
 len(list_distinct(w)) / greatest(len(w), 1) AS unique_words_ratio, CAST(0 AS DOUBLE) AS question_count, CAST(len(regexp_extract_all(n, '!')) AS DOUBLE) AS exclamation_count FROM q)"""


@query(f"WITH {_DOCS}, {_STRUCT} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in FE.STRUCTURAL)} FROM u")
def structural_features(spark, sf_dir):
    out = FE.with_structural(_docs(spark, sf_dir), F.col("n"))
    return _rounded(out, FE.STRUCTURAL).select("doc_id", *FE.STRUCTURAL)


@query(f"WITH {_DOCS}, {_STRUCT} SELECT doc_id, {', '.join(f'round({c} / CASE WHEN max({c}) OVER () = 0 THEN 1 ELSE max({c}) OVER () END, 6) AS {c}' for c in FE.STRUCTURAL)} FROM u")
def structural_scaled(spark, sf_dir):
    out = cut(FE.with_structural(_docs(spark, sf_dir), F.col("n")).select("doc_id", *FE.STRUCTURAL))  # read for the maxima, then scaled
    return _rounded(FE.scaled(out, FE.STRUCTURAL), FE.STRUCTURAL).select("doc_id", *FE.STRUCTURAL)


@query()
def feature_vectors(spark, sf_dir):
    """Vector sizes and lengths of the combined general features."""
    v = FE.feature_blocks(_t(ship(spark), sf_dir, "documents")).withColumn("held", F.unwrap_udt("features"))  # sparse ones stay sparse
    size = F.coalesce("held.size", F.size("held.values"))
    return v.select("doc_id", size.alias("size"), F.size(F.filter("held.values", lambda x: x != 0)).alias("n_set"))


_HIT = {k: "len(list_filter(z, lambda x: x IN (" + ", ".join(repr(w) for w in words) + f"))) / {len(words)}.0" for k, words in {**ASCII_TYPES, **ASCII_DOMAINS}.items()}


def _best(names: list[str]) -> str:
    """Names with a score, best first, ties by name."""
    pairs = ", ".join(f"struct_pack(s := -round(({_HIT[k]}) / ({' + '.join(_HIT[x] for x in names)}), 12), n := '{k}', h := {_HIT[k]})" for k in names)
    return f"list_transform(list_sort(list_filter([{pairs}], lambda e: e.h > 0)), lambda e: e.n)"


@query(f"""WITH {_DOCS}, {_WORDS}, c AS (SELECT z.doc_id, documents.text, coalesce({_best(list(ASCII_TYPES))}[1], 'other') AS kind, {_best(list(ASCII_DOMAINS))} AS domains FROM z JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text_summary, kind AS content_type, CASE kind WHEN 'answer' THEN 'other' ELSE kind END AS stored_type, array_to_string(domains, ',') AS domains FROM c""")
def rule_classification(spark, sf_dir):
    out = M.classify(_t(spark, sf_dir, "documents"), types=ASCII_TYPES, domains=ASCII_DOMAINS)
    return out.select("doc_id", "text_summary", "content_type", M.storage_type(F.col("content_type")).alias("stored_type"), F.array_join("domains", ",").alias("domains"))


# Pages


_TITLE = r"regexp_replace(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\s*\|.*$', ''), '\s*-.*$', '')"
_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g')"
_HREFS = rf"list_filter(regexp_extract_all({_BARE}, '(?i)<a\s[^>]*?href=\"([^\"]*)\"', 1), lambda x: NOT regexp_matches(x, '^(javascript:|mailto:|tel:|#)'))"
_AUTH = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PLAIN = r"regexp_replace(regexp_replace({0}, '[?#].*$', ''), ';[^/]*$', '')"
_PATH = r"regexp_replace(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), ';[^/]*$', '')"
_SEG = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_URL = {"auth": _AUTH.format("url"), "plain": _PLAIN.format("url"), "path": _PATH.format("url"), "seg": _SEG.format("url")}


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", H.fast_title(F.col("html")).alias("title"))


_LINKS = rf"l AS (SELECT page_id, url, unnest({_HREFS}) AS href FROM pages), r AS (SELECT page_id, url, CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%' THEN href ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href END AS link FROM l)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select("page_id", "url", F.explode(H.fast_links(F.col("html"))).alias("href"))
    return rows.select("page_id", "url", U.resolve_rooted(F.col("href"), F.col("url")).alias("link"))


@query(f"WITH {_LINKS} SELECT page_id, link, count(*) AS n FROM r GROUP BY page_id, link")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT DISTINCT page_id, {_PLAIN.format('link')} AS link FROM r WHERE {_AUTH.format('link')} = {_AUTH.format('url')}")
def page_links_internal(spark, sf_dir):
    rows = _links(spark, sf_dir).where(U.authority(F.col("link")) == U.authority(F.col("url")))
    return rows.select("page_id", U.normalize_url(F.col("link")).alias("link")).distinct()


_LIST_RE = r"/category/|/tag/|/archive/|/blog/|/articles/|/questions/|/list/|/search/|/page/\d+|/\?page=\d+"


@query(f"SELECT page_id, CASE WHEN regexp_matches(url, '{_LIST_RE}') OR len(regexp_extract_all(html, '(?i)<article[ >]')) >= 3 THEN 'list' ELSE 'generic' END AS page_type FROM pages")
def page_types(spark, sf_dir):
    rows = _t(ship(spark), sf_dir, "pages").select("page_id", H.structure_fields(F.col("url"), F.col("html")).alias("s"))
    return rows.select("page_id", "s.page_type")


@query(r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') AS h FROM pages), c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<header\b.*?</header>', '', 'g'), '(?is)<footer\b.*?</footer>', '', 'g'), '(?is)<nav\b.*?</nav>', '', 'g') AS h FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text FROM c""")
def page_clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", H.fast_clean_text(F.col("html")).alias("clean_text"))


_SECTION = f"""WITH {_LINKS}, s AS (SELECT page_id, string_split(regexp_replace(href, '[?#].*$', ''), '/')[2] AS part, count(*) AS n, min(k) AS k FROM (SELECT page_id, unnest({_HREFS}) AS href, unnest(generate_series(1, len({_HREFS}))) AS k FROM pages) WHERE href LIKE '/%' GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, k) AS place FROM s)
SELECT page_id, part, place FROM p WHERE place <= 5 AND part <> '' AND part NOT IN ('wp-content', 'wp-includes', 'js', 'css', 'img', 'images')"""


@query(_SECTION)
def main_sections_top5(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(H.fast_links(F.col("html"))).alias("k", "href")).where(F.col("href").startswith("/") | F.col("href").startswith("http"))
    part = F.get(F.split(U.path(F.col("href")), "/"), F.lit(1))
    counts = rows.select("page_id", "k", part.alias("part")).where("part IS NOT NULL").groupBy("page_id", "part").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    top = S.top_per_group(counts, ["page_id"], [F.desc("n"), F.col("k")], 5)
    from siltstone.functions.lexicon import ASSET_PARTS

    return top.where((F.col("part") != "") & ~F.col("part").isin(*ASSET_PARTS)).select("page_id", "part", "place")


@query()
def page_extract(spark, sf_dir):
    rows = _t(ship(spark), sf_dir, "pages").select("page_id", "url", H.extract_fields(F.col("url"), F.col("html")).alias("r"))
    return rows.select("page_id", "url", "r.title", "r.content", "r.date", "r.author", "r.page_type", F.size("r.related_links").alias("n_related"), "r.error")


@query()
def page_legacy(spark, sf_dir):
    rows = _t(ship(spark), sf_dir, "pages").select("page_id", H.legacy_fields(F.col("url"), F.col("html")).alias("r"))
    return rows.select("page_id", "r.title", "r.content", "r.date", "r.author", "r.clean_text", F.size("r.links").alias("n_links"))


@query()
def page_selectors(spark, sf_dir):
    rows = _t(ship(spark), sf_dir, "pages").select("page_id", H.structure_fields(F.col("url"), F.col("html")).alias("s"))
    return rows.select("page_id", "s.page_type", F.to_json("s.selectors").alias("selectors"), F.to_json("s.xpaths").alias("xpaths"), F.array_join("s.main_sections", ",").alias("main_sections"))


@query("SELECT count(*) AS n, count(*) FILTER (html <> '') AS n_ok, CAST(count(*) FILTER (html <> '') AS DOUBLE) / greatest(count(*), 1) AS success_rate FROM pages")
def extraction_stats(spark, sf_dir):
    rows = _t(ship(spark), sf_dir, "pages").select(H.extract_fields(F.col("url"), F.col("html")).alias("r")).select("r.*")
    return S.extraction_totals(rows)


# URLs


@query(f"SELECT page_id, {_URL['plain']} AS url, replace({_URL['auth']}, '.', '_') AS host_token FROM pages")
def url_normalized(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", U.normalize_url(u).alias("url"), U.host_token(u).alias("host_token"))


@query(f"SELECT DISTINCT k - 1 AS position, s[k] AS value FROM (SELECT s, unnest(generate_series(1, len(s))) AS k FROM (SELECT {_URL['seg']} AS s FROM pages))")
def url_segments(spark, sf_dir):
    return N.path_values(_t(spark, sf_dir, "pages")).select(F.col("position").cast("long").alias("position"), "value")


@query(r"SELECT DISTINCT split_part(p, '=', 1) AS key, CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END AS value FROM (SELECT unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> ''")
def url_query_values(spark, sf_dir):
    return N.query_values(_t(spark, sf_dir, "pages"))


@query(f"""WITH v AS (SELECT DISTINCT k - 1 AS position, s[k] AS value FROM (SELECT s, unnest(generate_series(1, len(s))) AS k FROM (SELECT {_URL['seg']} AS s FROM pages))),
g AS (SELECT position, count(*) AS n_values, count(*) FILTER (regexp_matches(value, '^\\d+$')) AS d, count(*) FILTER (contains(value, '-')) AS h, string_agg(value, ',' ORDER BY value) AS l FROM v GROUP BY position)
SELECT position, n_values, CASE WHEN n_values < 10 THEN 'enumerated' WHEN d > 0.7 * n_values THEN 'numeric' WHEN h > 0.7 * n_values THEN 'slug' ELSE 'unknown' END AS kind,
CASE WHEN n_values < 10 THEN l WHEN d > 0.7 * n_values THEN '<id>' WHEN h > 0.7 * n_values THEN '<slug>' ELSE '<variable>' END AS listed FROM g WHERE n_values > 1""")
def url_sections(spark, sf_dir):
    out = N.sections(_t(spark, sf_dir, "pages"))
    return out.select(F.col("position").cast("long").alias("position"), "n_values", "kind", F.array_join("values", ",").alias("listed"))


_LIST_SQL = " OR ".join(f"contains({{0}}, '{p}')" for p in ("/category/", "/tag/", "/archive/", "/blog/", "/articles/", "/questions/", "/list/", "/search/", "/page/", "\\?page=", "archive", "category", "tag", "blog", "articles"))
_DETAIL_SQL = f"(contains({{0}}, '*') OR regexp_matches({{0}}, '/post/|/article/|/question/|/view/|/show/|/single/|/\\d+/|/[^/]+/')) AND NOT ({_LIST_SQL})"


_PATTERNS = f"""WITH p AS (SELECT DISTINCT url, {_URL['seg']} AS s, {_URL['auth']} AS host, {_URL['path']} AS path FROM pages), t AS (SELECT count(*) AS total FROM p), g AS (SELECT len(s) AS k, count(*) AS size FROM p GROUP BY 1),
a AS (SELECT url AS pattern, path AS shape, CAST(1 AS BIGINT) AS url_count FROM p JOIN g ON len(s) = k WHERE size < 3),
e AS (SELECT len(s) AS k, i, min(s[i]) AS lo, max(s[i]) AS hi FROM (SELECT s, unnest(generate_series(1, len(s))) AS i FROM p) GROUP BY 1, 2),
b AS (SELECT k, string_agg(CASE WHEN lo = hi THEN lo ELSE '*' END, '/' ORDER BY i) AS path FROM e GROUP BY k),
c AS (SELECT min_by(host, url) || '/' || coalesce(any_value(b.path), '') AS pattern, count(*) AS url_count FROM p JOIN g ON len(s) = g.k LEFT JOIN b ON b.k = g.k WHERE size >= 3 GROUP BY g.k),
o AS (SELECT * FROM a UNION ALL SELECT pattern, pattern, url_count FROM c)"""


@query(f"""{_PATTERNS} SELECT pattern, ({_LIST_SQL.format('shape')}) AS is_list, ({_DETAIL_SQL.format('shape')}) AS is_detail, url_count, round(url_count / total, 6) AS weight FROM o, t""")
def url_patterns(spark, sf_dir):
    out = N.heuristic_patterns(_t(spark, sf_dir, "pages"))
    return out.select("pattern", "is_list", "is_detail", "url_count", F.round("weight", 6).alias("weight"))


@query(f"""WITH p AS (SELECT page_id, url, {_URL['auth']} AS host, string_split(regexp_replace({_URL['path']}, '^/+|/+$', '', 'g'), '/') AS s FROM pages), x AS (SELECT a.page_id AS a, b.page_id AS b, a.host AS ha, b.host AS hb, a.s AS sa, b.s AS sb FROM p a JOIN p b ON b.page_id = a.page_id + 1)
SELECT a, b, round(CASE WHEN ha <> hb THEN 0.1 WHEN len(sa) <> len(sb) THEN 0.3 ELSE len(list_filter(generate_series(1, len(sa)), lambda i: sa[i] = sb[i])) / greatest(len(sa), 1) END, 6) AS similarity FROM x""")
def url_similarity(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    a, b = p.select(F.col("page_id").alias("a"), F.col("url").alias("ua")), p.select(F.col("page_id").alias("b"), F.col("url").alias("ub"))
    rows = a.join(b, F.col("b") == F.col("a") + 1)
    return rows.select("a", "b", F.round(U.url_similarity(F.col("ua"), F.col("ub")).cast("double"), 6).alias("similarity"))


_KIND = f"CASE WHEN {_LIST_SQL.format('url')} THEN 'list' WHEN {_DETAIL_SQL.format('url')} THEN 'detail' ELSE 'page' END"
_PRIORITY = "CAST(trunc((depth * 10 + CASE kind WHEN 'list' THEN -30.0 WHEN 'detail' THEN -10.0 WHEN 'sitemap' THEN -60.0 ELSE 0 END + slashes * 5 * 0.8) / (1.0 + CASE kind WHEN 'list' THEN 1.5 WHEN 'detail' THEN 1.0 WHEN 'sitemap' THEN 2.0 ELSE 0 END + 0.8)) AS INT)"


@query(f"WITH k AS (SELECT page_id, url, CAST(page_id % 6 AS INT) AS depth, {_KIND} AS kind, len({_URL['path']}) - len(replace({_URL['path']}, '/', '')) AS slashes FROM pages) SELECT page_id, kind, {_PRIORITY} AS priority FROM k")
def url_priority(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 6).cast("int").alias("depth"), C.page_class(F.col("url")).alias("kind"))
    return rows.select("page_id", "kind", U.weighted_priority(F.col("url"), F.col("depth"), F.col("kind")).alias("priority"))


@query(f"WITH k AS (SELECT page_id, url, CAST(page_id % 6 AS INT) AS depth, {_KIND} AS kind FROM pages) SELECT page_id, CAST(depth * 10 + CASE kind WHEN 'list' THEN -20 WHEN 'detail' THEN -10 ELSE 0 END - CASE WHEN regexp_matches(url, '/legal/|/law/|/cases/|/judgments/|/attorneys/') THEN 5 ELSE 0 END AS INT) AS priority FROM k")
def url_priority_additive(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 6).cast("int").alias("depth"), C.page_class(F.col("url")).alias("kind"))
    return rows.select("page_id", U.additive_priority(F.col("url"), F.col("depth"), F.col("kind")).alias("priority"))


@query()
def url_clusters(spark, sf_dir):
    return N.vector_clusters(_t(spark, sf_dir, "pages")).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"""{_PATTERNS}, m AS (SELECT pattern, ({_LIST_SQL.format('shape')}) AS is_list, ({_DETAIL_SQL.format('shape')}) AS is_detail, url_count / total AS weight, row_number() OVER (ORDER BY url_count DESC, pattern) AS ordinal FROM o, t),
u AS (SELECT DISTINCT url, regexp_replace({_URL['plain']}, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS target FROM pages),
f AS (SELECT url, arg_min(struct_pack(pattern, is_list, is_detail, weight), ordinal) AS m FROM u JOIN m ON regexp_matches(target, '^' || replace(pattern, '*', '.*?') || '$') GROUP BY url)
SELECT u.url, coalesce(f.m.pattern, u.url) AS pattern, coalesce(f.m.is_list, {_LIST_SQL.format('u.url')}) AS is_list, coalesce(f.m.is_detail, {_DETAIL_SQL.format('u.url')}) AS is_detail, round(coalesce(f.m.weight, 0.1), 6) AS weight FROM u LEFT JOIN f USING (url)""")
def url_matches(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    patterns = N.heuristic_patterns(pages)
    patterns = patterns.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("url_count"), "pattern")))  # some hundred patterns
    return N.match_patterns(pages, patterns).withColumn("weight", F.round("weight", 6))


@query()
def selector_lookup(spark, sf_dir):
    pages = _t(ship(spark), sf_dir, "pages").select("page_id", "url", H.structure_fields(F.col("url"), F.col("html")).alias("s"))
    stored = cut(pages.select("url", "s.page_type", "s.selectors", F.col("page_id").alias("ordinal")))  # a page is parsed once
    out = N.match_selectors(stored.select("url", "page_type"), stored)
    return out.select("url", "page_type", F.size("selectors").alias("n_selectors"))


# Frontier and state


_HOST = "blog.tiontion.example.com"


@query(f"WITH {_LINKS}, c AS (SELECT {_PLAIN.format('link')} AS url, 1 AS depth FROM r), u AS (SELECT url, min(depth) AS depth FROM c GROUP BY url), v AS (SELECT min({_URL['auth']}) AS host FROM pages), o AS (SELECT url, CASE WHEN url IN (SELECT {_URL['plain']} FROM pages WHERE contains(html, '<b>')) THEN 'skipped_visited' WHEN {_URL['auth']} <> host THEN 'skipped_host' ELSE 'queued' END AS outcome FROM u, v) SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def frontier_outcomes(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    cand = _links(spark, sf_dir).select(U.normalize_url(F.col("link")).alias("url"), F.lit(1).alias("depth"), F.col("url").alias("parent_url"))
    seen = pages.where(F.contains("html", F.lit("<b>"))).select(U.normalize_url(F.col("url")).alias("url"))
    host = pages.agg(F.min(U.authority(F.col("url")))).first()[0]
    return C.enqueue(cand, seen, host, max_depth=5).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS}, c AS (SELECT DISTINCT {_PLAIN.format('link')} AS url FROM r), s AS (SELECT DISTINCT {_URL['plain']} AS url FROM pages) SELECT url, CASE WHEN url IN (SELECT url FROM s) THEN 'skipped_visited' ELSE 'skipped_depth' END AS outcome FROM c")
def frontier_in_progress(spark, sf_dir):
    """Candidates too deep, but for what a worker has in hand."""
    cand = _links(spark, sf_dir).select(F.col("link").alias("url"), F.lit(6).alias("depth"), F.col("url").alias("parent_url"))
    held = _t(spark, sf_dir, "pages").select(U.normalize_url(F.col("url")).alias("url"))
    return C.enqueue(cand, held.where("false"), "", max_depth=5, in_progress=held).select("url", "outcome")


# Customers link to their orders, and an order to the customer whose key is its own, if there is one.
_EDGES = "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || o_orderkey, 'c' || c_custkey FROM orders JOIN customer ON c_custkey = o_orderkey"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT 'c1' AS url, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 5) SELECT url, min(depth) AS depth FROM w GROUP BY url""")
def frontier_bfs(spark, sf_dir):
    return C.waves(_edges(spark, sf_dir), spark.createDataFrame([("c1",)], "url string"), 5)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    customer, order = F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("o"), F.col("o_orderkey"))
    back = o.join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_orderkey")).select(order, F.concat(F.lit("c"), F.col("c_custkey")))
    return o.select(customer.alias("src"), order.alias("dst")).union(back)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src FROM e WHERE starts_with(src, 'c') GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), w AS (SELECT src AS url, 0 AS wave FROM r UNION SELECT e.dst, w.wave + 1 FROM w JOIN e ON e.src = w.url WHERE w.wave < 6),
f AS (SELECT url, min(wave) AS wave FROM w GROUP BY url), p0 AS (SELECT url, 1 AS place FROM f WHERE wave = 0),
p1 AS (SELECT url, row_number() OVER (ORDER BY url) + 1 AS place FROM f WHERE wave = 1),
p2 AS (SELECT f.url, row_number() OVER (ORDER BY min(p1.place), f.url) + 1 + (SELECT count(*) FROM p1) AS place FROM f JOIN e ON e.dst = f.url JOIN p1 ON p1.url = e.src WHERE f.wave = 2 GROUP BY f.url),
p3 AS (SELECT f.url, row_number() OVER (ORDER BY min(p2.place), f.url) + 1 + (SELECT count(*) FROM p1) + (SELECT count(*) FROM p2) AS place FROM f JOIN e ON e.dst = f.url JOIN p2 ON p2.url = e.src WHERE f.wave = 3 GROUP BY f.url),
p4 AS (SELECT f.url, row_number() OVER (ORDER BY min(p3.place), f.url) + 1 + (SELECT count(*) FROM p1) + (SELECT count(*) FROM p2) + (SELECT count(*) FROM p3) AS place FROM f JOIN e ON e.dst = f.url JOIN p3 ON p3.url = e.src WHERE f.wave = 4 GROUP BY f.url),
a AS (SELECT url, place, 0 AS wave FROM p0 UNION ALL SELECT url, place, 1 FROM p1 UNION ALL SELECT url, place, 2 FROM p2 UNION ALL SELECT url, place, 3 FROM p3 UNION ALL SELECT url, place, 4 FROM p4)
SELECT url, CAST(wave AS INT) AS wave, CAST(place AS INT) AS place FROM a WHERE place <= 50 AND wave <= 4""")
def site_discovery(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    root = edges.where(F.col("src").startswith("c")).distinct().groupBy("src").count().orderBy(F.desc("count"), "src").first()[0]
    return N.discover_site(edges, root, 50).where("wave <= 4")


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id AS url, ts AS visited_at FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) , n WHERE NOT (n > 500 AND r <= 100)")
def visited_eviction(spark, sf_dir):
    return C.evict(_t(spark, sf_dir, "events").select(F.col("event_id").alias("url"), F.col("ts").alias("visited_at")), cap=500).select("url", "visited_at")


@query("SELECT user_id AS url, count(*) AS attempts, min(ts) AS first_attempt, max(ts) AS last_attempt, arg_max(props, struct_pack(ts, props)) AS last_error, count(*) < 3 AS retry FROM events WHERE event_type = 'error' GROUP BY user_id")
def failed_attempts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("url"), "ts", F.col("props").alias("error"))
    f = C.failures(e)
    return C.should_retry(f.select("url", "first_attempt", "last_attempt", "last_error"), f).join(f.select("url", "attempts"), "url")


@query("SELECT count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS elapsed_seconds, CAST(floor(count(*) FILTER (event_type <> 'error') / greatest(floor(epoch(max(ts)) - epoch(min(ts))), 1) * 60) AS BIGINT) AS urls_per_minute FROM events")
def crawl_rate(spark, sf_dir):
    return C.crawl_stats(_t(spark, sf_dir, "events"), F.col("event_type") != "error")


@query("SELECT user_id, event_id, CASE WHEN p IS NULL THEN 0.0 ELSE greatest(0.0, 60.0 - (epoch_us(ts) - epoch_us(p)) / 1e6) END AS wait FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def politeness_waits(spark, sf_dir):
    from siltstone.sources.web import politeness

    e = _t(spark, sf_dir, "events").withColumn("host", F.col("user_id"))
    return politeness(e, 60.0).select("user_id", "event_id", F.col("wait").cast("double").alias("wait"))


_STEPS = """SELECT user_id % 4 AS site, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS "at", count(*) * 40 AS processed, count(*) FILTER (event_type = 'view') AS new FROM events GROUP BY 1, 2"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    at = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    rows = e.groupBy((F.col("user_id") % 4).alias("site"), at.alias("at")).agg((F.count("*") * 40).alias("processed"), F.count_if(F.col("event_type") == "view").alias("new"))
    first = F.min("at").over(Window.partitionBy("site"))
    return rows.withColumn("minutes", ((F.col("at") - first) / 60).cast("double"))


@query(f"""WITH RECURSIVE s AS ({_STEPS}), m AS (SELECT *, ("at" - min("at") OVER (PARTITION BY site)) / 60.0 AS minutes, row_number() OVER (PARTITION BY site ORDER BY "at") AS k FROM s),
f AS (SELECT site, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS "at", 'initial' AS phase, CAST(0 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS new, CAST(0 AS DOUBLE) AS since FROM (SELECT DISTINCT site FROM s)
UNION ALL SELECT site, k, "at", nxt, CASE WHEN nxt = phase THEN p ELSE 0 END, CASE WHEN nxt = phase THEN n ELSE 0 END, CASE WHEN nxt = phase THEN since ELSE minutes END FROM (
 SELECT m.site, m.k, m."at", f.phase, f.since, CAST(m.minutes AS DOUBLE) AS minutes, f.processed + m.processed AS p, f.new + m.new AS n,
 CASE WHEN f.phase = 'initial' AND (f.processed + m.processed > 100 OR m.minutes - f.since > 60) THEN 'active'
 WHEN f.phase = 'active' AND (f.processed + m.processed > 1000 OR m.minutes - f.since > 240) AND (f.new + m.new) / greatest(1, f.processed + m.processed) * 100 < 20 THEN 'steady'
 WHEN f.phase = 'steady' AND (f.processed + m.processed > 5000 OR m.minutes - f.since > 1440) AND (f.new + m.new) / greatest(1, f.processed + m.processed) * 100 < 5 THEN 'maintenance' ELSE f.phase END AS nxt
 FROM f JOIN m ON m.site = f.site AND m.k = f.k + 1))
SELECT site, "at", phase, processed, new FROM f WHERE k > 0""")
def phase_machine(spark, sf_dir):
    return C.phase_history(_steps(spark, sf_dir))


# Store


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def page_scan(spark, sf_dir):
    return S.page(_t(spark, sf_dir, "orders"), 200, 100, "o_orderkey", o_orderstatus="F", no_such_column=1).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filtered_count(spark, sf_dir):
    return S.count(_t(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey = 7")
def get_by_id(spark, sf_dir):
    return S.by_id(_t(spark, sf_dir, "supplier"), 7, "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT s_nationkey AS domain, s_suppkey AS id, s_acctbal AS rating, place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) WHERE place <= 3")
def top_experts_per_domain(spark, sf_dir):
    e = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("domain"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("rating"))
    return S.top_per_group(e, ["domain"], [F.desc("rating"), F.col("id")], 3)


@query("WITH a AS (SELECT l_suppkey AS id, count(*) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1) SELECT s_suppkey AS id, CAST(coalesce(n, 0) AS INT) AS answers_count FROM supplier LEFT JOIN a ON id = s_suppkey")
def active_answer_count(spark, sf_dir):
    answers = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("expert_id"), F.when(F.col("l_returnflag") == "N", "active").otherwise("hidden").alias("status"))
    return S.answer_counts(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), answers).select("id", "answers_count")


@query("SELECT doc_id AS id, title FROM (SELECT doc_id, substr(text, 1, 20) AS title, text FROM documents) WHERE contains(title, 'the ') OR contains(text, 'the ') ORDER BY doc_id LIMIT 100")
def keyword_search(spark, sf_dir):
    items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"))
    return S.keyword_search(items, "the ", 100).select("id", "title")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a batch to store: url by source and id group, arrival by id."""
    d = _t(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("arrival"), F.concat_ws("/", "source", (F.col("doc_id") % 300).cast("string")).alias("url"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.lit("article").alias("content_type"), F.col("lang").alias("meta_data"), X.similarity_hash(F.col("text")).alias("similarity_hash"))


def _store(items: DataFrame) -> DataFrame:
    """What the store holds before: the first row of every hash among the first 100 ids, urls kept unique."""
    old = items.where("arrival < 100 AND similarity_hash IS NOT NULL")
    one = S.top_per_group(old, ["similarity_hash"], [F.col("arrival")], 1).drop("place")
    one = S.top_per_group(one, ["url"], [F.col("arrival")], 1).drop("place")
    return one.select((F.col("arrival") + 1).alias("id"), "url", "title", "content", "content_type", "meta_data", "similarity_hash")


_ITEMS = f"i AS (SELECT doc_id AS arrival, source || '/' || CAST(doc_id % 300 AS VARCHAR) AS url, text AS content, CASE WHEN text <> '' THEN {_HASH} END AS h FROM documents), s0 AS (SELECT * FROM i WHERE arrival < 100 AND h IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h ORDER BY arrival) = 1), s AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival) = 1)"


_ARRIVED = f"""{_ITEMS}, b AS (SELECT *, row_number() OVER (ORDER BY arrival) AS k FROM i WHERE arrival >= 100),
q AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS arrival, '' AS outcome, (SELECT list(h) FROM s) AS hs, (SELECT list(url) FROM s) AS us
 UNION ALL SELECT k, arrival, o, CASE WHEN o = 'inserted' THEN list_append(hs, h) ELSE hs END, CASE WHEN o = 'inserted' THEN list_append(us, url) ELSE us END FROM (
  SELECT b.k, b.arrival, b.h, b.url, q.hs, q.us, CASE WHEN coalesce(b.content, '') = '' THEN 'rejected_empty' WHEN list_contains(q.hs, b.h) THEN 'updated' WHEN list_contains(q.us, b.url) THEN 'rejected_url_conflict' ELSE 'inserted' END AS o FROM q JOIN b ON b.k = q.k + 1))"""


@query(f"WITH RECURSIVE {_ARRIVED} SELECT outcome, count(*) AS n FROM q WHERE k > 0 GROUP BY outcome")
def upsert_outcomes(spark, sf_dir):
    items = _items(spark, sf_dir)
    return S.outcome_counts(S.upsert_outcomes(items.where("arrival >= 100"), _store(items)))


@query(f"""WITH RECURSIVE {_ARRIVED}, t AS (SELECT q.arrival, q.outcome, b.h, b.url, b.content FROM q JOIN b USING (k) WHERE q.outcome IN ('inserted', 'updated')), l AS (SELECT h, arg_max(content, arrival) AS content FROM t GROUP BY h),
n AS (SELECT (SELECT max(arrival) + 1 FROM s) + row_number() OVER (ORDER BY arrival) AS id, url, h FROM t WHERE outcome = 'inserted')
SELECT s.arrival + 1 AS id, s.url, s.h AS similarity_hash, md5(coalesce(l.content, s.content)) AS content_md5 FROM s LEFT JOIN l USING (h) UNION ALL SELECT id, url, n.h, md5(l.content) FROM n JOIN l USING (h)""")
def upsert_store(spark, sf_dir):
    items = _items(spark, sf_dir)
    store = _store(items)
    after = S.apply_upsert(S.upsert_outcomes(items.where("arrival >= 100"), store), store)
    return after.select("id", "url", "similarity_hash", F.md5("content").alias("content_md5"))


@query(f"WITH {_ITEMS} SELECT count(*) AS n, count(DISTINCT h) AS n_hashes FROM (SELECT h, min(arrival) AS arrival FROM i WHERE arrival >= 100 AND h IS NOT NULL AND h NOT IN (SELECT h FROM s) GROUP BY h)")
def smart_store_new(spark, sf_dir):
    items = _items(spark, sf_dir)
    fresh = S.smart_store(items.where("arrival >= 100").drop("similarity_hash"), _store(items))
    return fresh.agg(F.count("*").alias("n"), F.count_distinct("similarity_hash").alias("n_hashes"))


@query("""WITH o AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 25 AS d FROM orders), n AS (SELECT DISTINCT o_custkey AS c, (o_orderkey + o_custkey % 2) % 30 AS d FROM orders), k AS (SELECT * FROM n WHERE d < 25)
SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM k EXCEPT SELECT * FROM o) UNION ALL SELECT 'deleted', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def link_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    old = o.select(F.col("o_custkey").alias("content_id"), (F.col("o_orderkey") % 25).cast("string").alias("domain_id"), F.lit(0.8).alias("relevance_score")).distinct()
    items = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(((F.col("o_orderkey") + F.col("o_custkey") % 2) % 30).cast("string")).alias("domains"))
    domains = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return S.link_diff(old, items, domains).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT lang AS domain, count(*) AS n FROM documents GROUP BY lang")
def counts_by_domain(spark, sf_dir):
    return S.domain_counts(_t(spark, sf_dir, "documents").withColumn("domains", F.array("lang")))


@query("WITH c AS (SELECT CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'article' ELSE 'other' END AS content_type FROM conversations), k AS (SELECT unnest(['question', 'article', 'profile', 'other']) AS content_type) SELECT k.content_type, count(c.content_type) AS n FROM k LEFT JOIN c USING (content_type) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM c")
def counts_by_type(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "article").otherwise("other")
    return S.type_counts(_t(spark, sf_dir, "conversations").select(kind.alias("content_type")))


@query("SELECT n.n_name, r.r_name, count(s.s_suppkey) AS n FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY ALL")
def reference_navigation(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    region = _t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "id")
    named = S.with_reference(nation, region, "n_regionkey", ["r_name"])
    sup = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    return named.join(sup, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("k", F.lit(0)).alias("n"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0")
def update_delete(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "id")
    changed = S.update(s, s.where("id % 5 = 0").select("id", F.lit(0.0).alias("s_acctbal"), F.lit("x").alias("unknown")))
    left = S.delete({"supplier": changed}, "supplier", s.where("id % 7 = 0"))["supplier"]
    return left.select(F.col("id").alias("s_suppkey"), "s_name", "s_acctbal")


# Classification


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a fixed rule as predictor: score is a length, prediction a bound on it."""
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), (F.length("text") > 1000).cast("int").alias("yhat"), F.floor(F.length("text") / 500).alias("score"))


_TOLD = "t AS (SELECT doc_id, quality AS y, CAST(length(text) > 1000 AS INT) AS yhat, CAST(floor(length(text) / 500) AS BIGINT) AS score FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_TOLD}, g AS (SELECT y, count(*) AS n FROM t GROUP BY y) SELECT y, n, round((SELECT count(*) FROM t) / ((SELECT count(*) FROM g) * n), 6) AS weight FROM g")
def class_weights(spark, sf_dir):
    return FE.class_weights(_told(spark, sf_dir), "y").select("y", "n", F.round("weight", 6).alias("weight"))


@query(f"WITH {_TOLD}, g AS (SELECT y, count(*) AS n FROM t GROUP BY y) SELECT y, CAST(round(n * 0.2) AS BIGINT) AS n_test, CAST(n - round(n * 0.2) AS BIGINT) AS n_train FROM g")
def stratified_split_sizes(spark, sf_dir):
    return M.split(_told(spark, sf_dir), "doc_id", "y").groupBy("y").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query(f"WITH {_TOLD}, g AS (SELECT y, yhat, count(*) AS n FROM t GROUP BY ALL) SELECT y, yhat, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM g")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_told(spark, sf_dir)).select("y", "yhat", "n", F.round("share", 6).alias("share"))


_PRF = f"""{_TOLD}, l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (y = label AND yhat = label) AS tp, count(*) FILTER (y = label) AS re, count(*) FILTER (yhat = label) AS sa FROM t, l GROUP BY label),
p AS (SELECT label, CASE WHEN sa > 0 THEN tp / sa ELSE 0 END AS p, CASE WHEN re > 0 THEN tp / re ELSE 0 END AS r, re FROM c), m AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM p)"""


@query(f"WITH {_PRF} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, re AS support FROM m")
def class_prf(spark, sf_dir):
    out = M.class_metrics(_told(spark, sf_dir))
    return _rounded(out, ["precision", "recall", "f1"])


@query(f"WITH {_PRF} SELECT round((SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0 END) FROM t), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM m")
def macro_prf(spark, sf_dir):
    return _rounded(M.macro(_told(spark, sf_dir)), ["accuracy", "precision", "recall", "f1"])


@query(f"WITH {_TOLD}, s AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM t GROUP BY score), c AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM s WINDOW w AS (ORDER BY score DESC)) SELECT score, tp, fp, round(tp / (SELECT sum(p) FROM s), 6) AS tpr, round(fp / (SELECT sum(n) FROM s), 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM c")
def roc_points(spark, sf_dir):
    return _rounded(M.curve(_told(spark, sf_dir)), ["tpr", "fpr", "precision"])


@query()
def train_quality_model(spark, sf_dir):
    """Predictions of a trained logistic model on held-out labelled documents."""
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    rows = d.select("doc_id", F.col("quality").cast("double").alias("y"), X.tokenize(X.normalize(F.col("text"))).alias("words"))
    dealt = M.split(rows, "doc_id", "y")
    model = M.train(dealt.where("NOT is_test"), "logistic")
    told = model.transform(dealt.where("is_test")).select("doc_id", "y", F.col("prediction").alias("yhat"))
    return told


# Relational reads over the larger tables


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def line_totals(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# Operators of the store, frontier and models, one each


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text", X.similarity_hash(F.col("text")).alias("similarity_hash"))


@query(f"SELECT h AS similarity_hash, min(doc_id) AS id FROM (SELECT doc_id, {_HASH} AS h FROM documents WHERE text <> '') WHERE h IN (SELECT {_HASH} FROM documents WHERE lang = 'en') GROUP BY h")
def lookup_by_hash(spark, sf_dir):
    items = _hashed(spark, sf_dir)
    return S.lookup(items.where("similarity_hash IS NOT NULL"), items.where("lang = 'en'"), "similarity_hash").select("similarity_hash", "id")


@query(f"WITH {_LINKS} SELECT url, min(page_id) AS id FROM (SELECT page_id, {_URL['plain']} AS url FROM pages) WHERE url IN (SELECT {_PLAIN.format('link')} FROM r) GROUP BY url")
def lookup_by_url(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), U.normalize_url(F.col("url")).alias("url"))
    return S.lookup(pages, _links(spark, sf_dir).select(U.normalize_url(F.col("link")).alias("url")), "url").select("url", "id")


@query("SELECT s_suppkey AS id, round(s_acctbal / 10000, 6) AS confidence FROM supplier WHERE s_acctbal / 10000 >= 0.7 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def confident_domains(spark, sf_dir):
    d = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("confidence"))
    return S.confident_domains(d).select("id", F.round("confidence", 6).alias("confidence"))


@query("SELECT s_suppkey AS id, s_acctbal AS rating FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def top_experts_of_domain(spark, sf_dir):
    e = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("rating"), "s_nationkey")
    links = e.join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("id").alias("expert_id"), F.col("n_regionkey").cast("string").alias("domain_id"))
    return S.top_experts(e, links, "1").select("id", "rating")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name), s_name FROM supplier")
def bulk_insert(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return S.insert(table, S.numbered(table, rows, ["name"]))


@query("SELECT p_partkey AS id, p_brand AS brand, CAST(NULL AS INT) AS size FROM part UNION ALL SELECT 0, 'new', NULL")
def insert_one(spark, sf_dir):
    table = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.lit(None).cast("int").alias("size"))
    return S.insert(table, spark.createDataFrame([(0, "new")], "id long, brand string"))


@query("SELECT n.n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation n ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def raw_sql(spark, sf_dir):
    tables = {"c": _t(spark, sf_dir, "customer"), "n": _t(spark, sf_dir, "nation")}
    return S.run_sql(tables, "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM {c} JOIN {n} ON n_nationkey = c_nationkey WHERE c_mktsegment = :segment GROUP BY 1", segment="BUILDING")


@query("SELECT n_nationkey AS id, 'domain_' || sha256(n_name) AS surrogate FROM nation")
def surrogate_ids(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), S.surrogate("domain", "n_name").alias("surrogate"))


@query("""SELECT n_nationkey AS id, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json, n_name AS again FROM nation""")
def json_rows(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    told = S.to_json_rows(nation)
    return S.from_json_rows(told.withColumn("keep", F.col("json")).select("json", "keep"), "n_nationkey int, n_name string").join(told.withColumn("n_nationkey", F.get_json_object("json", "$.n_nationkey").cast("int")), "n_nationkey").select(F.col("n_nationkey").alias("id"), "json", F.col("n_name").alias("again"))


@query(f"SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'question' ELSE 'article' END AS content_type, '' AS title, 0 AS view_count, 'active' AS status, CASE WHEN text <> '' THEN {_HASH} END AS similarity_hash FROM documents")
def constructed_rows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("lang") == "en", "question").alias("content_type"))
    return S.constructed(d, "content_items").select("id", "content_type", "title", "view_count", "status", "similarity_hash")


@query(f"WITH c AS (SELECT DISTINCT url, {_KIND} AS kind FROM pages WHERE contains(html, '<b>')) SELECT page_id, coalesce(kind, 'other') AS content_type, CASE WHEN kind IS NULL THEN '' ELSE 'd_' || kind END AS domains FROM pages LEFT JOIN c USING (url)")
def merged_records(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    kind = C.page_class(F.col("url"))
    told = pages.where(F.contains("html", F.lit("<b>"))).select("url", kind.alias("content_type"), F.array(F.concat(F.lit("d_"), kind)).alias("domains")).distinct()
    return S.merged(pages.select("page_id", "url"), told).select("page_id", "content_type", F.array_join("domains", ",").alias("domains"))


@query("SELECT s_suppkey AS id, s_acctbal > 0 AS indexed FROM supplier")
def index_marks(spark, sf_dir):
    items = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"), "s_acctbal")
    return S.index_mark(items, items.where("s_acctbal > 0")).select("id", F.col("indexed_at").isNotNull().alias("indexed"))


@query(f"SELECT doc_id AS id, CASE WHEN toxic = 1 THEN md5('removed ' || doc_id) WHEN text <> '' THEN {_HASH} END AS similarity_hash, CASE WHEN toxic = 1 THEN 'removed ' || doc_id ELSE text END AS content FROM documents LEFT JOIN labels USING (doc_id)")
def content_updates(spark, sf_dir):
    items = _hashed(spark, sf_dir).select("id", F.col("text").alias("content"), "similarity_hash")
    texts = _t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.concat(F.lit("removed "), F.col("doc_id")).alias("content"))
    return S.replace_content(items, texts)


@query("""WITH w AS (SELECT n_regionkey AS region, n_name AS word, CAST(length(n_name) AS DOUBLE) AS score FROM nation WHERE n_name <> 'CHINA' UNION ALL SELECT r_regionkey, 'law', 9.5 FROM region),
p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, word) AS place FROM w) SELECT region, string_agg(word, ',' ORDER BY place) FILTER (place <= 3) AS top, count(*) AS n FROM p GROUP BY region""")
def word_maps(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.length("n_name").cast("double")))).alias("words"))
    words = S.drop_word(S.add_word(F.col("words"), "law", 9.5), "CHINA")
    return n.select("region", F.array_join(S.top_words(words, 3), ",").alias("top"), F.size(words).cast("long").alias("n"))


@query(f"WITH {_LINKS}, a AS (SELECT split_part(regexp_replace({_PATH.format('link')}, '^/', ''), '/', 1) AS pattern, link AS url, page_id AS arrival FROM r), f AS (SELECT pattern, url, min(arrival) AS arrival, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY arrival, url) AS place FROM f) SELECT pattern, string_agg(url, ' ' ORDER BY place) FILTER (place <= 5) AS samples, CAST(sum(n) AS BIGINT) AS url_count FROM p GROUP BY pattern")
def pattern_samples(spark, sf_dir):
    rows = _links(spark, sf_dir)
    rows = rows.select(F.split_part(F.regexp_replace(U.path(F.col("link")), "^/", ""), F.lit("/"), F.lit(1)).alias("pattern"), F.col("link").alias("url"), F.col("page_id").alias("arrival"))
    return N.add_samples(rows).select("pattern", F.array_join("sample_urls", " ").alias("samples"), "url_count")


@query("SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 30 ELSE 180 END AS DOUBLE) AS minutes FROM events")
def sleep_times(spark, sf_dir):
    phase = F.when(F.col("event_type") == "view", "initial").when(F.col("event_type") == "click", "active").otherwise("steady")
    return _t(spark, sf_dir, "events").select("event_id", F.round(C.sleep_minutes(phase, draw=F.lit(0.5)), 6).cast("double").alias("minutes"))


@query("SELECT url, 'page' AS job_type FROM pages")
def start_urls(spark, sf_dir):
    from siltstone.sources.web import start_sources

    none = spark.createDataFrame([], "sitemap string")
    return start_sources(none, _t(spark, sf_dir, "pages").select("url"), "https://root.example").select("url", "job_type")


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS y FROM documents WHERE lang IS NOT NULL")
def label_numbers(spark, sf_dir):
    return M.label_index(_t(spark, sf_dir, "documents").where("lang IS NOT NULL"), "lang").select("doc_id", "y")


@query("SELECT doc_id, CAST(lang = 'de' AS INT) AS y_de, CAST(lang = 'en' AS INT) AS y_en, CAST(source = 'src1' AS INT) AS y_src1 FROM documents")
def multi_hot_labels(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("labels", F.array("lang", "source"))
    return M.multi_hot(d, "labels", ["src1", "en", "de"]).select("doc_id", "y_de", "y_en", "y_src1")


@query(r"SELECT page_id, md5(regexp_replace(html, '<.*?>', '', 'g')) AS bare FROM pages")
def stripped_pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("bare"))


@query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN len(w) < 5 THEN '' ELSE md5(array_to_string(w, ' ')) END AS digest FROM t")
def preprocessed_texts(spark, sf_dir):
    plain = X.preprocess(F.col("n"), 5, [])
    return _docs(spark, sf_dir).select("doc_id", plain.alias("p")).select("doc_id", F.when(F.col("p") == "", "").otherwise(F.md5("p")).alias("digest"))


@query(f"WITH d AS (SELECT doc_id, text, md5({_N}) AS h FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, coalesce(a.text <> '' AND b.text <> '' AND a.h = b.h AND least(length(a.text), length(b.text)) / greatest(length(a.text), length(b.text)) >= 0.8, false) AS same FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def similar_neighbours(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    a, b = d.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), d.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", X.similar(F.col("ta"), F.col("tb")).alias("same"))


@query(f"{_PATTERNS} SELECT pattern, '^' || replace(pattern, '*', '.*?') || '$' AS regex FROM o")
def pattern_regexes(spark, sf_dir):
    return N.heuristic_patterns(_t(spark, sf_dir, "pages")).select("pattern", U.pattern_regex(F.col("pattern")).alias("regex"))


@query(f"""WITH {_PRF}, g AS (SELECT y, yhat, count(*) AS n FROM t GROUP BY ALL) SELECT 'class' AS part, CAST(label AS VARCHAR) AS name, 'precision' AS measure, round(p, 6) AS value FROM m UNION ALL SELECT 'class', CAST(label AS VARCHAR), 'recall', round(r, 6) FROM m UNION ALL SELECT 'class', CAST(label AS VARCHAR), 'f1', round(f, 6) FROM m UNION ALL SELECT 'class', CAST(label AS VARCHAR), 'support', re FROM m
UNION ALL SELECT 'all', '', 'accuracy', round((SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0 END) FROM t), 6) UNION ALL SELECT 'all', '', 'precision', round(avg(p), 6) FROM m UNION ALL SELECT 'all', '', 'recall', round(avg(r), 6) FROM m UNION ALL SELECT 'all', '', 'f1', round(avg(f), 6) FROM m
UNION ALL SELECT 'confusion', y || '>' || yhat, 'n', n FROM g""")
def evaluation_report(spark, sf_dir):
    return M.report(_told(spark, sf_dir)).withColumn("value", F.round("value", 6))
