"""Store, frontier, patterns, sources, models and streams on small cases."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.lexicon import CONTENT_TYPES, DOMAINS
from siltstone.functions.text import similarity_hash
from siltstone.operators import features as FE
from siltstone.operators import frontier as C
from siltstone.operators import models as M
from siltstone.operators import store as S
from siltstone.operators import urlmining as N
from siltstone.sources import files, web
from siltstone.sources.schemas import empty, schema


def store_of(spark, rows):
    df = spark.createDataFrame(rows, "id long, url string, title string, content string, content_type string, meta_data string")
    return df.withColumn("similarity_hash", similarity_hash(F.col("content")))


def batch_of(spark, rows):
    df = spark.createDataFrame(rows, "arrival long, url string, title string, content string, content_type string, meta_data string")
    return df.withColumn("similarity_hash", similarity_hash(F.col("content")))


def sequential(batch, store):
    """Outcomes by storing one row after the other."""
    hashes, urls, out = {r.similarity_hash for r in store}, {r.url for r in store}, {}
    for r in sorted(batch, key=lambda r: r.arrival):
        if not r.content:
            out[r.arrival] = "rejected_empty"
        elif r.similarity_hash in hashes:
            out[r.arrival] = "updated"
        elif r.url in urls:
            out[r.arrival] = "rejected_url_conflict"
        else:
            out[r.arrival] = "inserted"
            hashes.add(r.similarity_hash)
            urls.add(r.url)
    return out


def test_upsert(spark):
    store = store_of(spark, [(1, "u1", "t", "old text", "article", None)])
    import random

    rng = random.Random(4)
    rows = [(1, "u9", "n", "old text", "question", "m"), (2, "u1", "n", "new text", "article", None), (3, "u2", "n", "new text", "article", None), (4, "u3", "n", "", "article", None), (5, "u4", "n", None, "article", None)]
    rows += [(10 + i, f"v{rng.randrange(12)}", f"t{i}", f"text {rng.randrange(15)}", "article", None) for i in range(60)]
    batch = batch_of(spark, rows)
    out = S.upsert_outcomes(batch, store)
    got = {r.arrival: r.outcome for r in out.collect()}
    assert got == sequential(batch.collect(), store.collect())
    after = S.apply_upsert(out, store).collect()
    old = next(r for r in after if r.id == 1)
    assert old.url == "u1" and old.title == "n" and old.content_type == "question"
    assert len({r.similarity_hash for r in after}) == len(after) == 1 + sum(o == "inserted" for o in got.values()) and len({r.id for r in after}) == len(after)
    again = S.upsert_outcomes(batch, S.apply_upsert(out, store))
    assert not again.where("outcome = 'inserted'").count()


def test_links(spark):
    domains = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    old = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5)], "content_id long, domain_id string, relevance_score double")
    items = spark.createDataFrame([(1, ["b", "c", "zz"])], "id long, domains array<string>")
    diff = S.link_diff(old, items, domains)
    assert sorted((r.domain_id, r.change, r.relevance_score) for r in diff.collect()) == [("a", "deleted", 0.5), ("c", "added", 0.8)]
    assert sorted((r.content_id, r.domain_id) for r in S.apply_links(old, diff).collect()) == [(1, "b"), (1, "c"), (2, "a")]


def test_rows(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}", float(i)) for i in range(1, 11)], "id long, name string, rating double")
    assert [r.id for r in S.page(df, 1, 2, name="n1", nothing=3).collect()] == [4, 7] and S.count(df, name="n1").first().n == 4
    assert S.by_id(df, 99).count() == 0
    up = S.update(df, spark.createDataFrame([(2, None, 9.0), (99, "x", 1.0)], "id long, name string, rating double"))
    assert next(r for r in up.collect() if r.id == 2) == (2, "n2", 9.0) and up.count() == 10
    tables = {"experts": df, "answers": spark.createDataFrame([(1, 5, 2), (2, 5, 3)], "id long, content_id long, expert_id long")}
    left = S.delete(tables, "experts", spark.createDataFrame([(2,)], "id long"))
    assert left["experts"].count() == 9 and [r.expert_id for r in left["answers"].collect()] == [3]
    new = S.numbered(df, spark.createDataFrame([("z", 5), ("y", 3)], "name string, k int"), ["k"])
    assert sorted((r.id, r.name) for r in new.collect()) == [(11, "y"), (12, "z")]
    assert [r.id for r in S.top_experts(df, limit=2).collect()] == [10, 9]
    m = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))
    r = spark.range(1).select(S.top_words(S.add_word(m, "c", 3.0), 2).alias("t"), S.add_word(m, "a").alias("same"), S.drop_word(m, "a").alias("d")).first()
    assert r.t == ["c", "b"] and r.same == {"a": 1.0, "b": 2.0} and r.d == {"b": 2.0}
    assert S.type_counts(empty(spark, "content_items")).count() == 5 and schema("domains").fieldNames()[0] == "id"
    back = S.from_json_rows(S.to_json_rows(df), "id long, name string, rating double")
    assert sorted(back.collect()) == sorted(df.collect())


@pytest.mark.parametrize(("phase", "processed", "new", "minutes", "want"), [("initial", 101, 0, 0, "active"), ("initial", 100, 0, 60, "initial"), ("active", 1001, 250, 0, "active"), ("active", 1001, 100, 0, "steady"), ("steady", 5001, 200, 0, "maintenance"), ("maintenance", 9999, 0, 9999, "maintenance")])
def test_phases(spark, phase, processed, new, minutes, want):
    assert C.next_phase(phase, processed, new, minutes) == want
    assert spark.range(1).select(C.phase_column(F.lit(phase), F.lit(processed), F.lit(new), F.lit(float(minutes)))).first()[0] == want


def test_frontier(spark):
    seen = spark.createDataFrame([("http://h/a",)], "url string")
    cand = spark.createDataFrame([("http://h/a?x", 1, "p", None), ("http://h/b", 9, "p", None), ("http://g/c", 1, "p", None), ("http://h/blog/d", 2, "p", None), ("http://h/blog/d#z", 1, "p", None), ("http://g/s.xml", 9, "p", "sitemap")], "url string, depth int, parent_url string, job_type string")
    got = {r.url: r for r in C.enqueue(cand, seen, "h").collect()}
    assert {k: v.outcome for k, v in got.items()} == {"http://h/a": "skipped_visited", "http://h/b": "skipped_depth", "http://g/c": "skipped_host", "http://h/blog/d": "queued", "http://g/s.xml": "queued"}
    assert got["http://h/blog/d"].depth == 1 and got["http://h/blog/d"].job_type == "list"
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "src string, dst string")
    assert {(r.url, r.depth) for r in C.waves(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r.url for r in N.discover_site(edges, "a", 3).orderBy("place").collect()] == ["a", "b", "c"]
    hist = spark.createDataFrame([(f"u{i}", i) for i in range(12)], "url string, visited_at long")
    assert C.evict(hist, 10, 3).count() == 9 and C.evict(hist, 12, 3).count() == 12
    pages = spark.createDataFrame([("http://h/", 0, "<a href='/x'>x</a>", None, 200), ("http://h/e", 0, None, "boom", None)], "url string, depth int, html string, error string, status_code int")
    wave = C.process_wave(pages)
    assert [r.url for r in wave["children"].collect()] == ["http://h/x"] and [r.error for r in wave["failed"].collect()] == ["boom"] and wave["visited"].count() == 1


def test_patterns(spark):
    urls = spark.createDataFrame([(f"http://h/news/{i}",) for i in range(12)] + [("http://h/about",)], "url string")
    pats = {r.pattern: r for r in N.heuristic_patterns(urls).collect()}
    assert set(pats) == {"h/news/*", "http://h/about"} and pats["h/news/*"].is_detail and pats["h/news/*"].url_count == 12 and len(pats["h/news/*"].sample_urls) == 5
    ordered = N.heuristic_patterns(urls).withColumn("ordinal", F.length("pattern"))
    m = {r.url: r for r in N.match_patterns(spark.createDataFrame([("http://h/news/99",), ("http://z/q",)], "url string"), ordered).collect()}
    assert m["http://h/news/99"].pattern == "h/news/*" and m["http://z/q"].weight == 0.1
    sec = {r.position: r for r in N.sections(urls).collect()}
    assert sec[0]["values"] == ["about", "news"] and sec[1].kind == "numeric"
    assert N.discovered_patterns(urls).count() >= 1
    stored = spark.createDataFrame([("http://h/a/b/c/1", "detail", {"title": "h1"}, 1)], "url string, page_type string, selectors map<string,string>, ordinal int")
    look = N.match_selectors(spark.createDataFrame([("http://h/a/b/c/2", "detail"), ("http://h/x/b/c/2", "detail")], "url string, page_type string"), stored)
    assert {r.url: r.selectors for r in look.collect()} == {"http://h/a/b/c/2": {"title": "h1"}, "http://h/x/b/c/2": {}}


def test_sources(spark, tmp_path):
    seed = tmp_path / "seed.json"
    seed.write_text('{"domains":[{"id":"d1","name":"n","description":"x","keywords":["a","b"]}],"experts":[{"name":"e","bio":"b","expertise":["a"],"profile_url":"p","avatar_url":"q"}],"expert_domains":[{"expert_id":1,"domain_id":"d1"}]}')
    got = files.seed(spark, str(seed))
    assert got["domains"].first().keywords == {"a": 1.0, "b": 1.0} and got["expert_domain"].first().confidence_score == 0.8 and got["experts"].first().id == 1
    assert files.seed(spark, str(tmp_path / "none.json"))["domains"].count() == 0
    t = files.synthetic_types(spark, 40, CONTENT_TYPES)
    assert t.count() == 40 and t.select("content_type").distinct().count() > 2
    d = files.synthetic_domains(spark, 20, DOMAINS).collect()
    assert all(1 <= len(r.domains) <= 3 and r.text for r in d)
    text = "User-agent: *\nDisallow: /no\nCrawl-delay: 7\nSitemap: http://h/s.xml\nSITEMAP:http://h/t.xml"
    robots = spark.createDataFrame([("h", text)], "host string, text string")
    jobs = spark.createDataFrame([("http://h/no/x",), ("http://h/yes",), ("http://g/no",)], "url string")
    gate = {r.url: (r.allowed, r.crawl_delay) for r in web.robots_gate(jobs, robots).collect()}
    assert gate["http://h/no/x"] == (False, 7.0) and gate["http://h/yes"] == (True, 7.0) and gate["http://g/no"][0]
    assert sorted(r.sitemap for r in web.sitemaps_in_robots(robots).collect()) == ["http://h/s.xml", "http://h/t.xml"]
    maps = [("i", 0, "<sitemapindex xmlns='x'><sitemap><loc>a</loc></sitemap></sitemapindex>"), ("u", 2, "<urlset><url><loc> b </loc></url></urlset>"), ("t", 0, "# c\n\nhttp://x/\n"), ("n", 0, None)]
    out = web.sitemap_entries(spark.createDataFrame(maps, "url string, depth int, text string")).collect()
    assert sorted((r.url, r.depth, r.loc) for r in out) == [("i", 1, "a"), ("t", 0, "http://x/"), ("u", 0, "b")]
    state = {"visited": jobs}
    files.save_checkpoint(state, str(tmp_path / "c"))
    assert files.load_checkpoint(spark, str(tmp_path / "c"), ["visited", "failed"])["visited"].count() == 3


def test_structure(spark):
    r = spark.range(1).select(FE.structural(F.lit("چرا این شد؟ بله. خیر!")).alias("s")).select("s.*").first()
    assert (r.text_length, r.word_count, r.sentence_count, r.avg_sentence_length, r.avg_word_length, r.unique_words_ratio, round(r.punctuation_ratio * 21)) == (21, 5, 3, 6.0, 3.4, 1.0, 3)
    q = spark.range(1).select(FE.type_structure(F.lit("چرا این شد؟ بله"))["starts_with_question"]).first()[0]
    assert q == 1.0
    df = spark.createDataFrame([(1, "the the of"), (2, "zzz")], "doc_id long, t string")
    s = {r.doc_id: (r.a, r.b) for r in FE.with_keyword_scores(df, F.col("t"), {"a": ["the"], "b": ["of", "x"]}).collect()}
    assert s == {1: (0.8, 0.2), 2: (0.0, 0.0)}


def test_models(spark):
    rows = [(i, ["good", "fine", f"w{i % 4}"] if i % 3 else ["bad", "poor", f"w{i % 4}"], float(bool(i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>, y double")
    dealt = M.split(df, "doc_id", "y")
    assert dealt.where("is_test").count() == 12
    for kind in ("logistic", "svm"):
        model = M.train(dealt.where("NOT is_test"), kind)
        told = model.transform(dealt.where("is_test")).withColumn("yhat", F.col("prediction"))
        assert M.macro(told).first().f1 == 1.0
    assert M.importances(model, 3).count() == 3
    points = M.curve(spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, score double"))
    assert M.auc(points).first().auc == 0.75
    p = spark.range(1).select(M.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p"), M.sigmoid_pair(F.lit(0.0)).alias("s")).first()
    assert p.p == [0.5, 0.5] and p.s == [0.5, 0.5]
    y = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], "i int, d array<string>")
    assert [(r.y_a, r.y_b) for r in M.multi_hot(y, "d", ["b", "a"]).orderBy("i").collect()] == [(1, 0), (1, 1)]
    told = spark.createDataFrame([("قانون چیست؟ جرم و مجازات", 1)], "text string, i int")
    r = M.classify(told).first()
    assert r.content_type == "question" and r.domains[0] == "criminal" and r.analysis.has_question_mark and "چیست" in r.analysis.question_indicators


def test_streams(spark, tmp_path):
    from siltstone.streaming.crawl import phase_stream, read_store, upsert_stream

    steps = [("s", i, 60, 1, float(i)) for i in range(30)] + [("t", i, 10, 1, float(i * 40)) for i in range(10)]
    df = spark.createDataFrame(steps, "site string, at long, processed long, new long, minutes double")
    df.write.parquet(str(tmp_path / "in"))
    q = phase_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("phases").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = C.phase_history(df).select("site", "at", "phase", "processed", "new").collect()
    assert sorted(spark.table("phases").collect()) == sorted(want)
    rows = batch_of(spark, [(1, "u", "t", "some text", "article", None), (2, "v", "t", "some text", "article", None)]).drop("similarity_hash")
    rows.write.parquet(str(tmp_path / "b"))
    upsert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "b")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert read_store(spark, str(tmp_path / "store"), 0).count() == 1


def test_upsert_rounds_decide_whole_groups(spark):
    """Ten thousand rows of one hash at known urls, and chains of hashes and urls, against a loop."""
    from siltstone.operators import store as S

    store = spark.range(10_000).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("h"), "id").alias("similarity_hash"))
    batch = spark.range(10_000).select(F.col("id").alias("arrival"), F.concat(F.lit("u"), "id").alias("url"), F.lit("x").alias("content"), F.lit("error").alias("similarity_hash"))
    more = spark.createDataFrame([(20_000, "free", "x", "error"), (20_001, "other", "x", "error"), (20_002, "free", "x", "late")], batch.schema)
    rounds = []
    import siltstone.operators.store as module

    real = module.cut
    module.cut = lambda df: rounds.append(1) or real(df)
    try:
        got = {r.outcome: r.n for r in S.outcome_counts(S.upsert_outcomes(batch.union(more), store)).collect()}
    finally:
        module.cut = real
    assert got == {"rejected_url_conflict": 10_001, "inserted": 1, "updated": 1} and len(rounds) <= 6


def test_upsert_against_a_loop(spark):
    import random

    from siltstone.operators import store as S

    rng = random.Random(2)
    old = [(f"u{i}", f"h{i}") for i in range(4)]
    rows = [(k, f"u{rng.randrange(12)}", rng.choice(["x", "x", "x", "", None]), f"h{rng.randrange(14)}") for k in range(200)]
    urls, hashes, want = {u for u, _ in old}, {h for _, h in old}, {}
    for k, u, c, h in rows:
        if not c:
            want[k] = "rejected_empty"
        elif h in hashes:
            want[k] = "updated"
        elif u in urls:
            want[k] = "rejected_url_conflict"
        else:
            want[k] = "inserted"
            urls.add(u)
            hashes.add(h)
    out = S.upsert_outcomes(spark.createDataFrame(rows, "arrival long, url string, content string, similarity_hash string"), spark.createDataFrame(old, "url string, similarity_hash string"))
    assert {r.arrival: r.outcome for r in out.collect()} == want


def test_similarity_hash_reads_the_start_of_long_texts(spark):
    """The same hash as of the whole normalized text, made from its start where that is enough."""
    import hashlib

    from siltstone.functions.text import plain

    gap, marks = " \n\t\u2003" * 900, "e\u0301" * 1400
    odd = ["a b " * 900, gap + "x " * 900 + gap + "end", marks + " tail" * 300, "\ufb01 \u00bd \ud55c" * 700, "a" * 1499 + " " + "b" * 50, "a" * 999 + gap + "b" * 900, ("x" * 200 + gap) * 6, "\U0001f600\u2019\u00a0\u00a8" * 600, "a" * 1400 + "\ufb01" * 300, " " * 5000, "short \u00e9", "\u0301" * 1600 + "abc", "ab" + "\u0301" * 1600 + "\ufb01" * 1200]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string").repartition(2)
    got = {r.i: r.h for r in df.select("i", similarity_hash(F.col("t")).alias("h")).collect()}
    assert got == {i: hashlib.md5(plain(t)[:1000].encode()).hexdigest() for i, t in enumerate(odd)}
    many = spark.range(2000).select(F.concat(F.repeat(F.lit("w\u00e9 "), 700), F.col("id").cast("string")).alias("t"))
    plan = many.select(similarity_hash(F.col("t")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert "1500" in plan  # only starts are normalized for all texts


def test_upsert_makes_hashes_once(spark):
    """Hashing is the dear part: outcomes and the store after them read each text's hash from one pass."""
    from siltstone.operators import store as S

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def hashed(text):
        made.add(1)
        return f"h{text}"

    batch = spark.range(40).select(F.col("id").alias("arrival"), F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("url"), F.concat(F.lit("c"), (F.col("id") % 10).cast("string")).alias("content"))
    batch = batch.withColumn("similarity_hash", hashed("content"))
    store = spark.createDataFrame([(1, "u0", "old", "hc3")], "id long, url string, content string, similarity_hash string")
    outcomes = S.upsert_outcomes(batch, store)
    after = {r.similarity_hash: (r.id, r.url, r.content) for r in S.apply_upsert(outcomes, store).collect()}
    assert after["hc3"] == (1, "u0", "c3") and len(after) == 7 and made.value == 40


def test_normalize_by_tables(spark):
    """Marks, gaps and characters that decompose into several, against Python; marks went through a pattern of 300 ranges a character."""
    import random

    from siltstone.functions import text as X

    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\x85", "\xa0", "\u2009", "\u200c", "\u0301", "\u0344", "\u3099", "é", "ß", "…", "½", "ﬁ", "한", "ك", "٣", "¨", "a", "b", "😀", "𝐀", "\U0001d165"]
    texts = ["".join(rng.choices(parts, k=rng.choice([1, 3, 8, 40]))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize(F.col("t")).alias("n")).collect()
    assert all(r.n == X.plain(r.t) for r in got)
    plan = spark.createDataFrame([("a",)], "t string").select(X.normalize(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "\\x{300}-" not in plan


def test_selectors_of_a_large_host(spark):
    """The first similar page of 20,000 on one host, which made 400 million pairs; long paths go by blocks."""
    import time

    pages = spark.range(20_000).select(F.concat(F.lit("http://h/"), F.concat_ws("/", (F.col("id") % 10).cast("string"), (F.col("id") % 7).cast("string"), F.lit("x"), F.col("id").cast("string"))).alias("url"), F.lit("detail").alias("page_type"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("selectors"), F.col("id").alias("ordinal"))
    began = time.perf_counter()
    got = N.match_selectors(pages.select("url", "page_type"), pages).select("url", "selectors.k").collect()
    assert time.perf_counter() - began < 120
    assert len(got) == 20_000 and all(int(r.k) == int(r.url.rsplit("/", 1)[1]) % 70 for r in got)
    long = "http://h/" + "/".join("abcdefghijklmnopqrst")
    stored = spark.createDataFrame([(long.replace("/c/d/e/f/g/", "/1/2/3/4/5/"), "list", {"k": "b"}, 2), (long.replace("/a/b/c/d/e/f/", "/1/2/3/4/5/6/"), "list", {"k": "a"}, 1)], "url string, page_type string, selectors map<string,string>, ordinal int")
    assert [r.selectors for r in N.match_selectors(spark.createDataFrame([(long, "list")], "url string, page_type string"), stored).collect()] == [{"k": "b"}]


@pytest.mark.parametrize("eps, at_once", [(0.3, 2_000_000), (0.3, 5), (0.02, 5), (0.0005, 5)])
def test_linked_vectors_against_all_pairs(spark, monkeypatch, eps, at_once):
    """Boxes halved to the end, and pairs compared at once, give the components of all pairs."""
    import random

    import numpy as np

    monkeypatch.setattr(N, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(7)
    points = {tuple(float(rng.choice([0, -1, -2, rng.randrange(10**6)])) for _ in range(4)) for _ in range(60)}
    for k in range(40):  # two crowded places, close to each other
        points.add((1e5 + k, 3e5, 0.0, float(k % 3)))
        points.add((1e5 + k, 3.2e5, 1e4, float(k % 5)))
    points = sorted(points | {(0.0, 0.0, 0.0, 0.0)})
    m = np.array(points)
    norm = np.sqrt((m * m).sum(1))
    near = 1 - (m @ m.T) / np.maximum(np.outer(norm, norm), 1e-9) <= eps
    of = list(range(len(points)))
    for i in range(len(points)):
        for j in np.flatnonzero(near[i][:i]):
            x, y = sorted((of[i], of[j]))
            of = [x if k == y else k for k in of]
    want = {i: of[i] for i in range(len(points)) if of.count(of[i]) > 1}
    nodes = spark.createDataFrame([(i, list(map(float, p)), float(norm[i])) for i, p in enumerate(points)], "node long, v array<double>, norm double")
    assert {r.node: r.component for r in N.linked_vectors(nodes, 4, eps).collect()} == want


def test_frequent_counts(spark):
    """Documents are counted only for frequent terms, yet the vocabulary is that of all counts, also where most frequent terms are out of bounds."""
    rows = [(i, [*["the"] * 3, f"w{i % 9}", f"w{i % 4}", "x"]) for i in range(40)]
    rows += [(100 + i, [f"once{i}"] * 30) for i in range(40)]  # frequent, but in one document each
    docs = spark.createDataFrame(rows, "doc_id long, w array<string>")
    whole = FE.vocabulary(FE.term_counts(docs, F.col("w"), "doc_id", 2), 80, 12, 2, 0.4).orderBy("rank").collect()
    few = FE.vocabulary(FE.frequent_counts(docs, F.col("w"), "doc_id", 2, 80, 12, 2, 0.4), 80, 12, 2, 0.4).orderBy("rank").collect()
    assert few == whole and len(few) == 12


def test_features_read_texts_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        made.add(1)
        return text

    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("جرم the word "), (F.col("id") % 5).cast("string"), F.lit(" of all.")).alias("text")).withColumn("text", read("text"))
    assert FE.feature_blocks(docs).count() == 30 and FE.feature_blocks(docs).collect() and made.value == 60


def test_keyword_hits_without_case(spark):
    from siltstone.functions import text as X

    rows = [("جرم و قتل، جرم",), ("plain text",), ("",), (None,), ("جرمx قتل",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(X.keyword_hits(F.col("t"), ["جرم", "قتل"]).alias("n")).collect()]
    assert got == [3, 0, 0, None, 1]


def test_entities_are_pluggable(spark):
    from siltstone.functions import html as H

    page = "<html><body><article><p>Ada Lovelace wrote to Charles Babbage about the engine, and he wrote back to her.</p></article></body></html>"
    df = spark.createDataFrame([("https://h/a", page), ("https://h/b", "")], "url string, html string")
    names = lambda text: {"person": [w for w in text.split() if w in ("Ada", "Charles")]}
    got = [r.r.entities for r in df.select(H.extract_fields(F.col("url"), F.col("html"), names).alias("r")).collect()]
    assert got == [{"person": ["Ada", "Charles"]}, {}]
    assert [r.r.entities for r in df.select(H.extract_fields(F.col("url"), F.col("html")).alias("r")).collect()] == [{}, {}]
