"""Main text and vectors, against samples and brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm.htmltext import Tree, blocks, extract, labelled, main_text
from siltstone.llm.vectors import Code, near_vectors

TREE = Tree(*labelled())


def test_tree_on_other_sample_pages():
    x, y = labelled(200, seed=7)
    kept = TREE.predict(x) >= 0.5
    assert (kept == y).mean() > 0.98 and kept[y == 1].mean() > 0.98
    none = x[:, 6] == 0  # pages without an article element
    assert none.mean() > 0.4 and (x[none & kept & (y == 1), 0].sum() / x[none & (y == 1), 0].sum()) > 0.99


def test_link_density_and_neighbours_decide():
    rules = TREE.rules()
    assert rules.startswith("link_density") and all(f in rules for f in ("words_before", "density_before", "words_after", "density_after"))
    run, menu = "word " * 30, "<a href=/>" + "word " * 30 + "</a>"
    page = f"<div>{menu}</div><p>{run}.</p><p>{run}.</p><p>word word</p><p>{run}.</p><div>{menu}</div><p>word word</p><div>{menu}</div>"
    assert main_text(page, TREE).count("word") == 92


def sentences(*sizes):
    return [" ".join(["Word"] * n) + "." for n in sizes]


def test_all_article_text_is_kept():
    """Paragraphs of any length, with and without an article element, stray quotes and unclosed media around."""
    rng = np.random.default_rng(3)
    for k in range(60):
        own = sentences(*rng.integers(5, 500, rng.integers(2, 9)))
        odd = ['<p class="a"">', "<p title=it's>", "<p data-x='1' \">", "<p><audio src=x>", "<p><video controls>", "<p><object>", "<p><svg>", "<p>"]
        body = "".join(f"{odd[int(rng.integers(len(odd)))]}{x}</p>" for x in own)
        around = ("<article>", "</article>") if k % 2 else ("<div>", "</div>")
        page = f"<nav><a href=/>Home</a> <a href=/n>News</a></nav>{around[0]}<h1>A title here</h1>{body}{around[1]}<footer>Owned by us.</footer>"
        assert main_text(page, TREE) == "\n".join(["A title here", *own]), k
    assert main_text(f"<p>{sentences(40)[0]}</p>", TREE) == sentences(40)[0]
    assert main_text('<article><p class="open>Never closed.</p><p>Goes on.</p></article>', TREE) == "Never closed.\nGoes on."



def test_main_text_cases():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav>
    <article><h1>A &amp; B&nbsp;C</h1><p>First   line<br>goes on <b>bold</b>ly.<p>Second &lt;p&gt; &#233;</article>
    <div class="ad">Buy now</div><div id="comments"><p>I like it a lot.</p></div><footer>&copy; us</footer><!-- <p>x</p> --></body>"""
    assert main_text(page, TREE) == "A & B C\nFirst line goes on boldly.\nSecond <p> é"
    assert main_text("", TREE) == "" and main_text("<p", TREE) == "" and main_text("<script>never closed <p>x", TREE) == ""
    assert main_text("<article><p>so <math><mi>x</mi><mo>=</mo></math> holds<svg><text>no</text></svg><video>none</video></p><p>A &am<b>p;</b>", TREE) == "so x= holds\nA &amp;"
    assert main_text("<article><section class='legal-analysis'><h2>On law</h2><p>It is so.</p></section><div class=notice>Note</div></article>", TREE) == "On law\nIt is so."
    assert main_text("<article>5 < 6 and a <b title='>'>tag</b>", TREE) == "5 < 6 and a tag"
    texts, x = blocks("<p>a b <a href=x>c d</a></p><p>e</p>")
    assert texts == ["a b c d", "e"] and x[0, 1] == 0.5 and x[1, 2] == 4


def test_extract_pages(spark, sf):
    odd = [(1, "u", None), (1, "u", None), (None, None, "<article>x</article>"), (2, "v", "<main>" + "long text " * 50_000 + "</main>")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted(((r.page_id or 0, r.url, r.text[:9], r.n_chars) for r in extract(df).collect()), key=str)
    assert got == [(0, None, "x", 1), (1, "u", "", 0), (1, "u", "", 0), (2, "v", "long text", 499_999)]
    assert extract(df.where("false")).count() == 0
    import html
    import re

    for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(b for b in parts if b)


def brute(rows, bound):
    good = {n: np.array(v, float) for n, (i, v, lab) in enumerate(rows) if v and lab is not None and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = {n: set() for n in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= bound:
                    links[a].add(b)
    return links


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        centre = rng.normal(size=64)
        for _ in range(1 + k % 6):
            spread = 0.3 * rng.random()
            rows.append((len(rows), [float(x) for x in centre + spread * rng.normal(size=64)], k % 3))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 1), (1002, None, 1), (1003, [0.0] * 64, 1), (1004, [float("nan")] * 64, 1), (1005, [None] * 64, 1), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [], 0), (1010, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("k1", "a", "size", "id", "vec", "component")})
    links = brute(rows, 0.93)
    for tile in (1024, 8):
        got = {r.vec_id: r for r in near_vectors(df, tile=tile).collect()}
        assert sum(r.n_links for r in got.values()) >= 0.95 * sum(map(len, links.values()))
        for n, (i, *_) in enumerate(rows):
            assert got[i].n_links <= len(links[n])
        assert got[1000].component_id == got[1010].component_id == 0 and got[1008].component_id == 1007 and got[1001].component_id == 1001
        assert all(got[i].n_links == 0 and got[i].kept for i in (1002, 1003, 1004, 1005, 1006, 1009))
    assert near_vectors(df.where("false")).count() == 0


def test_recall_by_cosine():
    """Shares of pairs that meet in a filter, at the bound and above, for small and for large codes."""
    rng = np.random.default_rng(1)
    for words in (128, 700):
        code = Code(64, words, 12, 8)
        for cosine, least in ((0.93, 0.93 if words == 128 else 0.9), (0.96, 0.975)):
            x, z = rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            z -= (z * x).sum(1, keepdims=True) * x
            z /= np.linalg.norm(z, axis=1, keepdims=True)
            y = cosine * x + math.sqrt(1 - cosine**2) * z
            met = [len(np.intersect1d(p, q)) > 0 for p, q in zip(code.decode(x), code.decode(y), strict=True)]
            assert np.mean(met) > least, (words, cosine, np.mean(met))
