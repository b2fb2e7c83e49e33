"""Text, URL and HTML functions on hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as X
from siltstone.functions import urls as U
from siltstone.functions.dom import parse

NORMAL = [
    ("كتاب‌ي  مدرسة", "کتاب ی مدرسه", "59945affd73e0871d954328fb1444e58"),
    ("آيا ١٢٣؟", "ایا 123؟", "b706edce45ca6cc566e75b36556a484a"),
    ("  Élan\tﬁn½ ", "Elan fin1⁄2", "2f7b448a8f82254a2f05d30f2bb1826c"),
    ("مُجرِم\n\nجرم", "مجرم جرم", "72b92cdf3a457f7aadfd5eb24ea9bbd9"),
    (None, "", None),
    ("", "", None),
]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_normalize(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(NORMAL)], "i int, t string")
    got = {r.i: r for r in df.select("i", X.normalize_exact(F.coalesce("t", F.lit(""))).alias("exact"), X.normalize(F.col("t")).alias("fast"), X.similarity_hash(F.col("t")).alias("h")).collect()}
    for i, (_, want, digest) in enumerate(NORMAL):
        assert got[i].exact == want
        assert got[i].fast == want and got[i].h == digest


def test_normalize_every_character(spark):
    texts = ["a" + "".join(chr(n) for n in range(k, min(k + 64, 0x110000)) if not 0xD800 <= n <= 0xDFFF) + "z" for k in range(0x20, 0x110000, 64 * 37)]
    texts += ["".join(map(chr, range(k, k + 64))) for k in range(0x80, 0x700, 64)] + ["한글 ﬃ ㎏ 𝐀𝐁 Ⅷ ½ é", "日本 ｶﾞ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", X.normalize(F.col("t")).alias("x")).collect():
        assert r.x == X.plain(texts[r.i]), r.i


def test_tokens(spark):
    tok = lambda t: one(spark, x=X.tokenize(X.normalize(F.lit(t)))).x
    assert tok("a,b c-d") == ["ab", "cd"]
    assert tok("جرم، مجازات و جرم؟") == ["جرم", "مجازات", "جرم"]
    assert tok("آن کتاب") == ["ان", "کتاب"]
    assert one(spark, x=X.preprocess(F.lit("one"))).x == "" and one(spark, x=X.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, 3)).x == ["a", "b", "c", "a b", "b c", "a b c"]


@pytest.mark.parametrize(("word", "text", "hits"), [("جرم", "جرم و مجازات. جرم، جرمی", 2), ("آیا", "آیا جرم", 0), ("؟", "چرا؟ بله", 0), ("قانون مجازات", "قانون‌مجازات", 1)])
def test_keyword_hits(spark, word, text, hits):
    assert one(spark, x=X.keyword_hits(X.normalize(F.lit(text)), [word])).x == hits


def test_summaries_and_hashes(spark):
    r = one(spark, a=X.summary(F.lit("x" * 151)), b=X.summary(F.lit(None).cast("string")), c=X.brief(F.lit("y" * 101)), d=X.similar(F.lit("a b"), F.lit("a  b")), e=X.similar(F.lit(""), F.lit("")), f=X.text_hash(F.lit("a b"), "sha1"))
    assert len(r.a) == 150 and r.a.endswith("...") and r.b == "" and r.c == "y" * 100 + "..." and not r.e and len(r.f) == 40


@pytest.mark.parametrize(("path", "depth", "kind", "want"), [("/a/b", 2, "list", 0), ("/a/b", 1, "detail", 2), ("/sitemap.xml", 0, "sitemap", -14), ("/a/b/c", 3, "page", 23), ("", 0, "page", 0)])
def test_weighted_priority(spark, path, depth, kind, want):
    assert one(spark, x=U.weighted_priority(F.lit("https://h" + path), F.lit(depth), F.lit(kind))).x == want


def test_urls(spark):
    s = lambda a, b: round(float(one(spark, x=U.url_similarity(F.lit(a), F.lit(b))).x), 4)
    assert (s("https://h/a/b/c", "https://h/a/x/c"), s("https://h/a", "https://h/a/b"), s("https://h/a", "https://g/a"), s("https://h/", "https://h")) == (0.6667, 0.3, 0.1, 1.0)
    for url, is_list, is_detail in (("https://ex.com", False, False), ("https://ex.com/", False, True), ("https://ex.com/blog/1", True, False)):
        r = one(spark, a=U.is_list(F.lit(url)), b=U.is_detail(F.lit(url)))
        assert (r.a, r.b) == (is_list, is_detail)
    r = one(spark, a=U.normalize_url(F.lit("http://h:80/a;p?q#f")), b=U.additive_priority(F.lit("http://h/law/x"), F.lit(2), F.lit("list")), c=U.pattern_regex(F.lit("h/a/*")), d=U.host_token(F.lit("http://a.b.c/x")))
    assert (r.a, r.b, r.c, r.d) == ("http://h:80/a", -5, "^h/a/.*?$", "a_b_c")
    df = spark.createDataFrame([("../x", "http://h/a/b/c"), ("http://z/", "http://h/"), (None, "http://h/")], "u string, b string")
    assert [r[0] for r in df.select(U.resolve("u", "b")).collect()] == ["http://h/a/x", "http://z/", None]


@pytest.mark.parametrize(("raw", "want"), [("Title | Site", "Title"), ("A-b - Site", "A"), ("X-ray | S", "X")])
def test_titles(raw, want):
    root = parse(f"<title>{raw}</title>")
    assert H.legacy_title(root) == H.rich_title(root) == want


def test_dates_and_authors():
    assert H.rich_date(parse('<time datetime=" 2024-01-02 ">x</time>')) == "2024-01-02"
    assert H.rich_date(parse("<time>May</time>")) == "May" == H.legacy_date(parse("<time> May </time>"))
    assert H.rich_date(parse('<meta name="pubdate" content="d">')) == "d"
    assert H.rich_date(parse("<p>on 1402/3/4 or so</p>")) == "1402/3/4" and H.legacy_date(parse("<p>on 1402/3/14</p>")) == "02/3/14"
    assert H.rich_date(parse("<p>never</p>")) == "" and H.legacy_date(parse("<p>never</p>")) is None
    assert H.rich_author(parse('<meta name="author" content=" Ann ">')) == "Ann"
    assert H.rich_author(parse('<p class="byline">نویسنده: Ann</p>')) == "Ann"
    assert H.legacy_author(parse('<span class="author">Bob B</span>')) == "Bob B"
    assert H.legacy_author(parse("<p>نویسنده: Bo</p>")) is None and H.legacy_author(parse("<p>نویسنده: Robert B</p>")) == "Robert B"


def test_clean_and_content():
    root = H.clean(parse('<div class="uploads">u</div><div class="ad">kept</div><nav>n</nav><div class="TopBanner">b</div>'))
    assert root.text(strip=True) == "kept"
    many = "<div><p>a</p><p>b</p><p>c</p></div><section>" + "x" * 120 + "</section>"
    assert H.rich_content(parse(many)) == "a b c"
    farm = "<div><a href=x>" + "l" * 150 + "</a></div><section>" + "y" * 60 + "</section>"
    assert H.rich_content(parse(farm)) == "y" * 60
    assert H.rich_content(parse("<article>" + "z" * 201 + "</article>"), "detail") == "z" * 201
    assert H.clean_html("<script>x</script><p>a</p><b>b") == "a b" and H.main_content('<div class="body">one</div><div class="main">longer</div>') == "longer"
    assert H.text_from_tags("<p id=a>x</p><b class='k'> y </b><p>z</p>", ["b", "p"]) == "y x z"


def test_links():
    root = parse('<a href="/a?x#y">1</a><a href="#f">2</a><a href="http://o/z">3</a><a href="/a">4</a><a href="mailto:x">5</a>')
    assert H.links(root, "http://h/p") == ["http://h/a?x#y", "http://o/z", "http://h/a"]
    assert H.links(root, "http://h/p", True) == ["http://h/a?x#y", "http://h/a"]
    assert H.discovered_links(root, "http://h/p") == ["http://h/a"]


def test_list_items_and_related():
    page = '<ul class="items"><li><h2><a href="/1">One</a></h2><p class="excerpt">s</p></li><li><a href="/2">Two</a></li><li>no</li></ul>'
    assert H.list_items(parse(page)) == [{"title": "One", "link": "/1", "summary": "s"}, {"title": "Two", "link": "/2", "summary": None}]
    many = '<div class="related">' + "".join(f'<a href="/{i % 12}">{i}</a>' for i in range(30)) + "</div>"
    got = H.related_links(parse(many), "http://h/x/y")
    assert len(got) == 10 and got[0] == {"title": "0", "url": "http://h/0"}
    fallback = "<body><a href=/a>a</a><p>x</p><p>y</p><a href=/b>b</a><a href=/c></a></body>"
    assert H.related_links(parse(fallback), "http://h/") == [{"title": "b", "url": "http://h/b"}]


def test_page_types_and_selectors():
    assert H.page_type("http://h/blog/", parse("")) == "list" and H.page_type("http://h/", parse("<article></article>" * 3)) == "list"
    assert H.page_type("http://h/x", parse('<div class="single">x</div>')) == "detail" and H.page_type("http://h/x", parse("<p>x</p>")) == "generic"
    assert H.page_type("http://h/x", parse("<h1>t</h1><div class=text>" + "a" * 501 + "</div>")) == "detail"
    page = '<div class="posts-container">' + '<div class="post-item"><h2>t</h2><a href="/x">l</a><p>s</p></div>' * 3 + '</div><ul class="pagination"><a href="?2">2</a></ul>'
    found = H.list_selectors(parse(page))
    assert found == {"container": "div.posts-container", "item": "div.post-item", "title": "h2", "link": "a", "summary": "p", "pagination": "ul.pagination", "pagination_links": "a"}
    assert H.xpaths(found, "list")["title"] == "//div[contains(@class, 'posts-container')]//div[contains(@class, 'post-item')]//h2"
    record = H.extract_by_selectors("http://h/", page, "list", found)
    assert len(record["items"]) == 3 and record["items"][0] == {"title": "t", "link": "http://h/x", "summary": "s"} and record["pagination_links"] == ["http://h/?2"]
    detail = parse('<article><h1>t</h1><div class="content">c</div><span class="date">d</span><a class="author">w</a></article>')
    assert H.detail_selectors(detail) == {"container": "article", "title": "h1", "content": "div.content", "date": "span.date", "author": "a.author"}
    links = "".join(f'<a href="/{s}/1">x</a>' for s in "aabbbcjs") + '<a href="/css/x">y</a>' * 4
    assert H.main_sections(parse(links)) == ["b", "a", "c", "j"]


def test_record_of_broken_pages(spark):
    df = spark.createDataFrame([("u", None), ("u", "<div><p>a"), ("u", "")], "url string, html string")
    got = [r.r for r in df.select(H.extract_fields(F.col("url"), F.col("html")).alias("r")).collect()]
    assert [r.error for r in got] == ["empty html", None, "empty html"] and got[1].content == "a"
    s = df.select(H.structure_fields(F.col("url"), F.col("html")).alias("s")).collect()
    assert s[1].s.page_type == "generic" and s[1].s.selectors == {}
