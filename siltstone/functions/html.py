"""HTML extraction on the document tree, in two families, and as Arrow-batched functions.

``legacy_*`` read the page as it comes; ``rich_*`` work on the tree that :func:`clean` leaves. One
function parses a page once and returns all fields (:func:`extract_fields`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import partial
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.dom import Node, parse
from siltstone.functions.lexicon import ASSET_PARTS, LIST_PAGE_PARTS

_SPACE = re.compile(r"\s+")
#: Links that lead nowhere.
_NO_LINK = ("javascript:", "mailto:", "tel:", "#")

# Patterns for dates and authors in running text.
LEGACY_DATES = [
    r"تاریخ انتشار:?\s*(\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{2,4})",
    r"تاریخ:?\s*(\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{2,4})",
    r"(\d{1,2}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{2,4})",
    r"(\d{2,4}\s*[/\-]\s*\d{1,2}\s*[/\-]\s*\d{1,2})",
]
LEGACY_AUTHORS = [r"نویسنده:?\s*([^\n\.،]*)", r"نگارنده:?\s*([^\n\.،]*)", r"نگارش:?\s*([^\n\.،]*)", r"تهیه کننده:?\s*([^\n\.،]*)"]
RICH_DATES = [
    r"تاریخ(?:\s*انتشار)?[:]\s*(\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+[آ-یa-zA-Z]+\s+\d{4})",
    r"(\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4})",
    r"(\d{1,2}\s+[آ-یa-zA-Z]+\s+\d{4})",
]
RICH_AUTHORS = [r"نویسنده[:]\s*([آ-یA-Za-z\s]+)", r"نگارنده[:]\s*([آ-یA-Za-z\s]+)", r"نوشته[:]\s*([آ-یA-Za-z\s]+)"]
RICH_DATE_META = [("property", "article:published_time"), ("property", "article:modified_time"), ("name", "date"), ("name", "pubdate"), ("name", "publish_date")]
CLUTTER = "script style iframe noscript header footer nav aside".split()
CLUTTER_CLASSES = "ads advertisement banner popup social sharing footer menu".split()


def _first_match(patterns: list[str], text: str, accept=lambda x: True) -> str | None:
    return next((m[1].strip() for p in patterns if (m := re.search(p, text)) and accept(m[1].strip())), None)


def _without(root: Node, names: str) -> Node:
    gone = names.split()
    root.remove(lambda n: n.name in gone)
    return root


def clean_html(html: str | None) -> str:
    """Text without scripts, styles, headers, footers and menus, single-spaced."""
    return _SPACE.sub(" ", _without(parse(html), "script style header footer nav").text(" ")).strip() if html else ""


def text_from_tags(html: str | None, tags: list[str], cls: str | None = None, id_: str | None = None) -> str:
    """Trimmed texts of all matching elements, by tag and then page order, joined by spaces."""
    root = parse(html)
    found = [n.text().strip() for t in tags for n in root.all(t) if (cls is None or cls in n.classes) and (id_ is None or n.attrs.get("id") == id_)]
    return " ".join(x for x in found if x)


def main_content(html: str | None) -> str:
    """The element with a content class that has most text; else all of :func:`clean_html`."""
    if not html:
        return ""
    found = list(_without(parse(html), "script style header footer nav aside").all("article main div", r"(content|article|post|body|main)", flags=re.I))
    return _SPACE.sub(" ", max(found, key=lambda n: len(n.text())).text(" ")).strip() if found else clean_html(html)


def legacy_title(root: Node) -> str:
    title = root.first("title")
    if title:
        return re.sub(r"\s*-.*$", "", re.sub(r"\s*\|.*$", "", title.text().strip()))
    heading = root.first("h1")
    if heading:
        return heading.text().strip()
    return next((t for n in root.all("h2 header") if (t := n.text().strip()) and len(t) < 200), "")


def legacy_date(root: Node) -> str | None:
    time = root.first("time")
    if time:
        return time.attrs.get("datetime", time.text().strip())
    meta = root.first("meta", where=lambda n: re.search("publish|date|time", n.attrs.get("name", ""), re.I) and "content" in n.attrs)
    return meta.attrs["content"] if meta else _first_match(LEGACY_DATES, root.text())


def legacy_author(root: Node) -> str | None:
    meta = root.first("meta", where=lambda n: re.search("author", n.attrs.get("name", ""), re.I) and "content" in n.attrs)
    if meta:
        return meta.attrs["content"]
    named = root.first("a span div", "(author|نویسنده)", flags=re.I)
    return named.text().strip() if named else _first_match(LEGACY_AUTHORS, root.text(), lambda x: 5 < len(x) < 50)


def links(root: Node, base: str | None = None, internal: bool = False) -> list[str]:
    """Targets of all links in order, repeats too, resolved; ``internal``: of the base's host alone."""
    out = []
    for n in root.all("a", where=lambda n: "href" in n.attrs):
        href = n.attrs["href"]
        if href.startswith(_NO_LINK):
            continue
        if base and not href.startswith(("http://", "https://")):
            href = urljoin(base, href)
        if internal and base and urlsplit(href).netloc not in ("", urlsplit(base).netloc):
            continue
        out.append(href)
    return out


def discovered_links(root: Node, base: str) -> list[str]:
    """Internal links without query and fragment, each once."""
    plain = [urlsplit(u)._replace(query="", fragment="").geturl() for u in links(root, base) if urlsplit(u).netloc == urlsplit(base).netloc]
    return list(dict.fromkeys(plain))


def clean(root: Node) -> Node:
    """Takes clutter out: by element, then by what class names contain."""
    root.remove(lambda n: n.name in CLUTTER)
    root.remove(lambda n: any(c in x.lower() for x in n.classes for c in CLUTTER_CLASSES))
    return root


def rich_content(root: Node, job_type: str | None = None) -> str:
    """Detail pages: the first likely container with over 200 characters. Else the best-scored block, ties by text."""
    if job_type == "detail":
        for names, cls in (("article", None), ("div", r"(content|article|post|body|text|main)"), ("main", None), ("section", r"(content|article)")):
            node = root.first(names, cls)
            if node and len(node.text(strip=True)) > 200:
                return node.text(" ", strip=True)
    best = None
    for node in root.all("article div section"):
        text = node.text(" ", strip=True)
        paragraphs = sum(1 for _ in node.all("p"))
        anchors = sum(len(a.text(strip=True)) for a in node.all("a"))
        score = len(text) + (50 * paragraphs if paragraphs > 2 else 0) + (100 if node.first("h1 h2 h3") else 0) - (200 if anchors / max(1, len(text)) > 0.5 else 0)
        best = max(best or (score, text), (score, text))
    return best[1] if best else root.text(" ", strip=True)


def rich_title(root: Node) -> str:
    title = root.first("title")
    if title and title.text():
        return re.sub(r"\s*[-]\s*.+$", "", re.sub(r"\s*[|]\s*.+$", "", title.text().strip()))
    headings = [n.text(strip=True) for n in root.all("h1")]
    classed = [n.text(strip=True) for c in ("title", "heading", "post-title", "article-title", "main-title") if (n := root.first(None, c, flags=re.I))]
    second = root.first("h2")
    return next((t for t in [*headings, *classed, second.text(strip=True) if second else ""] if t), "")


def rich_date(root: Node) -> str:
    for n in root.all("time"):
        if "datetime" in n.attrs:
            return n.attrs["datetime"].strip()
        if n.text(strip=True):
            return n.text(strip=True)
    for key, value in RICH_DATE_META:
        meta = root.first("meta", where=lambda n, key=key, value=value: n.attrs.get(key) == value)
        if meta and meta.attrs.get("content"):
            return meta.attrs["content"].strip()
    for c in ("date", "time", "published", "pubdate", "timestamp"):
        node = root.first(None, c, flags=re.I)
        if node and node.text(strip=True):
            return node.text(strip=True)
    return _first_match(RICH_DATES, root.text()) or ""


def rich_author(root: Node) -> str:
    meta = root.first("meta", where=lambda n: n.attrs.get("name") == "author")
    if meta and meta.attrs.get("content"):
        return meta.attrs["content"].strip()
    for c in ("author", "writer", "byline", "by"):
        node = root.first(None, c, flags=re.I)
        if node and node.text(strip=True):
            return re.sub(r"^(?:نویسنده|نگارنده|نوشته)[:]\s*", "", node.text(strip=True), flags=re.I)
    return _first_match(RICH_AUTHORS, root.text(), lambda x: 2 < len(x) < 50) or ""


def list_items(root: Node) -> list[dict]:
    """Title, link and summary of each item of a list page's container, or of anything classed as an item; title or link is needed."""
    cls = r"(list|items|posts|articles)"
    held = next((n for t in ("ul", "div", "section") if (n := root.first(t, cls))), None)
    out = []
    for item in held.all("article div li") if held else root.all("article div li", r"(item|post|article)"):
        head = item.first("h2 h3 h4 a")
        anchor = head if head and head.name == "a" else head.first("a") if head else None
        note = item.first("p div", r"(summary|excerpt|desc)")
        row = {"title": head.text(strip=True) if head else None, "link": anchor.attrs.get("href") if anchor else None, "summary": note.text(strip=True) if note else None}
        if row["title"] or row["link"]:
            out.append(row)
    return out


def related_links(root: Node, url: str, most: int = 10) -> list[dict]:
    """Links of a container of related pages, else of the second half of the body's elements that have text; each URL once, ``most`` at most."""
    site = "{0.scheme}://{0.netloc}".format(urlsplit(url or ""))

    def of(nodes, need_text: bool):
        for a in nodes:
            href = a.attrs["href"]
            if not href.startswith(_NO_LINK) and (a.text(strip=True) or not need_text):
                yield href if href.startswith(("http://", "https://")) else urljoin(site, href), a.text(strip=True)

    linked = lambda n: "href" in n.attrs
    held = next((n for t in ("div", "section", "ul") if (n := root.first(t, r"(related|similar|suggested)"))), None)
    found = list(of(held.all("a", where=linked), False)) if held else []
    body = root.first("body")
    if not found and body:
        below = list(body.walk())
        found = list(of((n for n in below[len(below) // 2 :] if n.name == "a" and linked(n)), True))
    first: dict[str, str] = {}
    for href, title in found:
        first.setdefault(href, title)
    return [{"title": t, "url": u} for u, t in list(first.items())[:most]]


def page_type(url: str, root: Node) -> str:
    """list, detail or generic, by the URL, repeated elements, and elements of detail pages."""
    if any(re.search(p, url or "") for p in LIST_PAGE_PARTS):
        return "list"
    repeated = [root.all("div", r"(post|article|item|card)s?"), root.all("li", r"(post|article|item|card)s?"), root.all("article")]
    if any(sum(1 for _ in nodes) >= 3 for nodes in repeated):
        return "list"
    detail = r"(post|article|content)-detail"
    signs = (
        root.first("article", r"(post|article|content)"),
        root.first("div", detail),
        root.first("div", where=lambda n: re.search(detail, n.attrs.get("id", ""))),
        root.first("div", r"single"),
        root.first("section", r"(post|article|content)"),
    )
    one_heading = sum(1 for _ in root.all("h1")) == 1
    if any(signs) or one_heading and any(len(n.text()) > 500 for n in root.all("p div", r"(content|text|body)")):
        return "detail"
    return "generic"


def _selector(node: Node, with_class: bool = True) -> str:
    return f"{node.name}.{node.classes[0]}" if with_class and node.classes else node.name


def _pick(root: Node, choices: list[tuple[str, str | None]]) -> str | None:
    """The selector of the first choice (name, class pattern) that the tree has; the class counts where one was asked for."""
    return next((_selector(n, bool(cls)) for name, cls in choices if (n := root.first(name, cls))), None)


def list_selectors(root: Node) -> dict[str, str]:
    many = r"(posts|articles|items|cards|list)s?"
    out: dict[str, str] = {}
    held = next((n for name, cls in (("div", many + "-container"), ("div", many), ("ul", many), ("section", many)) if (n := root.first(name, cls))), None)
    if held:
        out["container"] = _selector(held)
    else:
        articles = list(root.all("article"))
        if len(articles) >= 2:
            held = articles[0].parent
            out |= {"container": _selector(held), "item": "article"}
    if held:
        one = r"(post|article|item|card)s?"
        for name, cls in (("div", one + "-item"), ("div", one), ("article", r".*"), ("li", one)):
            items = list(held.all(name, cls))
            if len(items) > 1:
                out["item"] = _selector(items[0])
                break
    items = held.select(out["item"])[:3] if held and "item" in out else []
    if items:
        for key, choices in (
            ("title", [("h2", None), ("h3", None), ("h4", None), ("div", "title"), ("span", "title"), ("a", None)]),
            ("link", [("a", None)]),
            ("summary", [("p", None), ("div", r"(summary|excerpt)"), ("span", r"(summary|excerpt)"), ("div", "content")]),
        ):
            for name, cls in choices:
                found = [i.first(name, cls) for i in items]
                if all(found):
                    out[key] = _selector(found[0], bool(cls))
                    break
    for name, cls in (("div", "pagination"), ("ul", "pagination"), ("nav", "pagination"), ("div", "paging")):
        pages = root.first(name, cls)
        if pages:
            out["pagination"] = _selector(pages)
            if pages.first("a"):
                out["pagination_links"] = "a"
            break
    return out


def detail_selectors(root: Node) -> dict[str, str]:
    part = r"(post|article|content)"
    choices = [("article", None), ("div", part + "-content"), ("div", part + "-detail"), ("div", part), ("section", part)]
    held = next(((n, cls) for name, cls in choices if (n := root.first(name, cls))), None)
    if not held:
        return {}
    node, cls = held
    out = {"container": _selector(node, bool(cls))}
    told = {
        "title": _pick(root, [("h1", None), ("h2", None), ("div", "title"), ("span", "title")]),
        "content": _pick(node, [("div", "content"), ("div", "body"), ("div", "text")]) or out["container"],
        "date": _pick(node, [("time", None), *((t, c) for c in ("date", "time", "published") for t in ("span", "div"))]),
        "author": _pick(node, [("span", "author"), ("div", "author"), ("a", "author"), ("div", "writer"), ("span", "writer")]),
    }
    return out | {k: v for k, v in told.items() if v}


def section_counts(root: Node) -> Counter:
    """How often each first path part stands in links that start with http or a slash."""
    hrefs = (n.attrs["href"] for n in root.all("a", where=lambda n: "href" in n.attrs))
    parts = (urlsplit(h).path.split("/") for h in hrefs if h.startswith(("http", "/")))
    return Counter(p[1] for p in parts if len(p) > 1)


def main_sections(root: Node, most: int = 5) -> list[str]:
    """The ``most`` frequent sections (ties in page order), then without empty and asset parts."""
    return [s for s, _ in section_counts(root).most_common(most) if s and s not in ASSET_PARTS]


def generic_selectors(root: Node) -> dict[str, str]:
    heading = root.first("h1")
    menu = _pick(root, [("nav", None), ("div", "nav"), ("div", "menu"), ("ul", "menu")])
    return ({"title": _selector(heading)} if heading else {}) | ({"navigation": menu} if menu else {})


def selectors(url: str, root: Node) -> tuple[str, dict[str, str], list[str]]:
    """(page type, selectors, main sections)."""
    kind = page_type(url, root)
    finders = {"list": list_selectors, "detail": detail_selectors, "generic": generic_selectors}
    return kind, finders[kind](root), main_sections(root) if kind == "generic" else []


def css_to_xpath(selector: str) -> str:
    name, _, cls = (selector or "").partition(".")
    return (f"{name}[contains(@class, '{cls.split('.')[0]}')]" if cls else name) if name else ""


def xpaths(found: dict[str, str], kind: str) -> dict[str, str]:
    """XPath of each selector, nested in the element that holds it."""
    inside = {
        "list": {"container": None, "item": "container", "title": "item", "link": "item", "summary": "item", "pagination": None, "pagination_links": "pagination"},
        "detail": {"container": None, "title": "", "content": "container", "date": "container", "author": "container"},
    }.get(kind, {})
    out: dict[str, str] = {}
    for key, parent in inside.items():
        needed = parent or ("container" if parent == "" else None)
        if key in found and (needed is None or needed in out):
            out[key] = (out[parent] if parent else "") + "//" + css_to_xpath(found[key])
    return out


def extract_by_selectors(url: str, html: str | None, kind: str, found: dict[str, str]) -> dict:
    """A page's record by the selectors of its type; fields that selectors do not give come from the legacy family."""
    root = parse(html)
    out: dict = {"url": url, "type": kind, "title": legacy_title(root), "date": legacy_date(root), "author": legacy_author(root), "content": None, "items": [], "has_pagination": False, "pagination_links": []}
    one = lambda within, key: next(iter(within.select(found[key])), None) if found.get(key) else None
    if kind == "list":
        held = one(root, "container") if found.get("item") else None
        for item in held.select(found["item"]) if held else []:
            title, link, note = one(item, "title"), one(item, "link"), one(item, "summary")
            out["items"].append({"title": title.text().strip() if title else None, "link": urljoin(url, link.attrs["href"]) if link and "href" in link.attrs else None, "summary": note.text().strip() if note else None})
        pages = one(root, "pagination")
        if pages:
            out["has_pagination"] = True
            out["pagination_links"] = [urljoin(url, a.attrs["href"]) for a in (pages.select(found["pagination_links"]) if "pagination_links" in found else []) if "href" in a.attrs]
    elif kind == "detail" and found:
        body = one(root, "content")
        out["content"] = body.text().strip() if body else None if "content" in found else main_content(html)
        for key in ("date", "author"):
            node = one(root, key)
            if node and not out[key]:
                out[key] = node.text().strip()
    elif kind != "detail":
        out["content"] = main_content(html)
    return out


_LINK = "struct<title: string, url: string>"
_ITEM = "struct<title: string, link: string, summary: string>"
FIELDS = f"struct<title: string, content: string, date: string, author: string, page_type: string, list_items: array<{_ITEM}>, related_links: array<{_LINK}>, entities: map<string,array<string>>, error: string>"
LEGACY = "struct<title: string, content: string, date: string, author: string, clean_text: string, links: array<string>, internal_links: array<string>, discovered_links: array<string>>"
STRUCTURE = "struct<page_type: string, selectors: map<string,string>, xpaths: map<string,string>, main_sections: array<string>>"


Entities = Callable[[str], dict[str, list[str]]]


def record(url: str | None, html: str | None, job_type: str | None = None, entities: Entities | None = None) -> dict:
    """The extracted record; an empty page or an error gives a record with ``error`` and nothing else.

    ``entities`` names the entities of a content's first 10,000 characters, by kind; without it there are none.
    """
    empty = {"title": None, "content": None, "date": None, "author": None, "page_type": job_type, "list_items": None, "related_links": None, "entities": {}, "error": None}
    if not html:
        return empty | {"error": "empty html"}
    try:
        root = parse(html)
        kind = job_type or page_type(url or "", root)
        root = clean(root)
        out = empty | {"title": rich_title(root), "content": rich_content(root, kind), "date": rich_date(root), "author": rich_author(root), "page_type": kind}
        if kind == "list":
            out["list_items"] = list_items(root)
        elif kind == "detail":
            out["related_links"] = related_links(root, url or "")
        if entities and out["content"]:
            out["entities"] = entities(out["content"][:10_000])
        return out
    except Exception as e:  # one broken page is a row with an error, never a failed task
        return empty | {"error": f"{type(e).__name__}: {e}"}


def legacy_record(url: str | None, html: str | None) -> dict:
    root = parse(html)
    return {
        "title": legacy_title(root) if html else "", "content": main_content(html), "date": legacy_date(root) if html else None, "author": legacy_author(root) if html else None,
        "clean_text": clean_html(html), "links": links(root, url), "internal_links": links(root, url, True), "discovered_links": discovered_links(root, url or ""),
    }


def structure(url: str | None, html: str | None) -> dict:
    kind, found, sections = selectors(url or "", parse(html))
    return {"page_type": kind, "selectors": found, "xpaths": xpaths(found, kind), "main_sections": sections}


def _applied(f, kind: str):
    @F.pandas_udf(kind)
    def over(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(u, p) for u, p in zip(urls, pages, strict=True)])

    return over.asNondeterministic()  # a page is parsed once, however many fields are taken


def extract_fields(url: Column, html: Column, entities: Entities | None = None) -> Column:
    """The rich record as a struct; ``entities`` as for :func:`record`."""
    return _applied(partial(record, entities=entities), FIELDS)(url, html)


def legacy_fields(url: Column, html: Column) -> Column:
    """The legacy family's fields as a struct."""
    return _applied(legacy_record, LEGACY)(url, html)


def structure_fields(url: Column, html: Column) -> Column:
    """Page type, selectors, XPaths and main sections as a struct."""
    return _applied(structure, STRUCTURE)(url, html)


# Regex variants in the JVM, exact for well-formed pages with double-quoted attributes.


def fast_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.regexp_replace(F.regexp_replace(F.trim(found), r"\s*\|.*$", ""), r"\s*-.*$", "")


def fast_links(html: Column) -> Column:
    """Values of href in anchors, in order; none that leads nowhere."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    found = F.regexp_extract_all(bare, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda h: ~h.rlike(r"^(javascript:|mailto:|tel:|#)"))


def fast_clean_text(html: Column) -> Column:
    """:func:`clean_html` without character references, by patterns alone."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|header|footer|nav)\b.*?</\1>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
