"""Operator 2: the main text of web pages.

A page becomes flat text blocks. Each block has its word count and link density, those of its
neighbours, whether it reads as a sentence, and flags from the elements around it; a decision
tree, trained on a small labelled table, keeps or drops it. The table comes from labelled sample
pages, composed by :func:`sample_pages` below, so that training and use share one featuriser.
"""

from __future__ import annotations

import functools
import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never running text (up to their end tag); media and choices, whose content is skipped where they are closed in
#: their own block and else read; elements that interrupt a line of text; elements around boilerplate.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "annotation", "annotation-xml"])
MEDIA = frozenset(["svg", "object", "canvas", "audio", "video", "select", "datalist"])
BLOCK = frozenset(
    ["address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure"]
    + ["footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "input", "label", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "p", "pre"]
    + ["section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
)
AROUND = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "optgroup", "option"])
#: Words in classes and ids around boilerplate; words that say so only as a whole name; words around reader comments; roles.
MARKS = frozenset(
    ["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "promoted", "sponsor", "sponsored", "sidebar", "nav", "navbar", "navigation"]
    + ["breadcrumb", "breadcrumbs", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login"]
    + ["share", "sharing", "social", "recommended", "recommendations", "widget", "pagination", "pager"]
)
WHOLE_MARKS = frozenset(["menu", "rail", "header", "footer", "notice", "notices", "alert", "legal", "copyright", "skip", "disclaimer", "related"])
REMARKS = frozenset(["comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "discussion"])
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_LEAVES = frozenset(["p", "li", "dd", "dt", "tr", "td", "th", *_HEADINGS])
_OWN = frozenset(["html", "body", "article", "main"])  # their classes say nothing of a part of the page
# Attributes as browsers read them: a quote opens a value only after an equals sign, and only if it is closed somewhere.
_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_ASKED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style)\b", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_ENDS = {name: re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I) for name in RAW}
_CLOSED = {name: re.compile(rf"(</{name}\b[^>]*>)|<{name}\b|</(?:p|div|article|section|main|body|li|td|h[1-6])\b", re.I) for name in MEDIA}
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*\Z")
#: Names of a block's features, in order. mark: 2 inside boilerplate or comments, 1 inside something whose
#: name only holds such a word, else 0; before the first block and after the last, 2.
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_article", "mark", "remark", "heading", "sentence", "mark_before", "mark_after")


def _marks(attributes: str, article: bool = False) -> tuple[int, bool]:
    """(mark, reader comment) by class, id, role and hiding; inside an article a header is its own."""
    mark, remark = 0, False
    if not _ASKED.search(attributes):
        return mark, remark
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            mark = 2
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            mark = 2
        elif name in ("class", "id"):
            for word in value.split():
                parts = {x.lower() for x in _SPLIT.split(word)}
                if parts & MARKS or word.lower() in WHOLE_MARKS and not (article and word.lower() in ("header", "legal")):
                    mark = 2
                elif parts & WHOLE_MARKS:
                    mark = max(mark, 1)
                remark |= bool(parts & REMARKS)
    return mark, remark


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Flat text blocks in page order, white space made single and character references decoded, and their features."""
    texts: list[str] = []
    own: list[list[float]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # element, then what holds inside it: article, mark, remark
    parts: list[str] = []
    linked: list[str] = []
    anchor = heading = False
    inside = 0  # blocks opened since the anchor
    at, n = 0, len(page)

    def around() -> tuple[bool, int, bool]:
        return stack[-1][1:] if stack else (False, 0, False)

    def flush() -> None:
        words = "".join(parts).split()
        if words:
            text = " ".join(words)
            texts.append(text)
            own.append([len(words), min(1.0, len("".join(linked).split()) / len(words)), *around(), heading, bool(_SENTENCE.search(text))])
        parts.clear()
        linked.clear()

    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at:
            run = page[at:less]
            if "&" in run:
                run = htmllib.unescape(run)
            parts.append(run)
            if anchor:
                linked += (run, " ")
        if less == n:
            break
        m = _TOKEN.match(page, less)
        if not m:  # a lone less-than sign
            parts.append("<")
            at = less + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "a":
            anchor, inside = not closing and "href" in m[3].lower(), 0
        elif name == "br":
            parts.append(" ")
        elif name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else n if name in ("script", "style") else at
        elif name in MEDIA:
            end = None if closing else _CLOSED[name].search(page, at)
            if end and end[1]:
                at = end.end()
        elif name not in BLOCK:
            if not closing and name not in _VOID and (mark := _marks(m[3], True))[0] == 2 or name == "option" and not closing:
                # an inline element marked as boilerplate: a block of its own
                flush()
                article, old, remark = around()
                stack.append((name, article, 2, remark or mark[1] if name != "option" else remark))
            elif closing and stack and stack[-1][0] == name:
                flush()
                stack.pop()
        else:
            flush()
            heading = not closing and name in _HEADINGS
            inside += -1 if closing else name not in _VOID
            if inside < 0:
                anchor = False
            if closing:
                held = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if held is not None and not any(x[0] in ("article", "main", "aside", "nav", "footer", "form") for x in stack[held + 1 :] if name in ("p", "li", "div", "td", "span")):
                    del stack[held:]
            elif name not in _VOID:
                article, mark, remark = around()
                if stack and stack[-1][0] == name and name in _LEAVES:
                    stack.pop()  # a marked paragraph or item that was never closed ends where the next begins
                    article, mark, remark = around()
                new = _marks(m[3], article) if name not in _OWN else (0, False)
                if name not in _LEAVES or new != (0, False):
                    held = 2 if name in AROUND or name == "header" and not article else new[0]
                    stack.append((name, (article or name in ("article", "main")) and name != "aside", max(mark, held), remark or new[1]))
    flush()
    x = np.zeros((len(texts), len(FEATURES)))
    if texts:
        o = np.array(own, float)
        x[:, [0, 1, 6, 7, 8, 9, 10]] = o
        x[1:, 2:4], x[:-1, 4:6] = o[:-1, :2], o[1:, :2]
        marks = np.maximum(o[:, 3], 2 * o[:, 4])
        x[:, 11:] = 2
        x[1:, 11], x[:-1, 12] = marks[:-1], marks[1:]
    return texts, x


class Tree:
    """A decision tree by Gini impurity over numeric features; leaves hold the share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 6):
        self.cut: tuple | None = None
        self.share = float(y.mean()) if len(y) else 0.0
        n, best = len(y), 2 * self.share * (1 - self.share) * len(y) - 1e-9
        if depth and n >= 2 * least and best > 0:
            left = np.arange(1, n)
            for j in range(x.shape[1]):
                order = np.argsort(x[:, j], kind="stable")
                v, ones = x[order, j], np.cumsum(y[order])
                a, b = ones[:-1], ones[-1] - ones[:-1]
                gini = 2 * a * (1 - a / left) + 2 * b * (1 - b / (n - left))
                gini[(v[1:] == v[:-1]) | (left < least) | (n - left < least)] = np.inf
                k = int(gini.argmin())
                if gini[k] < best - 1e-9:
                    best, self.cut = gini[k], (j, (v[k] + v[k + 1]) / 2)
        if self.cut:
            low = x[:, self.cut[0]] <= self.cut[1]
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.cut or not len(x):
            return np.full(len(x), self.share)
        out, low = np.empty(len(x)), x[:, self.cut[0]] <= self.cut[1]
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out

    def rules(self, indent: str = "") -> str:
        """The tree as indented text."""
        if not self.cut:
            return f"{indent}{self.share:.2f}\n"
        name = f"{indent}{FEATURES[self.cut[0]]} <= {self.cut[1]:.3g}"
        return f"{name}\n{self.low.rules(indent + '  ')}{indent}else\n{self.high.rules(indent + '  ')}"


class Writer:
    """Composes sample pages; ``html`` and ``labels`` (1 for a block of main text, in order) grow with every call."""

    def __init__(self, seed: int):
        self.rng, self.html, self.labels = np.random.default_rng(seed), [], []

    def chance(self, share: float) -> bool:
        return bool(self.rng.random() < share)

    def any(self, *choices: str) -> str:
        return choices[int(self.rng.integers(len(choices)))]

    def words(self, least: int, most: int) -> int:
        """A number of words, small ones as likely as large ones by their logarithm."""
        return int(round(np.exp(self.rng.uniform(np.log(least), np.log(most)))))

    def put(self, label: int, tag: str, n: int, linked: float = 0.0, stop: float = 0.0) -> None:
        """A block of n words, the first ``linked`` of them a link, ended by a full stop with the chance ``stop``."""
        k = min(n, int(np.ceil(n * linked)))
        link, rest = " ".join(["word"] * k), " ".join(["word"] * (n - k))
        full = "." if self.chance(stop) else ""
        text = (f'<a href="/x">{link}{"" if rest else full}</a> ' if k else "") + (rest + full if rest else "")
        name = tag.split()[0]
        self.html.append(f"<{tag}>{text}</{name}>" if tag else f"{text}<br>")
        self.labels.append(label)

    def open(self, tag: str) -> None:
        self.html.append(f"<{tag}>")

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")

    def noise(self, tag: str, least: int, most: int, stop: float, linked: float = 0.0, count: int = 1) -> None:
        """Boilerplate in an element of its own."""
        self.open(tag)
        for _ in range(count):
            self.put(0, self.any("p", "div", "li") if count > 1 else "p", self.words(least, most), linked, stop)
        self.close(tag.split()[0])

    def prose(self, article: bool) -> None:
        """A heading and paragraphs, with what articles also hold: lists, quotations, links, weakly marked sections, and adverts, which are not text."""
        if self.chance(0.9):
            self.put(1, self.any("h1", "h2"), self.words(2, 14), stop=0.2)
        if article and self.chance(0.3):
            self.put(1, "p", self.words(2, 6))
        weak = article and self.chance(0.25)
        if weak:
            self.open(self.any("section class=legal-analysis", "div class=article-header", "div class=copyright-law", "div id=notice-body", "div class=related-work"))
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.7:
                short = self.chance(0.2)
                linked = self.rng.choice([0.0, 0.1, 0.3], p=[0.7, 0.2, 0.1])
                self.put(1, "p", self.words(1, 8) if short else self.words(8, 500), 0 if short else linked, 0.6 if short else 0.97)
            elif kind < 0.78:
                self.put(1, self.any("h2", "h3"), self.words(1, 9), stop=0.1)
            elif kind < 0.86:
                for _ in range(int(self.rng.integers(2, 6))):
                    self.put(1, "li", self.words(2, 40), stop=0.5)
            elif kind < 0.92:
                self.put(1, self.any("blockquote", "pre", "td"), self.words(4, 80), stop=0.7)
            elif kind < 0.94 and article:
                self.put(1, "p", self.words(2, 12), 1.0)
            else:
                self.noise(self.any("div class=ad", "div class='ad-slot'", "aside", "div class=share", "div class=newsletter", "div class='promo box'"), 2, 60, 0.6, self.any("", "1") == "1")
        if weak:
            self.close("section" if "<section class=legal-analysis>" in self.html[-60:] else "div")

    def page(self) -> tuple[str, str]:
        """A whole page and its labels."""
        self.html, self.labels = [], []
        article, bare = self.chance(0.5), self.chance(0.15)
        if bare and self.chance(0.3):  # nothing but a paragraph or two
            for _ in range(int(self.rng.integers(1, 3))):
                self.put(1, "p", self.words(8, 500), stop=0.97)
            return "".join(self.html), "".join(map(str, self.labels))
        if not bare and self.chance(0.7):
            top = self.any("header", "div id=header", "div class=masthead", "div", "div class=site-header")
            self.open(top)
            self.put(0, "p", self.words(1, 4), self.rng.integers(2))
            if self.chance(0.5) and top != "div":
                self.put(0, "p", self.words(4, 20), stop=0.3)
            self.close(top.split()[0])
        if not bare:
            menu = self.any("nav", "div class=nav", "ul", "div", "ul class=site-menu")
            self.open(menu)
            for _ in range(int(self.rng.integers(2, 12))):
                self.put(0, self.any("li", "div"), self.words(1, 7), 1.0)
            self.close(menu.split()[0])
        if not bare and self.chance(0.5):
            self.noise(self.any("div class=cookie-notice", "div class=banner", "div id=alert", "div class=breadcrumbs", "div class=ad", "div role=dialog"), 3, 60, 0.6)
        if not bare and self.chance(0.2):
            self.put(0, "div", self.words(1, 3))
        body = self.any("article", "main") if article else self.any("div", "div id=content", "td", "div class=post")
        self.open(body)
        self.prose(article)
        self.close(body.split()[0])
        if self.chance(0.4):
            self.noise(self.any("div id=comments", "section class=comment-list", "div class=reply", "section id=disqus", "div id=respond"), 1, 120, 0.8, 0, int(self.rng.integers(1, 5)))
        if self.chance(0.5):  # teasers
            self.open(self.any("div", "div class=related", "aside", "div class=sidebar", "div class=recommended"))
            for _ in range(int(self.rng.integers(2, 8))):
                self.put(0, self.any("p", "li", "div"), self.words(3, 30), self.rng.choice([0.6, 0.8, 1.0]), 0.2)
            self.close("div" if "aside" not in self.html[-1] else "aside")
        if self.chance(0.3):
            self.noise(self.any("form", "div class=subscribe", "div class=sidebar"), 2, 60, 0.6, 0, 2)
        if not bare and self.chance(0.4):
            for _ in range(int(self.rng.integers(1, 3))):
                self.put(0, self.any("p", "div"), self.words(1, 4), self.rng.integers(2))
        if not bare and self.chance(0.1):
            self.put(0, self.any("p", "div"), self.words(3, 10), stop=0.2)
        elif not bare and self.chance(0.7):
            self.noise(self.any("footer", "div id=footer", "div class=site-footer", "div class=copyright"), 2, 60, 0.6, 0, int(self.rng.integers(1, 4)))
        return "".join(self.html), "".join(map(str, self.labels))


def sample_pages(count: int, seed: int) -> list[tuple[str, str]]:
    """``count`` composed pages with a label for each of their blocks."""
    writer = Writer(seed)
    return [writer.page() for _ in range(count)]


@functools.lru_cache
def labelled(count: int = 2000, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table as features and labels."""
    xs, ys = [], []
    for page, labels in sample_pages(count, seed):
        texts, x = blocks(page)
        if len(texts) != len(labels):
            raise ValueError(f"{len(texts)} blocks, {len(labels)} labels: {page}")
        xs.append(x)
        ys.append([int(c) for c in labels])
    return np.vstack(xs), np.concatenate(ys).astype(float)


def main_text(page: str, tree: Tree) -> str:
    texts, x = blocks(page)
    return "\n".join(t for t, s in zip(texts, tree.predict(x), strict=True) if s >= 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: the id, the url, text (blocks joined by line feeds, empty if none), n_chars, n_blocks.

    One row for each row of ``pages``; null html counts as empty, broken html as far as it goes:
    unclosed elements end with what is around them, an unclosed tag at the end is dropped. Repeated
    rows repeat; null ids and urls stay null; extra columns are ignored.
    """
    tree = Tree(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "", tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars", "n_blocks"],
            )

    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long, n_blocks long"
    return pages.select(id_col, F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)
