"""Text as Spark columns: normalization, tokens, hashes, summaries, n-grams.

Everything here is a ``Column -> Column`` expression and stays in the JVM, but for texts with
characters that decompose into several (ligatures, fractions, Hangul): these alone go to Python.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.functions.lexicon import CHARACTERS, PUNCTUATION, STOP_WORDS


def _ranges(characters: list[int]) -> str:
    """Ascending code points as the inside of a pattern class."""
    runs: list[list[int]] = []
    for n in characters:
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def _decomposed() -> tuple[str, str, str, str, str]:
    """Characters whose decomposition without marks is one other character, and these; the marks; pattern classes of characters that become several, and of a text with none of these up to U+06FF and nothing beyond."""
    source, target, marks, several = [], [], [], []
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        if unicodedata.combining(c):
            marks.append(c)
        elif not 0xD800 <= n <= 0xDFFF:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(plain) != 1:
                several.append(n)
            elif plain != c:
                source.append(c)
                target.append(plain)
    unsure = f"[^{_ranges(sorted(set(range(0x700)).difference(several)))}]"
    return "".join(source), "".join(target), "".join(marks), f"[{_ranges(several)}]", unsure


_FROM, _TO, _MARKS, _SEVERAL, _UNSURE = _decomposed()
#: A run of white space that is not just one space.
_GAPS = r"(?U)[\s&&[^ ]]\s*| \s+"
#: The Latin part of the same rule, for columns known to hold nothing else.
_LATIN = [(a, b) for a, b in zip(_FROM, _TO, strict=True) if a < "ɐ"]


def squeeze(c: Column) -> Column:
    """Unicode white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _GAPS, " "))


def normalize(c: Column, latin: bool = False) -> Column:
    """Replaced characters, single spaces, then compatibility decomposition without marks; null gives ''.

    Texts with characters that decompose into several go through :func:`normalize_exact`, all others
    through tables in the JVM. ``latin``: the text has no marks or accents beyond Latin, so a short table will do.
    """
    c = F.coalesce(c, F.lit(""))
    if latin:
        return F.translate(squeeze(c), "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN))
    apart, native = _native(c)
    return F.coalesce(normalize_exact(F.when(apart, c)), native)


def _native(c: Column) -> tuple[Column, Column]:
    """Whether a text needs :func:`normalize_exact`, and what tables in the JVM make of it otherwise."""
    ascii_ = F.octet_length(c) == F.length(c)
    odd = F.regexp_replace(c, r"[\x00-\x7F]+", "")  # large classes cost much a character, so they see only these
    apart = ~ascii_ & F.rlike(odd, F.lit(_UNSURE)) & F.rlike(odd, F.lit(_SEVERAL))
    replaced = squeeze(F.translate(c, "".join(CHARACTERS), "".join(CHARACTERS.values())))
    native = F.when(ascii_, squeeze(c)).otherwise(F.translate(replaced, _FROM + _MARKS, _TO))  # marks have no counterpart and go
    return apart, native


def plain(text: str | None) -> str:
    """Replaced characters, single spaces, compatibility decomposition without marks."""
    text = (text or "").translate(str.maketrans(CHARACTERS))
    return "".join(x for x in unicodedata.normalize("NFKD", " ".join(text.split())) if not unicodedata.combining(x))


@F.pandas_udf(StringType())
def normalize_exact(texts: pd.Series) -> pd.Series:
    """:func:`plain` by Arrow batches; null stays null."""
    return texts.map(plain, na_action="ignore")


def tokenize(normal: Column, stop_words: list[str] | None = None, punctuation: bool = True) -> Column:
    """Words of normalized text: punctuation deleted (not replaced), split at white space, stop words left out; repeats stay."""
    if punctuation:
        normal = F.translate(normal, PUNCTUATION, "")
    words = F.array_remove(F.split(normal, r"(?U)\s+"), "")
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def preprocess(normal: Column, min_tokens: int = 2, stop_words: list[str] | None = None) -> Column:
    """Tokens joined by spaces, '' for fewer than ``min_tokens``."""
    words = tokenize(normal, stop_words)
    return F.when(F.size(words) < min_tokens, "").otherwise(F.array_join(words, " "))


def similarity_hash(c: Column, method: str = "md5", latin: bool = False) -> Column:
    """Hash of the first 1000 normalized characters; null for null or empty text. Unknown methods mean md5."""
    if latin:
        head = F.substring(normalize(c, latin), 1, 1000)
    else:  # normalization goes by characters and runs of white space: a start that yields 1000 has the same first 1000
        apart, native = _native(F.coalesce(F.substring(c, 1, 1500), F.lit("")))
        short = (F.length(c) > 1500) & (F.length(native) < 1000)
        head = F.substring(F.coalesce(normalize_exact(F.when(apart | short, c)), native), 1, 1000)
    return F.when(c.isNull() | (c == ""), None).otherwise(F.sha2(head, 256) if method == "sha256" else F.md5(head))


def text_hash(c: Column, method: str = "md5", latin: bool = False) -> Column:
    """Hash of the whole normalized text; null for null or empty text. Unknown methods mean md5."""
    whole = squeeze(normalize(c, latin))
    digest = {"sha1": F.sha1(whole), "sha256": F.sha2(whole, 256)}.get(method, F.md5(whole))
    return F.when(c.isNull() | (c == ""), None).otherwise(digest)


def similar(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether both texts have content, lengths in the ratio ``threshold``, and the same whole hash."""
    close = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)) >= threshold
    return F.coalesce((a != "") & (b != "") & close & (text_hash(a) == text_hash(b)), F.lit(False))


def summary(c: Column, most: int = 150) -> Column:
    """At most ``most`` characters; a longer text is cut for three dots. Null gives ''."""
    return F.when(F.length(c) <= most, c).when(c.isNull(), "").otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def brief(c: Column, most: int = 100) -> Column:
    """The first ``most`` characters, followed by three dots if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(F.coalesce(c, F.lit("")))


def ngrams(words: Column, least: int = 1, most: int = 2) -> Column:
    """Runs of ``least`` to ``most`` words, joined by spaces."""
    none = F.array().cast("array<string>")

    def run(n: int) -> Column:
        if n == 1:
            return words
        joined = words
        for k in range(2, n + 1):  # each place's run with the word after it; the last ones have none
            after = F.slice(words, k, F.greatest(F.size(words) - k + 1, F.lit(0)))
            joined = F.zip_with(F.slice(joined, 1, F.size(after)), after, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(words) >= n, joined).otherwise(none)

    runs = [run(n) for n in range(least, most + 1)]
    return F.concat(*runs)


def found_words(text: Column, words: list[str]) -> Column:
    """Those of ``words`` that the text holds, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def strip_tags(html: Column) -> Column:
    """Whatever stands between angle brackets on a line, removed."""
    return F.regexp_replace(html, "<.*?>", "")


def keyword_hits(normal: Column, keywords: list[str]) -> Column:
    """Whole-word occurrences, ignoring case, summed over the keywords; each is taken literally.

    A keyword without case stands in a text only as it is, so that one plain search spares its pattern, and
    one for the range of their first characters spares all of them.
    """
    uncased = [bool(k) and k.lower() == k.upper() == k.casefold() for k in keywords]
    total = None
    for k, plain_ in zip(keywords, uncased, strict=True):
        hits = F.regexp_count(normal, F.lit(r"(?iu)(?U)\b" + _literal(k) + r"\b"))
        hits = F.when(~F.contains(normal, F.lit(k)), 0).otherwise(hits) if plain_ else hits
        total = hits if total is None else total + hits
    if not all(uncased):
        return total
    first = sorted(ord(k[0]) for k in keywords)
    return F.when(~F.rlike(normal, F.lit(f"[\\x{{{first[0]:X}}}-\\x{{{first[-1]:X}}}]")), 0).otherwise(total)


def _literal(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/#&~" else c for c in word)
