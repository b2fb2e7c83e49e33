"""URLs as Spark columns. Parts follow the generic syntax: scheme://authority/path?query#fragment."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.functions.lexicon import DETAIL_PARTS, IMPORTANT_PARTS, LIST_PARTS


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path without query, fragment and the last segment's parameters."""
    whole = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(whole, r";[^/]*$", "")


def normalize_url(url: Column) -> Column:
    """scheme://authority and path of an absolute URL: no parameters, query or fragment; no folding of case or slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r";[^/]*$", "")


@F.pandas_udf(StringType())
def resolve(url: pd.Series, base: pd.Series) -> pd.Series:
    """``url`` as seen from ``base``; absolute ones stay."""
    return pd.Series([None if u is None else u if u.startswith(("http://", "https://")) or not b else urljoin(b, u) for u, b in zip(url, base, strict=True)])


def resolve_rooted(href: Column, base: Column) -> Column:
    """:func:`resolve` without Python for links that are absolute, rooted, or only a query or fragment."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(site, href)).otherwise(href)


def segments(url: Column) -> Column:
    """Path segments between slashes, none empty."""
    return F.array_remove(F.split(path(url), "/"), "")


def raw_segments(url: Column) -> Column:
    """Path segments as splitting the trimmed path at slashes gives them: one empty segment for an empty path."""
    return F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/")


def url_vector(url: Column, width: int) -> Column:
    """[hash of host, then for each segment -1 for digits, -2 with a hyphen, else a hash below a million], padded with 0."""
    parts = segments(url)
    coded = F.transform(parts, lambda s: F.when(s.rlike(r"^\d+$"), F.lit(-1)).when(F.contains(s, F.lit("-")), F.lit(-2)).otherwise(F.pmod(F.xxhash64(s), F.lit(1_000_000))).cast("double"))
    padded = F.slice(F.concat(coded, F.array_repeat(F.lit(0.0), width)), 1, width)
    return F.concat(F.array(F.pmod(F.xxhash64(authority(url)), F.lit(1_000_000)).cast("double")), padded)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_list(pattern: Column) -> Column:
    return _any([F.contains(pattern, F.lit(p)) for p in LIST_PARTS])


def is_detail(pattern: Column) -> Column:
    return (F.contains(pattern, F.lit("*")) | _any([pattern.rlike(p) for p in DETAIL_PARTS])) & ~is_list(pattern)


def pattern_regex(pattern: Column) -> Column:
    """A URL pattern as an anchored regular expression: ``*`` for any text; one that starts with ^ and ends with $ stays."""
    lazy = F.replace(pattern, F.lit("*"), F.lit(".*?"))
    opened = F.when(lazy.startswith("^"), lazy).otherwise(F.concat(F.lit("^"), lazy))
    closed = F.when(opened.endswith("$"), opened).otherwise(F.concat(opened, F.lit("$")))
    return F.when(pattern.startswith("^") & pattern.endswith("$"), pattern).otherwise(closed)


def url_similarity(a: Column, b: Column) -> Column:
    """0.1 for other hosts, 0.3 for other numbers of segments, else the share of equal segments."""
    p, q = raw_segments(a), raw_segments(b)
    same = F.size(F.filter(F.zip_with(p, q, lambda x, y: x == y), lambda x: x))
    return F.when(authority(a) != authority(b), 0.1).when(F.size(p) != F.size(q), 0.3).otherwise(same / F.greatest(F.size(p), F.lit(1)))


def host_token(url: Column) -> Column:
    return F.replace(authority(url), F.lit("."), F.lit("_"))


def weighted_priority(url: Column, depth: Column, job_type: Column) -> Column:
    """Mean of the default policies that apply, by weight, towards zero: depth, list, detail, sitemap, slashes in the path."""
    policies = [
        (depth.isNotNull(), depth * 10, 1.0),
        (job_type == "list", F.lit(-20), 1.5),
        (job_type == "detail", F.lit(-10), 1.0),
        (job_type == "sitemap", F.lit(-30), 2.0),
        (F.lit(True), F.regexp_count(path(url), F.lit("/")) * 5, 0.8),
    ]
    return mean_of_policies(policies)


def mean_of_policies(policies: list[tuple[Column, Column, float]]) -> Column:
    """(condition, priority, weight) of each policy to one whole number; 0 where none applies."""
    on = [F.coalesce(c, F.lit(False)) for c, _, _ in policies]
    total = reduce(lambda a, b: a + b, [F.when(c, v * w).otherwise(0.0) for c, (_, v, w) in zip(on, policies, strict=True)])
    weight = reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(0.0) for c, (_, _, w) in zip(on, policies, strict=True)])
    return F.when(weight > 0, total / weight).otherwise(0.0).cast("int")


def additive_priority(url: Column, depth: Column, job_type: Column) -> Column:
    kind = F.when(job_type == "list", -20).when(job_type == "detail", -10).otherwise(0)
    return (depth * 10 + kind + F.when(_any([F.contains(url, F.lit(p)) for p in IMPORTANT_PARTS]), -5).otherwise(0)).cast("int")
