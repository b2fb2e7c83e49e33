"""Operator 4: benchmark decontamination by a prefix-filtered join, in DataFrame operations alone.

An item is cut into windows of ten words; a document word inside an occurrence of a window is hit.
A window's tokens are its five-word shingles, ordered by how rare they are in all documents. As an
occurrence must hold every token, the necessary prefix is one token: the rarest. Documents'
shingles join these tokens; the shingle's place and the window's offset give where the window
would start, which must lie within the document; then its words are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, word_array


def shingles(w: Column, n: Column, width: int) -> Column:
    """Hashes of the ``width`` words from each place on, as array; empty for fewer words."""
    start = F.when(n >= width, F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(start, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item_id and w (words) of each window: every ``window`` consecutive words, or all of an item with fewer, but not none."""
    words = items.select(F.col(id_col).alias("item_id"), word_array(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("w"))


def _by_width(docs: DataFrame, widths: list[int], keep: list[str]) -> DataFrame:
    """The documents' shingles of all widths: keep, width, pos, token."""
    out = None
    for width in widths:
        part = docs.select(*keep, F.lit(width).alias("width"), F.posexplode(shingles(F.col("words"), F.col("n_words"), width)).alias("pos", "token"))
        out = part if out is None else out.union(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, width: int = 5, block: int = 200_000) -> DataFrame:
    """Which words of each document lie inside occurrences of benchmark windows.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z as a-z. Rows, one for
    each row of ``docs``: the id, n_words, n_hit (words hit), n_items (items with an occurring
    window), items_sha256 (of those ids, sorted as strings, comma-joined), contaminated (n_hit > 0),
    text_hash (with the id, what tells rows apart).

    Null or wordless texts have no words; wordless items have no windows. Items that repeat a window
    all count; a null item id hits words but is not listed. Rows that repeat id and text fare alike;
    null ids stay null. Extra columns are ignored. The benchmark joins in blocks of at most ``block``
    windows, each broadcast, so that its size is bounded; a larger benchmark takes more passes.
    """
    all_windows = cut(item_windows(items, item_id, item_text, window))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = word_array(F.col("text"))
    base = base.select("id", F.xxhash64("text").alias("th"), words.alias("words")).withColumn("n_words", F.size("words"))

    distinct = all_windows.groupBy("w").agg(F.count("*")).select("w", F.xxhash64("w").alias("wkey"), F.size("w").alias("len"))
    distinct = cut(distinct)
    sizes = [r[0] for r in distinct.select("len").distinct().collect()]  # at most ``window`` numbers
    widths = sorted({min(width, n) for n in sizes})
    total = distinct.count()
    blocks = -(-total // block)
    hits = None
    for b in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("wkey", F.lit(b"blk")), F.lit(blocks)) == b) if blocks > 1 else distinct
        tokens = None
        for k in widths:
            mine = own.where(F.col("len") >= k if k == width else F.col("len") == k)
            part = mine.select("wkey", "len", "w", F.lit(k).alias("width"), F.posexplode(shingles(F.col("w"), F.col("len"), k)).alias("offset", "token"))
            tokens = part if tokens is None else tokens.union(part)
        tokens = cut(tokens)
        # How often each token stands in all documents; a token that stands nowhere rules its windows out.
        wanted = F.broadcast(tokens.select("width", "token").distinct())
        rarity = _by_width(base, widths, []).join(wanted, ["width", "token"]).groupBy("width", "token").agg(F.count("*").alias("seen"))
        counted = tokens.join(rarity, ["width", "token"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        first = counted.groupBy("wkey").agg(F.min(F.struct("seen", "token", "offset", "width")).alias("p"))
        prefix = own.join(first, "wkey").where("p.seen > 0").select("wkey", "len", "w", "p.token", "p.offset", "p.width")
        prefix = cut(prefix)
        start = F.col("pos") - F.col("offset")
        found = _by_width(base, widths, ["id", "th", "words", "n_words"]).join(F.broadcast(prefix), ["width", "token"])
        found = found.where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        found = found.where(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("w"))
        found = found.select("id", "th", start.alias("start"), "len", "wkey")
        hits = found if hits is None else hits.union(found)
    out = base.select("id", "th", F.col("n_words").cast("long"))
    none = F.sha2(F.lit(""), 256)
    if hits is None:
        return out.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"), F.col("th").alias("text_hash"))
    hits = cut(hits.distinct())
    # Places by start, and how far the words before them are hit already.
    spans = hits.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    fold = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["len"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["end"], s["start"]))).alias("n")
    )
    spans = spans.select("id", "th", F.aggregate("spans", zero, fold)["n"].alias("n_hit"))
    listed = hits.select("id", "th", "wkey").distinct().join(all_windows.select("item_id", F.xxhash64("w").alias("wkey")).distinct(), "wkey")
    listed = listed.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = spans.join(listed, spans["id"].eqNullSafe(listed["id"]) & (spans["th"] == listed["th"])).select(spans["id"].alias("_id"), spans["th"].alias("_th"), "n_hit", "items")
    out = out.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("items", ","), 256), none).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("th").alias("text_hash"),
    )
