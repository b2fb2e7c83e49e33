"""Operator 6: line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

Lines are compared by their normalized units: lower case, punctuation and white space between them
left out; a unit is a word, or a character in scripts that put no spaces between words. Equal lines
form a class, and only classes go on. Two lines at most one unit apart (one put in, left out or
exchanged) share their first or their last units, so that only classes that share these with another
emit variants: hashes of the line with each one unit left out, and of the line itself. Equal
variants meet in a join that carries the earliest line of each group, never pairs; the pair with
that line is verified on the units, and the earlier line stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, hot_keys, release, spread_join, stored

#: Whatever stands between words.
SIGNS = r"[^a-z\p{L}\p{M}\p{N}]+"
#: The same, unless it is just one space.
_GAPS = r"[^ a-z\p{L}\p{M}\p{N}][^a-z\p{L}\p{M}\p{N}]*| [^a-z\p{L}\p{M}\p{N}]+"
#: Scripts without spaces between words.
UNSPACED = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
_LINE, _TEXT = 2**30, 2**32  # so many lines a text, and so many hashes of texts with one id


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays are at most one inserted, deleted or exchanged element apart."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    same = F.zip_with(short, F.slice(long_, 1, F.size(short)), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False)).cast("int")  # 0 if all are the same
    exchanged = (F.size(a) == F.size(b)) & ((first == 0) | (F.slice(short, first + 1, F.size(short)) == F.slice(long_, first + 1, F.size(long_))))
    tail = F.when(first == 0, F.lit(True)).otherwise(F.slice(short, F.greatest(first, F.lit(1)), F.size(short)) == F.slice(long_, F.greatest(first, F.lit(1)) + 1, F.size(long_)))
    return exchanged | ((F.size(long_) == F.size(short) + 1) & tail)


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _base(id_: Column, text: Column) -> Column:
    """A text's place in the order by id (null first), then by a hash of the text, as one number that leaves room for its lines."""
    first = _whole(F.coalesce(id_.cast("long"), F.lit(-(2**63))))
    return _whole((_whole(first * F.lit(_TEXT)) + F.pmod(F.xxhash64(text), F.lit(_TEXT))) * F.lit(_LINE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(line: Column) -> Column:
    """The line in lower case, with single spaces between its units and none at its ends."""
    plain = F.regexp_replace(F.lower(line), _GAPS, " ")
    parted = F.regexp_replace(F.regexp_replace(plain, UNSPACED, " $0 "), " +", " ")
    spaced = (F.octet_length(line) == F.length(line)) | ~F.rlike(line, F.lit(UNSPACED))
    return F.btrim(F.when(spaced, plain).otherwise(parted))


def _short(n: Column) -> Column:
    """How many units at either end are compared in lines of ``n``: the three leading bits of n / 2, so that it seldom differs from n to n + 1."""
    half = F.floor(n / 2).cast("int")
    bits = F.floor(F.log2(half + F.lit(0.5)))  # half is never near a power of two then
    return half - half % F.pow(F.lit(2), F.greatest(bits - 2, F.lit(0))).cast("int")


def _ends(line: Column, n: Column) -> list[Column]:
    """Hashes of a line's first and last units, as many as for its own length, and as for a line of one less if that differs."""

    def hashes(size: Column) -> list[Column]:
        return [F.xxhash64(size, F.lit(side), F.call_function("substring_index", line, F.lit(" "), size if not side else -size)) for side in (0, 1)]

    differs = _short(n) != _short(n - 1)
    return hashes(_short(n)) + [F.when(differs, h) for h in hashes(_short(n - 1))]


def _lines(rows: DataFrame, near_units: int) -> DataFrame:
    """at (the line's place), k1 and k2 (its class), e0 to e3 (hashes of its ends, for lines that may have near ones) of every line; k1 is null for blank ones."""
    lines = rows.select("base", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.select("base", "line_no", "raw", units(F.col("raw")).alias("u"))  # not filtered here: that would make the units twice
    n = F.length("u") - F.length(F.replace("u", F.lit(" "), F.lit(""))) + 1
    # A line of signs alone is itself, but for white space at its ends; a line feed tells it from words.
    signs = F.concat(F.lit("\n"), F.regexp_replace("raw", r"^\s+|\s+$", ""))
    lines = lines.select("base", "line_no", n.alias("n"), F.when(F.col("u") != "", F.col("u")).otherwise(signs).alias("line"))
    ends = [F.when(F.col("n") >= near_units, e).alias(f"e{i}") for i, e in enumerate(_ends(F.col("line"), F.col("n")))]
    k1 = F.when(F.col("line") != "\n", F.xxhash64("line"))
    return lines.select(_whole(F.col("base") + F.col("line_no")).alias("at"), k1.alias("k1"), F.hash("line").alias("k2"), *ends)


def _classes(lines: DataFrame) -> DataFrame:
    """k1, k2, first (the place of the earliest), c (how many), e0 to e3."""
    return stored(lines.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("c"), *[F.first(f"e{i}").alias(f"e{i}") for i in range(4)]))


def _candidates(classes: DataFrame) -> DataFrame:
    """first of the classes that share an end with another, with left and right: which."""
    ends = F.array(*[F.struct(F.col(f"e{i}").alias("seg"), F.lit(i % 2).alias("side")) for i in range(4)])
    dealt = classes.where("e0 IS NOT NULL").select("first", F.explode(ends).alias("e")).select("first", "e.*").where("seg IS NOT NULL")
    shared = cut(dealt.groupBy("seg").agg(F.count("*").alias("c")).where("c > 1"))
    some = spread_join(dealt, shared.drop("c"), ["seg"], hot_keys(shared, ["seg"], "c", 2 * classes.count()), F.col("first"))
    return cut(some.groupBy("first").agg(F.max(F.col("side") == 0).alias("left"), F.max(F.col("side") == 1).alias("right")))


def _words(some: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates with w, their units, from the place of their first line."""
    line_no = (F.col("first") % F.lit(_LINE)).cast("int")
    by_text = some.groupBy(_whole(F.col("first") - line_no).alias("base")).agg(F.collect_list(F.struct("first", line_no.alias("line_no"), "left", "right")).alias("places"))
    texts = rows.join(cut(by_text), "base")
    found = let(F.struct(F.split("text", "\n").alias("lines"), "places"), lambda x: F.transform(x["places"], lambda p: F.struct(p["first"].alias("first"), p["left"].alias("left"), p["right"].alias("right"), F.split(units(F.get(x["lines"], p["line_no"])), " ").alias("w"))))
    words = texts.select(F.inline(found))
    return stored(words.dropDuplicates(["first"]))  # repeated rows have the same place


def _running(x: Column) -> Column:
    """Each element's exclusive-or with all before it, by doubling: n log n."""

    def further(acc: Column, r: Column) -> Column:
        by = F.pow(F.lit(2), r).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0).cast("long"), by), F.slice(acc, 1, F.size(acc) - by)), lambda a, b: a.bitwiseXOR(b))

    rounds = F.sequence(F.lit(0), F.length(F.bin((F.size(x) - 1).cast("long"))) - 1)
    return F.aggregate(rounds, x, further)


def _variants(words: DataFrame) -> DataFrame:
    """first, key, i: the hash of the line without unit i (from 1), and of the whole line (i = 0).

    The hash of a line is the exclusive-or of its units' hashes with their places, so that each
    variant follows from sums over what is before and after it. Units that the line shares with others
    stay.
    """
    xor = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    placed = words.select("first", "left", "right", F.transform("w", lambda x, i: F.xxhash64(x, i)).alias("g"), F.transform("w", lambda x, i: F.xxhash64(x, i - 1)).alias("s"))
    change = F.zip_with("g", "s", lambda a, b: a.bitwiseXOR(b))
    placed = placed.select("first", "left", "right", xor(F.col("g")).alias("own"), xor(F.col("s")).alias("all"), "s", _running(change).alias("upto"), F.size("s").alias("n"), _short(F.size("s") - 1).alias("b"))
    # Without unit i: those before it at their places, those after it one place back.
    without = F.zip_with("s", F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col("upto")), 1, F.col("n")), lambda s, before: s.bitwiseXOR(before))
    listed = F.transform(without, lambda x, i: F.struct((i + 1).alias("i"), x.bitwiseXOR(F.col("all")).alias("key")))
    wanted = F.filter(listed, lambda v: (F.col("left") & (v["i"] > F.col("b"))) | (F.col("right") & (v["i"] <= F.col("n") - F.col("b"))))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("own").alias("key")))
    return stored(placed.select("first", F.explode(F.concat(whole, wanted)).alias("v")).select("first", "v.key", "v.i"))


def near_earlier(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """first of the classes that have an earlier class within one unit."""
    spark = classes.sparkSession
    words = _words(_candidates(classes), rows)
    release(spark)
    variants = _variants(words)
    # A unit left out at one place of both: an exchange. A whole line that another has with a unit left out: an insertion.
    per = variants.groupBy("key", "i").agg(F.min("first").alias("m"), F.count("*").alias("c"))
    met = per.groupBy("key").agg(F.min(F.when(F.col("i") == 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.col("m"))).alias("less"))
    rival = F.when(F.col("i") == 0, F.col("less")).otherwise(F.least("m", "whole"))
    rivals = per.join(met, "key").select("key", "i", "c", rival.alias("rival"), "m").where((F.col("rival") != F.col("m")) | (F.col("c") > 1))
    rivals = cut(rivals.select("key", "i", "c", "rival"))
    found = spread_join(variants, rivals.drop("c"), ["key", "i"], hot_keys(rivals, ["key", "i"], "c", variants.count()), F.col("first")).where("rival < first")
    found = cut(found.select("first", "rival").distinct())
    other = words.select(F.col("first").alias("rival"), F.col("w").alias("rival_w"))
    checked = found.join(words.select("first", "w"), "first").join(other, "rival").where(within_one(F.col("w"), F.col("rival_w")))
    return cut(checked.select("first").distinct())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_units: int = 10) -> DataFrame:
    """Drops every line that an earlier line repeats; returns all rows and columns with the texts that remain.

    Lines end at line feeds. They are compared in lower case by their units (words, or single
    characters in scripts without spaces), whatever signs or white space stand between; a line of
    signs alone is compared as it is, blank lines all stay. A line repeats an earlier one if all units
    are the same, or if both have ``near_units`` or more and are at most one unit apart. Of a class of
    equal lines only the first stays, and not that if an earlier line is within one unit of it.
    Earlier: by id (an integer), then by a hash of the text, then by line; null ids first.

    Adds n_lines and n_dropped (long; 0 for null text, which stays null); a text that loses all its
    lines is empty. Rows that repeat both id and text count as one and fare alike. Columns of ``docs``
    with these names are replaced. Candidates for near lines cost n log n for n units.
    """
    spark = docs.sparkSession
    own_text = F.col(text_col).cast("string")
    rows = docs.select(_base(F.col(id_col), own_text).alias("base"), own_text.alias("text"))
    lines = stored(_lines(rows, near_units)).where("k1 IS NOT NULL")
    classes = _classes(lines)
    gone = near_earlier(classes, rows)
    release(spark)
    again = classes.where("c > 1").select("k1", "k2", "first", "c")
    hot = hot_keys(again, ["k1", "k2"], "c", lines.count())
    places = spread_join(lines.select("k1", "k2", "at"), again.drop("c"), ["k1", "k2"], hot, F.col("at")).where(F.col("at") != F.col("first")).select("at")
    places = places.union(gone).select((F.col("at") % F.lit(_LINE)).cast("int").alias("line_no"), "at").select(_whole(F.col("at") - F.col("line_no")).alias("base"), "line_no")
    dropped = cut(places.groupBy(F.col("base").alias("_ld_base")).agg(F.collect_set("line_no").alias("_ld_dropped")))
    release(spark)
    out = docs.drop("n_lines", "n_dropped").withColumn("_ld_own", _base(F.col(id_col), own_text))
    out = out.join(dropped, F.col("_ld_own") == F.col("_ld_base"), "left")
    parts = F.split(own_text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_ld_dropped"))
    left = let(F.struct(parts.alias("parts"), kept.alias("kept")), lambda x: F.array_join(F.transform(x["kept"], lambda i: F.get(x["parts"], i)), "\n"))
    text = F.when(F.col("_ld_dropped").isNull(), own_text).otherwise(left)
    for name, value in (("n_lines", F.size(parts)), ("n_dropped", F.coalesce(F.size("_ld_dropped"), F.lit(0)))):
        out = out.withColumn(name, F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.greatest(value, F.lit(0))).cast("long"))
    return out.withColumn(text_col, text).drop("_ld_own", "_ld_base", "_ld_dropped")
