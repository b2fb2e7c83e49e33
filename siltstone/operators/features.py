"""Features of texts: TF-IDF in long form and as vectors, keyword and type scores, structural statistics."""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as X
from siltstone.functions.lexicon import CONTENT_TYPES, COUNTED_MARKS, DOMAINS, QUESTION_WORDS
from siltstone.plans.lineage import cut

#: Vocabulary size, least documents, largest share of documents, longest n-gram by kind of feature set.
TFIDF = {"general": (10_000, 2, 0.95, 2), "type": (5_000, 2, 0.9, 2), "domain": (8_000, 2, 0.9, 3)}


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _grams(docs: DataFrame, words: Column, key: str, longest: int) -> DataFrame:
    """key, _grams: a column of its own, so that n-grams are made once."""
    return docs.select(key, words.alias("_words")).select(key, X.ngrams(F.col("_words"), 1, longest).alias("_grams"))


def terms(docs: DataFrame, words: Column, key: str, longest: int, vocab: DataFrame | None = None) -> DataFrame:
    """key, term, tf; with ``vocab``, only of its terms, so that no others are shuffled."""
    listed = _grams(docs, words, key, longest).select(key, F.explode("_grams").alias("term"))
    if vocab is not None:
        listed = listed.join(F.broadcast(vocab.select("term")), "term")  # of a bounded size
    return listed.groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, words: Column, key: str, longest: int) -> DataFrame:
    """term, df (documents that have it), total (times it occurs): counted in one pass, combined before the shuffle by term."""
    one = lambda grams, df, n: F.transform(grams, lambda g: F.struct(g.alias("term"), F.lit(df).alias("df"), F.lit(n).alias("n")))
    listed = _grams(docs, words, key, longest).select(F.inline(F.concat(one(F.array_distinct("_grams"), 1, 0), one(F.col("_grams"), 0, 1))))
    return listed.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"))


def frequent_counts(rows: DataFrame, words: Column, key: str, longest: int, n_docs: int, size: int, least: int, most: float) -> DataFrame:
    """Of :func:`term_counts`, at least the rows that :func:`vocabulary` takes: documents are counted for the most frequent terms alone, for more of them until ``size`` fit."""
    listed = _grams(rows, words, key, longest)
    totals = listed.select(F.explode("_grams").alias("term")).groupBy("term").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    taken = 2 * size
    while True:
        top = cut(totals.orderBy(F.desc("total"), "term").limit(taken))
        held = F.broadcast(top.select("term")) if taken <= 50_000 else top.select("term")
        df = listed.select(F.explode(F.array_distinct("_grams")).alias("term")).join(held, "term").groupBy("term").agg(F.count("*").alias("df"))
        out = cut(top.join(df, "term").select("term", "df", "total"))
        if top.count() < taken or out.where((F.col("df") >= least) & (F.col("df") <= most * n_docs)).count() >= size:
            return out
        taken *= 8


def vocabulary(counts: DataFrame, n_docs: int, size: int, least: int, most: float) -> DataFrame:
    """term, df, total, idf, rank of :func:`term_counts`: terms in ``least`` documents to a share ``most``, the ``size`` most frequent, ties by term."""
    v = counts.where((F.col("df") >= least) & (F.col("df") <= most * n_docs)).orderBy(F.desc("total"), "term").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("total"), "term"))  # ``size`` rows at most
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return v.select("term", "df", "total", idf.alias("idf"), rank.alias("rank"))


def tfidf(tf: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, term, weight: tf * idf, rows of length 1. The vocabulary has a bounded size and is broadcast."""
    w = tf.join(F.broadcast(vocab.select("term", "idf", "rank")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # a document's own terms, vocabulary size at most
    return w.select(key, "term", "rank", (F.col("w") / norm).alias("weight"))


def tfidf_vectors(rows: DataFrame, words: str, vocab: DataFrame, longest: int, output: str) -> DataFrame:
    """Adds the TF-IDF rows of length 1 as sparse vectors, by the engine's own transformers; the vocabulary, of a bounded size, is collected."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    known = [(r.term, r.idf) for r in vocab.orderBy("rank").collect()] or [("", 0.0)]
    counted = CountVectorizerModel.from_vocabulary([t for t, _ in known], inputCol="_grams", outputCol="_tf")
    counted = counted.transform(rows.withColumn("_grams", X.ngrams(F.col(words), 1, longest)))
    scaled_ = ElementwiseProduct(scalingVec=Vectors.dense([w for _, w in known]), inputCol="_tf", outputCol="_tfidf").transform(counted)
    return Normalizer(inputCol="_tfidf", outputCol=output).transform(scaled_).drop("_grams", "_tf", "_tfidf")


def keyword_scores(normal: Column, keywords: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Hits by keywords of each name over how many there are, scaled so that a row sums to 1; zeros without a hit."""
    keywords = keywords or DOMAINS
    raw = {k: X.keyword_hits(normal, words) / len(words) for k, words in keywords.items()}
    total = _sum(list(raw.values()))
    return {k: F.when(total > 0, v / total).otherwise(0.0) for k, v in raw.items()}


def with_keyword_scores(docs: DataFrame, normal: Column, keywords: dict[str, list[str]] | None = None, prefix: str = "") -> DataFrame:
    """As columns; raw hits are computed once."""
    keywords = keywords or DOMAINS
    raw = docs.withColumns({f"_raw_{k}": X.keyword_hits(normal, words) / len(words) for k, words in keywords.items()})
    total = _sum([F.col(f"_raw_{k}") for k in keywords])
    return raw.withColumns({prefix + k: F.when(total > 0, F.col(f"_raw_{k}") / total).otherwise(0.0) for k in keywords}).drop(*[f"_raw_{k}" for k in keywords])


def sentences(normal: Column) -> Column:
    return F.filter(F.split(normal, "[.!؟]+"), lambda s: ~s.rlike(r"^(?U)\s*$"))


def _mean_length(parts: Column) -> Column:
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    return total / F.greatest(F.size(parts), F.lit(1))


def paragraphs(normal: Column) -> Column:
    return F.size(F.filter(F.split(normal, "\n"), lambda p: ~p.rlike(r"^(?U)\s*$")))


def type_structure(normal: Column) -> dict[str, Column]:
    """The six structural parts of a content type's features."""
    parts = sentences(normal)
    marks = F.regexp_count(normal, F.lit("؟"))
    first = F.lower(F.trim(F.get(parts, F.lit(0))))
    asks = reduce(lambda a, b: a | b, [F.contains(first, F.lit(q)) for q in QUESTION_WORDS])
    out = {
        "length_k": F.length(normal) / 1000,
        "paragraphs": paragraphs(normal).cast("double"),
        "question_marks": marks.cast("double"),
        "sentence_length_h": _mean_length(parts) / 100,
        "questions_per_sentence": marks / F.greatest(F.size(parts), F.lit(1)),
        "starts_with_question": F.when(F.coalesce(asks, F.lit(False)), 1.0).otherwise(0.0),
    }
    return {k: F.when(normal == "", 0.0).otherwise(v) for k, v in out.items()}


def type_scores(docs: DataFrame, normal: Column, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    return with_keyword_scores(docs, normal, keywords or CONTENT_TYPES, "type_").withColumns(type_structure(normal))


#: Names of the twelve structural statistics, in order.
STRUCTURAL = ["text_length", "word_count", "sentence_count", "paragraph_count", "avg_sentence_length", "avg_word_length", "punctuation_ratio", "uppercase_ratio", "digit_ratio", "unique_words_ratio", "question_count", "exclamation_count"]


def structural(normal: Column) -> Column:
    """The twelve structural statistics of normalized text, unscaled, as a struct; words and sentences are parted once."""
    marks = "[" + "".join("\\" + c for c in COUNTED_MARKS) + "]"

    def values(x: Column) -> Column:
        text, words, parts = x["text"], x["words"], x["parts"]
        length = F.greatest(F.length(text), F.lit(1))
        out = [
            F.length(text),
            F.size(words),
            F.size(parts),
            paragraphs(text),
            _mean_length(parts),
            _mean_length(words),
            F.regexp_count(text, F.lit(marks)) / length,
            F.regexp_count(text, F.lit(r"\p{Lu}|\p{Lt}")) / length,
            F.regexp_count(text, F.lit(r"\p{Nd}")) / length,
            F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
            F.regexp_count(text, F.lit("؟")),
            F.regexp_count(text, F.lit("!")),
        ]
        return F.struct(*[v.cast("double").alias(k) for k, v in zip(STRUCTURAL, out, strict=True)])

    held = F.struct(normal.alias("text"))
    held = F.transform(F.array(held), lambda x: F.struct(x["text"].alias("text"), F.array_remove(F.split(x["text"], r"(?U)\s+"), "").alias("words"), sentences(x["text"]).alias("parts")))
    return F.get(F.transform(held, values), F.lit(0))


def with_structural(docs: DataFrame, normal: Column) -> DataFrame:
    """``docs`` with the twelve statistics as columns."""
    return docs.withColumn("_structural", structural(normal)).select(*docs.columns, "_structural.*")


def batch_max(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns])


def scaled(df: DataFrame, columns: list[str], maxima: DataFrame | None = None) -> DataFrame:
    """Columns over their largest value in the whole batch (or fitted ``maxima``), 0 counting as 1."""
    top = (batch_max(df, columns) if maxima is None else maxima).select(*[F.col(c).alias(f"_max_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(top))  # one row
    return out.withColumns({c: F.col(c) / F.when(F.col(f"_max_{c}") == 0, 1.0).otherwise(F.col(f"_max_{c}")) for c in columns}).drop(*top.columns)


def class_weights(rows: DataFrame, label: str, strategy: str = "balanced") -> DataFrame:
    """label, n, weight: n / (k * n_i) if balanced, else 1 / n_i."""
    each = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = each.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    weight = F.col("_n") / (F.col("_k") * F.col("n")) if strategy == "balanced" else 1.0 / F.col("n")
    return each.crossJoin(F.broadcast(whole)).select(label, "n", weight.alias("weight"))  # one row


class Preprocessor(Transformer):
    """Adds an array of tokens (``output``) of a text column (``input``), as other stages take it."""

    @keyword_only
    def __init__(self, input: str = "text", output: str = "words", stop_words: list[str] | None = None):
        super().__init__()
        self.input, self.output, self.stop_words = input, output, stop_words

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.output, X.tokenize(X.normalize(F.col(self.input)), self.stop_words))


def feature_blocks(docs: DataFrame, kind: str = "general", key: str = "doc_id", text: str = "text", latin: bool = False, use: tuple[str, ...] = ("tfidf", "keywords", "structural")) -> DataFrame:
    """key, features: TF-IDF, keyword and structural parts side by side in one vector.

    general: TF-IDF, domain keywords, structure. type: TF-IDF, type scores with their structure,
    structure. domain: TF-IDF, domain keywords.
    """
    from pyspark.ml.feature import VectorAssembler

    size, least, most, longest = TFIDF[kind]
    rows = docs.select(key, X.normalize(F.col(text), latin).alias("_n")).withColumn("_p", X.preprocess(F.col("_n")))
    words = F.array_remove(F.split("_p", " "), "")
    parts: list[str] = []
    if "keywords" in use:
        rows = type_scores(rows, F.col("_n")) if kind == "type" else with_keyword_scores(rows, F.col("_n"))
        parts += [*[f"type_{k}" for k in CONTENT_TYPES], *type_structure(F.col("_n"))] if kind == "type" else list(DOMAINS)
    structure = "structural" in use and kind != "domain"
    if structure:
        rows = with_structural(rows, F.col("_n"))
        parts += STRUCTURAL
    rows = cut(rows.drop("_n"))  # texts are read once; maxima, vocabulary and vectors come from here
    if structure:
        rows = scaled(rows, STRUCTURAL)
    if "tfidf" in use:
        n_docs = rows.count()
        vocab = vocabulary(frequent_counts(rows, words, key, longest, n_docs, size, least, most), n_docs, size, least, most)
        rows = tfidf_vectors(rows.withColumn("_w", words), "_w", vocab, longest, "_t")
        parts = ["_t", *parts]
    return VectorAssembler(inputCols=parts, outputCol="features").transform(rows).select(key, "features")
