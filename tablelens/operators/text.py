"""Text features over a free-text column.

The vocabulary (top terms, a bounded list) comes from one shuffle keyed by term
with map-side combine; term counts and weights of a document are then sparse
vectors made inside its row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.text import SPARK_ENGLISH_STOP_WORDS, WHITESPACE_CLASS, whitespace_tokens, word_tokens
from tablelens.operators.ranks import attach_scalars

# Lexicon for the sentiment split (positive, then negative words).
POSITIVE_WORDS = ["good", "great", "love", "loved", "excellent", "amazing", "best", "perfect", "happy",
                  "recommend", "awesome", "fantastic", "wonderful", "nice", "fast", "easy", "quality",
                  "comfortable", "beautiful", "favorite", "worth", "smooth", "pleased", "satisfied"]
NEGATIVE_WORDS = ["bad", "worst", "hate", "hated", "terrible", "awful", "poor", "broken", "slow",
                  "disappointed", "waste", "horrible", "never", "problem", "refund", "damaged", "cheap",
                  "useless", "annoying", "expensive", "uncomfortable", "wrong", "stopped", "defective"]


def content_words(text: F.Column, stop_words=SPARK_ENGLISH_STOP_WORDS) -> F.Column:
    """Lower-cased words of a text that are no stop words; NULL gives none."""
    words = F.coalesce(word_tokens(text), F.array().cast("array<string>"))
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))  # planned as a hash-set lookup (InSet)


def vocabulary(df: DataFrame, text_col: str, size: int, min_df: int = 1) -> DataFrame:
    """Top ``size`` terms by total count (ties by term), among terms in at least
    ``min_df`` documents: ``term, total, df``.  Shuffled by term only, and
    combined map-side: a document's distinct terms are found in its row."""
    words = df.select(content_words(F.col(text_col)).alias("w"))
    seen = F.concat(F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("docs"))),
                    F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("docs"))))
    terms = words.select(F.inline(seen)).groupBy("term").agg(F.sum("tf").alias("total"), F.sum("docs").alias("df"))
    return terms.where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(size)


def keywords(df: DataFrame, doc_col: str, text_col: str, top: int = 12, vocab_size: int = 500,
             min_df: int = 2) -> DataFrame:
    """The ``top`` most frequent vocabulary terms: ``term, total``."""
    return vocabulary(df, text_col, min(top, vocab_size), min_df).select("term", "total")


def term_vectors(df: DataFrame, text_col: str, terms: list[str], out: str = "counts") -> DataFrame:
    """Add the counts of the given terms in each text, as a sparse vector made inside the row."""
    from pyspark.ml.feature import CountVectorizerModel
    words = df.withColumn("__words", content_words(F.col(text_col)))
    return CountVectorizerModel.from_vocabulary(terms, inputCol="__words", outputCol=out).transform(words).drop("__words")


def tfidf_vectors(df: DataFrame, text_col: str, vocab_size: int = 300, out: str = "tfidf") -> tuple[DataFrame, list[str]]:
    """E5: add scikit-learn-style TF-IDF vectors over the ``vocab_size`` most
    frequent terms (smooth idf ``ln((1+n)/(1+df)) + 1``, rows of length one), and
    the terms.  The vocabulary is bounded and is all that reaches the driver."""
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors
    vocab = vocabulary(df, text_col, vocab_size).collect()
    if not vocab:
        raise ValueError("no words to build a vocabulary from")
    n, terms = df.count(), [r["term"] for r in vocab]
    idf = Vectors.dense([math.log((1 + n) / (1 + r["df"])) + 1 for r in vocab])
    counted = term_vectors(df, text_col, terms, "__counts")
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="__counts", outputCol="__weights").transform(counted)
    return Normalizer(p=2.0, inputCol="__weights", outputCol=out).transform(weighted).drop("__counts", "__weights"), terms


def _entries(vector: str) -> F.Column:
    """(index, value) of the places of a vector that are not zero."""
    from pyspark.ml.functions import vector_to_array
    pairs = F.transform(vector_to_array(vector), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(pairs, lambda e: e["x"] != 0)


def bag_of_words(df: DataFrame, doc_col: str, text_col: str, vocab_size: int = 500, min_df: int = 2) -> DataFrame:
    """Document-term counts over a ``vocab_size`` vocabulary (terms in at
    least ``min_df`` documents): ``doc, term, tf``.  No shuffle of the documents."""
    terms = [r["term"] for r in vocabulary(df, text_col, vocab_size, min_df).collect()]
    if not terms:
        return df.select(F.col(doc_col).alias("doc"), F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")).limit(0)
    names = F.array(*map(F.lit, terms))
    counted = term_vectors(df.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")), "text", terms)
    return (counted.select("doc", F.inline(_entries("counts")))
            .select("doc", F.element_at(names, F.col("i") + 1).alias("term"), F.col("x").cast("long").alias("tf")))


def tfidf_matrix(df: DataFrame, doc_col: str, text_col: str, vocab_size: int = 300) -> DataFrame:
    """E5 in long form: ``doc, term, weight`` of every weight that is not zero."""
    vectors, terms = tfidf_vectors(df.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")), "text", vocab_size)
    names = F.array(*map(F.lit, terms))
    return (vectors.select("doc", F.inline(_entries("tfidf")))
            .select("doc", F.element_at(names, F.col("i") + 1).alias("term"), F.col("x").alias("weight")))


def tfidf_top_terms(df: DataFrame, doc_col: str, text_col: str, vocab_size: int = 60, top: int = 6,
                    floor: float = 0.08) -> DataFrame:
    """E5: the mean TF-IDF weight of each of the ``vocab_size`` most frequent terms
    over ALL documents; top ``top`` terms with ``weight`` = mean / max, floored
    at ``floor``.  Output ``term, mean, weight``; shuffled by term only."""
    n_docs = df.agg(F.count(F.lit(1)).alias("n"))
    sums = tfidf_matrix(df, doc_col, text_col, vocab_size).groupBy("term").agg(F.sum("weight").alias("sum"))
    top_rows = (attach_scalars(sums, n_docs).select("term", (F.col("sum") / F.col("n")).alias("mean"))
                .orderBy(F.desc("mean"), "term").limit(top))
    mx = top_rows.agg(F.max("mean").alias("_mx"))
    return attach_scalars(top_rows, mx).select(
        "term", "mean", F.greatest(F.lit(floor), F.col("mean") / F.col("_mx")).alias("weight"))


def sentiment(df: DataFrame, text_col: str) -> DataFrame:
    """Lexicon split — a text is positive when it holds more distinct
    positive than negative words, negative when fewer, neutral on a tie.
    Output one row ``positive, neutral, negative`` (shares, NULL texts skipped)."""
    # array_intersect already de-duplicates, so the raw split is enough here
    toks = F.split(F.lower(F.col(text_col)), WHITESPACE_CLASS)
    pos = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in POSITIVE_WORDS])))
    neg = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in NEGATIVE_WORDS])))
    d = df.where(F.col(text_col).isNotNull()).select(pos.alias("p"), neg.alias("n"))
    return d.agg(F.avg((F.col("p") > F.col("n")).cast("double")).alias("positive"),
                 F.avg((F.col("p") == F.col("n")).cast("double")).alias("neutral"),
                 F.avg((F.col("p") < F.col("n")).cast("double")).alias("negative"))


def sentiment_labels(df: DataFrame, text_col: str) -> DataFrame:
    """E9 per row: adds ``sentiment`` in {positive, neutral, negative}."""
    toks = whitespace_tokens(F.col(text_col))
    pos = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in POSITIVE_WORDS])))
    neg = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in NEGATIVE_WORDS])))
    return df.withColumn("sentiment", F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"))


def lda_topics(df: DataFrame, doc_col: str, text_col: str, vocab_size: int = 500, min_df: int = 2,
               words: int = 6, seed: int = 42):
    """Online LDA with k = min(5, max(2, n // 60)) topics over a
    ``vocab_size`` bag of words; ``topic, words`` (top ``words`` terms each)."""
    from pyspark.ml.clustering import LDA

    terms = sorted(r["term"] for r in vocabulary(df, text_col, vocab_size, min_df).collect())
    if len(terms) < 4:
        raise ValueError("topics need at least four terms that occur in two texts")
    data = term_vectors(df.select(F.col(text_col).alias("text")), "text", terms, "features").drop("text")
    n = data.count()
    model = LDA(k=min(5, max(2, n // 60)), maxIter=10, optimizer="online", seed=seed, featuresCol="features").fit(data)
    names = F.array(*map(F.lit, terms))
    return model.describeTopics(words).select(
        (F.col("topic") + 1).alias("topic"), F.transform("termIndices", lambda i: F.element_at(names, i + 1)).alias("words"))
