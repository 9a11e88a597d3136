"""E5-E9 over the whole documents table (all languages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.text import SPARK_ENGLISH_STOP_WORDS, WHITESPACE_CLASS, WORD_PATTERN, sql_str_list
from tablelens.operators import text as X
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register


def all_docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


_TC_SQL = f"""
docs AS (SELECT doc_id, text FROM documents),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS term FROM docs),
tc AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE NOT list_contains({sql_str_list(SPARK_ENGLISH_STOP_WORDS)}, term)
       GROUP BY 1, 2)
"""


@register("keywords", f"""
WITH {_TC_SQL},
v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tc GROUP BY term HAVING count(*) >= 2
      ORDER BY total DESC, term LIMIT 500)
SELECT term, total FROM v ORDER BY total DESC, term LIMIT 12
""")
def keywords(spark, sf):
    return X.keywords(all_docs(spark, sf), "doc_id", "text")


@register("bag_of_words", f"""
WITH {_TC_SQL},
v AS (SELECT term FROM tc GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 500)
SELECT count(*) AS entries, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT term) AS terms FROM tc JOIN v USING (term)
""")
def bag_of_words(spark, sf):
    b = X.bag_of_words(all_docs(spark, sf), "doc_id", "text")
    return b.agg(F.count(F.lit(1)).alias("entries"), F.sum("tf").alias("tokens"),
                 F.countDistinct("term").alias("terms"))


@register("tfidf_top_terms", f"""
WITH {_TC_SQL},
n AS (SELECT count(*) AS n FROM docs),
v AS (SELECT term, count(*) AS df FROM tc GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 60),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tc JOIN v USING (term), n),
nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS wn FROM w),
m AS (SELECT term, sum(wn) / any_value(n) AS mean FROM nw, n GROUP BY term ORDER BY mean DESC, term LIMIT 6)
SELECT term, round(mean, 6) AS mean, round(greatest(0.08, mean / max(mean) OVER ()), 6) AS weight FROM m
""")
def tfidf_top_terms(spark, sf):
    t = X.tfidf_top_terms(all_docs(spark, sf), "doc_id", "text")
    return t.select("term", r6(F.col("mean")).alias("mean"), r6(F.col("weight")).alias("weight"))


def _sent_sql(table_sql: str, col: str) -> str:
    from tablelens.operators.text import NEGATIVE_WORDS, POSITIVE_WORDS
    return f"""
WITH t AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower({col}), '{WHITESPACE_CLASS}'), lambda x: x <> '')) AS tk
           FROM ({table_sql}) WHERE {col} IS NOT NULL),
c AS (SELECT len(list_intersect(tk, {sql_str_list(POSITIVE_WORDS)})) AS p,
             len(list_intersect(tk, {sql_str_list(NEGATIVE_WORDS)})) AS n FROM t)
SELECT round(avg(CAST(p > n AS DOUBLE)), 6) AS positive, round(avg(CAST(p = n AS DOUBLE)), 6) AS neutral,
       round(avg(CAST(p < n AS DOUBLE)), 6) AS negative FROM c
"""


@register("sentiment", _sent_sql("SELECT text FROM documents", "text"))
def sentiment(spark, sf):
    s = X.sentiment(load(spark, sf, "documents"), "text")
    return s.select(*[r6(F.col(c)).alias(c) for c in ("positive", "neutral", "negative")])


@register("sentiment_conversations", _sent_sql("SELECT text FROM conversations", "text"))
def sentiment_conversations(spark, sf):
    s = X.sentiment(load(spark, sf, "conversations"), "text")
    return s.select(*[r6(F.col(c)).alias(c) for c in ("positive", "neutral", "negative")])


@register("topics_lda")
def topics_lda(spark, sf):
    return X.lda_topics(all_docs(spark, sf), "doc_id", "text")
