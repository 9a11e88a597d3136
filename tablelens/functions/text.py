"""Text tokenisation expressions shared by the text operators and their oracles.

Word tokens follow scikit-learn's default ``(?u)\\b\\w\\w+\\b`` on lower-cased
text, written as an explicit Unicode class both Java regex and RE2 accept.
Whitespace tokens follow Python's ``str.split()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.split() whitespace, as a regex character class.
WHITESPACE_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
# Word = run of two or more letters / digits / underscore.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Spark ML's default English stop words
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")), kept as
# text so the DuckDB oracles can filter with the same list.
SPARK_ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now "
    "i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()


def word_tokens(text: Column) -> Column:
    """Array of lower-cased word tokens (with repeats)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def whitespace_tokens(text: Column) -> Column:
    """Distinct lower-cased whitespace-separated tokens (Python ``set(t.lower().split())``)."""
    toks = F.split(F.lower(text), WHITESPACE_CLASS)
    return F.array_distinct(F.filter(toks, lambda t: t != ""))


def sql_str_list(words) -> str:
    """SQL list literal of strings (for oracles)."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
