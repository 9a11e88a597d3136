"""Token counts by distinct pre-tokens.

BPE never merges across pre-tokens, so a text's count is the sum over its
pre-tokens, and each distinct pre-token is encoded once for the whole corpus.
One pass counts pre-tokens (a bounded counter per task, then an aggregation),
the tokenizer encodes the distinct ones, and a second pass counts each
document's pre-tokens and sums: the most frequent pre-tokens, ``HEAD`` at most, come from
a broadcast table of bounded size, all others are joined by pre-token, so a very
common word meets no shuffle and no document's ids are ever held.

Defined cases: null text counts as empty (0 tokens); strings of special tokens
inside a text count as the library's default counts them; repeated rows get a row each;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, text_of

#: Most frequent pre-tokens in the broadcast table, and the characters that each may have.
HEAD, HEAD_CHARS = 1 << 17, 64
#: Distinct pre-tokens that a task counts before it hands its counts on.
HELD = 1 << 18

# The classes of the byte-level pre-tokenizer, below U+0250 (letters, numbers, white space).
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile("[^\x00-ɏ]")


class PreTokens:
    """Splits texts as the tokenizer does: special strings first, then its pre-tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = set(special)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def of(self, text: str) -> list[str]:
        if not self.cut or not any(s in text for s in self.special):
            return self.plain(text)
        return [p for part in self.cut.split(text) for p in ([part] if part in self.special else self.plain(part))]

    def plain(self, text: str) -> list[str]:
        if not BEYOND.search(text):
            return LATIN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


@functools.lru_cache(1)
def pretokens(path: str) -> PreTokens:
    """One tokenizer for all tasks of a worker process."""
    return PreTokens(path)


def _corpus_counts(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = pretokens(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pretoken": pa.array(list(held), pa.string()),
                                               "n": pa.array(list(held.values()), pa.int64())})
        for batch in batches:
            for text in batch.column(0):
                held.update(split.of(text.as_py()))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()
    return count


def _pieces(path: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(split.pieces(part.column(0).to_pylist()), pa.int32())],
                    names=["pretoken", "n", "pieces"])
    return pieces


def _document_counts(path: str, head):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = pretokens(path), head.value
        for batch in batches:
            sums, rest = [], []
            for text in batch.column(1):
                found = split.of(text.as_py())
                pieces = [known.get(p) for p in found]
                tail = Counter(p for p, n in zip(found, pieces) if n is None)
                sums.append(sum(filter(None, pieces)))
                rest.append([{"pretoken": p, "times": n} for p, n in tail.items()])
            tail_type = pa.list_(pa.struct([("pretoken", pa.string()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, pa.int64()), pa.array(rest, tail_type)], names=["id", "known", "rest"])
    return count


def pretoken_pieces(texts: DataFrame, path: str) -> DataFrame:
    """(pretoken, n, pieces) of every distinct pre-token of a one-column table of texts."""
    counts = texts.mapInArrow(_corpus_counts(path), "pretoken string, n long")
    return materialise(counts.groupBy("pretoken").agg(F.sum("n").alias("n"))
                       .mapInArrow(_pieces(path), "pretoken string, n long, pieces int"), "pretokens")


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows whose count ``n`` reaches a level that at most ``most`` rows reach.

    The level is read off a histogram of counts, eight bins to a doubling."""
    level = F.floor(8 * F.log2("n"))
    bins = sorted(table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    cut, total = None, 0
    for at, rows in bins:  # at most 8 x 63
        total += rows
        if total > most:
            break
        cut = at
    return table.where(level >= cut) if cut is not None else table.limit(0)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens."""
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"),
                                F.octet_length(text_of(text_col)).cast("long").alias("n_bytes")).alias("id"),
                       text_of(text_col).alias("text"))
    table = pretoken_pieces(rows.select("text"), tokenizer_path)
    top = most_frequent(table.where(F.length("pretoken") <= HEAD_CHARS), HEAD).select("pretoken", "pieces").toPandas()
    head = docs.sparkSession.sparkContext.broadcast(dict(zip(top["pretoken"], top["pieces"].tolist())))
    counted = materialise(rows.mapInArrow(
        _document_counts(tokenizer_path, head), f"id {rows.schema['id'].dataType.simpleString()}, known long, "
        "rest array<struct<pretoken:string,times:long>>").select("id.*", "known", "rest"), "document_counts")
    tail = (counted.select("row_id", F.inline("rest")).join(table, "pretoken")
            .groupBy("row_id").agg(F.sum(F.col("times") * F.col("pieces")).alias("joined")))
    return (counted.select("row_id", "id", "n_bytes", "known").join(tail, "row_id", "left")
            .select("id", "n_bytes", (F.col("known") + F.coalesce("joined", F.lit(0))).alias("n_tokens")))
