"""Top-k similarity and retrieval.

Exact top-k of a stated query set by a blocked join: the pairs are never rows.
Queries are hashed into blocks and items into chunks of bounded size, and every
(block, chunk) cell is one cogroup task that scores the cell tile by tile with NumPy
and emits only its local top-k per query.  A final ``row_number() <= k`` per query (Spark plans it as a
WindowGroupLimit, so partial top-k happens before the shuffle) merges the
cells.  Memory per task is bounded by the block sizes, whatever the table
sizes; a dense cluster cannot create a larger group.  Neighbours of every item
come from :mod:`tablelens.operators.neighbours`, without all pairs.

Keyword retrieval sends the inverted index of a query set of checked size to the documents, which
are then read once and never shuffled.  Beyond that size queries and documents meet by token.  A query's k-th score among
documents that share its rarest tokens is a bound: a document that reaches it
must share one of all but so many of the query's tokens, so the posting lists of the most common
ones are never read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.scalars import hash_bucket
from tablelens.functions.text import whitespace_tokens
from tablelens.operators.ranks import shared


#: Queries and rows that make a cell of their own, at least, and those whose scores are there at once: two megabytes, so
#: that they are looked through before they leave the processor's cache.
Q_TILE, D_TILE, Q_SCORES, D_SCORES = 2048, 8192, 256, 1024
#: Numbers of one side of a cell, at most, and cells that a larger join has, at least.
SIDE_NUMBERS, LEAST_CELLS = 1 << 22, 64


def _sides(nq: int, nd: int, width: int) -> tuple[int, int]:
    """(query blocks, row chunks): as few as memory allows, as each side is sent once for each part of the other."""
    most = max(1, SIDE_NUMBERS // max(1, width))
    b = max(1, math.ceil(nq / most), min(math.isqrt(LEAST_CELLS), math.ceil(nq / Q_TILE)))
    return b, max(1, math.ceil(nd / most), min(math.ceil(LEAST_CELLS / b), math.ceil(nd / D_TILE)))


def _cell_topk(kind: str, k: int, exclude_self: bool):
    def fn(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "did": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        d = d.sort_values("did", kind="stable").reset_index(drop=True)
        qids = q["qid"].to_numpy()
        dids = d["did"].to_numpy()
        qm = np.vstack([np.asarray(v, dtype=np.float64) for v in q["payload"]])
        dm = np.vstack([np.asarray(v, dtype=np.float64) for v in d["payload"]])
        norms = (dm * dm).sum(axis=1)
        own = np.full(len(qids), -1)
        if exclude_self:  # dids are sorted: locate each query's own row directly
            pos = np.searchsorted(dids, qids)
            own = np.where((pos < len(dids)) & (dids[np.minimum(pos, len(dids) - 1)] == qids), pos, -1)
        found = []
        for i in range(0, len(qids), Q_SCORES):
            qt = qm[i:i + Q_SCORES]
            leaders = _Leaders(len(qt), k)
            for j in range(0, len(dids), D_SCORES):
                scores = dm[j:j + D_SCORES] @ qt.T
                if kind == "euclidean":  # negative squared distance: larger is nearer
                    scores = 2 * scores - norms[j:j + D_SCORES, None] - (qt * qt).sum(axis=1)[None, :]
                at = own[i:i + Q_SCORES] - j
                ok = (own[i:i + Q_SCORES] >= 0) & (at >= 0) & (at < len(scores))
                scores[at[ok], np.flatnonzero(ok)] = -np.inf
                leaders.add(scores, dids[j:j + D_SCORES])
            found.append(leaders.rows(qids[i:i + Q_SCORES]))
        return pd.concat(found, ignore_index=True)
    return fn


#: Rows after which the leaders are first looked at, and how many times as many rows come until they are again.
FIRST_ROWS, MORE_ROWS = 64, 8


class _Leaders:
    """The ``k`` best rows of each query so far, by (score desc, id asc).

    Rows come by rising id, so only those above a query's k-th score can still be among its best: after the first few rows a
    tile's scores are compared once, and hardly any is sorted."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.c, self.score, self.did = np.empty(0, np.intp), np.empty(0), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, dids: np.ndarray) -> None:
        begin, step = 0, FIRST_ROWS if not len(self.c) else len(dids)
        while begin < len(dids):
            r, c = np.nonzero(scores[begin:begin + step] > self.least[None, :])
            if len(r):
                c = np.r_[self.c, c]
                score, did = np.r_[self.score, scores[begin + r, c[len(self.c):]]], np.r_[self.did, dids[begin + r]]
                order = np.lexsort((did, -score, c))
                c = c[order]
                place = np.arange(len(c)) - np.searchsorted(c, c, side="left")
                kept = order[place < self.k]
                last = order[place == self.k - 1]
                self.least[c[place == self.k - 1]] = score[last]
                self.c, self.score, self.did = c[place < self.k], score[kept], did[kept]
            begin, step = begin + step, step * MORE_ROWS

    def rows(self, qids: np.ndarray) -> pd.DataFrame:
        some = np.isfinite(self.score)
        return pd.DataFrame({"qid": qids[self.c[some]].astype("int64"), "did": self.did[some].astype("int64"),
                             "score": self.score[some].astype("float64")})


def _local_topk(scores: np.ndarray, qids: np.ndarray, dids: np.ndarray, k: int) -> pd.DataFrame:
    """Top-k rows of every column by (score desc, row asc) — rows are in id
    order — with a linear-time partition and one vectorised sort of the few
    candidates (values at or above each column's k-th largest)."""
    n, m = scores.shape
    kk = min(k, n)
    if kk < n:
        part = np.argpartition(-scores, kk - 1, axis=0)[:kk]
        thr = np.take_along_axis(scores, part, axis=0).min(axis=0)
        r, c = np.nonzero(scores >= thr[None, :])
    else:
        r, c = np.nonzero(np.ones_like(scores, dtype=bool))
    sc = scores[r, c]
    order = np.lexsort((r, -sc, c))
    r, c, sc = r[order], c[order], sc[order]
    first = np.searchsorted(c, c, side="left")
    keep = ((np.arange(len(c)) - first) < kk) & np.isfinite(sc)
    return pd.DataFrame({"qid": qids[c[keep]].astype("int64"), "did": dids[r[keep]].astype("int64"),
                         "score": sc[keep].astype("float64")})


def blocked_topk(queries: DataFrame, corpus: DataFrame, k: int, kind: str, exclude_self: bool = False,
                 q_block: int | None = None, d_chunk: int | None = None) -> DataFrame:
    """Top-``k`` items per query: ``qid, did, score, rank`` (rank 1 = best; ties
    by ascending ``did``).  Inputs have columns ``qid long, payload`` and
    ``did long, payload`` where payload is a unit vector (``cosine``) or a raw
    vector (``euclidean``: score = minus squared distance).  Blocks and chunks
    are as large as ``SIDE_NUMBERS`` allows unless their rows are given."""
    nq = queries.count()
    nd, width = corpus.agg(F.count(F.lit(1)), F.max(F.size("payload"))).first()
    b, c = _sides(nq, nd, width or 1)
    b = max(1, math.ceil(nq / q_block)) if q_block else b
    c = max(1, math.ceil(nd / d_chunk)) if d_chunk else c
    # fresh aliases: the two sides may come from the same DataFrame (self top-k)
    queries = queries.select(F.col("qid").alias("qid"), F.col("payload").alias("payload"))
    corpus = corpus.select(F.col("did").alias("did"), F.col("payload").alias("payload"))
    q = queries.withColumn("qb", hash_bucket(["qid"], b, 11)) \
               .withColumn("dc", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    d = corpus.withColumn("dc", hash_bucket(["did"], c, 13)) \
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    cells = q.groupBy("qb", "dc").cogroup(d.groupBy("qb", "dc")).applyInPandas(
        _cell_topk(kind, k, exclude_self), schema="qid long, did long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("did"))
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``qid/did`` candidates: id and L2-normalised double vector (zero stays zero)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    # a column each: inside the last function they would be worked out again for every number of a vector
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)))
    unit = F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(F.lit(0.0)))
    return rows.select("id", unit.alias("payload"))


def vector_topk(queries: DataFrame, q_id: str, corpus: DataFrame, d_id: str, vec_col: str, k: int = 5,
                exclude_self: bool = False) -> DataFrame:
    """R2 / V1: exact cosine top-k of stored vectors."""
    q = unit_vectors(queries, q_id, vec_col).withColumnRenamed("id", "qid")
    d = unit_vectors(corpus, d_id, vec_col).withColumnRenamed("id", "did")
    return blocked_topk(q, d, k, "cosine", exclude_self)


#: Queries, and their tokens, up to which their index is broadcast; cells of counts and meetings looked at together.
INDEX_QUERIES, INDEX_TOKENS, CELLS = 1 << 14, 1 << 21, 1 << 22
#: Rows of a posting list above which it is split (where that is over 1/1024 of all postings, so few are).
HOT_ROWS = 100_000


def _leading(found: DataFrame, by: str, rows: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(by), F.asc("did"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows)


def _best(frames: list[pd.DataFrame], k: int) -> pd.DataFrame:
    found = pd.concat(frames).sort_values(["qid", "score", "did"], ascending=[True, False, True], kind="stable")
    return found.groupby("qid", sort=False).head(k)


def _scan_documents(index, k: int):
    """The ``k`` best documents of a task for every query: counts of shared tokens by the queries' inverted index."""
    def run(batches):
        vocabulary, begins, owners, qids = index.value
        frames, held, n = [], 0, len(qids)
        at_once = max(1, min(CELLS // max(n, 1), 4 * CELLS // max(len(owners), 1)))  # a document meets each posting once
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                tokens, sizes = part.column(1), pc.list_value_length(part.column(1)).to_numpy()
                codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)[codes >= 0]
                codes = codes[codes >= 0]
                lengths = begins[codes + 1] - begins[codes]
                posting = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins[codes], lengths)
                counts = np.bincount(np.repeat(row, lengths) * n + owners[posting], minlength=len(sizes) * n)
                dids = part.column(0).to_numpy()
                order = np.argsort(dids, kind="stable")
                frames.append(_local_topk(counts.reshape(len(sizes), n)[order].astype(float), qids, dids[order], k))
                held += len(frames[-1])
                if held > 8 * k * n + 100_000:
                    frames = [_best(frames, k)]
                    held = len(frames[0])
        if frames:
            yield pa.RecordBatch.from_pandas(_best(frames, k)[["qid", "did", "score"]], preserve_index=False)
    return run


def _index_of(queries: list) -> tuple:
    """(tokens, begin of each posting list, queries, their ids) of rows (qid, tokens)."""
    flat = [(t, i) for i, r in enumerate(queries) for t in r["tokens"]]
    codes, names = pd.factorize(np.array([t for t, _ in flat], dtype=object)) if flat else (np.empty(0, int), [])
    order = np.argsort(codes, kind="stable")
    owners = np.array([i for _, i in flat], np.int64)[order] if flat else np.empty(0, np.int64)
    begins = np.searchsorted(codes[order], np.arange(len(names) + 1))
    return pa.array(list(names), pa.string()), begins, owners, np.array([r["qid"] for r in queries], np.int64)


def keyword_topk(queries: DataFrame, q_id: str, q_text: str, corpus: DataFrame, d_id: str, d_text: str,
                 k: int = 2, rare: int = 4) -> DataFrame:
    """Documents ranked by the number of distinct lower-cased whitespace
    tokens shared with the query; ties by document id; unmatched documents
    score 0 and still fill ``k``.  ``rare``: the tokens of a query whose documents set its bound.  Ids are
    unique; null texts have no tokens."""
    none = F.array().cast("array<string>")
    q = queries.select(F.col(q_id).cast("long").alias("qid"), F.coalesce(whitespace_tokens(F.col(q_text)), none).alias("tokens"))
    d = corpus.select(F.col(d_id).cast("long").alias("did"), F.coalesce(whitespace_tokens(F.col(d_text)), none).alias("tokens"))
    asked = q.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("tokens")).alias("tokens")).first()
    if asked["rows"] <= INDEX_QUERIES and (asked["tokens"] or 0) <= INDEX_TOKENS:
        index = d.sparkSession.sparkContext.broadcast(_index_of(q.collect()))
        found = d.mapInArrow(_scan_documents(index, k), "qid long, did long, score double")
        return _leading(found.withColumn("score", F.col("score").cast("long")), "score", k).select("qid", "did", "score", "rank")
    postings = d.select("did", F.explode("tokens").alias("token"))
    lists = shared(postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    total = lists.agg(F.sum("n")).first()[0] or 0
    most = max(total // 1024, HOT_ROWS)
    hot = F.broadcast(lists.where(F.col("n") > most).select("token", F.ceil(F.col("n") / most).cast("int").alias("salts")))  # 1,023 at most
    # the tokens of each query that the corpus has, the rarest first
    terms = shared(q.select("qid", F.explode("tokens").alias("token")).join(lists, "token").groupBy("qid")
                   .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("by")).select("qid", F.col("by.token").alias("terms")))

    def shares(wanted: DataFrame) -> DataFrame:
        """(qid, did, n): how many of the wanted (qid, token) each document has; a hot list is met in parts."""
        salts = F.coalesce("salts", F.lit(1))
        left = wanted.join(hot, "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        right = postings.join(hot, "token", "left").withColumn("salt", F.pmod(F.xxhash64("did"), salts).cast("int"))
        return left.drop("salts").join(right.drop("salts"), ["token", "salt"]).groupBy("qid", "did").agg(F.count(F.lit(1)).alias("n"))

    def kth(found: DataFrame, by: str, name: str) -> DataFrame:
        return _leading(found, by, k).where(F.col("rank") == k).select("qid", F.col(by).alias(name))

    d_rows = d.hint("merge")  # its tokens are many times its files' bytes: never broadcast by those
    common = F.size(F.array_intersect("tokens", "terms"))
    first = _leading(shares(terms.select("qid", F.explode(F.slice("terms", 1, rare)).alias("token"))), "n", 4 * k).select("qid", "did")
    first = first.join(d_rows, "did").join(terms, "qid").select("qid", "did", common.alias("score"))
    # so many of a query's commonest tokens cannot lift a document to the bound on their own
    spare = F.greatest(F.coalesce("bound", F.lit(0)) - 1, F.lit(0))
    split = shared(terms.join(kth(first, "score", "bound"), "qid", "left").withColumn("spare", spare)
                   .withColumn("needed", F.size("terms") - F.col("spare")))
    found = shared(shares(split.select("qid", F.explode(F.slice("terms", F.lit(1), F.col("needed"))).alias("token"))))
    open_ = (found.join(split.join(kth(found, "n", "reached"), "qid", "left"), "qid")
             .where(F.col("n") + F.col("spare") >= F.greatest(F.coalesce("bound", F.lit(0)), F.coalesce("reached", F.lit(0)))))
    rest = F.slice("terms", F.col("needed") + 1, F.greatest(F.col("spare"), F.lit(1)))
    scored = (open_.select("qid", "did", "n", rest.alias("terms")).join(d_rows, "did")
              .select("qid", "did", (F.col("n") + common).alias("score")))
    # queries with fewer than k documents: the first ids of those that share nothing
    short = (q.select("qid").join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("met")), "qid", "left")
             .where(F.coalesce("met", F.lit(0)) < k).select("qid"))
    ids = [r["did"] for r in d.select("did").orderBy("did").limit(2 * k).collect()]
    fill = short.withColumn("did", F.explode(F.array(*map(F.lit, ids)).cast("array<long>")))
    fill = fill.join(found, ["qid", "did"], "left_anti").withColumn("score", F.lit(0).cast("long"))
    return _leading(scored.unionByName(fill), "score", k).select("qid", "did", "score", "rank")


def similar_items(features: DataFrame, id_col: str, feature_cols: list[str], k: int = 5) -> DataFrame:
    """U16: content-based neighbours of EVERY item: cosine over the given
    (already standardised) feature columns, self excluded: ``item, similar, score, rank``."""
    vec = features.select(F.col(id_col).cast("long").alias("id"),
                          F.array(*[F.col(f"`{c}`").cast("double") for c in feature_cols]).alias("v"))
    unit = unit_vectors(vec, "id", "v")
    from tablelens.operators.neighbours import proven_topk
    res = proven_topk(unit.withColumnRenamed("id", "qid"), unit.withColumnRenamed("id", "did"), k, "cosine", exclude_self=True)
    return res.select(F.col("qid").alias("item"), F.col("did").alias("similar"), "score", "rank")

