"""Neighbours and keyword retrieval against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import neighbours as N
from tablelens.operators import similar as S


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


def _neighbours(rows):
    out = {}
    for r in rows:
        out.setdefault(r["qid"], set()).add(r["did"])
    return out


def _triples(found):
    return sorted((r["qid"], r["did"], r["rank"]) for r in found.collect())


def test_recall_of_product_codes(vectors):
    queries = vectors.where("vec_id % 20 = 0")
    exact = _neighbours(S.vector_topk(queries, "vec_id", vectors, "vec_id", "embedding", 5, True).collect())
    found = N.quantised_topk(queries, "vec_id", vectors, "vec_id", "embedding", 5, True)
    rows = found.collect()
    got = _neighbours(rows)
    assert set(got) == set(exact) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[q] & exact[q]) / 5 for q in exact]) >= 0.9
    cosine = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    for r in rows[:20]:
        a, b = cosine[r["qid"]], cosine[r["did"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_proven_neighbours_are_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(N, "ALL_PAIRS", 0)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(8, 3)).repeat(60, axis=0) + rng.normal(scale=0.1, size=(480, 3)), np.zeros((6, 3)),
                        np.ones((30, 3))])  # clusters, zero vectors and copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    rows = S.unit_vectors(df, "id", "v") if metric == "cosine" else df.withColumnRenamed("v", "payload")
    q, d = rows.withColumnRenamed("id", "qid"), rows.withColumnRenamed("id", "did")
    exact = S.blocked_topk(q, d, 4, metric, True)
    found = N.proven_topk(q, d, 4, metric, True, q_block=40, d_chunk=25)
    scores = lambda t: sorted((r["qid"], r["rank"], round(r["score"], 9)) for r in t.collect())
    assert scores(found) == scores(exact)
    ties = {i for i, x in enumerate(v) if not x.any() or (x == 1).all()}
    assert [t for t in _triples(found) if t[0] not in ties] == [t for t in _triples(exact) if t[0] not in ties]


def test_proven_neighbours_read_few_lists(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(20, 4), scale=30).repeat(100, axis=0) + rng.normal(size=(2000, 4))
    centres = N.lloyd(v[rng.permutation(2000)], 44)
    away = N._distance(v, centres, "euclidean")
    own = away.argmin(1)
    radius = np.array([away[own == c, c].max() if (own == c).any() else 0 for c in range(len(centres))])
    kth = np.sort(np.sqrt(N.squared(v[:200], v)), axis=1)[:, 5]
    assert ((away[:200] - radius) <= kth[:, None]).mean() < 0.2


def test_one_vector_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert [r["did"] for r in S.similar_items(one.select("id", F.col("v")[0].alias("a")), "id", ["a"], 2).collect()] == []
    none = one.limit(0)
    assert N.quantised_topk(one, "id", none, "id", "v").count() == 0


@pytest.mark.parametrize("hot,tokens", [(100_000, 0), (5, 0), (5, 1 << 20)])
def test_keyword_retrieval_against_all_pairs(spark, monkeypatch, hot, tokens):
    """By token, with and without split lists, and by the broadcast index."""
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    monkeypatch.setattr(S, "INDEX_TOKENS", tokens)
    monkeypatch.setattr(S, "CELLS", 400)
    pick = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(pick.expovariate(0.12)))] for _ in range(n))
    docs = [(i, text(pick.randint(0, 30)) if i % 9 else None) for i in range(150)]
    asked = [(i, text(pick.randint(1, 20))) for i in range(25)] + [(90, ""), (91, None), (92, "nowhere"), (93, "W3 w3 w59")]
    found = S.keyword_topk(spark.createDataFrame(asked, "q long, t string"), "q", "t",
                           spark.createDataFrame(docs, "d long, t string"), "d", "t", k=3)
    want = []
    for q, t in asked:
        own = set((t or "").lower().split())
        best = sorted((-len(own & set((x or "").lower().split())), d) for d, x in docs)[:3]
        want += [(q, d, -s, i + 1) for i, (s, d) in enumerate(best)]
    assert sorted((r["qid"], r["did"], r["score"], r["rank"]) for r in found.collect()) == sorted(want)


def test_cells_are_tiled_and_few(spark, monkeypatch):
    """A side of the exact join is sent a few times at most, whatever its rows; tiles find what one matrix finds."""
    for rows in (120_000, 720_000):
        b, c = S._sides(rows, rows, 64)
        assert 64 <= b * c and b + c <= 24
    rng = np.random.default_rng(5)
    q = pd.DataFrame({"qid": np.arange(40), "payload": list(rng.integers(0, 3, (40, 2)).astype(float))})
    d = pd.DataFrame({"did": np.arange(90) // 2, "payload": list(rng.integers(0, 3, (90, 2)).astype(float))})
    for kind in ("cosine", "euclidean"):
        whole = S._cell_topk(kind, 4, True)(q, d)
        monkeypatch.setattr(S, "Q_TILE", 7)
        monkeypatch.setattr(S, "D_TILE", 9)
        order = ["qid", "score", "did"]
        tiled = S._cell_topk(kind, 4, True)(q, d).sort_values(order).reset_index(drop=True)
        monkeypatch.undo()
        pd.testing.assert_frame_equal(tiled, whole.sort_values(order).reset_index(drop=True))


@pytest.mark.parametrize("self_too", [True, False])
def test_cells_are_searched_beside_the_query(monkeypatch, self_too):
    """The rows of a cell that a query scores are few, and the neighbours are those of all pairs."""
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=(3000, 3)) * [1000, 3, 1], np.full((40, 3), 7.0), rng.normal(size=(5, 3)) * 1e5])
    q = pd.DataFrame({"qid": np.arange(0, len(v), 2), "payload": v[::2].tolist()})
    d = pd.DataFrame({"did": np.arange(len(v)), "payload": v.tolist()}).sample(frac=1, random_state=1)
    pairs, whole = [], N.squared
    monkeypatch.setattr(N, "squared", lambda a, b: pairs.append(len(a) * len(b)) or whole(a, b))
    found = N._near_topk(5, self_too)(q, d).sort_values(["qid", "score", "did"], ascending=[True, False, True])
    exact = S._cell_topk("euclidean", 5, self_too)(q, d).sort_values(["qid", "score", "did"], ascending=[True, False, True])
    assert sum(pairs) < len(q) * len(d) / 3
    assert found["qid"].tolist() == exact["qid"].tolist()
    far = np.abs(found["score"].to_numpy() - exact["score"].to_numpy())
    assert (far <= 1e-6 + 1e-9 * np.abs(exact["score"].to_numpy())).all()
    apart = ~found["qid"].between(3000, 3039).to_numpy()  # copies tie
    assert found["did"].to_numpy()[apart].tolist() == exact["did"].to_numpy()[apart].tolist()


@pytest.mark.parametrize("self_too", [True, False])
def test_cosine_cells_are_searched_beside_the_query(monkeypatch, self_too):
    """Unit vectors' cells score few of their pairs; zero vectors meet all rows; the neighbours are those of all pairs."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(3000, 4)) * [0, 1, 0.1, 0.02] + [2, 0, 0, 0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:120] = v[100]
    asked = v[::2].copy()
    asked[[3, 700]] = 0
    q = pd.DataFrame({"qid": np.arange(0, len(v), 2), "payload": asked.tolist()})
    d = pd.DataFrame({"did": np.arange(len(v)), "payload": v.tolist()}).sample(frac=1, random_state=1)
    order = {"by": ["qid", "score", "did"], "ascending": [True, False, True]}
    exact = S._cell_topk("cosine", 5, self_too)(q, d).sort_values(**order)
    pairs, best = [], N._local_topk
    monkeypatch.setattr(N, "_local_topk", lambda scores, *rest: pairs.append(scores.size) or best(scores, *rest))
    found = N._near_topk(5, self_too, "cosine")(q, d).sort_values(**order)
    assert sum(pairs) < len(q) * len(d) / 2
    assert found["qid"].tolist() == exact["qid"].tolist()
    assert np.allclose(found["score"], exact["score"], rtol=0, atol=1e-12)
    apart = ~found["qid"].between(100, 119).to_numpy()  # copies tie
    assert found["did"].to_numpy()[apart].tolist() == exact["did"].to_numpy()[apart].tolist()


def test_rows_of_one_file_are_searched_by_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))]
    d = spark.createDataFrame(rows, "id long, payload array<double>").coalesce(1)
    q, d = d.withColumnRenamed("id", "qid"), d.withColumnRenamed("id", "did")
    monkeypatch.setattr(N, "ALL_PAIRS", 0)
    kept, real = [], N.shared
    monkeypatch.setattr(N, "shared", lambda t: kept.append(t) or real(t))
    found = N.proven_topk(q, d, 4, "euclidean", True).collect()
    want = S.blocked_topk(q, d, 4, "euclidean", True).collect()
    assert {(r["qid"], r["rank"], r["did"]) for r in found} == {(r["qid"], r["rank"], r["did"]) for r in want}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [t.rdd.getNumPartitions() for t in kept[:2]] == [parts, parts]


@pytest.mark.parametrize("kind", ["cosine", "euclidean"])
def test_scores_of_a_cell_are_not_sorted(monkeypatch, kind):
    """Rows behind the k-th so far are dropped by one comparison; ties go to the least id, in tiles of any size."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 3)) * 2)  # many equal scores
    ids = rng.permutation(900)
    q = pd.DataFrame({"qid": np.arange(0, 900, 3), "payload": list(x[::3])})
    d = pd.DataFrame({"did": ids, "payload": list(x[ids])})
    sorted_, real = [], np.lexsort
    partition = np.argpartition
    monkeypatch.setattr(S.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or real(keys))
    monkeypatch.setattr(S.np, "argpartition", lambda a, *rest, **more: sorted_.append(a.size) or partition(a, *rest, **more))
    got = S._cell_topk(kind, 4, True)(q, d)
    assert sum(sorted_) < len(q) * len(d) / 2
    score = x[::3] @ x.T if kind == "cosine" else 2 * x[::3] @ x.T - (x * x).sum(1) - (x[::3] ** 2).sum(1)[:, None]
    score[np.arange(300), np.arange(0, 900, 3)] = -np.inf
    want = [(3 * i, int(j), score[i, j]) for i in range(300) for j in np.lexsort((np.arange(900), -score[i]))[:4]]
    assert [tuple(r) for r in got.itertuples(index=False)] == want


def test_a_vector_has_its_norm_worked_out_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    unit = S.unit_vectors(df, "id", "v")
    assert [r["payload"] for r in unit.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert unit._jdf.queryExecution().optimizedPlan().toString().lower().count("aggregate(") == 1
