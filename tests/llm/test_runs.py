"""Periodic runs against brute force, however the stream is cut."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tablelens.llm import periodic_runs
from tests.llm.common import ODD, prose, table


def brute(words, least=24):
    """Every period tried at every place; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in out.items())


def rest(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def stream(pick, kinds, size):
    words = []
    while len(words) < size:
        unit = [pick.randrange(kinds) for _ in range(pick.randint(1, pick.choice([3, 12, 50])))]
        words += (unit * pick.randint(1, 7))[:pick.randint(1, 200)]
        words += [pick.randrange(kinds) for _ in range(pick.randint(0, 10) * (pick.random() < 0.3))]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_all_found_and_primitive(seed):
    pick = random.Random(seed)
    for _ in range(150):
        least, words = pick.choice([3, 6, 9, 12, 24]), stream(pick, pick.choice([1, 2, 3, 8]), pick.choice([5, 40, 150, 400]))
        catcher, at = periodic_runs.SquareCatcher(least), 0
        while at < len(words):
            step = pick.choice([1, 3, 17, 1000])
            catcher.append(np.array(words[at:at + step]))
            at += step
        assert catcher.finish() == brute(words, least)


def test_a_word_at_a_time_gives_the_same():
    words = stream(random.Random(77), 2, 600)
    catcher = periodic_runs.SquareCatcher()
    for w in words:
        catcher.append(np.array([w]))
    assert catcher.finish() == brute(words)


def test_colliding_hashes_only_nominate(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_symbols", lambda ids: np.zeros(len(ids), np.uint64))  # all windows look equal
    words = stream(random.Random(3), 3, 120)
    catcher = periodic_runs.SquareCatcher(9)
    catcher.append(np.array(words))
    assert catcher.finish() == brute(words, 9)


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "STREAM", 500)
    monkeypatch.setattr(periodic_runs, "CHUNK", 90)
    line = prose(8, 40)
    rows = ODD + [(40, " ".join([line] * 5), "a"), (41, "w " * 5000, "a"), (42, prose(1, 30) + " x y" * 12 + " " + line, "a"),
                  (43, "\n".join([prose(9, 3)] * 8 + [prose(10, 5)] * 6), None), (40, " ".join([line] * 5), "a")]
    got = periodic_runs.find_runs(table(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words) if len(words) < 10000 else []
        want.append((str(i), len(words), runs, rest(words, runs)))
    assert sorted((str(r.id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert sum(bool(w[2]) for w in want) >= 5
    assert periodic_runs.find_runs(table(spark, rows).limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_small):
    from tablelens.llm.queries import QUERIES
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute(w)
        r = got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), rest(w, runs))]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert [r.runs_sha256, r.collapsed_sha256] == sha
    assert sum(r.n_runs > 0 for r in got.values()) > 5
