"""Exact, substring and SimHash dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.llm import exact_dedup, simhash, substring_dedup
from tests.llm.common import ODD, PASSAGE, prose, table

WHITE = r"[\x20\x09-\x0D]"


@pytest.mark.parametrize("k", [2, 1024])
def test_exact_dedup(spark, k):
    got = exact_dedup.dedup_groups(table(spark, ODD), k=k).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(hashlib.sha256(re.sub(WHITE, "", t or "").encode()).digest(), []).append((i, t or ""))
    for r in got:
        own = groups[bytes(r.digest)]
        best = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        assert (r.group_size, r.keep_id) == (len(own), best[0])
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_all_columns(spark):
    docs = table(spark, ODD)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(WHITE, "", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(WHITE, "", t or "") for _, t, _ in ODD})
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def test_misra_gries_finds_every_heavy_digest():
    import pyarrow as pa
    pick = random.Random(3)
    rows = [pick.choice(["hot"] * 5 + [str(i) for i in range(15)]) for _ in range(4000)]
    parts = [pa.RecordBatch.from_pydict({"d": pa.array([x.encode() for x in rows[i:i + 500]], pa.binary())}) for i in range(0, 4000, 500)]
    summary = next(exact_dedup.misra_gries(4)(iter(parts))).to_pydict()
    assert rows.count("hot") - 4000 / 5 <= dict(zip(summary["digest"], summary["n"]))[b"hot"] <= rows.count("hot")


def removed(rows, length):
    """Brute force: (n_bytes, n_removed, n_spans, kept) by (id, text)."""
    out, seen = {}, set()
    distinct = sorted({(i is None, i or 0, t or "") for i, t, _ in rows}, key=lambda x: x[:2])
    assert len({x[:2] for x in distinct}) == len(distinct)
    for none, i, t in distinct:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if b[j:j + length] in seen:
                gone[j:j + length] = True
            seen.add(b[j:j + length])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[None if none else i, t] = (len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("group", [1, 4096])
def test_substring_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)  # 1: every anchor with several contexts is crowded
    line = prose(50, 30)
    rows = [x for x in ODD if x[0] is not None] + [(None, prose(2, 250), "a")]
    rows += [(100 + i, prose(1000 + i, 20) + line + prose(2000 + i, 20), "a") for i in range(12)]
    rows += [(200, prose(7, 70) * 3, "a"), (201, prose(1, 45000)[1000:280000], "a")]  # longer than a chunk
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    want = removed(rows, 100)
    assert len(got) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) in [want[r.id, t] for t in texts[r.id]], r.id
    assert substring_dedup.remove_repeats(table(spark, rows).limit(0)).count() == 0


def repeats_marked(contexts, length):
    context, place = substring_dedup.repeated_windows(contexts, length)
    want, seen = [], set()
    for c, t in enumerate(contexts):
        for j in range(len(t) - length + 1):
            if t[j:j + length] in seen:
                want.append((c, j))
            seen.add(t[j:j + length])
    assert sorted(zip(context.tolist(), place.tolist())) == want


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.text("ab\0", min_size=6, max_size=40), min_size=1, max_size=12))
def test_run_length_index_marks_repeated_windows(texts):
    repeats_marked([t.encode() for t in texts], 6)


def test_run_length_index_where_the_first_context_has_neighbours():
    repeats_marked([b"baaaaa", b"aaaaaa", b"aaaaaa", b"baaaab"], 6)
    repeats_marked([b"\0" * 6, b"\0" * 7, b"\0" * 6], 6)
    for seed in range(400):
        pick = random.Random(seed)
        shared = prose(seed, 40)[:110]
        contexts = [(prose(pick.randrange(3), 9)[-pick.randrange(1, 30):] + shared[:pick.randint(100, 110)]
                     + prose(pick.randrange(3), 9)[:pick.randrange(30)]).encode() for _ in range(pick.randint(3, 8))]
        repeats_marked(contexts, 100)


def test_near_copies_over_many_partitions(spark):
    pick, base = random.Random(5), prose(71, 120)
    rows = []
    for i in range(60):
        words = base.split()
        for _ in range(pick.randrange(4)):
            words[pick.randrange(len(words))] = prose(pick.randrange(5), 1)
        rows.append((i, " ".join(words[pick.randrange(9):]), "a"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = removed(rows, 100)
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == {i: want[i, t] for i, t, _ in rows}


def test_runs_are_fewer_than_places_in_repetitive_text():
    text = np.frombuffer((prose(4, 40) * 50).encode(), np.uint8)
    index = substring_dedup.RunLengthIndex(text, 20)
    assert index.runs < len(text) / 5


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark):
    rows = ODD + [(300 + i, prose(1, 400) + f" {i}", "a") for i in range(6)]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    fps = [fingerprint(t) for _, t, _ in rows]
    roots = components(fps, 3)
    least = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f, str(least.get(r))) for (i, _, _), f, r in zip(rows, fps, roots))
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.count() == len(set(roots))
    assert simhash.keep_one(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 4096])
def test_links_connect_all_pairs_within_reach(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 8: cells are split and blocks meet in pairs
    pick = random.Random(5)
    fps = [pick.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in pick.sample(range(64), pick.randint(1, 4))) for f in fps for _ in range(3)]
    hub = pick.getrandbits(64)
    fps += [hub, 0, 1, (1 << 64) - 1, *(hub ^ sum(1 << b for b in pick.sample(range(64), 2)) for _ in range(60))]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    tied = {r.node % (1 << 64): r.component % (1 << 64) for r in simhash.components(simhash.links(nodes, 3)).collect()}
    own = {}
    for f, r in zip(fps, components(fps, 3)):
        own.setdefault(r, set()).add(f)
    found = {}
    for f in fps:
        found.setdefault(tied.get(f, f), set()).add(f)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, found.values()))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_count_distance_is_a_lower_bound(a, b):
    one, two = simhash.counts_of(np.array([a, b], np.uint64))
    assert np.abs(one - two).sum() <= (a ^ b).bit_count()


def test_planted_copies_and_passages(spark):
    rows = [(i, prose(i, 200), "a") for i in range(30)]
    rows += [(100, rows[3][1] + "  ", "a"), (101, rows[4][1].replace(" ", "\n"), "b"), (102, rows[5][1] + PASSAGE, "a"), (103, PASSAGE, "a")]
    docs = table(spark, rows)
    gone = {r.id for r in exact_dedup.dedup_groups(docs).where("not kept").collect()}
    assert len(gone) == 2 and gone & {3, 100} and gone & {4, 101}
    cut = {r.id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert cut[103] == len(PASSAGE) and cut[100] > 0 and cut[102] >= len(rows[5][1]) - 100 and not any(cut[i] for i in range(30))
