"""Decontamination, quality, mixing, sharding and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tablelens.llm import decontaminate, mixing, quality, sharding
from tests.llm.common import ODD, PASSAGE, prose, table
from tests.llm.test_dedup import components, fingerprint

BENCHMARK = [(1, PASSAGE), (2, "one two three"), (3, None), (4, " .,"), (5, PASSAGE), (6, prose(77, 30)), (2, "ONE two; three")]


def benchmark(spark, rows=BENCHMARK):
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(text, items, n=10):
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            window = w[i:i + n]
            for j in range(len(own) - len(window) + 1):
                if own[j:j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def test_find_leaks(spark):
    rows = [x for x in ODD if x[0] != 10] + [(30, "ONE-two. three!", "a"), (31, "one two one two three three", "a"), (32, "one two", "a"),
                                              (33, prose(77, 30)[10:], "a"), (34, prose(8, 50) + " " + PASSAGE.upper() + " tail", "a")]
    got = decontaminate.find_leaks(table(spark, rows), benchmark(spark)).collect()
    want = sorted((str(i), *leaks(t, BENCHMARK)) for i, t, _ in rows)
    assert sorted((str(r.id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert decontaminate.find_leaks(table(spark, rows).limit(0), benchmark(spark)).count() == 0
    none = decontaminate.find_leaks(table(spark, rows), benchmark(spark, [(1, None)])).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))


def test_benchmark_in_several_blocks(spark, monkeypatch):
    """A pass for each block, one broadcast at a time; the same rows and texts as from one block."""
    rows = [x for x in ODD if x[0] != 10] + [(30, PASSAGE + " and " + prose(77, 30), "a"), (31, "one two three", "a"), (31, "one two three", "b")]
    docs = table(spark, rows)
    whole = decontaminate.remove_leaks(docs, benchmark(spark), length_col="n_chars").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 50)
    blocks = list(decontaminate.benchmark_blocks(benchmark(spark), "item_id", "text"))
    assert len(blocks) > 2
    there, most, passes = set(), [0], [0]
    make = spark.sparkContext.broadcast

    def broadcast(block):
        held = make(block)
        there.add(id(held))
        passes[0], most[0] = passes[0] + 1, max(most[0], len(there))
        gone = held.destroy
        held.destroy = lambda: (there.discard(id(held)), gone())
        return held
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    got = decontaminate.find_leaks(docs, benchmark(spark)).collect()
    assert (passes[0], most[0]) == (len(blocks), 1)
    assert sorted((str(r.id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted((str(i), *leaks(t, BENCHMARK)) for i, t, _ in rows)
    parts = decontaminate.remove_leaks(docs, benchmark(spark), length_col="n_chars")
    assert parts.columns == docs.columns and sorted(map(str, parts.collect())) == sorted(map(str, whole))
    assert decontaminate.find_leaks(docs.limit(0), benchmark(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=200), st.integers(1, 4))
def test_fm_index_finds_all_occurrences(symbols, n):
    text = np.array([*symbols, 0], np.int64)
    index = decontaminate.FMIndex(text, 3)
    patterns = np.unique(np.array([symbols[i:i + n] for i in range(len(symbols) - n + 1)] or np.ones((1, n), int)), axis=0)
    for pattern, begin, end in zip(patterns, *index.search(patterns)):
        found = sorted(index.locate(np.arange(begin, end)).tolist())
        assert found == [i for i in range(len(symbols) - n + 1) if symbols[i:i + n] == pattern.tolist()]


def test_remove_leaks(spark):
    rows = [(1, "Intro: " + PASSAGE + ". Outro!", "a"), (2, PASSAGE, "a"), (3, "clean text, here", "a"), (4, None, "a"), (None, "x One two THREE y", "a")]
    docs = table(spark, rows)
    got = decontaminate.remove_leaks(docs, benchmark(spark), length_col="n_chars")
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in got.collect()} == {
        (1, "Intro: . Outro!", 15), (3, "clean text, here", 16), (4, None, None), (None, "x  y", 4)}


def test_quality_on_held_out_rows(spark, sf_small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.held_out(F.col("doc_id"))
    weights = quality.fit_quality(docs, labels, "quality", ~out)
    scored = quality.score_quality(docs, weights).join(labels, "doc_id").where(out)
    right = scored.where((F.col("score") >= 0.5) == (F.col("quality") == 1)).count()
    assert right >= 0.97 * scored.count() > 50


def test_quality_learns_one_text_of_a_document(spark):
    rows = [(1, "good words here"), (2, "bad things there"), (3, "fine words again")]
    hot = rows + [(2, "bad things there")] * 500
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    once, often = (quality.fit_quality(spark.createDataFrame(r, "doc_id long, text string"), labels, "quality", F.lit(True))
                   for r in (rows, hot))
    assert once.any() and (once == often).all()
    texts = [(1, "good words here"), (1, "other text"), (2, "bad things there")]
    one, two = (quality.fit_quality(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, "quality", F.lit(True))
                for r, n in ((texts, 1), (texts[::-1] * 3, 4)))
    assert (one == two).all()


def test_quality_of_odd_rows(spark):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 0), (15, 0)], "doc_id long, quality int")
    weights = quality.fit_quality(docs, labels, "quality", F.lit(True))
    got = quality.score_quality(docs, weights, column="score").collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[1] > 0.5 > {r.doc_id: r.score for r in got}[15]
    none = quality.fit_quality(docs, labels.limit(0), "quality", F.lit(True))
    assert not none.any() and {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0


def filled(sizes, weights, share=1.5, epochs=2.0):
    """Water-filling as it is told: share by weight, clamp, share the excess again."""
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    left = sum(sizes.values()) * share
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = sum(max(target[s] - epochs * sizes[s], 0) for s in open_)
        full = {s for s in open_ if target[s] >= epochs * sizes[s]}
        target.update({s: epochs * sizes[s] for s in full})
        open_ -= full
    return target


def test_mix(spark):
    pick = np.random.default_rng(1)
    rows = [x for x in ODD if x[0] != 10]
    rows += [(1000 + i, prose(i, int(pick.integers(1, 60))), pick.choice(["a"] * 6 + ["b", "ü", "zz", "Z"])) for i in range(400)]
    rows = [(i, t, None if s is None else str(s)) for i, t, s in rows]
    docs = table(spark, rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    assert len(got) == len(rows)
    known = {}
    for i, t, s in rows:
        known.setdefault(i, []).append((size(t), sizes[s], round(want[s], 6)))
    for r in got:
        assert (r.size, r.source_size, round(r.target, 6)) in known[r.id]
        assert 0 <= r.taken <= 2 * r.size
    taken, copies = {}, mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    for r in copies.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s in sizes:
        assert abs(taken.get(s, 0) - want[s]) <= 60, s
    assert copies.count() == sum(r.repetitions for r in got)
    again = sorted((str(r.id), r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((str(r.id), r.taken) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.mixed_documents(docs.limit(0)).count()


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    pick = np.random.default_rng(2)
    rows = ODD + [(1000 + i, "one hot text " * 20 if hot and i % 3 == 0 else prose(i, int(pick.integers(1, 80))), "a") for i in range(1500)]
    rows = [x for x in rows if x[0] != 10]
    got = sharding.assign_shards(table(spark, rows), 40).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.id), r.size, r.text_crc32) for r in got) == want
    slots, sums = {}, np.zeros(40)
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 16 for _, t, _ in rows)
    assert np.abs(sums - sums.mean()).max() <= largest + 0.01 * sums.mean()


def test_shards_of_few_rows_and_of_one_key(spark):
    few = sharding.sharded_documents(table(spark, ODD), 40)
    assert few.count() == len(ODD) and few.columns == [*table(spark, ODD).columns, "shard", "slot"]
    same = table(spark, [(1, "same", "a")] * 30)
    assert {(r.shard, r.slot) for r in sharding.assign_shards(same, 4).collect()} == {
        (s, i) for s in {r.shard for r in sharding.assign_shards(same, 4).collect()} for i in range(30)}
    assert sharding.assign_shards(same.limit(0), 4).count() == 0


def test_written_shards(spark, tmp_path):
    docs = table(spark, ODD)
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) and set(back.columns) == {*docs.columns, "shard", "slot"}


def test_pipeline_against_brute_force(spark, sf_small):
    """Every stage's decisions on the small tables, each judged on its own input."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    good = stage["quality"](spark, docs, sf_small)
    good_ids = {r.doc_id for r in good.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    known = [i for i in labels if i in rows and zlib.crc32(str(i).encode()) % 3 == 1]
    assert good.columns == docs.columns and sum((i in good_ids) == (labels[i] == 1) for i in known) >= 0.9 * len(known)

    near = stage["near_dedup"](spark, docs, sf_small)
    ids = sorted(rows)
    roots = components([fingerprint(rows[i].text) for i in ids], 3)
    assert sorted(r.doc_id for r in near.collect()) == sorted({ids[r] for r in roots}) and near.columns == docs.columns

    clean = {r.doc_id: r.text for r in stage["decontaminate"](spark, docs, sf_small).collect()}
    for i, r in rows.items():
        n, hit, _ = leaks(r.text, items)
        assert clean.get(i) == r.text if not hit else (hit == n and i not in clean) or leaks(clean[i], [])[0] == n - hit

    mixed = stage["mix"](spark, docs, sf_small)
    assert mixed.columns == docs.columns and mixed.count() > docs.count()
    last = stage["shard"](spark, docs, sf_small)
    assert last.columns == [*docs.columns, "shard", "slot"] and last.count() == docs.count()


def test_pipeline_runs_whole_and_again(spark, sf_small):
    got = corpus_pipeline.run(spark, sf_small).select("doc_id", F.md5("text").alias("text"), "shard", "slot")
    digest = [hashlib.md5(str(sorted(map(tuple, got.collect()))).encode()).hexdigest() for _ in range(2)]
    assert digest[0] == digest[1]


def test_pipeline_stages_take_odd_and_empty_tables(spark, sf_small):
    for rows in (ODD, []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_small)
            assert out.columns[:len(docs.columns)] == docs.columns, name
            docs = out.select(*docs.columns)
            n = docs.count()
            assert (n > 0) == bool(rows), name
