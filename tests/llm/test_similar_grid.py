"""The fingerprints' part in near-dedup, and the bound that long texts get."""

import random

import numpy as np

import corpus_pipeline as pipeline
from maskwright.llm import similar, simhash

from .conftest import words
from .test_similar import copies, reach


def test_near_dedup_takes_links_from_the_fingerprints_first(spark, tmp_path, monkeypatch):
    """With no key left to the prefix filter, copies within three bits still go; with both, all of them do."""
    base = words(random.Random(5), 400).split()
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, words(random.Random(6), 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bin((simhash.fingerprint(rows[0][1].encode(), 5) ^ simhash.fingerprint(rows[1][1].encode(), 5)) & (2**64 - 1)).count("1") <= 3
    every = similar.prefixes
    monkeypatch.setattr(similar, "prefixes", lambda *a: every(*a).where("false"))
    assert {r.doc_id for r in pipeline.near_dedup(spark, df, str(tmp_path)).collect()} == {1, 3}


def test_close_pairs_connect_what_three_bits_connect(spark):
    rows = copies(random.Random(8))
    fps = [simhash.fingerprint((t or "").encode(), 5) & (2**64 - 1) for _, t in rows]

    def parts(pairs):
        part = list(range(len(rows)))
        for a, b in pairs:
            lo, hi = sorted((part[a], part[b]))
            part = [lo if p == hi else p for p in part]
        return part

    want = parts((a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3)
    got = simhash.close_pairs(spark.createDataFrame(rows, "doc_id long, text string"), size=5).collect()
    assert parts((r.a, r.b) for r in got) == want and len(set(want)) < len(rows)


def test_long_texts_that_share_little_are_not_neighbours(spark):
    """Before, 256 segments of some thirty shingles let any two such texts pass."""
    rng = random.Random(9)
    shared, long = words(rng, 40), words(rng, 7000).split()
    near = " ".join(w if i % 100 else "changed" for i, w in enumerate(long))
    rows = [(1, shared + " " + " ".join(long)), (2, shared + " " + words(rng, 7000)), (3, shared + " " + near), (4, " ".join(long[:6600]))]
    verify = similar._Verify(spark.createDataFrame([(i, t.encode()) for i, t in rows], "id long, text binary"), 5, 0.8)
    pairs = similar.table(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "a long, b long"), "pairs")
    assert {tuple(r) for r in verify.may(pairs).collect()} == {(1, 3), (1, 4)}


def test_distance_is_a_lower_bound_across_resolutions():
    rng = np.random.default_rng(3)
    for n in (1, 200, 1023, 1024, 5000, 40_000):
        every = rng.integers(0, 2**64, n + n // 9, dtype=np.uint64)
        for a, b in ((every[:n], every), (every[:n], every[n // 9 :]), (every, every), (every[:n] >> np.uint64(9), every >> np.uint64(9))):
            assert similar.distance(similar.segment_counts(a), similar.segment_counts(b)) <= len(np.setxor1d(a, b))


def test_similar_pairs_of_several_lengths(spark):
    rng = random.Random(11)
    rows = copies(rng)
    for n in (1015, 1030, 2100):
        base = words(rng, n).split()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: int(n * 0.85)])), (len(rows) + 2, " ".join(base[int(n * 0.21) :]))]
    want = reach(rows)
    got = {r.id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id").collect()}
    assert {i: got.get(i, i) for i, _ in rows} == want
