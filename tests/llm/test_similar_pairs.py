"""Texts that share passages without being similar, in numbers that the sampled order doesn't see."""

import random

import numpy as np

from maskwright.llm import similar

from .conftest import words
from .test_similar import copies, reach


def counted(monkeypatch):
    """Rows of each table that similar.py writes, by name."""
    rows, table = {}, similar.table

    def counting(df, name):
        out = table(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(similar, "table", counting)
    return rows


def test_texts_that_share_a_passage_make_no_pairs(spark, monkeypatch):
    """Before, each two of them at whose first shingles the passage stood made a row."""
    monkeypatch.setattr(similar, "SAMPLE", 1)
    monkeypatch.setattr(similar, "MANY", 1000)
    monkeypatch.setattr(similar, "ROUNDS", 0)
    made, rng = counted(monkeypatch), random.Random(4)
    passages = [words(rng, 12) for _ in range(6)]
    rows = [(i, words(rng, 40) + " " + passages[i % 5]) for i in range(60)]
    rows += [(i, words(rng, 1500) + " " + words(random.Random(77), 900)) for i in range(60, 75)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert similar.groups(df, "doc_id").count() == 0
    assert max(made["left"]) >= 60 and made["pairs"] == [0]


def test_shingles_that_many_texts_share_go_last_if_the_sample_misses_them(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE", 1)
    made, rng = counted(monkeypatch), random.Random(4)
    passage = words(rng, 12)
    rows = [(i, words(rng, 60) + " " + passage) for i in range(60)]
    assert similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").count() == 0
    assert made["met"] == [0]


def test_shingles_at_which_the_same_texts_meet_are_one(spark, monkeypatch):
    made, rng = counted(monkeypatch), random.Random(5)
    shared = words(rng, 400)
    rows = [(i, shared + " " + words(rng, 60)) for i in range(2)]
    got = similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()
    assert {r.id for r in got} == ({0, 1} if reach(rows)[1] == 0 else set()) and made["met"] == [2]


def test_odd_segments_are_a_lower_bound():
    rng = np.random.default_rng(3)
    for n in (1, 200, 5000, 40_000):
        every = rng.integers(0, 2**64, n + n // 9, dtype=np.uint64)
        for a, b in ((every[:n], every), (every[:n], every[n // 9 :]), (every, every)):
            for k in (len(similar.ODD), similar.MORE):
                assert np.bitwise_count((similar.odd_segments(a, k) ^ similar.odd_segments(b, k)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_same_links_without_rounds(spark, monkeypatch):
    """All pairs come from the last join."""
    monkeypatch.setattr(similar, "ROUNDS", 0)
    monkeypatch.setattr(similar, "SAMPLE", 5)
    monkeypatch.setattr(similar, "MANY", 3)
    rng = random.Random(6)
    rows = copies(rng)
    base = words(rng, 2600).split()
    rows += [(len(rows) + k, " ".join(base[:n])) for k, n in enumerate((2600, 2200, 1700, 1300, 1030))]
    want = reach(rows)
    got = {r.id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id").collect()}
    assert {i: got.get(i, i) for i, _ in rows} == want
