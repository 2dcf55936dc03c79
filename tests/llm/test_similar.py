import random

import corpus_pipeline as pipeline
from maskwright.llm import setsketch, similar

from .conftest import words


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def reach(rows, least=0.8):
    """Smallest id reachable over pairs of Jaccard similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                lo, hi = sorted((part[a], part[b]))
                part = {i: lo if p == hi else p for i, p in part.items()}
    return part


def copies(rng):
    """Texts, changed copies around the threshold, chains of copies, a passage all share."""
    rows, passage = [], words(rng, 30)
    for _ in range(25):
        base = words(rng, rng.choice([3, 8, 30, 120])).split()
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(base) + (" " + passage if rng.random() < 0.3 else "")))
            for _ in range(rng.randint(1, 2)):
                base[rng.randrange(len(base))] = words(rng, 1)
    return rows + [(len(rows), None), (len(rows) + 1, " \n"), (len(rows) + 2, "One"), (len(rows) + 3, "one")]


def test_all_similar_pairs(spark):
    rows = copies(random.Random(3))
    want = reach(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.component_id for r in similar.groups(df, "doc_id").collect()}
    assert {i: got.get(i, i) for i, _ in rows} == want and len(set(want.values())) < len(rows)
    assert similar.groups(df.limit(0), "doc_id").count() == 0


def test_pipeline_drops_near_copies_beyond_three_bits(spark, hard_rows, tmp_path):
    """The stage in use, with null and repeated ids: rows 5 and 6 are 5 bits and 0.95 apart."""
    texts = {r[0]: r[1] for r in hard_rows if r[0] is not None}
    rows = [(5, texts[5]), (6, texts[6]), (None, texts[5] + " z"), (7, "a text of its own in six"), (6, "another one of seven words with 6")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(pipeline.STAGES)["SimHash near-dedup"]
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted([rows[0], rows[3], rows[4]])


def test_copies_just_above_and_below_the_threshold(spark, monkeypatch):
    """Neighbourhoods that the nearest pairs don't join, settled in small blocks."""
    monkeypatch.setattr(setsketch, "BLOCK", 3)
    rng = random.Random(13)
    base, rows = words(rng, 90).split(), []
    for _ in range(30):
        text = list(base)
        for at in rng.sample(range(90), rng.choice([0, 1, 2, 2])):
            text[at] = words(rng, 1)
        rows.append((len(rows), " ".join(text)))
    want = reach(rows)
    got = {r.id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id").collect()}
    assert {i: got.get(i, i) for i, _ in rows} == want and 1 < len(set(want.values())) < 28
