import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import labels, metrics, spantables

SPAN = "seq int, start int, end int, category string"


def tables(spark, docs):
    """docs: (doc, engine, predicted, gold). Both tables and the arrays of `metrics`."""
    side = lambda at: [(d, e, i, *s, "x") for d, e, *sides in docs for i, s in enumerate(sides[at])]
    schema = f"doc long, engine string, {SPAN}, other string"
    arrays = spark.createDataFrame([(d, e, *[[(i, *s) for i, s in enumerate(x)] for x in sides]) for d, e, *sides in docs], f"doc long, engine string, predicted array<struct<{SPAN}>>, gold array<struct<{SPAN}>>")
    return spark.createDataFrame(side(0), schema).repartition(3), spark.createDataFrame(side(1), schema).repartition(2), arrays


def some(rng, n, length):
    kinds = ["PATIENT", "NAME_PROVIDER", "DATE", "MRN", "ID_ACCESSION", "geo_city"]
    out = []
    for _ in range(n):
        a = rng.randrange(length)
        out.append((a, a + rng.choice([0, 1, 3, 5, 9, 20]), rng.choice(kinds)))
    return out


def documents():
    rng = random.Random(6)
    docs = [(d, rng.choice(["a", "b"]), some(rng, rng.randint(0, 12), 60), some(rng, rng.randint(0, 12), 60)) for d in range(60)]
    docs.append((100, "a", some(rng, 300, 3000), some(rng, 300, 3000)))  # a long one
    return [*docs, (101, "b", [(5, 9, "DATE"), (5, 9, "DATE"), (7, 7, "DATE")], [(5, 9, "DATE"), (7, 7, "DATE"), (7, 7, "DATE")]), (None, "a", [(1, 4, "DATE")], [(2, 5, "DOB")])]


@pytest.mark.parametrize("mode", ["overlap", "exact"])
def test_equals_the_arrays(spark, monkeypatch, mode):
    monkeypatch.setattr(spantables, "SLAB", 40)
    predicted, gold, arrays = tables(spark, documents())
    count = lambda df: sorted(map(tuple, df.groupBy("engine", "category", "tp", "fp", "fn").count().collect()), key=str)
    want = arrays.select("engine", F.inline(metrics.match(F.col("predicted"), F.col("gold"), mode)))
    assert count(spantables.match_tables(predicted, gold, "doc", mode=mode, by=["engine"])) == count(want)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(spantables.table_metrics(predicted, gold, "doc", mode=mode, by=["engine"])) == rows(metrics.span_metrics(arrays, "predicted", "gold", mode, ["engine"]))


def test_runs_across_slabs(spark):
    spans = [(1, 0, 95), (1, 10, 12), (1, 94, 96), (1, 96, 97), (1, 200, 201), (1, 205, 330), (1, 329, 331), (2, 5, 6), (None, 5, 6)]
    got = spantables.runs(spark.createDataFrame(spans, "doc long, start int, end int"), "doc", 30).collect()
    assert {(r.doc, r.start): r.run for r in got} == {(1, 0): 0, (1, 10): 0, (1, 94): 0, (1, 96): 96, (1, 200): 200, (1, 205): 205, (1, 329): 205, (2, 5): 5, (None, 5): 5}


def test_spans_without_a_range(spark):
    schema = f"doc long, {SPAN}"
    one = spark.createDataFrame([(1, 0, None, 3, "DATE"), (1, 1, 2, None, None)], schema)
    two = spark.createDataFrame([(1, 0, 1, 3, None), (1, 1, None, None, "MRN")], schema)
    got = sorted(map(tuple, spantables.match_tables(one, two, "doc").collect()), key=str)
    assert got == sorted([("DATE", 0, 1, 0), (None, 0, 1, 0), (None, 0, 0, 1), ("MRN", 0, 0, 1)], key=str)
    assert spantables.match_tables(one.limit(0), two.limit(0), "doc").count() == 0


def test_interval_join_gives_each_pair_once(spark):
    rng = random.Random(8)
    make = lambda n: [(rng.randrange(4) or None, i, (a := rng.randrange(500)), a + rng.choice([0, 1, 10, 200])) for i in range(n)]
    left, right = make(80), make(70)
    frame = lambda rows: spark.createDataFrame(rows, "doc long, i int, start int, end int")
    got = spantables.interval_join(frame(left), frame(right), "doc", 16).select("i", "other.i").collect()
    want = [(x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    outer = spantables.interval_join(frame(left), frame(right), "doc", 16, "left")
    assert {r.i for r in outer.collect()} == {x[1] for x in left} and outer.where("other is not null").count() == len(want)


def test_labels_of_tokens(spark):
    rng = random.Random(9)
    docs = []
    for d in range(30):
        at, tokens = 0, []
        for i in range(25):
            at += rng.randint(0, 2)
            n = rng.choice([0, 2, 3, 4, 5]) if i else 3
            tokens.append((i, at, at + n))
            at += n
        entities = [(k, (a := rng.randrange(at)), a + rng.randint(1, 12), rng.choice(["DATE", "MRN"])) for k in range(5)]
        docs.append((d, tokens, entities))
    whole = spark.createDataFrame(docs, f"doc long, tokens array<struct<i int, start int, end int>>, entities array<struct<{SPAN}>>")
    tokens, entities = whole.select("doc", F.inline("tokens")), whole.select("doc", F.inline("entities"))
    want = {(r.doc, i): x for r in whole.select("doc", labels.encode(F.col("tokens"), F.col("entities")).alias("x")).collect() for i, x in enumerate(r.x)}
    got = {(r.doc, r.i): r.label for r in spantables.label_tokens(tokens, entities, "doc").collect()}
    assert got == want and len(set(want.values())) > 4
