import random
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import pytest

from maskwright.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 9, "b": 1}, {"a": 5, "b": 3, "c": 2}, {k: k + 1 for k in range(17)}, {"a": 997, "b": 2, "c": 1}, {"a": 0.7, "b": 0.3 - 1e-4, "c": 1e-4}])
def test_less_than_one_block_from_target(weights):
    quota = mixing.quotas(weights)
    total = sum(Fraction(str(v)) for v in weights.values())
    done = Counter()
    for t, (source, block) in enumerate(mixing.schedule(quota), 1):
        assert block == done[source]
        done[source] += 1
        assert all(abs(done[s] - Fraction(str(v)) / total * t) < 1 for s, v in weights.items())


def test_tiny_weights_are_exact():
    assert mixing.quotas({"a": 1, "b": 1e-7}) == {"a": 10**7, "b": 1}
    assert mixing.quotas({"a": Fraction(1, 3), "b": Fraction(1, 7)}) == {"a": 7, "b": 3}


def brute(blocks, weights):
    """(source, block) of every slot: at each, of the released blocks the one due first; whenever a source
    has nothing left the others start anew."""
    out, left, done, ends = [], dict(blocks), Counter(), []
    weights = {k: Fraction(str(v)) for k, v in weights.items()}
    while left:
        total = sum(weights[k] for k in left)
        w = {k: weights[k] / total for k in left}
        run, t = Counter(), 0
        while True:
            ready = [k for k in left if floor(run[k] / w[k]) <= t]
            k = min(ready, key=lambda k: (ceil((run[k] + 1) / w[k]), sorted(left).index(k)))
            if run[k] == left[k]:
                break
            out.append((k, done[k] + run[k]))
            run[k] += 1
            t += 1
        ends.append(len(out))
        done.update(run)
        left = {k: n - run[k] for k, n in left.items() if n > run[k]}
    return out, ends


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 0.9, "b": 0.07, "c": 0.03}, {"c": 1, "z": 1e-7}, None])
def test_slots_of_a_whole_table(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "PART_SLOTS", 7)
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 30), rng.choice("aaabbc")) for i in range(1500)] + [(1500, "z" * 500, "z"), (1501, "", "e"), (1502, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df, weights, block=100).collect()
    assert len(got) == len(rows)
    size, sizes = {i: len(t or "") for i, t, _ in rows}, Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    if weights is None:
        weights = mixing.shares({s: n for s, n in sizes.items() if n}, 0.5)
    blocks = {s: -(-sizes[s] // 100) for s in weights if sizes[s]}
    slots, ends = brute(blocks, weights)
    of = {x: t for t, x in enumerate(slots)}
    for s in sizes:
        at = 0
        for r in sorted((r for r in got if r.source == s and size[r.doc_id]), key=lambda r: (r.mix_block or 0, r.mix_rank or 0)):
            if s in blocks:
                assert (r.mix_block, r.mix_rank, r.mix_slot) == (at // 100, at % 100, of[s, at // 100])
                assert r.in_mix == (r.mix_slot < ends[0])
            else:
                assert r.mix_slot is None and not r.in_mix
            at += size[r.doc_id]
    assert all(r.mix_slot is not None for r in got if r.source in blocks) and len(slots) == sum(blocks.values())


def test_more_sources_than_asked_for(spark):
    """A weighted source whose name comes late keeps its documents."""
    df = spark.createDataFrame([(i, "text", s) for i, s in enumerate("abcdzzzz")], "doc_id long, text string, source string")
    got = mixing.mix(df, {"z": 1}, grid=2).collect()
    assert {r.source for r in got if r.in_mix} == {"z"} and sum(r.in_mix for r in got) == 4


def test_one_id_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 20)
    df = spark.createDataFrame([(7, f"text {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    assert len({(r.mix_block, r.mix_rank) for r in mixing.mix(df, block=50).collect()}) == 400


def test_ranges_agree(spark, monkeypatch):
    """The same places whatever the ranges of hashes."""
    df = spark.createDataFrame([(i, "y" * (i % 7), f"s{i % 3}") for i in range(500)], "doc_id long, text string, source string")
    one = {r.doc_id: r[3:] for r in mixing.mix(df, block=50).collect()}
    monkeypatch.setattr(mixing, "PART_ROWS", 20)
    assert {r.doc_id: r[3:] for r in mixing.mix(df, block=50).collect()} == one


def test_hard_rows(hard, hard_rows, empty):
    got = mixing.mix(hard, block=1000)
    assert got.columns == [c for c in hard.columns if c != "mix_slot"] + ["mix_block", "mix_slot", "mix_rank", "in_mix"]
    rows = got.collect()
    assert len(rows) == len(hard_rows) and all((r.mix_slot is not None) == (r.source is not None or r.doc_id != 0) for r in rows if r.text)
    some = mixing.mix(hard, {"a": 1, None: 1}, block=1000).collect()
    assert {r.source for r in some if r.mix_slot is not None} == {"a", None}
    assert mixing.mix(empty).count() == 0
