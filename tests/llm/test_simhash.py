import random

import numpy as np
import xxhash

from maskwright.llm import simhash
from maskwright.llm.components import components


def fingerprint(t):
    w = [x.decode() for x in (t or "").encode().lower().split()]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reach(fps):
    """Smallest id reachable over links of at most three bits."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def grouped(spark, fps):
    nodes = spark.createDataFrame([(signed(f), i) for i, f in fps.items()], "fp long, rep long")
    found = {r.id: r.component_id for r in components(simhash.links(nodes)).collect()}
    return {i: found.get(i, i) for i in fps}


def test_fingerprints_are_native_hashes(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] == signed(xxhash.xxh64_intdigest(b"a b c", 42))


def test_links_of_up_to_three_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 3)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = random.Random(5)
    fps, used = {}, set()
    for c in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            if f not in used:
                used.add(f)
                fps[len(fps)] = f
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
                f ^= 1 << b
        if c == 0:  # a dense ball
            fps |= {len(fps) + k: v for k, v in enumerate(sorted({f ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} - used))}
    assert grouped(spark, fps) == reach(fps)


def test_hard_rows(hard, hard_rows, empty):
    got = simhash.near_groups(hard).collect()
    assert len(got) == len(hard_rows)
    assert {(r.doc_id, r.fp) for r in got} == {(i, signed(fingerprint(t))) for i, t, *_ in hard_rows}
    fps = {i: fingerprint(t) for i, t, *_ in hard_rows if i is not None}
    want = reach(fps)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [want[5]]
    assert simhash.near_groups(empty).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    assert {r.id: r.component_id for r in components(edges).collect()} == {i: 0 for i in range(101)} | {500: 500, 501: 500}


def test_forest_connects():
    f = np.array([0, 1, 3, 7, 15, 0xFF << 40], np.uint64)
    assert len(list(simhash._forest(f, np.array([True] * 6), 3))) == 4
