import random

import numpy as np
import pytest

from maskwright.llm import setsketch

from .conftest import words


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, least=85):
    """id, size of set, smallest id reachable, of each row (id or None, text)."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and part[a] != part[b]:
                part = [part[b] if p == part[a] else p for p in part]
    first = {p: min((rows[i][0] for i, q in enumerate(part) if q == p and rows[i][0] is not None), default=None) for p in part}
    return sorted(((i, len(s), first[p], i == first[p]) for (i, _), s, p in zip(rows, sets, part, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, setsketch.near_groups(df).collect()), key=str)


def test_registers_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    for n, shared in ((40, 36), (400, 340), (3000, 600), (3, 2), (1, 1)):
        agree, close = 0, 0
        for _ in range(20):
            h = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
            both = [h[:n], h[n - shared :]]
            x = setsketch.minima(np.concatenate(both), np.repeat([0, 1], n), 2)
            k = setsketch.truncated(x)
            agree += int((k[0] == k[1]).sum())
            assert np.isfinite(x).all()
            union = setsketch.truncated(setsketch.minima(h, np.zeros(len(h), int), 1))
            assert (union[0] == np.maximum(k[0], k[1])).all()  # sketches merge
            close += setsketch.may_be_similar(k[:1], k[1:], np.array([n]), np.array([n]), shared / (2 * n - shared))[0]
        assert agree / (20 * 256) == pytest.approx(shared / (2 * n - shared), abs=0.04)
        assert close == 20


def test_pairs_far_below_the_threshold_go():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 600).astype(np.uint64)
    k = setsketch.truncated(setsketch.minima(np.concatenate((h[:350], h[250:])), np.repeat([0, 1], 350), 2))
    assert not setsketch.may_be_similar(k[:1], k[1:], np.array([350]), np.array([350]), 0.85)[0]


def near_copies(rng):
    """Texts, changed copies around the threshold, chains of copies, passages shared, very short texts."""
    rows, passage = [], words(rng, 30)
    for _ in range(30):
        base = words(rng, rng.choice([1, 2, 3, 8, 30, 120, 300])).split()
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows), " ".join(base) + (" " + passage if rng.random() < 0.3 else "")))
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = words(rng, 1)
    return rows


def test_all_links(spark):
    rows = near_copies(random.Random(3))
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    assert 0 < sum(r[3] for r in want) < len(rows)


def test_groups_within_a_band_that_the_first_member_does_not_join(spark):
    """Two chains that start alike: at many bands, several components stay to be compared."""
    rng = random.Random(9)
    base, rows = words(rng, 100).split(), []
    for at in (0, 50):
        text = list(base)
        for k in range(40):
            text[at + k] = words(rng, 1)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == brute(rows)


@pytest.mark.parametrize("block", [2, 5])
def test_neighbourhoods_in_small_blocks(spark, monkeypatch, block):
    """Copies of one text just above and below the threshold to each other, in many units of work."""
    monkeypatch.setattr(setsketch, "BLOCK", block)
    monkeypatch.setattr(setsketch, "COLUMNS", 16)
    rng = random.Random(block)
    base, rows = words(rng, 80).split(), []
    for _ in range(40):
        text = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 2, 3])):
            text[at] = words(rng, 1)
        rows.append((len(rows), " ".join(text)))
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == want
    assert 1 < sum(r[3] for r in want) < 35


def test_hard_rows(hard, hard_rows, empty, spark):
    assert found(hard) == brute([r[:2] for r in hard_rows])
    assert found(empty) == []
    nameless = [(None, "a b c d"), (None, "A b c d"), (None, None), (4, ""), (4, "e f g h"), (4, "i j k l")]
    assert found(spark.createDataFrame(nameless, "doc_id long, text string")) == brute(nameless)
