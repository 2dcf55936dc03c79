"""Tokens as Arrow arrays, and their numbers, against plain counterparts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import lm


def texts(rng, n):
    def some(k):
        return bytes(rng.choice(b" \t\n\v\f\r\x1c\x1d\x85\xa0\x00aAzZ\xc3\x84\xff@[`{") for _ in range(rng.randrange(k)))

    return [rng.choice([None, b"", b" \n ", some(9), some(60), some(300)]) for _ in range(n)]


@pytest.mark.parametrize(("piece", "chunk"), [(10**6, 10**6), (10**6, 60), (100, 50), (20, 7)])
def test_chunks_hold_each_token_in_order(monkeypatch, piece, chunk):
    """One array of numbers and the distinct tokens; before, an object in Python for each token."""
    monkeypatch.setattr(lm, "PIECE", piece)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    batches, want = [], []
    for n in (1, 0, 40, 90):
        own = texts(random.Random(n), n)
        batches.append(pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(range(n), pa.int64())], ["text", "id"]))
        want += [(i, found, skip) for i, text in enumerate(own) for found, skip in lm.pieces(text)]
    got, sizes = [], []
    for rows, words, skips in lm.chunks(iter(batches)):
        names, ends = words.names.to_pylist(), np.cumsum(words.lengths).tolist()
        assert len(set(names)) == len(names) and words.code.max() < len(names)
        sizes.append((ends[-1], ends[-1] - words.lengths[-1]))
        got += [(r[0], [names[k] for k in words.code[b - n : b]], skip) for r, n, b, skip in zip(rows, words.lengths.tolist(), ends, skips.tolist(), strict=True)]
    assert got == want
    assert all(before < chunk <= n for n, before in sizes[:-1])  # cut where a piece reaches CHUNK


@pytest.mark.parametrize("head", [0, 1, 50])
def test_numbers_of_distinct_tokens(head):
    own = [b"t%d" % k for k in range(head)]
    asked = list(dict.fromkeys([b"zz", *own[::-2], b"", b"t10", b"t999"]))
    ids, h = lm.Head(own).number(pa.array(asked, pa.binary()))
    slots = lm.Slots(own)
    assert ids.tolist() == [slots[x] for x in asked] and h.tolist() == slots.hashes()[ids].tolist()


@pytest.mark.parametrize("by", [len, lambda x: 7])
def test_equal_hashes_do_not_make_tokens_equal(monkeypatch, by):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x, seed: by(x))
    ids, _ = lm.Head([b"ab", b"cd", b"e", b"ef"]).number(pa.array([b"cd", b"xy", b"ab", b"e", b"f", b"ef"], pa.binary()))
    assert ids.tolist() == [1, 4, 0, 2, 5, 3]


def test_step_adds_up_rows_of_any_multiplicity():
    """Rows that come up once, up to FEW times, and more often than that."""
    rng = np.random.default_rng(5)
    times = np.repeat(np.arange(1, 2 * lm.FEW), np.arange(1, 2 * lm.FEW))
    row = rng.permutation(np.repeat(np.arange(len(np.unique(times))), np.unique(times))).astype(np.int32)
    n = len(row)
    bias, node, way = np.full((1, lm.WAYS), -np.log(lm.WAYS), np.float32), np.zeros(n, int), rng.integers(0, lm.WAYS, n)
    weights = np.zeros((64, lm.WAYS), np.float32)
    square, seen = np.zeros(64, np.float32), np.zeros(64, np.float32)
    g = np.full((n, lm.WAYS), 1 / lm.WAYS) - np.eye(lm.WAYS)[way]
    total = np.zeros(weights.shape)
    np.add.at(total, row, g)
    squares = np.bincount(row, (g * g).sum(axis=1), 64)
    lm.step(bias, weights, square, seen, node, [row], way)
    assert np.allclose(weights, -total * (lm.RATE / np.sqrt(squares + 1e-2))[:, None], atol=1e-5) and np.allclose(square, squares, rtol=1e-5) and np.array_equal(seen, np.bincount(row, minlength=64))
