"""The training step and the numbering of tokens against plain counterparts."""

import numpy as np
from xxhash import xxh64_intdigest

from maskwright.llm import lm


def test_step_adds_up_what_comes_up_several_times():
    rng = np.random.default_rng(2)
    for rows in (4, 300, 2**16):
        bias = np.log(rng.dirichlet(np.ones(lm.WAYS), 5)).astype(np.float32)
        node, way, at = rng.integers(0, 5, 400), rng.integers(0, lm.WAYS, 400), [rng.integers(0, rows, 400).astype(np.int32) for _ in range(3)]
        weights = rng.normal(size=(rows, lm.WAYS)).astype(np.float32) * np.float32(0.1)
        square, seen = rng.random(rows).astype(np.float32), np.zeros(rows, np.float32)
        z = bias[node] + sum(weights[f] for f in at)
        g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(lm.WAYS)[way]
        total, squares, times = np.zeros(weights.shape), square.astype(float), np.zeros(rows)
        for f in at:
            np.add.at(total, f, g)
            np.add.at(squares, f, (g * g).sum(axis=1))
            np.add.at(times, f, 1)
        want = weights - total * (lm.RATE / np.sqrt(squares + 1e-2))[:, None]
        lm.step(bias, weights, square, seen, node, at, way)
        assert np.allclose(weights, want, atol=1e-4) and np.allclose(square, squares, rtol=1e-4) and np.array_equal(seen, times)


def test_slots_number_and_hash_tokens_in_order(monkeypatch):
    monkeypatch.setattr(lm, "MEMO", 2)
    slots = lm.Slots([b"a", b"b"])
    for tokens in ([b"c", b"a", b"c", b"d"], [b"e", b"b"], [b"d", b"f", b"g", b"a"]):
        ids = [slots[x] for x in tokens]
        h = slots.hashes()
        assert [slots.names[i] for i in ids] == tokens and h[ids].tolist() == [xxh64_intdigest(x, lm.SEED) for x in tokens]
        assert slots.names[:2] == [b"a", b"b"] and len(slots.names) == len(h) == len(slots)
        slots.trim()


def test_new_tokens_cost_no_call_of_their_own():
    """Before, each went through a method in Python, in every task for each token of the head."""
    assert "__missing__" not in vars(lm.Slots)
