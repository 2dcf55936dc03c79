import random

import numpy as np

from maskwright.llm import hashing

from .conftest import words


def test_equal_words_equal_hashes(monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, n) for n in (0, 1, 4, 5, 60, 300)] + ["  x\ty\n", "", "A a", "éÉ " * 9, "z" * 200]
    for piece in (hashing.PIECE, 16):  # in one piece, and cut between words
        monkeypatch.setattr(hashing, "PIECE", piece)
        seen: dict = {}
        for t in texts:
            want, got = t.encode().lower().split(), hashing.word_hashes(t.encode()).tolist()
            assert len(want) == len(got)
            for w, h in zip(want, got, strict=True):
                assert seen.setdefault(w, h) == h
            shingles = [b" ".join(want[i : i + 5]) for i in range(max(1, len(want) - 4))] if want else []
            found = hashing.shingle_hashes(t.encode(), 5)
            assert len(found) == len(shingles) and len(set(found.tolist())) == len(set(shingles))
        assert len(set(seen.values())) == len(seen)
    assert hashing.shingle_hashes(b"a b", 5).dtype == np.uint64
