import hashlib
import random

import numpy as np
import pytest

from maskwright.llm import suffix


def brute(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
    return out


def run(df, length=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, length=length).collect()}


@pytest.mark.parametrize("length", [20, 37, 100])
def test_against_brute_force(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcdé \n\0") for _ in range(rng.randint(5, 300))) for _ in range(12)]
    piece = lambda: rng.choice(pool)[rng.randint(0, 20) : rng.randint(30, 300)] if rng.random() < 0.6 else "".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 150)))
    docs = [(i * 3 - 50, None if rng.random() < 0.03 else "x" * rng.randint(0, 400) if rng.random() < 0.1 else "".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(80)]
    docs += [(1000 + i, docs[i][1]) for i in range(5)]
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), length) == brute(docs, length)


def test_hard_rows(hard, hard_rows, empty):
    got = suffix.remove_repeats(hard).collect()
    assert len(got) == len(hard_rows)
    by = {r.doc_id: r for r in got}
    assert by[4].n_removed == by[4].n_bytes and by[3].n_removed < 1000  # the first of two copies stays
    assert by[1].n_removed == 0 and by[7].n_removed == 799
    assert suffix.remove_repeats(empty).count() == 0


def test_merge_keeps_prefixes():
    rng = random.Random(1)
    for _ in range(50):
        runs = [sorted(bytes(rng.choices(b"ab\0", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 7))]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        order, prefix = suffix.merge([(r, [0] + [common(a, b) for a, b in zip(r, r[1:], strict=False)]) for r in runs])
        at = [0] * len(runs)
        out = []
        for r in order:
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(x for r in runs for x in r)
        assert prefix == [0] + [common(a, b) for a, b in zip(out, out[1:], strict=False)]


def test_front_coding():
    strings = np.array([list(b"abc\0"), list(b"abcd"), list(b"b\0\0\0")], np.uint8)
    common, rest = suffix.front_code(strings, np.array([3, 4, 1]))
    assert suffix.front_decode(common.tolist(), [3, 4, 1], rest) == [b"abc", b"abcd", b"b"]
