import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from maskwright.llm import lm


def base(rows, learned):
    tok = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    c = Counter(w for (i, _), words in zip(rows, tok, strict=True) if i is not None and learned(i) for w in words)
    n, v = sum(c.values()), len(c)
    return sorted((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for (i, _), w in zip(rows, tok, strict=True) if i is not None)


def shown(got):
    return sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("head", [3, 1000])
def test_base_scores(hard, hard_rows, head):
    got = lm.score(hard, F.col("doc_id") % 5 != 1, head=head).collect()
    assert len(got) == len(hard_rows)
    assert shown(got) == base([r[:2] for r in hard_rows], lambda i: math.fmod(i, 5) != 1)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_learns_what_follows(spark):
    """A language in which each word tells the next scores far above its counts, held out."""
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(40)]

    def text():
        k = rng.randrange(40)
        out = []
        for _ in range(60):
            out.append(vocab[k])
            k = (k * 7 + 3) % 40 if rng.random() < 0.95 else rng.randrange(40)
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    got = lm.score(df, F.col("doc_id") % 5 != 1).where("doc_id % 5 = 1").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.5


def model(seed=0, n=300):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 1000, n))[::-1]
    return lm.Tree(counts, [25.0] * 16), rng.normal(0, 1, (2**9, lm.WAYS)).astype(np.float32), rng


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_probabilities_sum_to_one(n):
    """After any two words, all tokens of the head and all groups of the rest share one."""
    tree, weights, rng = model(n=n)
    h = rng.integers(0, 2**63, n + lm.WAYS**lm.TAIL).astype(np.uint64)
    ids = np.arange(len(h))
    # One token of each group below the tail's leaf.
    for g in range(lm.WAYS**lm.TAIL):
        h[n + g] = sum((g // lm.WAYS ** (lm.TAIL - 1 - i) % lm.WAYS) << (8 * i) for i in range(lm.TAIL))
    assert lm.group_of(h[n:]).tolist() == list(range(lm.WAYS**lm.TAIL))
    for one, two in ((0, 0), (5, 9), (2**40, 77)):
        context = [np.repeat(c[2:3], len(h)) for c in lm.contexts(np.array([3, 99, 0]), np.array([two, one, 0], np.uint64), np.zeros(3, int), 10)]
        owner, node, way = tree.steps(ids, h)
        p = np.bincount(owner, lm.log_p(tree.bias, weights, node, lm.rows_of(context, owner, node, 9), way), len(h))
        assert np.exp(p + tree.rest[np.minimum(ids, n)]).sum() == pytest.approx(1, abs=1e-4)


def test_tree_without_features_gives_shares():
    counts = np.array([50, 20, 10, 5, 5, 4, 3, 2, 2, 1, 1, 1])
    tree = lm.Tree(counts, [0.375] * 16)
    owner, node, way = tree.steps(np.arange(12), np.zeros(12, np.uint64))
    p = lm.log_p(tree.bias, np.zeros((2, lm.WAYS), np.float32), node, [], way)
    assert np.exp(np.bincount(owner, p) + tree.rest[:12]) == pytest.approx((counts + 0.5) / (counts + 0.5).sum() * (counts + 0.5).sum() / ((counts + 0.5).sum() + 6), rel=1e-4)


def test_scores_by_hand(spark, monkeypatch):
    """Scores from the trained weights, token by token."""
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.randint(1, 30)]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    df, kept = spark.createDataFrame(rows, "doc_id long, text string"), []
    plain = lm.train_pass
    monkeypatch.setattr(lm, "train_pass", lambda *a: kept.append((a, plain(*a))) or kept[-1][1])
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") % 5 != 1, head=12).collect()}
    (_, head, tree, _), weights = kept[-1]
    learned = Counter(w for i, t in rows if i % 5 != 1 for w in [*t.encode().split(), b""])
    assert len(head) == 12 < len(learned)
    bits = len(weights).bit_length() - 1

    def rest(h):
        own = [w for w in learned if w not in head and lm.group_of(np.array([xxh64_intdigest(w, 42)], np.uint64))[0] == lm.group_of(np.array([h], np.uint64))[0]]
        return sum(learned[w] for w in own) + 0.5 * (len(own) + 1)

    for i, t in rows[:20]:
        total, hashes = 0.0, []
        for w in [*t.encode().split(), b""]:
            h = xxh64_intdigest(w, 42)
            u = np.uint64
            common = [x for x, y in hashes[:-1] if y in head]
            one, two = u(hashes[-1][0] if hashes else 0), u(common[-1] if common else 0)
            with np.errstate(over="ignore"):
                context = [np.array([x]) for x in (one * u(0x9E3779B97F4A7C15), two * u(0xC2B2AE3D27D4EB4F) + u(1), (one * u(0x165667B19E3779F9)) ^ (two * u(0xD6E8FEB86659FD93)))]
            _, node, way = tree.steps(np.array([head.index(w) if w in head else 12]), np.array([h], np.uint64))
            for k in range(len(node)):
                at = [f[0] for f in lm.rows_of(context, np.array([0]), node[k : k + 1], bits)]
                z = tree.bias[node[k]] + sum(weights[f] for f in at)
                total += (z[way[k]] - np.log(np.exp(z).sum())) / math.log(10)
            total += tree.rest[head.index(w) if w in head else 12] / math.log(10)
            if w not in head:
                total += math.log10((learned[w] + 0.5) / rest(h))
            hashes.append((h, w))
        assert got[i].score == pytest.approx(total, rel=1e-4)


def test_pieces_keep_their_context(monkeypatch):
    """A long text in pieces has the same tokens and features as in one."""
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(500)).encode()
    tree, _, _ = model(n=5)

    def found():
        got = list(lm.pieces(text))
        ids, h, _, owner, node, way, at = lm._batch(lm.Slots([b"a", b"b", b"cc", b"d", b"ee"]), tree, [x for x, _ in got], np.array([k for _, k in got]), 9)
        return len(got), sorted(zip(h[owner].tolist(), node.tolist(), way.tolist(), *[f.tolist() for f in at], strict=True))

    one, want = found()
    monkeypatch.setattr(lm, "PIECE", 100)
    many, got = found()
    assert one == 1 and many > 5 and got == want


def test_layout_has_no_bearing(spark, hard):
    one, six = ({(r.doc_id, r.n_tokens): r.score for r in lm.score(hard.repartition(k), F.col("doc_id") % 5 != 1).collect() if r.doc_id is not None} for k in (1, 6))
    assert one == six


def test_model_grows_with_the_corpus(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(lm, "train_pass", lambda rows, head, tree, weights: sizes.append((len(weights), len(head))) or weights)
    for n in (10, 4000):
        lm.score(spark.range(n).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, 1000), x -> id * x % {n * 100})) AS text"), F.lit(True))
    assert sizes[-1][0] > sizes[0][0] and sizes[-1][1] > sizes[0][1]


def test_empty(empty, hard, hard_rows):
    assert lm.score(empty, F.lit(True)).count() == 0
    none = lm.score(hard, F.lit(False)).collect()
    assert len(none) == len(hard_rows) and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_unknown_tokens_cost_what_they_cost_in_the_base(spark):
    """While the vocabulary fits into the head, held-out texts with unknown tokens score above their base too."""
    rng = random.Random(11)
    common = [f"w{i}" for i in range(40)]

    def text():
        at, out = rng.randrange(40), []
        for _ in range(60):
            at = (at * 7 + rng.choice([1, 2])) % 40
            out.append(common[at] if rng.random() < 0.9 else f"x{rng.randrange(10**6)}")
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    held = lm.score(df, F.col("doc_id") % 5 != 1).where("doc_id % 5 = 1").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.sum("n_known")).first()
    assert held[0] > held[1] and held[2] - held[3] > 300
    one = spark.createDataFrame([(1, "zzqq"), (0, common[0])], "doc_id long, text string")
    r = lm.score(df.union(one), F.col("doc_id") % 5 != 1).where("n_tokens = 2 and n_known = 1").first()
    assert r.score == pytest.approx(r.base_score, abs=1.0)
