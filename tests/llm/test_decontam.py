import random
import re

from maskwright.llm import decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    wins = []
    for i, t in items:
        w = tokens(t)
        wins += [(i, w[s : s + size]) for s in range(max(len(w) - size, 0) + 1)] if w else []
    out = {}
    for d, t in docs:
        w = tokens(t)
        hit, found = set(), set()
        for i, win in wins:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found), bool(hit))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r[0]: tuple(r[1:]) for r in decontam.decontaminate(d, b, **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "Étude", "été", "x1", "Zed", "and", "on"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 9, 10, 11, 25]))) for i in range(12)] + [(90, None), (91, "..."), (92, "unseenword " * 12), (0, "THE of")]
    docs = [(i, text(rng.randint(0, 80)) + rng.choice(["", ", " + (items[rng.randrange(12)][1]).upper() + "!"])) for i in range(60)] + [(100, None), (101, ""), (102, "the the the " * 3000)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, size=3) == brute(docs, items, 3)


def test_hard_rows(spark, hard, hard_rows, empty):
    items = spark.createDataFrame([(1, hard_rows[5][1]), (None, "short")], "item_id long, text string")
    got = decontam.decontaminate(hard, items).collect()
    assert len(got) == len(hard_rows)
    assert sorted((r.doc_id for r in got if r.contaminated), key=str) == sorted([5, 5, 6, None, -3], key=str)
    assert decontam.decontaminate(empty, items).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(hard, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha b c beta"), (2, "alpha b c d e f g beta"), (3, "beta alpha gamma"), (4, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, text string")
    index = decontam.build_index(docs, decontam.vocabulary(items))
    wins = decontam.windows(items)
    got = {(r.doc_id, r.win) for r in decontam.proximity_matches(index, wins, 3).join(decontam.documents(index), "row").collect()}
    by_item = {r.item_id: r.win for r in wins.collect()}
    assert got == {(1, by_item[1]), (3, by_item[1]), (3, by_item[2])}
    assert sorted(map(tuple, decontam.near_items(docs, items, 3).collect())) == [(1, 1, 1), (3, 1, 1), (3, 2, 1)]


def test_rows_that_share_an_id_or_have_none(spark):
    """The words of two rows of one id make no phrase together; a row without an id is hit like any other."""
    w = [f"w{i}" for i in range(10)]
    item = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    odd, even = " ".join(x if i % 2 else "z" for i, x in enumerate(w)), " ".join("z" if i % 2 else x for i, x in enumerate(w))
    docs = spark.createDataFrame([(1, odd), (1, even), (None, " ".join(w)), (2, " ".join(w)), (2, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_hit, r.item_ids) for r in decontam.decontaminate(docs, item).collect()), key=str)
    assert got == sorted([(1, 0, []), (1, 0, []), (None, 10, ["7"]), (2, 10, ["7"]), (2, 0, [])], key=str)


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    items = [(i, " ".join(rng.sample(vocab, 3))) for i in range(8)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.near_items(frame(docs, "doc_id"), frame(items, "item_id"), 4).collect()}
    df = {v: sum(t.split().count(v) for _, t in docs) for v in vocab}
    want = set()
    for i, q in items:
        least = min(df[x] for x in q.split())
        rare = [x for x in q.split() if df[x] == least]
        for d, t in docs:
            w = t.split()
            near = lambda x: any(y == x and set(q.split()) <= set(w[max(0, k - 4) : k + 5]) for k, y in enumerate(w))
            if any(near(x) for x in rare):
                want.add((d, i))
            if len(rare) > 1 and not all(near(x) for x in rare):
                want.discard((d, i))
                got.discard((d, i))
    assert got == want and len(want) > 20
