import random

from maskwright.operators import leaks

SCHEMA = "id long, patient string, masked_text string, value string"


def brute(texts, originals, grouped):
    out = {}
    values = {(p if grouped else 0, v.strip()) for p, v in originals if v and len(v.strip()) > 2}
    for i, p, t, _ in texts:
        for q, v in values:
            if t and (not grouped or p == q):
                n = sum(t.startswith(v, k) for k in range(len(t)))
                if n:
                    out[i, v] = out.get((i, v), 0) + n
    return out


def tables(spark, texts, originals):
    return spark.createDataFrame(texts, SCHEMA).repartition(3), spark.createDataFrame(originals, "patient string, original string").repartition(2)


def some(rng):
    originals = [(rng.choice(["p", "q", None]), "".join(rng.choice("abé 𝔸") for _ in range(rng.randint(1, 7)))) for _ in range(60)]
    texts = []
    for i in range(80):
        own = [rng.choice(originals)[1] if rng.random() < 0.3 else "".join(rng.choice("abé 𝔸c") for _ in range(rng.randint(0, 9))) for _ in range(6)]
        texts.append((i, rng.choice(["p", "q", None]), "|".join(own), "x"))
    return texts, originals


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 16)
    texts, originals = some(random.Random(5))
    texts += [(200, "p", None, "x"), (201, None, "", None), (202, "p", "ab", None)]
    originals += [("p", None), ("p", ""), (None, "  aba  "), ("q", "aba"), ("q", "aba")]
    masked, known = tables(spark, texts, originals)
    for group in (None, "patient"):
        want = brute(texts, originals, group is not None)
        got = {(r.id, r.value): r.n for r in leaks.leaks(masked, known, "id", group=group).collect()}
        assert got == want and len(want) > 20
        report = {r.id: (r.n_values, r.n_places, r.leak_free) for r in leaks.leak_report(masked, known, "id", group=group).collect()}
        assert set(report) == {t[0] for t in texts}
        assert all(v == (sum(k[0] == i for k in want), sum(n for k, n in want.items() if k[0] == i), all(k[0] != i for k in want)) for i, v in report.items())


def test_empty_tables(spark):
    masked, known = tables(spark, [(1, "p", "abc", None), (None, "p", "abc abc", None)], [("p", "abc")])
    assert leaks.leaks(masked.limit(0), known, "id").count() == 0
    assert [tuple(r) for r in leaks.leak_report(masked, known.limit(0), "id").collect()] == [(1, 0, 0, True), (None, 0, 0, True)] or leaks.leak_report(masked, known.limit(0), "id").where("leak_free").count() == 2
    got = {r.id: r.n_places for r in leaks.leak_report(masked, known, "id").collect()}
    assert got == {1: 1, None: 2}


def test_plan_has_no_cross_join(spark):
    masked, known = tables(spark, *some(random.Random(1)))
    plan = leaks.leaks(masked, known, "id", group="patient")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
