import hashlib

from maskwright.llm import exact


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), keep == i, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_hard_rows(hard, hard_rows):
    assert sorted(map(tuple, exact.exact_groups(hard).collect()), key=repr) == brute(hard_rows)


def test_small_buckets(spark):
    rows = [(i, f"text {i % 300}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact.exact_groups(df, capacity=10).collect()), key=repr) == brute(rows)
    _, heads, directory = exact.build_index(df, capacity=10)
    sizes = heads.groupBy("bucket").count().collect()
    assert len(sizes) > 16 and max(r["count"] for r in sizes) <= 10
    assert {r.bucket for r in directory.collect()} == {r["bucket"] for r in sizes}
    spans = heads.groupBy("bucket").agg(exact.F.min(exact.F.shiftrightunsigned("key", 1)).alias("a"), exact.F.max(exact.F.shiftrightunsigned("key", 1)).alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:], strict=False))  # each a range of keys


def test_directory_splits(spark):
    def of(counts, depth, capacity):
        df = spark.createDataFrame(list(counts.items()), "slot long, n long")
        return {r.slot: (r.bucket, r.local_depth) for r in exact.directory(exact.table(df, "counts"), depth, capacity).collect()}

    got = of({0: 5, 1: 5, 4: 1, 7: 2}, 3, 5)
    assert got[0] == (0b1000, 3) and got[1] == (0b1001, 3) and got[4] == got[7] == (0b11, 1)
    assert of({3: 99}, 2, 5) == {3: (0b111, 2)}  # equal keys chain
    assert of({0: 2, 1: 2}, 1, 5) == {0: (1, 0), 1: (1, 0)} and of({}, 4, 5) == {}


def test_groups_come_from_the_buckets(spark, monkeypatch):
    """Without its heads in the buckets a group isn't found."""
    build = exact.build_index
    monkeypatch.setattr(exact, "build_index", lambda *a: (x := build(*a)) and (x[0], x[1].where("keep_id <> 3"), x[2]))
    rows = [(1, "a"), (3, "a"), (2, "b"), (4, "b")]
    got = {r.doc_id: r.group_size for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 2}


def test_divided_chain(spark, monkeypatch):
    """Texts that share key and digest are told apart by their bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("ab"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None)]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]


def test_empty(empty):
    assert exact.exact_groups(empty).count() == 0
