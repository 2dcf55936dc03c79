"""Suffixes travel in blocks: rows don't grow with the number of suffixes."""

import random
from collections import Counter

import numpy as np

from maskwright.llm import phrases


def test_rows_of_suffixes_are_bounded_by_buckets(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(20)]
    df = spark.createDataFrame([("en" if i % 2 else "de", t.encode()) for i, t in enumerate(texts)], "lang string, text binary").repartition(3)
    every = np.full(2**12, 255, np.uint8)
    rows = phrases.suffixes(df, every, every, np.zeros(0, np.int64), 5, 7).collect()
    assert len(rows) <= 3 * 2 * 7 and sum(r.block.count(b"\n") + 1 for r in rows) > 5000
    assert sum(int(np.frombuffer(r.n, np.int64).sum()) for r in rows) == 20 * 399
    want: Counter = Counter()
    for i, t in enumerate(texts):
        w = t.split()
        want.update(("en" if i % 2 else "de", " ".join(w[j : j + k])) for k in range(2, 6) for j in range(len(w) - k + 1))
    want = {k: n for k, n in want.items() if n >= 10}
    for hot in (2**18, 60):  # from 60 on, pairs are dealt out
        monkeypatch.setattr(phrases, "HOT", hot)
        docs = df.select("lang", phrases.F.col("text").cast("string").alias("text"))
        got = {(r.lang, r.phrase): r.n for r in phrases.count_phrases(docs, least=10)[0].collect()}
        assert got == want
