import base64
import os

import pytest
import tiktoken

from maskwright.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no public tokenizer here")


def brute(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for _, text, lang, source, *_ in rows:
        d, n = out.get((source, lang), (0, 0))
        out[source, lang] = d + 1, n + len(enc.encode_ordinary(text or ""))
    return out


def as_dict(df):
    return {(r.source, r.lang): (r.docs, r.tokens) for r in df.collect()}


def test_hard_rows(hard, hard_rows, empty):
    assert as_dict(tokens.token_counts(hard)) == brute(hard_rows)
    # Deleted, estimated and revised documents end with their counts.
    assert as_dict(tokens.token_counts(hard, hard.where("doc_id in (4, 5)"))) == brute(hard_rows)
    assert tokens.token_counts(empty).count() == 0


def test_batches_count_once(spark):
    made = lambda rows: spark.createDataFrame([(i, s, "en", "v1", n) for i, s, n in rows], "doc_id long, source string, lang string, tokenizer string, tokens long")
    old, new = made([(1, "a", 10), (2, "a", 5), (3, "b", 7)]), made([(1, "a", 12), (2, "a", 5), (4, "b", 1)])
    r = tokens.Rollup(spark)
    assert r.apply("one", tokens.signed(old, 1)) and not r.apply("one", tokens.signed(old, 1))
    delta = tokens.changes(old, new)
    assert sorted((x.doc_id, x.sign, x.tokens) for x in delta.collect()) == [(1, -1, 10), (1, 1, 12), (3, -1, 7), (4, 1, 1)]
    assert r.apply("two", delta)
    want = {("a", "en"): (2, 17), ("b", "en"): (1, 1)}
    assert as_dict(r.totals()) == want
    r.compact()
    assert as_dict(r.totals()) == want and not r.apply("two", delta)
    assert r.apply("three", tokens.signed(made([(4, "b", 1)]), -1)) and as_dict(r.totals()) == {("a", "en"): (2, 17)}
    r.compact()
    assert as_dict(tokens.Rollup(spark, r.path).totals()) == {("a", "en"): (2, 17)}
    with pytest.raises(ValueError):
        r.apply("../x", delta)


def test_two_writers_of_one_batch(spark):
    """Both find the place free and finish: one counts."""
    rows = spark.createDataFrame([(1, "a", "en", "v1", 10)], "doc_id long, source string, lang string, tokenizer string, tokens long")
    r = tokens.Rollup(spark)
    r.apply("one", tokens.signed(rows, 1))
    r.apply("two", tokens.signed(rows, 1))
    assert r._move(f"{r.path}/batches/two/{r._list('batches/two')[0]}", f"{r.path}/batches/one/ffff")
    assert len(r._list("batches/one")) == 2 and as_dict(r.totals()) == {("a", "en"): (1, 10)}


def test_commit_while_compacting(spark, monkeypatch):
    """A batch that comes between the listing and the sums is neither named nor summed."""
    rows = spark.createDataFrame([(1, "a", "en", "v1", 10)], "doc_id long, source string, lang string, tokenizer string, tokens long")
    r = tokens.Rollup(spark)
    r.apply("one", tokens.signed(rows, 1))
    sums = r._sums
    monkeypatch.setattr(r, "_sums", lambda batches: r.apply("late", tokens.signed(rows, 1)) and sums(batches))
    r.compact()
    monkeypatch.undo()
    assert as_dict(r.totals()) == {("a", "en"): (2, 20)}
