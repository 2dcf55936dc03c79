"""The stages against plain Python over the same rows."""

import corpus_pipeline as pipeline
from maskwright.llm import common

from .test_decontam import brute as hits
from .test_similar import reach


def test_stages(spark, hard, hard_rows, tmp_path):
    docs = hard.where("doc_id is not null")
    rows = {r[0]: r[1] for r in hard_rows if r[0] is not None}
    items = [(1, rows[6])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    want = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    first = pipeline.language_id(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == set(want)
    want = {i: t for i, t in want.items() if i == max(j for j, u in want.items() if u == t)}
    second = pipeline.exact_dedup(spark, first, str(tmp_path))
    assert {r.doc_id for r in second.collect()} == set(want)
    near = reach(want.items())
    want = {i: t for i, t in want.items() if near[i] == i}
    third = pipeline.near_dedup(spark, second, str(tmp_path))
    assert {r.doc_id for r in third.collect()} == set(want)
    want = {i: t for i, t in want.items() if not hits([(i, t)], items)[i][3]}
    fourth = pipeline.decontaminate(spark, third, str(tmp_path))
    assert {r.doc_id for r in fourth.collect()} == set(want) and fourth.columns == docs.columns
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(want)
    assert out.columns[-4:] == ["mix_block", "mix_slot", "mix_rank", "in_mix"]


def test_anti_join_beyond_the_broadcast_bound(spark, hard, monkeypatch):
    monkeypatch.setattr(common.bounded, "__defaults__", (2, 10**9))
    gone = common.table(hard.where("doc_id between 20 and 40").select("doc_id").distinct(), "gone")
    assert common.without(hard, gone).where("doc_id between 20 and 40").count() == 0


def test_broadcast_by_bytes(spark):
    few = common.table(spark.createDataFrame([("x" * 100,)] * 10, "k string"), "few")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.bounded(few)) and not hinted(common.bounded(few, most=500)) and not hinted(common.bounded(few, rows=9))


def test_language_stage_follows_the_prediction(spark, tmp_path, monkeypatch):
    rows = [(i, "the house and the tree " * 3 if i % 2 else "das haus und der baum " * 3, "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(pipeline, "LANGUAGES", ("de",))
    assert {r.doc_id for r in pipeline.language_id(spark, df, str(tmp_path)).collect()} == {i for i in range(40) if i % 2 == 0}
    monkeypatch.setattr(pipeline, "LEAST_SCORE", 1.1)
    assert pipeline.language_id(spark, df, str(tmp_path)).count() == 0
