"""Row numbers of tables read from files take no copy of them."""

import os

import corpus_pipeline as pipeline
from maskwright.llm.common import ROW, numbered, shared_dir


def test_files_are_numbered_without_a_copy(spark, hard, tmp_path):
    path = f"{tmp_path}/it's 1%20 é"
    hard.repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    folder = f"{shared_dir(spark).removeprefix('file://')}/maskwright"
    rows = lambda: {x for x in os.listdir(folder) if x.startswith("rows-")} if os.path.isdir(folder) else set()
    before = rows()
    found = numbered(docs)
    assert rows() == before and found.columns == [*docs.columns, ROW]
    taken = [(r[ROW], r.text) for r in found.collect()]
    assert len({k for k, _ in taken}) == docs.count() and sorted(t or "" for _, t in taken) == sorted(r.text or "" for r in docs.collect())
    assert {(r[ROW], r.text) for r in found.select("text", ROW).repartition(3).collect()} == set(taken)
    stays = pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert rows() == before and stays.count() == len({r.text for r in docs.select("text").collect()} - {None}) + (0 if any(r.text == "" for r in docs.collect()) else 1)
    twice = docs.union(docs)
    assert len({r[ROW] for r in numbered(twice).collect()}) == 2 * docs.count()
