"""Rows whose ids are null or repeated, stage by stage."""

import corpus_pipeline as pipeline


def test_null_and_repeated_ids(spark, tmp_path):
    """One row of each group stays, and a row that shares its id with a copy."""
    leak = " ".join(f"leak{k}" for k in range(12))
    one, two, three = "a text that comes up in rows of one id", "another text in rows without an id", "a text in one row only"
    rows = [(1, one), (1, one), (None, two), (None, two), (2, one + " again"), (2, three), (3, leak), (3, "a clean text beside a leak"), (None, leak), (9, one + " again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", pipeline.F.lit("a")).withColumn("lang", pipeline.F.lit("en"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    taken = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    exact = [(1, one), (None, two), (2, three), (3, leak), (3, "a clean text beside a leak"), (9, one + " again")]
    assert taken(pipeline.exact_dedup(spark, df, str(tmp_path))) == sorted(exact, key=repr)
    clean = [r for r in rows if r[1] != leak]
    assert taken(pipeline.decontaminate(spark, df, str(tmp_path))) == sorted(clean, key=repr)
    out = pipeline.run(spark, str(tmp_path))
    assert taken(out) == sorted([r for r in exact if r[1] not in (leak, one + " again")], key=repr) and out.columns[:4] == df.columns
