import importlib.util

import __spark_entry__ as e


def test_every_counterpart_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_training_operators_are_registered_if_there():
    there = importlib.util.find_spec("maskwright.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None
    assert ("pipeline" in e.queries()) == there


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and "masked_text" in df.columns
