import pytest

from maskwright.llm.common import exists, passing, scratch, table


def test_passing_deletes_what_was_made_within(spark):
    before = table(spark.range(3), "before")
    with passing(spark):
        inner, unused = table(spark.range(5), "inner"), scratch(spark, "unused")
        with pytest.raises(ValueError), passing(spark):
            failed = table(spark.range(2), "failed")
            raise ValueError
        assert exists(spark, inner.table_path) and not exists(spark, failed.table_path)
    assert not exists(spark, inner.table_path) and not exists(spark, unused) and before.count() == 3
