from maskwright.llm import queries


def test_rows_without_a_conversation_are_one(spark, tmp_path):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "answer"), (5, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op8_chat_format(spark, str(tmp_path))
    assert dict(out.dtypes)["conv_id"] == "bigint"
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in out.collect()} == {None: (2, 6), 5: (1, 0), -1: (2, 21)}
