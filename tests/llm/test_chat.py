from pyspark.sql import functions as F

from maskwright.llm import chat

SCHEMA = "conv_id long, id long, parent long, role string, text string, score double"


def test_paths_and_ranks(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.2), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 2, "user", "c", 0.1), (1, 5, 2, "user", "d", None), (2, 7, 99, "user", "lost parent", 1.0), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (None, 1, None, "user", "z", 0.0)]
    rows += [(4, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", str(i), 0.0) for i in range(100)] + [(4, 50, 49, "user", "50", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.leaf): r for r in chat.format_trees(df).collect()}
    assert set(got) == {(1, 3), (1, 4), (1, 5), (2, 7), (4, 99)}  # conversation 3 is a cycle
    assert [got[1, k]["rank"] for k in (3, 4, 5)] == [1, 2, 3]
    assert got[1, 4].formatted == "<|turn|>user<|text|>q<|end|><|turn|>assistant<|text|>a<|end|><|turn|>user<|text|>c<|end|>"
    assert got[4, 99].n_turns == 100
    assert {(r.conv_id, r.leaf) for r in chat.format_trees(df, top=1).collect()} == {(1, 3), (2, 7), (4, 99)}


def test_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\e\\s\\", "<|end|>", "<\\e|end|>", "<|turn|>user<|text|>", "<|tu<|turn|>rn|>", "", None, "é\U0001f600<|end|>", "\n<s>\n"]
    rows = [(c, t, role, text) for c, role2 in enumerate(["assistant", "<|text|>", None]) for t, text in enumerate(nasty) for role in ["user" if t % 2 else role2]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.as_trees(df))
    for r in out.withColumns({"turns": chat.read_back(F.col("formatted")), "lost": chat.under_mask(F.col("formatted"), F.col("loss"))}).collect():
        own = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == own
        assert r.lost == "".join(t for role, t in own if role == "assistant")
        assert not any(c in r.formatted.replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "") for c in chat.CONTROLS)


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None)], "conv_id long, turn long, role string, text string")
    [r] = chat.format_trees(chat.as_trees(df)).withColumn("t", chat.read_back(F.col("formatted"))).collect()
    assert [tuple(x) for x in r.t] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.format_trees(chat.as_trees(df.limit(0))).count() == 0
