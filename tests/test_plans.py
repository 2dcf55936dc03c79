from types import SimpleNamespace as N

from pyspark.sql import functions as F

from maskwright import catalog_queries, jobs
from maskwright.operators import detect
from maskwright.plans import adapters, evaluate, gateway
from maskwright.sources import notes
from maskwright.streaming.stream import rehydrate_stream

GOLD = "id long, raw_text string, patient string, entities array<struct<start:int,end:int,category:string,text:string>>"


def gold(spark):
    text = "PATIENT: Ann Lee | MRN: A12345 | Phone: 617-555-0144. Seen 10/14/2023."
    of = lambda x, c: (text.index(x), text.index(x) + len(x), c, x)
    return spark.createDataFrame([(i, text, "p", [of("Ann Lee", "PATIENT"), of("A12345", "MRN"), of("617-555-0144", "PHONE"), of("10/14/2023", "DATE")]) for i in (1, 2)] + [(3, None, None, [])], GOLD)


def test_engines_are_scored(spark):
    run = evaluate.runs(gold(spark), patient_col="patient")
    assert run.count() == 9
    got = {r.engine: r for r in evaluate.summary(run).collect()}
    core = got["core"]
    assert (core.precision, core.recall, core.leak_rate) == (1.0, 1.0, 0.0) and core.utility == 1.0
    assert set(got) == set(evaluate.ENGINES) and got["regex"].recall == 1.0 and got["ner"].recall < 1  # it misses the record number
    rows = evaluate.by_category(run).collect()
    assert [(r.engine, r.category or "") for r in rows] == sorted((r.engine, r.category or "") for r in rows)
    assert {(r.tp, r.fp, r.fn) for r in rows if r.engine == "core" and r.category is not None} == {(2, 0, 0)}


def test_jobs(spark, tmp_path):
    p, text = str(tmp_path), "PATIENT: Ann Lee | MRN: A12345"
    spark.createDataFrame([(1, text), (2, None)], "id long, text string").write.parquet(f"{p}/in")
    out = jobs.main(["deidentify", "--input", f"{p}/in", "--output", f"{p}/out", "--mapping", f"{p}/map"], spark)
    assert "text" not in out.columns and {r.id: r.masked_text for r in out.collect()} == {1: "PATIENT: [PATIENT_1] | MRN: [MRN_1]", 2: ""}
    out.select("id", F.col("masked_text").alias("response")).write.parquet(f"{p}/replies")
    back = jobs.main(["rehydrate", "--input", f"{p}/replies", "--output", f"{p}/back", "--mapping", f"{p}/map"], spark)
    assert {r.id: r.final_text for r in back.collect()} == {1: text, 2: ""}
    said = jobs.main(["ask", "--input", f"{p}/in", "--output", f"{p}/said", "--question", "Who?"], spark)
    assert said.count() == 2 and said.where("not leak_check_passed").count() == 0
    gold(spark).write.parquet(f"{p}/gold")
    assert jobs.main(["benchmark", "--input", f"{p}/gold", "--output", f"{p}/scores", "--patient", "patient"], spark).count() == 3
    assert jobs.main(["health"], spark).count() == 4


def test_adapters_ask_a_client(spark):
    def fake():
        def create(**k):
            said = k["messages"][-1]["content"].upper()
            return N(choices=[N(message=N(content=said))], content=[N(text=said)])

        return N(chat=N(completions=N(create=create)), messages=N(create=create), models=N(generate_content=lambda model, contents: N(text=contents.split("\n\n", 1)[1].upper())))

    df = spark.createDataFrame([(1, "PATIENT: Ann Lee"), (2, None)], "id long, text string")
    for ask in (adapters.chat_completions("m"), adapters.messages("m"), adapters.generate_content("m")):
        got = {r.id: r for r in gateway.process(df, prompt="say {text}", adapter=adapters.service(fake, ask)).collect()}
        assert got[1].raw_response == "SAY PATIENT: [PATIENT_1]" and got[1].final_text == "SAY PATIENT: Ann Lee"
    none = adapters.service(lambda: None, lambda c, p: None)(df.withColumn("prompt", F.col("text")), "prompt", "said")
    assert {r.id: r.said for r in none.collect()} == {1: "", 2: None}


def test_model_spans_of_a_known_range_are_left_out(spark):
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([([(0, 3), (5, 9)], [(0, 3), (0, 4)])], f"a {span}, b {span}")
    assert [tuple(x) for x in df.select(detect.with_model_spans(F.col("a"), F.col("b")).alias("x")).first().x] == [(0, 3), (5, 9), (0, 4)]


def test_repeated_mapping_rows(spark):
    mapping = spark.createDataFrame([(1, "[A_1]", "x"), (1, "[A_1]", "x"), (1, "[A_1]", "y"), (None, None, None)], "id long, token string, original string")
    replies = spark.createDataFrame([(1, "got [A_1]"), (None, "none")], "id long, response string")
    assert {r.id: r.final_text for r in rehydrate_stream(replies, mapping, "id").collect()} == {1: "got y", None: "none"}


def test_markdown_has_all_rows(spark):
    assert len(notes.markdown(spark.range(1500).toDF("n")).splitlines()) == 1502


def test_every_detector_has_a_hit(spark, tmp_path):
    n = len(catalog_queries.VECTORS)
    spark.range(n).toDF("c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: (r.category, r.text) for r in catalog_queries.QUERIES["detector_vectors"](spark, str(tmp_path)).collect()}
    assert got == {i: (c, x) for i, (_, c, x) in enumerate(catalog_queries.VECTORS)}
