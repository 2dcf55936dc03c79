"""What is ruled out before a pattern runs."""

from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.spans import find_spans, gate
from maskwright.operators import detect

NOTE = "PATIENT: Eleanor Vance | DOB: 05/14/1995 | MRN: ORD-00012345\nATTENDING: Dr. Parkinson, MD (Phone: 617-555-0144)\nHISTORY: 61-year-old with Parkinson's disease, seen 1995-05-14. Exam [Normal]. 25/100 mg TID."


def test_gates_fold_as_patterns_do(spark):
    texts = ["nonagenarıan", "Mİss Lee has", "her ſon Tom Lee", "Fox on ١٠/١٤/٢٠٢٣", "617-555-٠١٤٤", "Boston, MA 02115", "cıty: Mıamı", "ab-12345", "fe80::1", "1:2:3:4:5:6:7:8", "92 – yo", "aged 101"]
    df, may = detect.gated(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"))
    every = [p for p in vars(P).values() if isinstance(p, P.Pattern) and p.kind != "city" and p.name in P.NEEDS]
    pairs = df.select(*[F.struct(find_spans(F.col("text"), p).alias("a"), find_spans(F.col("text"), p, when=may(p)).alias("b")).alias(p.name) for p in every]).collect()
    assert all(x.a == x.b for r in pairs for x in r)
    assert sum(bool(x.a) for r in pairs for x in r) >= 9


def test_most_patterns_are_ruled_out(spark):
    """Of 36 patterns with gates a note lets few run."""
    df = spark.createDataFrame([(NOTE,)], "text string").withColumn("__low", F.lower("text"))
    every = [p for p in vars(P).values() if isinstance(p, P.Pattern) and p.name in P.NEEDS]
    r = df.select(*[gate(p, F.col("__low")).alias(p.name) for p in every]).first().asDict()
    assert len(r) == 36 and {k for k, v in r.items() if v} <= {"mrn", "phone", "date", "mbi", "zip", "street", "patient_header", "provider_header"}


def test_structured_query_looks_at_gates(spark, tmp_path):
    from maskwright.catalog_queries import QUERIES

    spark.sql("select 1L as o_orderkey, 2L as o_custkey, timestamp'1995-05-14' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["spans_structured_notes"](spark, str(tmp_path))
    assert "__shape" in df._jdf.queryExecution().analyzed().toString() and df.count() == 4


def test_tokens_given_out_stay_as_they_are(spark):
    """Such a text is not taken apart; any other token in it still is put right."""
    from maskwright.functions import brackets

    cases = {"[PATIENT_1] (Phone: [PHONE_12]) [AGE_90+] [AGE_90+_2] ⟦x⟧": None, "[DATE_1]DATE_2[DATE_3]": "[DATE_1][DATE_2][DATE_3]", "([DATE_1]) (date 2)": "([DATE_1]) [DATE_2]", "[DOCTOR_1]": "[PROVIDER_1]", "[patient_1][MRN_2": "[PATIENT_1][MRN_2", "[[DATE_1]]": None, "[AGE_90]": "[AGE_90+]"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", brackets.normalize_tokens(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {t: n or t for t, n in cases.items()}
    assert P.GIVEN_TOKEN[:20] in df._jdf.queryExecution().optimizedPlan().toString()
