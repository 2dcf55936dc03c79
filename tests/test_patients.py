import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions.spans import SPAN
from maskwright.operators import mask
from maskwright.streaming import patients

SCHEMA = f"note_id long, patient string, day date, text string, spans array<{SPAN}>, extra string"
NAMES = ["Ann Lee", "ann lee", "Bo", "10/14/2023", "95-year-old", "97 years", "MRN 1"]


def note(rng, i, patient):
    import datetime

    text, spans = "", []
    for _ in range(rng.randint(0, 5)):
        x = rng.choice(NAMES)
        text += rng.choice(["seen ", "by é ", ", "])
        category = "DATE" if "/" in x else "AGE" if "year" in x else "MRN" if x[0] == "M" else rng.choice(["PATIENT", "DOCTOR", "provider"])
        spans.append((len(spans), len(text), len(text) + len(x), category, x, 0.9, "s", "01/01/2020" if "/" in x else None, "[AGE_90+]" if "year" in x else None))
        text += x
    return (i, patient, datetime.date(2024, 1, 1) + datetime.timedelta(days=i // 2), text + ".", spans, "x")


def notes():
    rng = random.Random(3)
    rows = [note(rng, i, rng.choice(["p", "p", "p", "q", None])) for i in range(40)]
    return [*rows, (40, "p", rows[-1][2], None, None, None), (41, "p", rows[-1][2], "plain", [], None)]


def brute(rows):
    """tokens by note: the numbering of each patient, in order."""
    given, last, out = {}, {}, {}
    alias = {"DOCTOR": "PROVIDER"}
    for i, p, _, _, spans, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = []
        for _, _, _, c, x, _, _, moved, custom in spans or []:
            counter = custom or alias.get(c.upper(), c.upper())
            if moved and not custom:
                counter = "DATE"
            # DOCTOR and PROVIDER count together but stay apart as keys, as they do within a note.
            key = (p, counter, ("DATE" if moved and not custom else c.upper()) + ":" + x.lower())
            if key not in given:
                last[p, counter] = n = last.get((p, counter), 0) + 1
                given[key] = counter if custom and n == 1 else f"[{counter.strip('[]')}_{n}]"
            out[i].append(given[key])
    return out


def tokens(df):
    return {r.note_id: list(r.tokens) for r in df.collect()}


def test_table(spark):
    rows = notes()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = patients.number_notes(df, "patient", "day", "note_id")
    assert out.columns == [*df.columns, "tokens", "masked_text"]
    assert tokens(out) == brute(rows)
    shown = {r.note_id: r.masked_text for r in out.collect()}
    assert shown[40] == "" and shown[41] == "plain" and not any("Ann Lee" in x for x in shown.values())
    assert patients.number_notes(df.limit(0), "patient", "day", "note_id").count() == 0


def test_one_note_is_numbered_as_by_itself(spark):
    """But for texts that come under several categories of one counter, whose rules differ."""
    rows = [note(random.Random(k), k, str(k)) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    own = {r.note_id: list(r.t) for r in df.select("note_id", mask.allocate(F.col("spans"))["tokens"].alias("t")).collect()}
    assert tokens(patients.number_notes(df, "patient", "day", "note_id")) == own


@pytest.fixture
def rocks(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_stream_in_batches_and_over_a_restart(rocks, tmp_path):
    rows = notes()
    for k, part in enumerate((rows[:14], rows[14:28], rows[28:])):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")

    def run(checkpoint, upto):
        paths = f"{tmp_path}/in/" + "{" + ",".join(map(str, range(upto))) + "}"
        stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(paths)
        out = patients.number_stream(stream, "patient", "day", "note_id")
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out-{checkpoint}").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination()
        return rocks.read.parquet(f"{tmp_path}/out-{checkpoint}")

    want = brute(rows)
    whole = run("a", 3)
    assert tokens(whole) == want and set(whole.columns) >= {"extra", "masked_text", "text", "spans"}
    twin = patients.number_notes(rocks.createDataFrame(rows, SCHEMA), "patient", "day", "note_id")
    assert {r.note_id: r.masked_text for r in whole.collect()} == {r.note_id: r.masked_text for r in twin.collect()}
    run("b", 2)
    assert tokens(run("b", 3)) == want  # a query that stopped and went on


def test_what_moves_is_short(spark):
    """Spans move as two digests and a place, and a repeated note's are not told apart by a shuffle of all spans."""
    df = spark.createDataFrame(notes(), SCHEMA)
    plan = patients.number_notes(df, "patient", "day", "note_id")._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 6
    twice = patients.number_notes(df.union(df), "patient", "day", "note_id")
    assert twice.count() == 2 * df.count() and tokens(twice) == brute(notes())
