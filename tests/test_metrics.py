import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import baselines, labels, metrics
from maskwright.sources import notes


def greedy(pred, gold, mode, ok):
    used, out = set(), []
    for a, b, c in pred:
        best = None
        for i, (x, y, d) in enumerate(gold):
            o = min(b, y) - max(a, x)
            if i in used or not ok(c, d):
                continue
            if mode == "exact":
                if (a, b) == (x, y):
                    best = (1, i)
                    break
            elif o > 0 and (best is None or o > best[0]):
                best = (o, i)
        used |= {best[1]} if best else set()
        out.append(bool(best))
    return sum(out), len(out) - sum(out), len(gold) - len(used)


@pytest.mark.parametrize("mode", ["overlap", "exact"])
def test_matching_against_plain_python(spark, mode):
    rng = random.Random(9)
    spans = lambda: [(a, a + rng.randint(1, 8), rng.choice(["DATE", "MRN", "NAME_PATIENT", "NAME_PROVIDER"])) for a in (rng.randint(0, 20) for _ in range(rng.randint(0, 6)))]
    rows = [(i, spans(), spans()) for i in range(80)]
    kind = "array<struct<start:int,end:int,category:string>>"
    got = spark.createDataFrame(rows, f"i int, p {kind}, g {kind}").select("i", metrics.match(F.col("p"), F.col("g"), mode).alias("m")).collect()
    ok = lambda a, b: a == b or ("NAME" in a and "NAME" in b)
    for r in got:
        _, p, g = rows[r.i]
        assert (sum(x.tp for x in r.m), sum(x.fp for x in r.m), sum(x.fn for x in r.m)) == greedy(p, g, mode, ok)


def test_rates(spark):
    rows = [(1, 1, 0, 0.5, 1.0, 0.6667, 0.8333), (0, 0, 0, 1.0, 1.0, 1.0, 1.0), (0, 0, 3, 0.0, 0.0, 0.0, 0.0), (0, 2, 0, 0.0, 1.0, 0.0, 0.0)]
    df = metrics.rates(spark.createDataFrame([r[:3] for r in rows], "tp long, fp long, fn long"))
    assert [(r.tp, r.fp, r.fn, *(round(x, 4) for x in (r.precision, r.recall, r.f1, r.f2))) for r in df.collect()] == rows


def test_compatible_by_part(spark):
    f = lambda a, b: spark.range(1).select(metrics.compatible(metrics.normalize_category(F.lit(a)), metrics.normalize_category(F.lit(b)))).first()[0]
    assert f("DOCTOR", "patient") and f("zip", "GEO_CITY") and f("NAME_PROVIDER", "ACCESSION") and not f("SSN", "MRN")


def test_leaks(spark):
    gold = "array<struct<text:string>>"
    df = spark.createDataFrame([([("Ann Lee",)], "Ann Lee was"), ([("Ann Lee",), ("ab",)], "[P] ab")], f"g {gold}, m string")
    assert metrics.leak_rate(df, "g", "m").first()[0] == 50.0
    assert metrics.leak_rate(df.limit(0), "g", "m").first()[0] == 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_utility(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))
    rows = [(text(), text()) for _ in range(40)] + [("a", "a "), ("", ""), (None, "x"), ("50 mg", "50 mg daily"), ("50 mg", "10 mg")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(metrics.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [lcs((a or "").split(), (b or "").split()) for a, b in rows]
    scores = {(r.a, r.b): r.utility for r in metrics.utility(df, "a", "b").collect()}
    assert scores["a", "a "] == scores["", ""] == 1.0 and scores[None, "x"] == 0.0
    assert scores["50 mg", "50 mg daily"] == pytest.approx(0.4 + 0.4 * 4 / 5 + 0.2 * 2 / 3) and scores["50 mg", "10 mg"] == pytest.approx(0.4 * 2 / 4 + 0.2 * 0.5)


def test_latency(spark):
    values = [10.0, 12.5, 15.0, 18.0, 22.0, 25.0, 30.0, 45.0, 60.0, 90.0]
    r = metrics.latency_stats(spark.createDataFrame([(v,) for v in values], "x double"), "x", tokens=F.lit(100)).first()
    assert r.p50 == 23.5 and r.p95 == pytest.approx(76.5) and r.min == 10 and r.notes_per_sec == pytest.approx(10 / 0.3275)


def test_baselines(spark):
    text = "PATIENT: Ann Lee | MRN: ABC12345 | 10/14/2023, 10/14/2023\nDr. James Fox, MD saw a 94 year old in Boston, MA. SSN 123-45-6789, 02115"
    df = spark.createDataFrame([(text,), ("",)], "text string")
    for spans, old in ((baselines.regex_spans, True), (baselines.ner_spans, False)):
        out = baselines.mask_from_end(df.withColumn("s", spans(F.col("text"))), "text", "s", old)
        from maskwright.operators.mask import substitute

        rows = out.withColumn("back", substitute(F.col("masked_text"), F.col("token_to_original"), False)).collect()
        assert all(r.back == r.text for r in rows)
        assert rows[0].masked_text.count("[DATE_1]") == 2 and "123-45-6789" not in rows[0].masked_text
    assert "[AGE_90+]" not in rows[0].masked_text


def test_labels(spark):
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([([(0, 0), (0, 3), (3, 6), (7, 9), (9, 12)], [(0, 6, "DATE"), (8, 10, "MRN")])], f"t {kind}, e array<struct<start:int,end:int,category:string>>")
    assert df.select(labels.encode(F.col("t"), F.col("e"))).first()[0] == [None, "B-DATE", "I-DATE", "I-MRN", "I-MRN"]
    assert labels.find_card("RoBERTa_base") == "roberta-base" and labels.find_card("none") == "deberta-v3-base"


def test_sources(spark, tmp_path):
    note = {"test_case_id": "t1", "specialty": "s", "note_type": "n", "adversarial_tags": ["a"], "raw_text": "x", "entities": [], "expected_masked_text": "x", "date_shift_days": 45}
    import json

    (tmp_path / "c.json").write_text(json.dumps([note, note], indent=2))
    (tmp_path / "d.json").write_text(json.dumps({"clinical_note": "é1\nline"}))
    (tmp_path / "e.txt").write_text("plain\ntext")
    (tmp_path / "f.json").write_text("not json")
    assert notes.read_corpus(spark, str(tmp_path / "c.json")).count() == 2 and notes.read_corpus(spark, [note]).first().test_case_id == "t1"
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in notes.read_texts(spark, [str(tmp_path / n) for n in ("d.json", "e.txt", "f.json")]).collect()}
    assert got == {"d.json": "é1\nline", "e.txt": "plain\ntext", "f.json": "not json"}
    assert notes.split_notes(["a", "b", "", "", "c"]) == ["a\nb", "c"]
    notes.write_json(spark.range(3), str(tmp_path / "out"))
    assert notes.read_table(spark, str(tmp_path / "out"), "json").count() == 3
    table = notes.comparison(spark.createDataFrame([("regex", 0.5), ("core", 1.0)], "engine string, recall double"))
    assert notes.markdown(table).splitlines()[-1] == "| recall | 0.5000 |  | 1.0000 |"
