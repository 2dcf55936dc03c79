import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.spans import find_spans, matches
from maskwright.operators import detect

#: Category vectors: text, category, what is found.
VECTORS = [
    ("SSN: 123-45-6789", "SSN", "123-45-6789"), ("MRN: 884-9102-X.", "MRN", "884-9102-X"), ("Phone: 617-555-0144 ext 12", "PHONE", "617-555-0144 ext 12"), ("call (555) 234-5678", "PHONE", "555) 234-5678"),
    ("Fax: 617-555-0199", "FAX", "617-555-0199"), ("mail jane.doe@x-y.org now", "EMAIL", "jane.doe@x-y.org"), ("from 192.168.10.255", "IP", "192.168.10.255"), ("see https://a.b/c?d=1 x", "URL", "https://a.b/c?d=1"),
    ("MBI 1EG4-TE5-MK73", "HEALTHPLAN", "1EG4-TE5-MK73"), ("Policy # ABC12345", "HEALTHPLAN", "ABC12345"), ("HAR: 12345678", "ACCOUNT", "12345678"), ("NPI: 1982736450", "NPI", "1982736450"), ("DEA: AB1234567", "LICENSE", "AB1234567"),
    ("State License: MD-99812", "LICENSE", "MD-99812"), ("VIN: 1HGCM82633A004352", "VEHICLE", "1HGCM82633A004352"), ("Serial Number: PM-88231", "DEVICE", "PM-88231"), ("Fingerprint ID: FP-2231", "BIOMETRIC", "FP-2231"),
    ("Image: scan_face.jpg", "PHOTO", "scan_face.jpg"), ("Specimen ID: S23-1182", "ACCESSION", "S23-1182"), ("lives at 12 Oak Street", "ADDRESS", "12 Oak Street"), ("zip 02115-1234", "ZIP", "02115-1234"),
    ("in Cook County", "COUNTY", "Cook County"), ("near Springfield", "CITY", "Springfield"), ("at Mercy General Hospital", "HOSPITAL", "Mercy General Hospital"), ("on 10/14/2023", "DATE", "10/14/2023"), ("a 94-year-old man", "AGE", "94-year-old"),
    ("PATIENT: Ann Lee | x", "PATIENT", "Ann Lee"), ("Mrs. Lee has pain", "PATIENT", "Lee"), ("ATTENDING: James Fox (x)", "PROVIDER", "James Fox"), ("Dr. Fox, MD", "PROVIDER", "Dr. Fox, MD"), ("Mother: Eva Lee.", "FAMILY", "Eva Lee"), ("her son Tom Lee", "FAMILY", "Tom Lee"),
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.spans for r in detect.detect(df).collect()}


def test_every_category(spark):
    got = found(spark, [t for t, _, _ in VECTORS])
    for i, (text, category, value) in enumerate(VECTORS):
        hits = [(s.category, s.text) for s in got[i]]
        assert (category, value) in hits, (text, hits)
        assert all(text[s.start : s.end] == s.text for s in got[i] if s.category != "HOSPITAL")


def test_what_isnt_found(spark):
    got = found(spark, ["", None, "  ", "no identifiers here", "95 mg daily, BP 190/95 yo", "Mr. Boston left", "26 years old", "phone 1234"])
    assert not any(got[i] for i in (0, 1, 2, 3, 6, 7))
    assert not [s for s in got[4] if s.category == "AGE"]
    assert not [s for s in got[5] if s.category == "CITY"]


@pytest.mark.parametrize("p", [p for p in P.STRUCTURED if p.kind == "whole"] + [P.DATE, P.GPS], ids=lambda p: p.name)
def test_offsets_equal_python(spark, p):
    """Patterns without groups give what Python's re gives, among accents and other scripts."""
    bits = ["123-45-6789", "é", "10.0.0.1", "a@b.co", "字", "\U0001f600", "May 3, 2020", "5 Elm St", "12345", "\xa0", "http://x.y", "2001:db8:0:0:0:0:0:1", "1EG4TE5MK73", "41.123, -71.456", "\n", "\ufdd0a\ufdd1"]
    texts = [sep.join(bits[i:] + bits[:i]) for sep in (" ", "é", "") for i in range(len(bits))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [(s.start, s.end, s.text) for s in r.s] for r in df.select("i", find_spans(F.col("text"), p).alias("s")).collect()}
    own = re.compile(p.regex, re.I if p.ignore_case else 0)
    assert got == {i: [(m.start(), m.end(), m.group()) for m in own.finditer(t)] for i, t in enumerate(texts)}


def test_gates_never_lose_a_match(spark):
    """Detectors find the same with and without the search for fixed strings before them."""
    texts = [t for t, _, _ in VECTORS] + ["ſn: abcd12", "Kg"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({"__low": F.lower("text"), "__digit": F.col("text").rlike(r"\p{Nd}")})
    every = [p for p in vars(P).values() if isinstance(p, P.Pattern) and p.kind != "city"]
    pairs = df.select(*[F.struct(find_spans(F.col("text"), p).alias("a"), detect.find_spans(F.col("text"), p).alias("b")).alias(p.name) for p in every]).collect()
    assert all(x.a == x.b for r in pairs for x in r)
    assert {p.name for p in every} - {"provider_titled"} | {"city_state_zip"} == set(P.NEEDS)


def test_column_as_pattern(spark):
    r = spark.createDataFrame([("aXbxc", "(?i)x")], "t string, p string").select(matches(F.col("t"), F.col("p")).alias("m")).first()
    assert [(x.at, x.m) for x in r.m] == [(1, "X"), (3, "x")]


def test_custom_patterns_and_threshold(spark):
    df = spark.createDataFrame([("code ZX-1 on 10/14/2023",)], "text string")
    got = detect.detect(df, custom={"CODE": r"ZX-\d"}, threshold=0.98).first().spans
    assert ("CODE", "ZX-1") in [(s.category, s.text) for s in got] and all(s.confidence >= 0.98 for s in got)
