"""The registered queries of the de-identification operators and their DuckDB counterparts.

`notes` are one synthetic clinical note an order, the same in both engines. Counterparts are
written from the notes' template or from the patterns' RE2 form, not from the operators' code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import brackets, dates, eponyms
from .functions import patterns as P
from .functions.spans import find_spans, matches
from .operators import baselines, detect, labels, mask, metrics, mock_llm, resolve
from .plans import evaluate, gateway
from .plans.deidentify import deidentify
from .sources import notes as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAMES = ["Eleanor Vance", "Arthur Pendelton", "Robert Henderson", "Sarah Connor", "Jonathan Archer", "Clara Bell", "Marcus Welby"]
DOCTORS = ["Parkinson", "Whipple", "Crohn", "Hodgkin", "Babinski"]


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _spread(df: DataFrame) -> DataFrame:
    """Small tables come in one piece; their rows are dealt to all cores. Larger ones stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _spread(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)
    day = F.col("o_orderdate")
    parts = {
        "name": pick(NAMES, F.col("o_custkey") % 7),
        "dob": F.date_format(day, "MM/dd/yyyy"),
        "mrn": F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")),
        "doctor": pick(DOCTORS, F.col("o_orderkey") % 5),
        "phone": F.concat(F.lit("617-555-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")),
        "age": (60 + F.col("o_custkey") % 45).cast("string"),
        "visit": F.date_format(day, "yyyy-MM-dd"),
    }
    text = F.concat(F.lit("PATIENT: "), "name", F.lit(" | DOB: "), "dob", F.lit(" | MRN: "), "mrn", F.lit("\nATTENDING: Dr. "), "doctor", F.lit(", MD (Phone: "), "phone", F.lit(")\nHISTORY: "), "age", F.lit("-year-old with Parkinson's disease, seen "), "visit", F.lit(". Exam [Normal]. 25/100 mg TID."))
    return o.select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").cast("string").alias("patient_id"), *[c.alias(k) for k, c in parts.items()]).withColumn("text", text)


NOTES = f"""o AS (SELECT o_orderkey AS note_id, o_custkey::VARCHAR AS patient_id, o_orderdate::DATE AS day, list_extract([{_strings(NAMES)}], (o_custkey % 7)::INT + 1) AS name,
  strftime(o_orderdate, '%m/%d/%Y') AS dob, 'ORD-' || lpad(o_orderkey::VARCHAR, 8, '0') AS mrn, list_extract([{_strings(DOCTORS)}], (o_orderkey % 5)::INT + 1) AS doctor,
  '617-555-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS phone, (60 + o_custkey % 45)::VARCHAR AS age, strftime(o_orderdate, '%Y-%m-%d') AS visit FROM orders),
notes AS (SELECT *, 'PATIENT: ' || name || ' | DOB: ' || dob || ' | MRN: ' || mrn || chr(10) || 'ATTENDING: Dr. ' || doctor || ', MD (Phone: ' || phone || ')' || chr(10) || 'HISTORY: ' || age || '-year-old with Parkinson''s disease, seen ' || visit || '. Exam [Normal]. 25/100 mg TID.' AS text FROM o)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found_sql(table: str, key: str, p: P.Pattern, text: str = "text") -> str:
    """SELECT of key, start, end, text, category for the pattern's matches."""
    r = _quote(p.re2)
    m = f"unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, {r}) AS m, regexp_split_to_array({text}, {r}) AS g, regexp_extract_all({text}, {r}, {1 if p.kind == 'value' else 0}) AS a, regexp_extract_all({text}, {r}, {2 if p.kind == 'value' else 0}) AS b FROM {table} WHERE regexp_matches({text}, {r}))"
    off = "coalesce(list_sum([len(x) for x in list_slice(g, 1, i)]), 0) + coalesce(list_sum([len(x) for x in list_slice(m, 1, i - 1)]), 0)"
    inner = f"SELECT {key}, {off} AS off, m[i] AS m, a[i] AS a, b[i] AS b FROM (SELECT *, {m})"
    if p.kind == "value":
        return f"""SELECT {key}, (off + CASE WHEN b <> '' THEN len(a) ELSE 0 END)::INT AS "start", (off + CASE WHEN b <> '' THEN len(a) + len(b) ELSE len(m) END)::INT AS "end", CASE WHEN b <> '' THEN b ELSE m END AS text, '{p.category}' AS category FROM ({inner})"""
    return f"""SELECT {key}, off::INT AS "start", (off + len(m))::INT AS "end", m AS text, '{p.category}' AS category FROM ({inner})"""


def _rows(df: DataFrame, key: str, spans: Column) -> DataFrame:
    # The outer form: Spark would work the spans out once more to skip rows without any.
    return df.select(key, F.explode_outer(spans).alias("s")).where("s is not null").select(key, "s.start", "s.end", "s.text", "s.category")


def _spans_of(*patterns: P.Pattern) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: _rows(_spread(_read(spark, sf, "documents").select("doc_id", "text")), "doc_id", F.concat(*[find_spans(F.coalesce("text", F.lit("")), p) for p in patterns]))


def _templated(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """o_orderkey, c0, c1...: each order's row of templates by its number, with {n} for the customer's."""
    strings = [tuple(x if isinstance(x, str) else str(x).lower() for x in r) for r in rows]
    known = spark.createDataFrame([(i, *r) for i, r in enumerate(strings)], "k long, " + ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(rows)).alias("k"), F.col("o_custkey").cast("string").alias("n"))
    return orders.join(F.broadcast(known), "k").select("o_orderkey", *[F.replace(f"c{i}", F.lit("{n}"), F.col("n")).alias(f"c{i}") for i in range(len(rows[0]))])  # as many rows as templates


def _templated_sql(rows: list[tuple], columns: dict[str, int], more: str = "") -> str:
    """The same: columns by name and place in the rows."""
    cell = lambda v: _quote(v if isinstance(v, str) else str(v).lower())
    values = ", ".join(f"({i}, {', '.join(map(cell, r))})" for i, r in enumerate(rows))
    names = ", ".join(f"c{i}" for i in range(len(rows[0])))
    chosen = ", ".join(f"replace(c{i}, '{{n}}', o_custkey::VARCHAR){'::BOOLEAN' if isinstance(rows[0][i], bool) else ''} AS {_ident(name)}" for name, i in columns.items())
    return f"SELECT o_orderkey, {chosen}{more} FROM orders JOIN (VALUES {values}) AS t(k, {names}) ON o_orderkey % {len(rows)} = k"


def _ident(name: str) -> str:
    return f'"{name}"'


for _name, _patterns in (("email", [P.EMAIL]), ("ip", [P.IPV4, P.IPV6]), ("phone", [P.PHONE])):
    QUERIES[f"spans_{_name}"] = _spans_of(*_patterns)
    ORACLES[f"spans_{_name}"] = " UNION ALL ".join(_found_sql("documents", "doc_id", p) for p in _patterns)


@query(f"WITH {NOTES} " + " UNION ALL ".join(_found_sql("notes", "note_id", p) for p in [*P.STRUCTURED, P.GPS, P.COUNTY, P.DATE]))
def spans_structured_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector that needs no context, on the notes."""
    df, may = detect.gated(notes(spark, sf_dir), F.col("text"))
    return _rows(df, "note_id", F.concat(*[find_spans(F.col("text"), p, when=may(p)) for p in [*P.STRUCTURED, P.GPS, P.COUNTY, P.DATE]]))


_CONTACTS = [P.PHONE, P.EMAIL, P.IPV4]
_CONTACTS_SQL = " UNION ALL ".join(_found_sql("documents", "doc_id", p) for p in _CONTACTS)


@query(f"""
WITH s AS ({_CONTACTS_SQL}),
f AS (SELECT *, min("start") OVER (PARTITION BY doc_id, category, lower(trim(text))) AS first FROM s),
t AS (SELECT *, '[' || category || '_' || dense_rank() OVER (PARTITION BY doc_id, category ORDER BY first) || ']' AS token, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS prev FROM f),
j AS (SELECT doc_id, string_agg(substring(d.text, prev::INT + 1, "start" - prev) || token, '' ORDER BY "start") AS head, max("end") AS last, count(*)::INT AS entity_count FROM t JOIN documents d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(head || substring(text, last + 1), text, '') AS masked_text, coalesce(entity_count, 0) AS entity_count FROM documents LEFT JOIN j USING (doc_id)""")
def masked_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with phone numbers, e-mail and IP addresses as numbered tokens."""
    df = _read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[find_spans(text, p) for p in _CONTACTS])
    df = df.withColumn("spans", resolve.resolve(F.transform(found, lambda s, i: s.withField("seq", i))))
    return mask.mask(df, "text", "spans").select("doc_id", "masked_text", F.size("entities").alias("entity_count"))


@query()
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with everything the detectors find as tokens."""
    return deidentify(_spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "masked_text", "entity_count", "date_shift_days", "leak_check_passed")


_AGE_SQL = "(age || '-year-old')"


@query(f"""WITH {NOTES} SELECT note_id, 'PATIENT: [PATIENT_1] | DOB: [DATE_1] | MRN: [MRN_1]' || chr(10) || 'ATTENDING: [PROVIDER_1] (Phone: [PHONE_1])' || chr(10) || 'HISTORY: '
  || CASE WHEN age::INT >= 90 THEN '[AGE_90+]' ELSE {_AGE_SQL} END || ' with Parkinson''s disease, seen [DATE_2]. Exam ⟦Normal⟧. 25/100 mg TID.' AS masked_text, true AS leak_check_passed FROM notes""")
def masked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentify(notes(spark, sf_dir), patient_col="patient_id").select("note_id", "masked_text", "leak_check_passed")


@query(f"""WITH {NOTES} SELECT note_id, unnest(['[PATIENT_1]', '[DATE_1]', '[MRN_1]', '[PROVIDER_1]', '[PHONE_1]', '[DATE_2]']) AS token, unnest([name, dob, mrn, 'Dr. ' || doctor || ', MD', phone, visit]) AS original, unnest(['PATIENT', 'DATE', 'MRN', 'PROVIDER', 'PHONE', 'DATE']) AS category FROM notes
UNION ALL SELECT note_id, '[AGE_90+]', {_AGE_SQL}, 'AGE' FROM notes WHERE age::INT >= 90""")
def token_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentify(notes(spark, sf_dir), patient_col="patient_id").select("note_id", F.inline_outer("tokens")).where("token is not null")


def _offset_sql(seed: str, salt: str = dates.SALT) -> str:
    h = f"sha256('{salt}:' || {seed})"
    out = "0"
    for i in range(8):
        out = f"(({out} * 4294967296 + ('0x' || substring({h}, {i * 8 + 1}, 8))::BIGINT) % 700)"
    return f"(CASE WHEN {out} = 350 THEN 137 ELSE {out} - 350 END)::INT"


_STYLES = [("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("MM-dd-yy", "%m-%d-%y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMM yyyy", "%-d %b %Y")]


def _style_sql(style: str) -> str:
    """A month spelt with three letters comes back with three."""
    full = f"strftime(day + delta, '{style}')"
    return f"CASE WHEN len(strftime(day, '%B')) <= 3 THEN strftime(day + delta, '{style.replace('%B', '%b')}') ELSE {full} END" if "%B" in style else full


@query("WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, " + _offset_sql("o_custkey::VARCHAR") + " AS delta FROM orders) "
       + " UNION ALL ".join(f"SELECT o_orderkey, delta AS delta_days, strftime(day, '{b}') AS original, {_style_sql(b)} AS shifted, day + delta AS shifted_date FROM o" for _, b in _STYLES)
       + " UNION ALL SELECT o_orderkey, delta, strftime(day, '%B %Y'), CASE WHEN len(strftime(day, '%B')) <= 4 THEN strftime(make_date(year(day), month(day), 15) + delta, '%b %Y') ELSE strftime(make_date(year(day), month(day), 15) + delta, '%B %Y') END, make_date(year(day), month(day), 15) + delta FROM o")
def date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in six styles, moved by each customer's offset."""
    o = _spread(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).withColumn("delta_days", dates.offset_days(F.col("o_custkey").cast("string")))
    texts = F.array(*[F.date_format("o_orderdate", a) for a, _ in [*_STYLES, ("MMMM yyyy", "")]])
    rows = o.select("o_orderkey", "delta_days", F.explode(texts).alias("original")).withColumn("s", dates.shift_date(F.col("original"), F.col("delta_days")))
    return rows.select("o_orderkey", "delta_days", "original", F.col("s.shifted_text").alias("shifted"), F.col("s.shifted_date").alias("shifted_date"))


@query("SELECT o_custkey, count(*) AS n, (max(o_orderdate::DATE) - min(o_orderdate::DATE))::INT AS days, true AS preserved FROM orders GROUP BY o_custkey")
def interval_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), dates.shift_date(F.date_format("o_orderdate", "yyyy-MM-dd"), dates.offset_days(F.col("o_custkey").cast("string")))["shifted_date"].alias("to"))
    span = lambda c: F.date_diff(F.max(c), F.min(c))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), span("to").alias("days"), (span("to") == span("day")).alias("preserved"))


@query(f"""WITH {NOTES} SELECT note_id, strpos(text, {_AGE_SQL}) - 1 AS "start", {_AGE_SQL} AS text, '[AGE_90+]' AS token FROM notes WHERE age::INT >= 90""")
def age_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes(spark, sf_dir).withColumn("__low", F.lower("text")).select("note_id", F.explode(detect.age_spans(F.col("text"))).alias("s"))
    return found.select("note_id", F.col("s.start").cast("long").alias("start"), "s.text", F.col("s.custom_token").alias("token"))


# Phrase, whether it counts from another event, whether it tells an age of ninety or more.
_PHRASES = [
    ("post-operative day {n}", True, False), ("POD #{n}", True, False), ("{n} days post-op", True, False), ("{n} weeks ago", True, False), ("in {n} weeks", True, False), ("for the past {n} days", True, False), ("every {n} hours", True, False), ("yesterday", True, False),
    ("10/14/2023 {n}", False, False), ("October 2023, {n}", False, False), ("{n} months later", True, False), ("stage {n}", False, False), ("94-year-old {n}", False, True), ("{n}, age 91", False, True), ("turned 92 in {n}", False, True), ("90th birthday {n}", False, True), ("89-year-old {n}", False, False), ("nonagenarian {n}", False, True), ("{n}/100 mg", False, False),
]


@query(_templated_sql(_PHRASES, {"phrase": 0, "relative": 1, "age_90": 2}))
def relative_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _templated(spark, sf_dir, _PHRASES).withColumnRenamed("c0", "phrase")
    return rows.select("o_orderkey", "phrase", dates.is_relative(F.col("phrase")).alias("relative"), dates.is_age_90(F.col("phrase")).alias("age_90"))


@query(f"WITH {NOTES} SELECT note_id, replace(text, '[Normal]', '⟦Normal⟧') AS escaped, text AS restored FROM notes")
def bracket_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).withColumn("escaped", brackets.escape_brackets(F.col("text"))).select("note_id", "escaped", brackets.unescape_brackets(F.col("escaped")).alias("restored"))


_BRACKETS = [("a [x{n}] b", "a ⟦x{n}⟧ b"), ("[PATIENT_{n}] [{n}]", "[PATIENT_{n}] ⟦{n}⟧"), ("[Patient stable]", "[Patient stable]"), ("[ ]", "⟦ ⟧"), ("[age_90+] [Normal]", "[age_90+] ⟦Normal⟧"), ("[patients]", "⟦patients⟧"), ("no {n}", "no {n}")]
_FUZZY = [("[ patient {n} ]", "[PATIENT_{n}]"), ("(DATE_{n})", "([DATE_{n}])"), ("PATIENT_{n} left", "[PATIENT_{n}] left"), ("[age_90+]", "[AGE_90+]"), ("(patient improved)", "[PATIENT_IMPROVED]"), ("[Doctor {n}]", "[PROVIDER_{n}]"), ("(street {n}) [facility_3]", "[ADDRESS_{n}] [HOSPITAL_3]"), ("[STAGE90]", "[AGE_90+]"), ("[AGE 90+]", "[AGE_90+]"), ("[AGE_90+_2]", "[AGE_90+_2]"), ("[Normal]", "[Normal]"), ("[mrn_{n}]", "[MRN_{n}]"), ("plain {n}", "plain {n}")]
_UNKNOWN = [("[PATIENT_{n}] [DATE_9{n}] [DATE_9{n}] [x]", "[DATE_9{n}],[DATE_9{n}]"), ("none {n}", ""), ("[AGE_90+] [MRN_{n}]", "[MRN_{n}]")]


@query(_templated_sql(_BRACKETS, {"t": 0, "escaped": 1}))
def bracket_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templated(spark, sf_dir, _BRACKETS).select("o_orderkey", F.col("c0").alias("t"), brackets.escape_brackets(F.col("c0")).alias("escaped"))


@query(_templated_sql(_FUZZY, {"t": 0, "normal": 1}))
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templated(spark, sf_dir, _FUZZY).select("o_orderkey", F.col("c0").alias("t"), brackets.normalize_tokens(F.col("c0")).alias("normal"))


@query(_templated_sql(_UNKNOWN, {"t": 0, "unknown": 1}))
def hallucinated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _templated(spark, sf_dir, _UNKNOWN).join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    held = F.create_map(F.concat(F.lit("[PATIENT_"), F.col("o_custkey").cast("string"), F.lit("]")), F.lit("a"), F.lit("[AGE_90+]"), F.lit("b"))
    return df.select("o_orderkey", F.col("c0").alias("t"), F.array_join(brackets.unknown_tokens(F.col("c0"), held), ",").alias("unknown"))


# Candidate, before, after, whether it is an eponym.
_EPONYMS = [
    ("Parkinson", "Patient with ", "'s disease", True), ("Parkinson", "Seen by Dr. ", " today", False), ("Whipple", "Underwent ", " procedure", True), ("Dr. Whipple", "by ", " procedure", False),
    ("Crohn", "history of ", " for years", True), ("Crohn", "Attending: ", "'s disease", False), ("Hodgkin", "diagnosed with ", " lymphoma", True), ("Hodgkin", "signed ", ", MD", False),
    ("Babinski", "positive ", " on the left", True), ("Babinski", "friend ", " came", False), ("circle of Willis", "in the ", ".", True), ("Charles McBurney", "with ", " today", False),
    ("McBurney's", "tender at ", " point", True), ("Foley", "placed ", " catheter", True), ("Smith", "the ", " fracture", True), ("Smith", "history of ", ".", False), ("Graves", "classic ", ".", True), ("James Bell, MD", "by ", ".", False), ("Bell", "Mrs. ", " palsy", False),
]


@query(_templated_sql([(a, b + ("" if b else "{n} "), c + " {n}", d) for a, b, c, d in _EPONYMS], {"candidate": 0, "before": 1, "after": 2}, ", c3::BOOLEAN AS eponym"))
def eponym_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _templated(spark, sf_dir, [(a, b + ("" if b else "{n} "), c + " {n}", d) for a, b, c, d in _EPONYMS])
    return rows.select("o_orderkey", F.col("c0").alias("candidate"), F.col("c1").alias("before"), F.col("c2").alias("after"), eponyms.is_eponym(F.col("c0"), F.col("c1"), F.col("c2")).alias("eponym"))


@query(f"""WITH {NOTES}, n AS (SELECT note_id, name, string_split(name, ' ') AS w FROM notes)
SELECT note_id, 9 AS "start", 9 + len(name)::INT AS "end", name AS text, 'heuristics' AS source FROM n
UNION ALL SELECT note_id, 9, 9 + len(w[1])::INT, w[1], 'patient_propagation' FROM n
UNION ALL SELECT note_id, 10 + len(w[1])::INT, 9 + len(name)::INT, w[2], 'patient_propagation' FROM n""")
def name_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(notes(spark, sf_dir).select("note_id", "text")).select("note_id", F.explode_outer("spans").alias("s")).where("s.category = 'PATIENT'")
    return found.select("note_id", "s.start", "s.end", "s.text", "s.source")


@query(f"WITH {NOTES} SELECT 'note' AS kind, note_id AS id, true AS restored FROM notes UNION ALL SELECT 'document', doc_id, true FROM documents")
def rehydrate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked and restored texts equal the originals."""
    one = notes(spark, sf_dir).select(F.lit("note").alias("kind"), F.col("note_id").alias("id"), "text")
    two = _read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    m = deidentify(one.unionByName(two))
    return m.select("kind", "id", (mask.rehydrate(F.col("masked_text"), F.col("token_to_original"), F.col("date_mappings")) == F.col("text")).alias("restored"))


_MAIL_SQL = _found_sql("documents", "doc_id", P.EMAIL)


@query(f"""WITH e AS ({_MAIL_SQL}), d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM e) AND doc_id % 2 = 1 AS leak FROM documents) SELECT round(avg(leak::INT) * 100, 6) AS leak_rate FROM d""")
def leak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses left in the documents of odd number."""
    df = _read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    masked = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", P.EMAIL.java, "[EMAIL]")).otherwise(F.col("text"))
    df = df.withColumns({"gold": find_spans(F.col("text"), P.EMAIL), "masked": masked})
    return metrics.leak_rate(df, "gold", "masked").select(F.round("leak_rate", 6).alias("leak_rate"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three gold spans an order and predictions of them up to six characters late."""
    o = _read(spark, sf_dir, "orders")
    k = (F.col("o_orderkey") % 7).cast("int")
    one = lambda a, b, c: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(c).alias("category"))
    gold = F.array(*[one(F.lit(20 * i), F.lit(20 * i + 5), c) for i, c in enumerate(("NAME_PATIENT", "DATE", "MRN"))])
    predicted = F.array(*[one(F.lit(20 * i) + k, F.lit(20 * i + 5) + k, c) for i, c in enumerate(("PROVIDER", "DATE", "SSN"))])
    return o.select(F.col("o_orderstatus").alias("engine"), gold.alias("gold"), predicted.alias("predicted"))


def _scored_sql(hit: str) -> str:
    return f"""
WITH o AS (SELECT o_orderstatus AS engine, ({hit})::INT AS hit FROM orders),
c AS (SELECT engine, 'NAME_PATIENT' AS category, hit AS tp, 0 AS fp, 1 - hit AS fn FROM o UNION ALL SELECT engine, 'NAME_PROVIDER', 0, 1 - hit, 0 FROM o WHERE hit = 0
  UNION ALL SELECT engine, 'DATE', hit, 1 - hit, 1 - hit FROM o UNION ALL SELECT engine, 'MRN', 0, 0, 1 FROM o UNION ALL SELECT engine, 'SSN', 0, 1, 0 FROM o),
s AS (SELECT engine, category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((engine, category), (engine))),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM s)
SELECT engine, category, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, round(CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0.0 END, 4) AS f2 FROM r"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1", "f2")})


@query(_scored_sql("o_orderkey % 7 < 5"))
def span_metrics_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.span_metrics(_scored(spark, sf_dir), "predicted", "gold", "overlap", ["engine"]))


@query(_scored_sql("o_orderkey % 7 = 0"))
def span_metrics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.span_metrics(_scored(spark, sf_dir), "predicted", "gold", "exact", ["engine"]))


_CATEGORIES = [(n.lower() + " ", name) for name, names in metrics.CANONICAL.items() for n in names] + [("GEO_PLANET{n}", "LOCATION_PLANET{n}"), ("LOCATION_x_{n}", "LOCATION_X_{n}"), ("other{n}", "OTHER{n}")]


@query(_templated_sql(_CATEGORIES, {"category": 0, "normal": 1}))
def category_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templated(spark, sf_dir, _CATEGORIES).select("o_orderkey", F.col("c0").alias("category"), metrics.normalize_category(F.col("c0")).alias("normal"))


_QUANTILES = ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))


@query(f"SELECT event_type, round(avg(value), 6) AS mean, {_QUANTILES}, round(min(value), 6) AS min, round(max(value), 6) AS max, round(count(*) / (sum(value) / 1000), 4) AS notes_per_sec, 0.0::DOUBLE AS tokens_per_sec FROM events GROUP BY event_type")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.latency_stats(_read(spark, sf_dir, "events"), "value", by=["event_type"])
    six = {c: F.round(c, 6) for c in ("mean", "p50", "p90", "p95", "p99", "min", "max")}
    return df.withColumns(six | {"notes_per_sec": F.round("notes_per_sec", 4), "tokens_per_sec": F.col("tokens_per_sec").cast("double")})


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.coalesce(F.max(F.when(F.col("turn") == t, F.col("text"))), F.lit("")).alias(n) for t, n in ((0, "a"), (1, "b"))])
    return c.withColumn("b", F.when(F.col("conv_id") % 3 == 0, F.concat("a", F.lit(" 50 mg"))).otherwise(F.col("b")))


_WORDS_SQL = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"
_UTILITY_SQL = rf"""
WITH c AS (SELECT conv_id, coalesce(max(text) FILTER (turn = 0), '') AS a, coalesce(max(text) FILTER (turn = 1), '') AS b FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, a, CASE WHEN conv_id % 3 = 0 THEN a || ' 50 mg' ELSE b END AS b FROM c),
w AS (SELECT conv_id, {_WORDS_SQL.format("a")} AS x, {_WORDS_SQL.format("b")} AS y FROM p)
SELECT conv_id, 1.0::DOUBLE AS slot_recall, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2 * len(list_intersect(x, y)) / (len(x) + len(y)) WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE 0.0 END, 6) AS token_f1 FROM w"""


@query(_UTILITY_SQL)
def utility_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pairs(spark, sf_dir).select("conv_id", metrics.utility_parts(F.col("a"), F.col("b")).alias("u"))
    return df.select("conv_id", "u.slot_recall", F.round("u.token_f1", 6).alias("token_f1"))


@query()
def utility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.utility(_pairs(spark, sf_dir), "a", "b").select("conv_id", F.round("utility", 6).alias("utility"))


def _baseline_sql(patterns: list[P.Pattern], table: str) -> str:
    every = " UNION ALL ".join(f"SELECT *, {i} AS place FROM ({_found_sql(table, 'note_id', p)})" for i, p in enumerate(patterns))
    return f"""
WITH RECURSIVE {NOTES}, s AS ({every}),
k AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY "start", "start" - "end", place) AS i FROM s),
w AS (SELECT note_id, i, true AS kept, "end" AS last FROM k WHERE i = 1
  UNION ALL SELECT k.note_id, k.i, k."start" >= w.last, CASE WHEN k."start" >= w.last THEN k."end" ELSE w.last END FROM w JOIN k ON k.note_id = w.note_id AND k.i = w.i + 1)
SELECT note_id, "start", "end", text, category FROM k JOIN w USING (note_id, i) WHERE kept"""


@query(_baseline_sql(baselines.REGEX, "notes"))
def regex_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(notes(spark, sf_dir), "note_id", baselines.regex_spans(F.col("text")))


@query(f"""WITH {NOTES} SELECT note_id, 'PATIENT: [PATIENT_1] | DOB: [DATE_2] | MRN: [MRN_1]' || chr(10) || 'ATTENDING: Dr. [PROVIDER_1] (Phone: [PHONE_1])' || chr(10) || 'HISTORY: ' || age || '-year-old with Parkinson''s disease, seen [DATE_1]. Exam [Normal]. 25/100 mg TID.' AS masked_text, true AS restored FROM notes""")
def regex_baseline_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = notes(spark, sf_dir).withColumn("spans", baselines.regex_spans(F.col("text")))
    return baselines.mask_from_end(df, "text", "spans", True).select("note_id", "masked_text", (mask.substitute(F.col("masked_text"), F.col("token_to_original"), False) == F.col("text")).alias("restored"))


# The first of two capitalised words, if it is a common name; the doctor; numbers and dates.
_NER_SQL = " UNION ALL ".join(
    f"""SELECT note_id, (strpos(text, {before}) + len({before}) - 1)::INT AS "start", (strpos(text, {before}) + len({before}) - 1 + len({value}))::INT AS "end", {value} AS text, '{category}' AS category FROM notes{where}"""
    for before, value, category, where in (
        ("'PATIENT: '", "split_part(name, ' ', 1)", "NAME_PATIENT", " WHERE name NOT LIKE 'Marcus%'"), ("'DOB: '", "dob", "DATE", ""), ("'Dr. '", "doctor", "NAME_PATIENT", ""), ("'(Phone: '", "phone", "PHONE", ""), ("'seen '", "visit", "DATE", ""),
    )
)


@query(f"WITH {NOTES} {_NER_SQL}")
def ner_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(notes(spark, sf_dir), "note_id", baselines.ner_spans(F.col("text")))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    token = lambda name, n: F.concat(F.lit(f"[{name}_"), n.cast("string"), F.lit("]"))
    text = F.concat(F.lit("Assessment of "), token("PATIENT", k % 3), F.lit(" by "), token("PROVIDER", k % 5), F.lit("\n\nroutine\n- plan: see "), token("DATE", k % 2), F.lit(" "), token("DATE", k % 4), F.lit("\nref "), token("MRN", k))
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.alias("prompt"))


_PROMPT_SQL = """p AS (SELECT o_orderkey, '[PATIENT_' || o_orderkey % 3 || ']' AS pa, '[PROVIDER_' || o_orderkey % 5 || ']' AS pr, '[DATE_' || o_orderkey % 2 || ']' AS d1, '[DATE_' || o_orderkey % 4 || ']' AS d2, '[MRN_' || o_orderkey || ']' AS m FROM orders)"""


@query(f"""WITH {_PROMPT_SQL} SELECT o_orderkey, 'CLINICAL SUMMARY & ASSESSMENT:' || chr(10) || 'Patient ' || pa || ' was evaluated by ' || pr || ' on ' || d1 || '.' || chr(10) || '- Assessment of ' || pa || ' by ' || pr || chr(10) || '- plan: see ' || d1 || ' ' || d2 || chr(10) || 'Reference Tokens: ' || m AS reply FROM p""")
def mock_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("o_orderkey", mock_llm.reply(F.col("prompt")).alias("reply"))


@query(f"""WITH {_PROMPT_SQL} SELECT o_orderkey, 'CLINICAL QA ANSWER:' || chr(10) || 'The procedure was performed by ' || pr || ' on ' || d1 || ' for patient ' || pa || '. All post-operative monitoring is within normal limits.' AS reply FROM p""")
def mock_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("o_orderkey", mock_llm.reply(F.col("prompt"), "qa").alias("reply"))


@query(f"""WITH {_PROMPT_SQL} SELECT o_orderkey, 'STRUCTURED CLINICAL EXTRACTION:' || list_aggregate([chr(10) || '- Identified Entity: ' || t for t in [pa, pr, d1, d2, m]], 'string_agg', '') AS reply FROM p""")
def mock_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("o_orderkey", mock_llm.reply(F.col("prompt"), "extract").alias("reply"))


@query(f"""WITH {NOTES} SELECT note_id, 'CLINICAL QA ANSWER:' || chr(10) || 'The procedure was performed by Dr. ' || doctor || ', MD on ' || dob || ' for patient ' || name || '. All post-operative monitoring is within normal limits.' AS final_text, true AS leak_check_passed, 6 + (age::INT >= 90)::INT AS entity_count FROM notes""")
def gateway_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked, asked about, restored."""
    return gateway.ask(notes(spark, sf_dir), "Who performed it?").select("note_id", "final_text", "leak_check_passed", "entity_count")


def _phi(by: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, "documents").select(by, F.explode_outer(F.concat(*[find_spans(F.coalesce("text", F.lit("")), p) for p in _CONTACTS])).alias("s")).where("s is not null")
        return df.select(by, "s.category").rollup(by, "category").agg(F.count("*").alias("n"))

    return run, f"WITH s AS ({_CONTACTS_SQL}) SELECT {by}, category, count(*) AS n FROM s JOIN documents USING (doc_id) GROUP BY ROLLUP ({by}, category)"


for _by in ("source", "lang"):
    QUERIES[f"phi_by_{_by}"], ORACLES[f"phi_by_{_by}"] = _phi(_by)


@query("""SELECT o_orderkey, 'Seen ' || strftime(o_orderdate, '%m/%d/%Y') || ' as ' || o_custkey || '.' AS raw_text, 'Seen [DATE_1] as [MRN_1].' AS expected_masked_text, 5 AS date_start, 15 AS date_end, strftime(o_orderdate::DATE + 45, '%m/%d/%Y') AS shifted_date, (19 + len(o_custkey::VARCHAR))::INT AS mrn_end FROM orders""")
def build_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda text, c=None, s=None, f=None: F.struct(text.alias("text"), *[F.lit(x).cast("string").alias(n) for x, n in ((c, "category"), (s, "surrogate"), (f, "format"))])
    segments = F.array(part(F.lit("Seen ")), part(F.date_format("o_orderdate", "MM/dd/yyyy"), "DATE", "[DATE_1]", "MM/dd/yyyy"), part(F.lit(" as ")), part(F.col("o_custkey").cast("string"), "MRN", "[MRN_1]"), part(F.lit(".")))
    df = src.build_notes(_read(spark, sf_dir, "orders").withColumn("segments", segments))
    e = lambda i, x: F.get("entities", F.lit(i))[x]
    return df.select("o_orderkey", "raw_text", "expected_masked_text", e(0, "start").alias("date_start"), e(0, "end").alias("date_end"), e(0, "shifted_date").alias("shifted_date"), e(1, "end").alias("mrn_end"))


@query(f"""WITH r AS (SELECT engine, precision AS p, recall AS r, f1, f2 FROM ({_scored_sql("o_orderkey % 7 < 5")}) WHERE category IS NULL),
m AS (SELECT engine, unnest(['precision', 'recall', 'f1', 'f2']) AS metric, unnest([p, r, f1, f2]) AS value FROM r)
SELECT metric, max(value) FILTER (engine = 'F') AS "F", max(value) FILTER (engine = 'O') AS "O", max(value) FILTER (engine = 'P') AS "P" FROM m GROUP BY metric""")
def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the three groups of orders side by side."""
    return src.comparison(span_metrics_overlap(spark, sf_dir).where("category is null").select("engine", "precision", "recall", "f1", "f2"), names=("F", "O", "P"))


_BIO = [("B-DATE{n} I-DATE{n} O", "0-8 DATE{n} 0.5"), ("O I-DATE B-M{n}", "8-12 M{n} 0.25"), ("B-DATE I-MRN I-MRN", "0-4 DATE 0.75;4-12 MRN 0.25"), ("O O O", "")]


@query(_templated_sql([(t, x) for t, x in _BIO], {"tags": 0, "spans": 1}))
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.array(F.lit(0.75), F.lit(0.5), F.lit(0.25))
    tokens = F.transform(F.split("c0", " "), lambda x, i: F.struct((i * 4).alias("start"), (i * 4 + 4).alias("end"), x.alias("label"), F.get(confidence, i).alias("confidence")))
    show = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(" "), s["category"], F.lit(" "), s["confidence"].cast("string"))
    return _templated(spark, sf_dir, _BIO).select("o_orderkey", F.col("c0").alias("tags"), F.array_join(F.transform(labels.decode(tokens), show), ";").alias("spans"))


@query("SELECT page_id, len(m)::INT AS n_urls FROM (SELECT page_id, regexp_extract_all(html, " + _quote(P.URL.re2) + ") AS m FROM pages)")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.size(matches(F.coalesce("html", F.lit("")), P.URL.java)).alias("n_urls"))


#: One text for each detector: text, category, what is found.
VECTORS = [
    ("SSN: 123-45-6789", "SSN", "123-45-6789"), ("MRN: 884-9102-X.", "MRN", "884-9102-X"), ("Phone: 617-555-0144 ext 12", "PHONE", "617-555-0144 ext 12"), ("Fax: 617-555-0199", "FAX", "617-555-0199"),
    ("mail jane.doe@x-y.org now", "EMAIL", "jane.doe@x-y.org"), ("from 192.168.10.255", "IP", "192.168.10.255"), ("at 2001:db8:0:0:0:0:0:1 now", "IP", "2001:db8:0:0:0:0:0:1"), ("see https://a.b/c?d=1 x", "URL", "https://a.b/c?d=1"),
    ("MBI 1EG4-TE5-MK73", "HEALTHPLAN", "1EG4-TE5-MK73"), ("Policy # ABC12345", "HEALTHPLAN", "ABC12345"), ("HAR: 12345678", "ACCOUNT", "12345678"), ("NPI: 1982736450", "NPI", "1982736450"), ("DEA: AB1234567", "LICENSE", "AB1234567"),
    ("State License: MD-99812", "LICENSE", "MD-99812"), ("VIN: 1HGCM82633A004352", "VEHICLE", "1HGCM82633A004352"), ("Serial Number: PM-88231", "DEVICE", "PM-88231"), ("Fingerprint ID: FP-2231", "BIOMETRIC", "FP-2231"),
    ("Image: scan_face.jpg", "PHOTO", "scan_face.jpg"), ("Specimen ID: S23-1182", "ACCESSION", "S23-1182"), ("lives at 12 Oak Street", "ADDRESS", "12 Oak Street"), ("zip 02115-1234", "ZIP", "02115-1234"), ("in Cook County", "COUNTY", "Cook County"),
    ("near Springfield", "CITY", "Springfield"), ("at Mercy General Hospital", "HOSPITAL", "Mercy General Hospital"), ("on 10/14/2023", "DATE", "10/14/2023"), ("a 94-year-old man", "AGE", "94-year-old"), ("PATIENT: Ann Lee | x", "PATIENT", "Ann Lee"),
    ("Mrs. Lee has pain", "PATIENT", "Lee"), ("ATTENDING: James Fox (x)", "PROVIDER", "James Fox"), ("Dr. Fox, MD", "PROVIDER", "Dr. Fox, MD"), ("Mother: Eva Lee.", "FAMILY", "Eva Lee"), ("her son Tom Lee", "FAMILY", "Tom Lee"),
]


@query(f"""WITH v(k, note, category, found) AS (VALUES {", ".join(f"({i}, {_quote(t)}, '{c}', {_quote(x)})" for i, (t, c, x) in enumerate(VECTORS))})
SELECT c_custkey, category, found AS text, (strpos(note, found) - 1)::INT AS "start", (strpos(note, found) - 1 + length(found))::INT AS "end" FROM customer JOIN v ON c_custkey % {len(VECTORS)} = k""")
def detector_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each customer, one of each detector in turn: the longest span of its category."""
    known = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(VECTORS)], "k long, note string, category string")
    df = _read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(VECTORS)).alias("k")).join(F.broadcast(known), "k")  # as many rows as VECTORS
    own = detect.detect(df, "note").select("c_custkey", F.filter("spans", lambda s: s["category"] == F.col("category")).alias("own"))
    best = F.array_max(F.transform("own", lambda s: F.struct((s["end"] - s["start"]).alias("n"), s["category"].alias("category"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"))))
    return own.select("c_custkey", best.alias("b")).select("c_custkey", "b.category", "b.text", "b.start", "b.end")


@query()
def evaluate_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three engines' scores over the notes, against the identifiers their template puts in."""
    n, parts = notes(spark, sf_dir), [("name", "PATIENT"), ("dob", "DATE"), ("mrn", "MRN"), ("phone", "PHONE"), ("visit", "DATE")]
    at = lambda c: (F.instr(F.col("text"), F.col(c)) - 1).cast("int")
    gold = F.array(*[F.struct(at(c).alias("start"), (at(c) + F.length(c)).cast("int").alias("end"), F.lit(k).alias("category"), F.col(c).alias("text")) for c, k in parts])
    return evaluate.summary(evaluate.runs(n.withColumn("gold", gold), "note_id", "text", "gold", "patient_id"))
