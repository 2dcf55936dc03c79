"""Registered queries of the operators over tables of spans, originals and patients' notes, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .catalog_queries import NOTES, _found_sql, _read, _rounded, _scored, _scored_sql, notes, query
from .functions import patterns as P
from .functions.spans import find_spans
from .operators import gazetteer, leaks, spantables, tagger
from .streaming import patients


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The spans of `_scored` as two tables; an order is a document."""
    df = _scored(spark, sf_dir).withColumn("doc", F.monotonically_increasing_id())
    one = lambda c: df.select("doc", "engine", F.posexplode(c).alias("seq", "s")).select("doc", "engine", "seq", "s.*")
    return one("predicted"), one("gold")


@query(_scored_sql("o_orderkey % 7 < 5"))
def span_tables_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two tables matched by overlap."""
    return _rounded(spantables.table_metrics(*_both(spark, sf_dir), "doc", "seq", "overlap", ["engine"]))


@query(_scored_sql("o_orderkey % 7 = 0"))
def span_tables_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spantables.table_metrics(*_both(spark, sf_dir), "doc", "seq", "exact", ["engine"]))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, n, p, s: the orders of a customer, numbered."""
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), number.alias("n"), F.col("o_orderkey").alias("p"), F.expr("o_orderkey div 7").alias("s"))


@query("""
WITH RECURSIVE l AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS p, o_orderkey // 7 AS s FROM orders),
s AS (SELECT doc, n AS k, 10 * n AS a, 10 * n + 8 AS b, CASE WHEN p % 3 = 0 THEN 'MRN' ELSE 'DATE' END AS c,
  10 * n + p % 13 - 4 AS x, 10 * n + p % 13 - 1 + s % 9 AS y, CASE WHEN s % 5 = 0 THEN 'MRN' ELSE 'DATE' END AS z FROM l),
d AS (SELECT doc, list(struct_pack(k := k, a := a, b := b, c := c) ORDER BY k) AS gold, list(struct_pack(x := x, y := y, z := z) ORDER BY k) AS pred FROM s GROUP BY doc),
w AS (SELECT doc, gold, pred, 1 AS i, [0]::BIGINT[] AS picks FROM d
  UNION ALL SELECT doc, gold, pred, i + 1, list_append(picks, coalesce(list_sort(list_transform(list_filter(gold, lambda g: g.c = pred[i].z AND NOT list_contains(picks, g.k) AND least(g.b, pred[i].y) > greatest(g.a, pred[i].x)),
    lambda g: struct_pack(o := greatest(g.a, pred[i].x) - least(g.b, pred[i].y), k := g.k)))[1].k, 0)) FROM w WHERE i <= len(pred)),
e AS (SELECT doc, gold, pred, picks[2:] AS picks FROM w WHERE i = len(pred) + 1),
r AS (SELECT p.z AS category, (pick > 0)::INT AS tp, (pick = 0)::INT AS fp, 0 AS fn FROM (SELECT unnest(pred) AS p, unnest(picks) AS pick FROM e)
  UNION ALL SELECT g.c, 0, 0, 1 FROM (SELECT unnest(gold) AS g, picks FROM e) WHERE NOT list_contains(picks, g.k))
SELECT category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM r GROUP BY category""")
def span_tables_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that want each other's gold spans: an order gives one of each, a customer is a document."""
    l = _lines(spark, sf_dir)  # noqa: E741
    n = F.col("n")
    side = lambda a, b, mrn: l.select("doc", n.alias("seq"), a.alias("start"), b.alias("end"), F.when(mrn, "MRN").otherwise("DATE").alias("category"))
    gold = side(10 * n, 10 * n + 8, F.col("p") % 3 == 0)
    late = 10 * n + F.col("p") % 13
    found = spantables.match_tables(side(late - 4, late - 1 + F.col("s") % 9, F.col("s") % 5 == 0), gold, "doc")
    return found.groupBy("category").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


@query("""
WITH l AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS p, o_orderkey // 7 AS s FROM orders),
t AS (SELECT doc, n - 1 AS i, 10 * n AS a, 10 * n + CASE WHEN n > 1 AND p % 11 = 0 THEN 0 ELSE 8 END AS b FROM l),
e AS (SELECT doc, n AS seq, 10 * n - 3 + s % 8 AS x, 10 * n + 1 + s % 8 + p % 15 AS y, CASE WHEN p % 2 = 0 THEN 'DATE' ELSE 'MRN' END AS c FROM l WHERE p % 4 <> 3),
f AS (SELECT *, i = 0 OR coalesce(lag(a = b) OVER (PARTITION BY doc ORDER BY i), false) AS first FROM t),
m AS (SELECT doc, i, arg_min(CASE WHEN a >= x AND b <= y AND (a = x OR first) THEN 'B-' ELSE 'I-' END || c, seq) AS label FROM f JOIN e USING (doc) WHERE a < y AND x < b AND a < b AND x < y AND (a >= x OR b <= y) GROUP BY ALL)
SELECT doc, i, CASE WHEN a < b THEN coalesce(label, 'O') END AS label FROM t LEFT JOIN m USING (doc, i)""")
def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tokens by the entities they overlap: a customer's orders as tokens, and other stretches by them as entities."""
    l, n = _lines(spark, sf_dir), F.col("n")  # noqa: E741
    tokens = l.select("doc", (n - 1).alias("i"), (10 * n).alias("start"), (10 * n + F.when((n > 1) & (F.col("p") % 11 == 0), 0).otherwise(8)).alias("end"))
    begin = 10 * n - 3 + F.col("s") % 8
    entities = l.where("p % 4 <> 3").select("doc", n.alias("seq"), begin.alias("start"), (begin + 4 + F.col("p") % 15).alias("end"), F.when(F.col("p") % 2 == 0, "DATE").otherwise("MRN").alias("category"))
    return spantables.label_tokens(tokens, entities, "doc").select("doc", "i", "label")


_ORIGINALS_SQL = f"""o AS (SELECT DISTINCT d.source, trim(s.text) AS value FROM ({_found_sql("documents", "doc_id", P.EMAIL)} UNION ALL {_found_sql("documents", "doc_id", P.PHONE)}) s JOIN documents d USING (doc_id) WHERE len(trim(s.text)) > 2),
m AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, {"'" + P.EMAIL.re2.replace("'", "''") + "'"}, '[EMAIL]', 'g') END AS masked_text FROM documents)"""


def _masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of which two in three have their e-mail addresses masked and none its phone numbers, and what was found in all."""
    df = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    text = F.coalesce("text", F.lit(""))
    spans = F.concat(find_spans(text, P.EMAIL), find_spans(text, P.PHONE))
    originals = df.select("source", F.explode_outer(spans).alias("s")).where("s is not null").select("source", F.col("s.text").alias("original"))
    return df.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.regexp_replace("text", P.EMAIL.java, "[EMAIL]")).alias("masked_text")), originals


@query(f"WITH {_ORIGINALS_SQL} SELECT doc_id, value FROM m JOIN (SELECT DISTINCT value FROM o) v ON contains(masked_text, value)")
def leaks_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers found in any document that stand in a masked one."""
    return leaks.leaks(*_masked(spark, sf_dir), "doc_id").select("doc_id", "value")


@query(f"""WITH {_ORIGINALS_SQL}, h AS (SELECT doc_id, count(*) AS n FROM m JOIN o ON m.source IS NOT DISTINCT FROM o.source AND contains(masked_text, value) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_values, n IS NULL AS leak_free FROM documents LEFT JOIN h USING (doc_id)""")
def leaks_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses and numbers of its own source each masked document holds."""
    return leaks.leak_report(*_masked(spark, sf_dir), "doc_id", group="source").select("doc_id", "n_values", "leak_free")


@query(f"""
WITH {NOTES},
s AS (SELECT note_id, patient_id, day, 0 AS place, 'DATE' AS c, dob AS x FROM notes UNION ALL SELECT note_id, patient_id, day, 1, 'MRN', mrn FROM notes
  UNION ALL SELECT note_id, patient_id, day, 2, 'PROVIDER', doctor FROM notes UNION ALL SELECT note_id, patient_id, day, 3, 'DATE', visit FROM notes),
f AS (SELECT patient_id, c, lower(x) AS x, min(struct_pack(a := day, b := note_id, p := place)) AS first FROM s GROUP BY ALL),
n AS (SELECT patient_id, c, x, '[' || c || '_' || row_number() OVER (PARTITION BY patient_id, c ORDER BY first) || ']' AS token FROM f)
SELECT s.note_id, array_to_string(list(token ORDER BY place), ' ') AS tokens FROM s JOIN n ON n.patient_id = s.patient_id AND n.c = s.c AND n.x = lower(s.x) GROUP BY s.note_id""")
def patient_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numbering of dates, record numbers and providers for each patient, over all notes of theirs in order."""
    n = notes(spark, sf_dir)
    span = lambda i, c, name: F.struct(F.lit(i).alias("seq"), (F.instr("text", F.col(c)) - 1).alias("start"), (F.instr("text", F.col(c)) - 1 + F.length(c)).alias("end"), F.lit(name).alias("category"), F.col(c).alias("text"), F.lit(0.9).alias("confidence"), F.lit("template").alias("source"), F.lit(None).cast("string").alias("shifted_text"), F.lit(None).cast("string").alias("custom_token"))
    n = n.withColumn("spans", F.array(*[span(i, c, k) for i, (c, k) in enumerate((("dob", "DATE"), ("mrn", "MRN"), ("doctor", "PROVIDER"), ("visit", "DATE")))]))
    out = patients.number_notes(n.select("note_id", "patient_id", "visit", "spans"), "patient_id", "visit", "note_id", text=None)
    return out.select("note_id", F.array_join("tokens", " ").alias("tokens"))


def _gold(df: DataFrame) -> DataFrame:
    """notes with gold, the spans of their fields."""
    at = lambda c: F.expr(f"cast(instr(text, {c}) - 1 as int)")
    fields = (("name", "PATIENT"), ("dob", "DATE"), ("mrn", "MRN"), ("doctor", "PROVIDER"), ("phone", "PHONE"), ("visit", "DATE"))
    return df.withColumn("gold", F.array(*[F.struct(at(c).alias("start"), (at(c) + F.length(c)).alias("end"), F.lit(k).alias("category")) for c, k in fields]))


_FIELDS_SQL = " UNION ALL ".join(
    f"""SELECT note_id, (strpos(text, {c}) - 1)::INT AS "start", (strpos(text, {c}) - 1 + len({c}))::INT AS "end", {c} AS text, '{k}' AS category, note_id % 5 = 0 AS held_out FROM notes"""
    for c, k in (("name", "PATIENT"), ("dob", "DATE"), ("mrn", "MRN"), ("doctor", "PROVIDER"), ("phone", "PHONE"), ("visit", "DATE"))
)


@query(f"WITH {NOTES} {_FIELDS_SQL}")
def tagged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a sequence tagger finds in all notes; it learns from four fifths of them."""
    df = _gold(notes(spark, sf_dir)).select("note_id", "text", "gold")
    model = tagger.train(df.where("note_id % 5 <> 0"), "text", "gold", rounds=2)
    found = tagger.tag(df, model, "text", "found").select("note_id", "text", F.explode_outer("found").alias("s")).where("s is not null")  # the outer form: Spark would tag once more to skip notes without any
    return found.select("note_id", "s.start", "s.end", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"), "s.category", F.expr("note_id % 5 = 0").alias("held_out"))


_LISTED = r"[\p{L}\p{M}\p{N}_]+"


@query(rf"""
WITH RECURSIVE t AS (SELECT item_id, regexp_extract_all(text, '{_LISTED}') AS w FROM benchmark WHERE text IS NOT NULL),
names AS (SELECT phrase, min(category) AS category, max(n) AS n FROM (SELECT array_to_string(w[1:k], ' ') AS phrase, 'FIRST_' || k AS category, k AS n FROM t, (VALUES (2), (4)) x(k) WHERE len(w) >= k) GROUP BY phrase),
d AS (SELECT doc_id, regexp_extract_all(text, '{_LISTED}') AS w, regexp_split_to_array(text, '{_LISTED}') AS g FROM documents),
q AS (SELECT doc_id, unnest(w) AS w, unnest(g[:len(w)]) AS g, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT *, sum(len(g) + len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM q),
s AS (SELECT doc_id, i, stop - len(w) AS start, w, lead(w, 1) OVER v AS w1, lead(w, 2) OVER v AS w2, lead(w, 3) OVER v AS w3, lead(g, 1) OVER v AS g1, lead(g, 2) OVER v AS g2, lead(g, 3) OVER v AS g3, stop, lead(stop, 1) OVER v AS e2, lead(stop, 3) OVER v AS e4 FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, start, e2 AS stop, w || regexp_replace(g1, '\s+', ' ', 'g') || w1 AS phrase FROM s WHERE w1 IS NOT NULL UNION ALL SELECT doc_id, start, e4, w || regexp_replace(g1, '\s+', ' ', 'g') || w1 || regexp_replace(g2, '\s+', ' ', 'g') || w2 || regexp_replace(g3, '\s+', ' ', 'g') || w3 FROM s WHERE w3 IS NOT NULL),
f AS (SELECT doc_id, start, max(stop) AS stop, arg_max(phrase, stop) AS phrase, arg_max(category, stop) AS category FROM c JOIN names USING (phrase) GROUP BY doc_id, start),
n AS (SELECT f.*, min(h.start) AS follows FROM f LEFT JOIN f h ON h.doc_id = f.doc_id AND h.start >= f.stop GROUP BY ALL),
r AS (SELECT * FROM n WHERE start = (SELECT min(start) FROM f WHERE f.doc_id = n.doc_id) UNION ALL SELECT n.* FROM r JOIN n ON n.doc_id = r.doc_id AND n.start = r.follows)
SELECT doc_id, start::INT AS "start", stop::INT AS "end", phrase AS text, category FROM r""")
def gazetteer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first two and four words of benchmark items stand in documents, the longer first."""
    words = F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0))
    names = _read(spark, sf_dir, "benchmark").select(words.alias("w")).select("w", F.explode(F.array(F.lit(2), F.lit(4))).alias("k")).where("size(w) >= k")
    names = names.select(F.array_join(F.expr("slice(w, 1, k)"), " ").alias("name"), F.concat(F.lit("FIRST_"), "k").alias("category"))
    return gazetteer.find_names(_read(spark, sf_dir, "documents"), "doc_id", "text", names)
