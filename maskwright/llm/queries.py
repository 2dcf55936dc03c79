"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, langid, licenses, lm, mixing, negatives, phrases, setsketch, simhash, suffix, tokens
from .common import crc_mod


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. Further batches delete those labelled toxic, insert them with estimates and revise these."""
    return tokens.token_counts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").where("toxic = 1"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_join("item_ids", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def decontam_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which the first and the third word of a benchmark item stand within five words of each other."""
    w = decontam.words(F.col("text"))
    items = _read(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(2))).alias("text"))
    return decontam.near_items(_read(spark, sf_dir, "documents"), items, 5).select("doc_id", "item_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_slot", "mix_rank", "in_mix")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    out = langid.identify(docs, langid.train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    # format_trees leaves rows without a conversation out; here they are one, as in the SQL.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    out = chat.format_trees(chat.as_trees(rows.withColumn("conv_id", key)))
    out = out.withColumn("conv_id", F.when(F.col("conv_id") != "null", F.expr("substring(conv_id, 2)")).cast(rows.schema["conv_id"].dataType))
    turns = chat.read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    out = lm.score(_read(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_groups(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_suffix_dedup, op4_mix_sources, op5_exact_dedup, op6_language_id, op7_license_scan, op8_chat_format, op9_simhash, op10_lm_score, op11_hard_negatives, op12_collocations, op13_setsketch, decontam_proximity)}

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(list_slice(w, s, s + 9), ' ') AS g FROM n),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
grams AS (SELECT doc_id, p, l, array_to_string(list_slice(w, p, p + l - 1), ' ') AS g FROM pos, (SELECT DISTINCT l FROM win) WHERE p + l - 1 <= len(w)),
m AS (SELECT DISTINCT doc_id, p, grams.l, item_id FROM grams JOIN win ON grams.g = win.g AND grams.l = win.l),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

_PROXIMITY = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, w[1] AS x, coalesce(w[3], w[1]) AS y FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT x FROM q UNION SELECT y FROM q))
SELECT DISTINCT m.doc_id, item_id FROM q JOIN p m ON m.word = q.x JOIN p n ON n.doc_id = m.doc_id AND n.word = q.y AND abs(m.i - n.i) <= 5"""

_OP5 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = rf"""regexp_replace(lower(coalesce({text}, '')), '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright[^\p{{L}}\n]*[0-9©(][^\n]*|(?:©|\(c\))[^\n]*|all rights reserved[^\p{{L}}\p{{N}}\n]*)$', ' ', 'g')"""
    out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"
    for a, b in licenses.SPELLINGS.items():
        spaced = a.replace(" ", "  ")
        out = f"replace({out}, ' {spaced} ', ' {b} ')"
    return f"trim(replace({out}, '  ', ' '))"


_OP7 = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in sorted(licenses.KNOWN.items()))}),
k AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
d AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN k USING (digest)"""


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\s')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\e{c[1:]}')"
    return out


_OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_escaped_sql("role")}) + length({_escaped_sql("t")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

_OP12 = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM p)),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
f AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS a FROM spot, range(1, 6) AS r(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM spot GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM c),
cut AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(list_slice(k.w, 1, k.k), ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(list_slice(k.w, k.k + 1, len(k.w)), ' ') JOIN n ON n.lang = k.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase FROM (SELECT lang, a, w, m, s, unnest(range(1, m - s + 2)) AS i FROM c, range(2, 5) AS q(s) WHERE s < m)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN part USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER w <= 2000"""

_OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, g FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
c AS (SELECT doc_id AS id, doc_id AS near FROM documents UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.near)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(near) AS component_id FROM c GROUP BY id) AS m USING (doc_id)"""

ORACLES = {"decontam_proximity": _PROXIMITY, "op11_hard_negatives": _OP11, "op12_collocations": _OP12, "op13_setsketch": _OP13, "op2_decontaminate": _OP2, "op5_exact_dedup": _OP5, "op7_license_scan": _OP7, "op8_chat_format": _OP8}
