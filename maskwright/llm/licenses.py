"""License scans by canonical digest lookup.

A text in canonical form is in lower case, without copyright lines, with one spelling for
words that are spelt in several ways, and with each run of other characters than letters and
digits as one blank. Its SHA-256 is joined to the digests of the known licences' canonical
forms; the two are equal where the whole texts are.

Defined results: a null text counts as empty; a text without a word has the digest of the
empty string and matches nothing; repeated rows give a row each; known texts that share a
canonical form give one row with the smallest id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table
from .license_texts import KNOWN

#: Spellings that licence matching treats as one (left becomes right).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "behaviour": "behavior", "calibre": "caliber",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "copyright owner": "copyright holder",
    "emphasise": "emphasize", "favour": "favor", "fulfil": "fulfill", "honour": "honor", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "sub license": "sublicense", "signalling": "signaling", "utilisation": "utilization", "while": "whilst",
    "wilful": "willful",
}


def canonical(text: Column) -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\n]*[0-9©(][^\n]*|(?:©|\(c\))[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$", " ")
    # Two blanks between words, so that each word has its own blank on either side.
    text = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for a, b in SPELLINGS.items():
        text = F.replace(text, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text of the licences that come with this package."""
    return spark.createDataFrame(sorted(KNOWN.items()), "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: id, digest, license_id (null if its text is no known licence)."""
    digests = known.select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''")
    digests = table(digests.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id")), "digests")
    rows = docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest"))
    return rows.join(bounded(digests), "digest", "left").select(id_col, "digest", "license_id")
