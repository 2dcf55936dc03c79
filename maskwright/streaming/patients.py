"""One numbering of tokens for each patient, across notes: a name that comes again in a later note gets the token it had.

`number_notes` does it for a table, `number_stream` for a stream, with a patient's tokens as keyed state that expires; notes that
come in order get the same tokens from both. Rules within a note are `mask.allocate`'s: equal texts, but for case, of a category share a token, tokens count up by
category as they first come, and dates that move are DATE. Of custom tokens (ages of ninety and more), a patient's first text gets the
token itself, further ones are numbered from 2.

Defined results: notes go by `order`, then by note id, then by place; a null patient is a patient of its own; null or empty spans give an empty array and the
text as it is; a table's rows that repeat a note are notes of their own, numbered alike. An empty table gives no rows. Column names that begin with `__` are
reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.spans import let, strip
from ..operators.mask import splice, token_category

#: Milliseconds after which a token that no note has used is forgotten.
EXPIRES = 400 * 24 * 3600 * 1000


def _keys(spans: Column) -> Column:
    """What numbers depend on, of each span: key, counter, custom token."""

    def one(s: Column) -> Column:
        custom = F.coalesce(s["custom_token"], F.lit(""))
        category = F.when((custom == "") & s["shifted_text"].isNotNull(), "DATE").otherwise(F.upper(s["category"]))
        return F.struct(F.concat(category, F.lit(":"), F.lower(strip(s["text"]))).alias("key"), F.when(custom != "", custom).otherwise(token_category(category)).alias("counter"), (custom != "").alias("custom"))

    return F.transform(spans, one)


def _token(counter: Column, custom: Column, n: Column) -> Column:
    """[PATIENT_2]; of custom tokens [AGE_90+], [AGE_90+_2]."""
    bare = F.regexp_replace(counter, r"^\[|\]$", "")
    return F.concat(F.lit("["), bare, F.when(custom & (n == 1), "").otherwise(F.concat(F.lit("_"), n.cast("string"))), F.lit("]"))


def number_notes(notes: DataFrame, patient: str, order: str, note_id: str, spans: str = "spans", text: str | None = "text") -> DataFrame:
    """notes with `tokens`, one for each of its resolved spans, and masked_text (if text is given). A patient's distinct originals are numbered, not their
    occurrences; a patient with a large share of all notes costs one task only what that patient has of distinct originals."""
    # Notes alike in all that bears on tokens get the same ones, so a digest tells notes apart well enough, and it is the same in every part of the plan.
    # What moves with each span is short: two digests of 16 bytes and its place.
    digest = lambda *of: F.substring(F.unhex(F.sha2(F.to_json(F.struct(*of)), 256)), 1, 16)
    notes = notes.withColumn("__note", digest(patient, order, note_id, spans))
    from_notes = notes.select("__note", F.col(patient).alias("__patient"), F.struct(F.col(order).alias("at"), F.col(note_id).alias("id")).alias("__at"), F.posexplode_outer(_keys(F.col(spans))).alias("__place", "__key"))
    every = from_notes.where("__key is not null").select("__note", "__patient", "__place", "__key.*", F.struct("__at", "__place").alias("__first"))
    first = every.groupBy("__patient", "key", "counter", "custom").agg(F.min("__first").alias("__first"))
    number = F.row_number().over(W.partitionBy("__patient", "counter", "custom").orderBy("__first", "key"))
    of = digest("__patient", "key", "counter", "custom").alias("__of")
    given = first.select(of, _token(F.col("counter"), F.col("custom"), number).alias("__token"))
    tokens = every.select("__note", "__place", of).join(given, "__of").groupBy("__note").agg(F.array_sort(F.collect_set(F.struct("__place", "__token"))).alias("__tokens"))  # a note's spans, which came in one row; of a repeated note's once
    out = notes.join(tokens, "__note", "left").withColumn("tokens", F.coalesce(F.col("__tokens.__token"), F.array().cast("array<string>"))).drop("__note", "__tokens")
    return out if text is None else _masked(out, text, spans)


def _masked(df: DataFrame, text: str, spans: str) -> DataFrame:
    none = F.coalesce(F.size(spans), F.lit(0)) <= 0
    raw = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("masked_text", F.when(none, raw).otherwise(splice(raw, F.col(spans), F.col("tokens"))))


class _Patient(StatefulProcessor):
    """A patient's tokens by key, and the last number of each counter."""

    def __init__(self, expires: int | None) -> None:
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getMapState("given", "key string", "token string", self.expires)
        self.last = handle.getMapState("last", "counter string", "n long", self.expires)

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        notes = pd.concat(list(rows)).set_axis(["patient", "at", "asked", "row"], axis=1).sort_values("at", kind="stable")  # what one trigger brings of one patient
        out = []
        for asked in notes["asked"]:
            tokens = []
            for x in asked:
                mark = (f"{x['counter']}|{x['key']}",)
                if self.given.containsKey(mark):
                    (token,) = self.given.getValue(mark)
                else:
                    count = (x["counter"],)
                    n = (self.last.getValue(count)[0] if self.last.containsKey(count) else 0) + 1
                    bare = x["counter"].removeprefix("[").removesuffix("]")
                    token = f"[{bare}]" if x["custom"] and n == 1 else f"[{bare}_{n}]"
                    self.last.updateValue(count, (n,))
                self.given.updateValue(mark, (token,))  # used, so it stays
                tokens.append(token)
            out.append(tokens)
        yield pd.DataFrame({"__row": notes["row"], "tokens": out})

    def close(self) -> None:
        pass


def number_stream(notes: DataFrame, patient: str, order: str, note_id: str, spans: str = "spans", text: str | None = "text", expires: int | None = EXPIRES) -> DataFrame:
    """`number_notes` on a stream of notes. The state, by patient, is in the query's checkpoint, so a query that starts again goes on where it stopped; a
    token is forgotten `expires` milliseconds after its last use (None: never). The session's state store has to be the RocksDB one; a query that expires tokens and is
    to end by itself needs spark.sql.streaming.noDataMicroBatches.enabled false, since Spark else goes on with empty batches."""
    place = F.to_json(F.struct(F.date_format(F.col(order), "yyyyMMddHHmmssSSSSSS").alias("at")) if isinstance(notes.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.struct(F.lpad(F.col(order).cast("string"), 20, "0").alias("at")))
    at = F.concat(place, F.lit("|"), F.lpad(F.col(note_id).cast("string"), 20, "0"))
    asked = F.coalesce(_keys(F.col(spans)), F.array().cast("array<struct<key:string,counter:string,custom:boolean>>"))
    key = F.coalesce(F.concat(F.lit("="), F.col(patient).cast("string")), F.lit("null"))
    rows = notes.select(key.alias("__patient"), at.alias("__at"), asked.alias("__asked"), F.to_json(F.struct(*notes.columns), {"ignoreNullFields": "false"}).alias("__row"))
    out = rows.groupBy("__patient").transformWithStateInPandas(_Patient(expires), "__row string, tokens array<string>", "Append", "None" if expires is None else "ProcessingTime")
    out = out.select(F.from_json("__row", notes.schema).alias("__row"), "tokens").select("__row.*", "tokens")
    return out if text is None else _masked(out, text, spans)
