"""Originals that stand in masked texts, across rows: none of a patient's originals in any text of theirs, or none of a batch's in any of its texts.

`metrics.has_leak` and `mask.leak_free` look for a row's originals in that row. Here originals and texts are two tables of any size, joined
without pairing each with each. Every original is known by its length and a hash; a text's hash of any stretch follows from running sums, so all
places of a text are tried at once, length by length, against a bitmap of fixed size of the originals' hashes. What passes is
taken as text and joined to the originals by equality, which settles it.

Defined results: an original is taken without white space at its ends and counts from LEAST characters on; null texts and originals hold nothing; a
null group is a group of its own; texts and originals that repeat give a row for each text; an empty table gives no rows. Very long texts are searched whole,
PIECE characters at a time. Case counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import strip

#: Characters from which an original counts, bits of the bitmap (8 MB) and characters of a text tried at a time.
LEAST, BITS, PIECE = 3, 26, 1 << 18

_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sums:
    """Hashes of all stretches of a text."""

    def __init__(self, text: str, most: int) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(codes)
        up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(0, self.n - 1), _ODD, np.uint64))))[: self.n]
        self.down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(0, self.n - 1), pow(_ODD, -1, 2**64), np.uint64))))[: self.n]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up)))

    def of(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """The hash of the stretch of the length at each place, or at the places given."""
        at = np.arange(self.n - length + 1) if at is None else at
        return _mix((self.sums[at + length] - self.sums[at]) * self.down[at] ^ np.uint64(length))


def _hashes(values: DataFrame) -> DataFrame:
    """length, hash, start of each original (value): start is the hash of its first LEAST characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(v), _Sums(v, 0)) for v in batch.column(0).to_pylist()]
            key = np.array([x.of(n, np.zeros(1, np.int64))[0] for n, x in found], np.uint64)
            start = np.array([x.of(LEAST, np.zeros(1, np.int64))[0] for _, x in found], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array(key.view(np.int64)), pa.array(start.view(np.int64))], ["length", "hash", "start"])

    return values.mapInArrow(run, "length int, hash long, start long")


def bitmap(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A set of 64-bit hashes as 2^bits bits: fixed size, whatever the number of hashes."""
    at = F.expr(f"({column} & {2**bits - 1}L) + 1")
    parts = keys.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = np.zeros(2**bits // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most 2^bits / 32768 rows of 4 KB
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def occurrences(texts: DataFrame, values: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, value, at: where values stand in texts, every place of each. values: a table of distinct strings (value) of LEAST characters
    or more, which is read three times."""
    known = _hashes(values).persist()  # three numbers an original
    starts, whole = bitmap(known, "start"), bitmap(known, "hash")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # no more than the longest original has characters
    known.unpersist()
    shared = texts.sparkSession.sparkContext.broadcast((starts, whole, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, every, sizes = shared.value
        over = sizes[-1] - 1 if sizes else 0
        for batch in batches:
            rows, found, places = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for begin in range(0, len(text) if sizes else 0, PIECE):
                    piece = text[begin : begin + PIECE + over]
                    if len(piece) < LEAST:
                        continue
                    sums = _Sums(piece, over)
                    may = np.flatnonzero(held(first, sums.of(LEAST)))
                    may = may[may < PIECE]
                    for n in sizes:
                        at = may[may + n <= len(piece)]
                        for x in at[held(every, sums.of(n, at))].tolist():
                            rows.append(i)
                            found.append(piece[x : x + n])
                            places.append(begin + x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int64())], [id_col, "value", "at"])

    kind = texts.schema[id_col].dataType.simpleString()
    some = texts.where(F.length(text_col) >= LEAST).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, value string, at long")
    return some.join(values.select("value"), "value", "left_semi").select(id_col, "value", "at")


def leaks(masked: DataFrame, originals: DataFrame, id_col: str, masked_col: str = "masked_text", original_col: str = "original", group: str | None = None) -> DataFrame:
    """id, value, n of the originals that stand in masked texts and how often: those of the same `group` (a patient, say), a column of both
    tables, or with None of any row. Rows of masked with one id count as one text."""
    values = originals.select(*([F.col(group).alias("__group")] if group else []), strip(F.col(original_col)).alias("value")).where(F.length("value") >= LEAST).distinct()
    if group is None:
        return occurrences(masked, values, id_col, masked_col).groupBy(id_col, "value").agg(F.count("*").alias("n"))
    row = masked.select(F.struct(F.col(id_col).alias("id"), F.col(group).alias("of")).alias("__row"), masked_col)
    # Each distinct value once, whatever the number of groups that have it; the group is settled by the join.
    found = occurrences(row, values.select("value").distinct(), "__row", masked_col).groupBy("__row", "value").agg(F.count("*").alias("n"))
    found = found.select(F.col("__row.id").alias(id_col), F.col("__row.of").alias("__of"), F.col("value").alias("__value"), "n")
    own = (F.col("__value") == F.col("value")) & F.col("__of").eqNullSafe(F.col("__group"))
    return found.join(values, own, "left_semi").select(id_col, F.col("__value").alias("value"), "n")


def leak_report(masked: DataFrame, originals: DataFrame, id_col: str, masked_col: str = "masked_text", original_col: str = "original", group: str | None = None) -> DataFrame:
    """id, n_values, n_places, leak_free of each masked text."""
    found = leaks(masked, originals, id_col, masked_col, original_col, group).groupBy(id_col).agg(F.count("*").alias("n_values"), F.sum("n").alias("n_places"))
    out = masked.select(id_col).join(found.withColumnRenamed(id_col, "__id"), F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(id_col, n("n_values"), n("n_places"), F.col("n_values").isNull().alias("leak_free"))
