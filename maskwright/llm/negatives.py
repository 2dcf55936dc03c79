"""Hard-negative mining by Four-Russians scoring.

A score is the inner product of whole numbers. Eight dimensions make a group; for every anchor and
group, a table holds the sums of all 256 subsets of the anchor's components there. Candidates are
indexed once, in blocks, as bit planes: in two's complement, the bits of one weight of a group's eight components make
a byte. A byte looks up its subset sum, the sums of a plane's groups are added, and the planes
are put together by shifts: the full score, exact, without a multiplication.

The anchors are a stated query set against all rows, in blocks: each block of anchors meets each block of
candidates once, as one row that a task scores. Of every such meeting at most a few rows a question go on, and ranks by
question settle them. Two passes: an anchor's positives by score among its own label, then,
for each positive, the best rows of other labels whose score lies in its window.

Defined results: rows with a null label, a null vector or any null or non-finite component take no part; shorter
vectors count as zero beyond their end, so an empty one scores zero; components are held to 64 bits, and scores are exact
where they fit into 64; ties go to the smaller id, a null id last, then rows as they come. Rows that repeat an id
are rows of their own: each anchor row gives rows, and finds its repetition like any other row. Anchors without a
positive and positives without a negative give no rows, nor does an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop, ship, table

#: Dimensions of a group; rows of a block of candidates and of anchors.
GROUP, CANDIDATES, ANCHORS = 8, 4096, 256
POSITIVES, NEGATIVES, LOW, HIGH, OUT_OF = 5, 5, 80, 100, 100

_BLOCK = "row binary, id binary, known binary, label binary, width int, values binary"
_INDEX = "row binary, id binary, known binary, label binary, width int, bits int, planes binary"
_FOUND = "a_block long, anchor long, place long, id long, row long, score long"


def usable(rows: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, label, asks, q of the rows that take part, q being floor(scale * x) for each component."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    found = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    q = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return found.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), q.alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of a matrix, zeros behind shorter ones, a multiple of GROUP wide."""
    n = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = max(GROUP, -(-int(n.max(initial=0)) // GROUP) * GROUP)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (row, id, label, q) in blocks of up to `most`, one a row."""

    def block(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(kept).combine_chunks()
        ids = t.column("id").combine_chunks()
        q = _matrix(t.column("q").combine_chunks())
        parts = [t.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), t.column("label").to_numpy()]
        return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([q.shape[1]], pa.int32()), pa.array([q.tobytes()], pa.binary())], ["row", "id", "known", "label", "width", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                kept.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == most:
                    yield block(kept)
                    kept, n = [], 0
        if n:
            yield block(kept)

    return rows.select("row", "id", "label", "q").mapInArrow(run, _BLOCK)


def planes(q: np.ndarray) -> tuple[int, np.ndarray]:
    """The bits a component of q takes, sign included, and a byte for each plane, group and row: [plane, group, row]."""
    low, high = int(q.min(initial=0)), int(q.max(initial=0))
    bits = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    out = np.empty((bits, q.shape[1] // GROUP, len(q)), np.uint8)
    for k in range(bits):
        out[k] = np.packbits((q >> k & 1).astype(np.uint8), axis=1, bitorder="little").T
    return bits, out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: the sum of those of the group's eight components whose bit is set."""
    parts = anchors.reshape(len(anchors), -1, GROUP)
    out = np.zeros((parts.shape[1], 1, len(anchors)), anchors.dtype)
    for d in range(GROUP):
        out = np.concatenate((out, out + parts[:, :, d].T[:, None, :]), axis=1)
    return out


def scores(index: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """[row, anchor]: inner products of the index's rows and the anchors, modulo 2^(bits of the type)."""
    bits, groups, n = index.shape
    out = np.zeros((n, sums.shape[2]), sums.dtype)
    found = np.empty_like(out)
    for k in range(bits - 1, -1, -1):
        out <<= 1
        for g in range(groups):
            np.take(sums[g], index[k, g], axis=0, out=found, mode="clip")
            if k == bits - 1:  # the sign's plane
                out -= found
            else:
                out += found
    return out


def _index(blocks: DataFrame) -> DataFrame:
    """The candidates' index: their blocks with bit planes for values."""
    names = ["row", "id", "known", "label", "width", "bits", "planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bits, found = planes(np.frombuffer(r["values"], np.int64).reshape(-1, r["width"]))
                same = [pa.array([r[k]], pa.binary()) for k in names[:4]]
                yield pa.RecordBatch.from_arrays([*same, pa.array([r["width"]], pa.int32()), pa.array([bits], pa.int32()), pa.array([found.tobytes()], pa.binary())], names)

    return blocks.mapInArrow(run, _INDEX)


class _Unit:
    """A block of candidates that met a block of anchors."""

    def __init__(self, r: dict) -> None:
        self.row, self.id, self.label = (np.frombuffer(r[k], np.int64) for k in ("row", "id", "label"))
        self.known = np.frombuffer(r["known"], np.bool_)
        self.index = np.frombuffer(r["planes"], np.uint8).reshape(r["bits"], -1, len(self.row))
        self.anchor, self.of = np.frombuffer(r["a_row"], np.int64), np.frombuffer(r["a_label"], np.int64)
        q, width = np.frombuffer(r["a_values"], np.int64).reshape(-1, r["a_width"]), r["width"]
        q = np.pad(q[:, :width], ((0, 0), (0, max(0, width - q.shape[1]))))
        most = max(abs(int(q.min(initial=0))), int(q.max(initial=0))) * width << r["bits"] + 1
        self.sums = subset_sums(q.astype(np.int32 if most < 2**31 else np.int64))

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        sums = self.sums if len(anchors) == self.sums.shape[2] else np.ascontiguousarray(self.sums[:, :, anchors])
        return scores(np.ascontiguousarray(self.index[:, :, rows]), sums)

    def best(self, s: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Of rows with scores s, the places of the first k."""
        if len(s) > k:
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        else:
            near = np.arange(len(s))
        of = rows[near]
        return near[np.lexsort((self.row[of], self.id[of], ~self.known[of], ~s[near]))[:k]]


def _own(k: int):
    """For each anchor of a unit, its first k other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                unit, found = _Unit(r), []
                for label in np.intersect1d(unit.of, unit.label).tolist():
                    rows, anchors = np.flatnonzero(unit.label == label), np.flatnonzero(unit.of == label)
                    s = unit.scores(rows, anchors)
                    for j, a in enumerate(anchors.tolist()):
                        other = np.flatnonzero(unit.row[rows] != unit.anchor[a])
                        best = other[unit.best(s[other, j], rows[other], k)]
                        found += [(r["a_block"], int(unit.anchor[a]), 0, *_told(unit, i), int(x)) for i, x in zip(rows[best].tolist(), s[best, j].tolist(), strict=True)]
                yield _batch(found)

    return run


def _others(k: int, low: int, high: int, out_of: int):
    """For each anchor and positive of a unit, the first k rows of another label in the positive's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                unit, found = _Unit(r), []
                asked: dict[int, list[tuple[int, int]]] = {}
                for x in r["asked"]:
                    asked.setdefault(x["anchor"], []).append((x["place"], x["score"]))
                at = {a: j for j, a in enumerate(unit.anchor.tolist())}
                anchors = np.array(sorted(at[a] for a in asked), np.int64)
                s = unit.scores(np.arange(len(unit.row)), anchors)
                for j, a in enumerate(anchors.tolist()):
                    rows = np.flatnonzero(unit.label != unit.of[a])
                    own = s[rows, j]
                    for place, p in asked[int(unit.anchor[a])]:
                        least, most = -(-low * p // out_of), high * p // out_of
                        within = np.flatnonzero((own >= least) & (own <= most)) if least <= most else rows[:0]
                        best = within[unit.best(own[within], rows[within], k)]
                        found += [(r["a_block"], int(unit.anchor[a]), place, *_told(unit, i), int(x)) for i, x in zip(rows[best].tolist(), own[best].tolist(), strict=True)]
                yield _batch(found)

    return run


def _told(unit: _Unit, i: int) -> tuple[int | None, int]:
    return int(unit.id[i]) if unit.known[i] else None, int(unit.row[i])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["a_block", "anchor", "place", "id", "row", "score"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each question, numbered from 1 in `rank`."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(index: DataFrame, asking: DataFrame, parts: int) -> DataFrame:
    """A row for each block of candidates and block of anchors. Both sides are dealt by the candidates' part, the anchors' to all of them."""
    every = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return index.repartition(2 * parts, "part").join(every.repartition(2 * parts, "part"), "part")


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, out_of: int = OUT_OF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows for which is_anchor holds.
    A negative's score n and its positive's p hold low * p <= out_of * n <= high * p."""
    ship(rows.sparkSession)
    taken = table(usable(rows, is_anchor, id_col, label_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    parts = max(1, ceil(taken.count() / CANDIDATES))
    index = table(_index(_blocks(taken.repartition(parts), CANDIDATES)).withColumn("part", F.spark_partition_id()), "planes")
    anchors = taken.where("asks").select("row", "id", "label", "q")
    asking = _blocks(anchors.repartition(max(1, ceil(anchors.count() / ANCHORS))), ANCHORS)
    asking = table(asking.select(F.monotonically_increasing_id().alias("a_block"), *(F.col(c).alias(f"a_{c}") for c in ("row", "label", "width", "values"))), "asking")
    own = _met(index, asking, parts).mapInArrow(_own(positives), _FOUND)
    own = table(_ranked(own, ["anchor"], positives), "positives")
    asked = own.groupBy("a_block").agg(F.collect_list(F.struct("anchor", F.col("rank").cast("long").alias("place"), "score")).alias("asked"))  # `positives` for each anchor of a block
    found = _met(index, asking.join(asked, "a_block"), parts).mapInArrow(_others(negatives, low, high, out_of), _FOUND)
    found = table(_ranked(found, ["anchor", "place"], negatives), "negatives")
    pairs = own.select("anchor", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "place"])
    out = out.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    drop(index)
    drop(asking)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
