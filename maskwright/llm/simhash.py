"""SimHash near-dedup by a grid over segment popcounts.

A fingerprint is embedded as the bit counts of its 32 segments of two bits. The Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints, so links at
three bits or fewer lie within distance three, and within distance one in one half of the
segments. Each half is a grid of unit cells in 16 dimensions: a fingerprint stands in its own
cell and looks into the cells one step up in each dimension, so that the two ends of every
link meet in a cell in which one of them stands. Pairs that meet are checked exactly.

Only distinct fingerprints enter the grid. A cell in which many stand is divided once more:
the rest of the distance falls on the other half's four quarters, one of which has equal
counts. In a cell the links are sought breadth first, so a dense group of copies gives a
spanning forest of its links, not all pairs; the components are the same.

Defined results: a null or blank text has fingerprint zero and links like any other; rows that
repeat an id give a row each, and component_id is the smallest id; a null id takes part as the
others of its fingerprint do and is no component's; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop, ship, table
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Residents of a cell from which it is divided once more.
DENSE = 256
#: Cells of up to this many rows are compared pair by pair.
SMALL = 32


def hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The hash of each of the text's shingles of `size` words; of all its words if they are fewer."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - size + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The text's SimHash as a signed 64-bit number."""
    h = hashes(text, size)
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp for each of docs, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py() or b"", size) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return table(rows.mapInArrow(run, "doc_id long, fp long"), "fingerprints")


def _half(half: int) -> Column:
    """The 16 counts of one half, two bits each."""
    x = f"(shiftrightunsigned(fp, {32 * half}) & 4294967295L)"
    return F.expr(f"({x} & 1431655765L) + (shiftrightunsigned({x}, 1) & 1431655765L)")


def cells(nodes: DataFrame) -> DataFrame:
    """key, fp, rep, own of every fingerprint in its own cells and those one step up."""
    parts = []
    for half in (0, 1):
        up = "transform(filter(sequence(0, 15), i -> (shiftrightunsigned(h, 2 * i + 1) & 1L) = 0), i -> h + shiftleft(1L, 2 * i))"
        found = nodes.withColumn("h", _half(half)).withColumn("o", _half(1 - half))
        found = found.select("fp", "rep", "h", "o", F.posexplode_outer(F.expr(f"concat(array(h), {up})")).alias("i", "cell"))
        parts.append(found.select(F.expr(f"cell + {half} * 4294967296L").alias("key"), "fp", "rep", "o", (F.col("i") == 0).alias("own")))
    every = parts[0].unionByName(parts[1])
    own = nodes.select(F.explode(F.array(_half(0), _half(1) + F.lit(2**32))).alias("key"))
    dense = table(own.groupBy("key").count().where(F.col("count") > DENSE).select("key"), "dense")
    some = every.join(bounded(dense), "key", "left_semi").select(F.explode(F.array(*[F.expr(f"key + shiftleft({q + 1}L + 8L * (shiftrightunsigned(o, {8 * q}) & 255L), 40)") for q in range(4)])).alias("key"), "fp", "rep", "own")
    return every.join(bounded(dense), "key", "left_anti").select("key", "fp", "rep", "own").unionByName(some)


def _forest(fp: np.ndarray, own: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links that connect what all links with an own end connect, breadth first."""
    left = np.arange(len(fp))
    queue: list[int] = []
    while len(left):
        if not queue:
            stands = left[own[left]]
            if not len(stands):
                return
            queue.append(int(stands[0]))
            left = left[left != stands[0]]
        x = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[x]) <= bits
        if not own[x]:
            near &= own[left]
        found = left[near]
        left = left[~near]
        queue += found.tolist()
        for y in found.tolist():
            yield x, y


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: links between fingerprints (fp, rep) by their rep, enough of them to connect
    what all links connect."""
    if bits > 3:
        raise ValueError("the grid finds links of up to three bits")

    def within(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.concatenate((first, [len(key)])))
        a, b = [], []
        for start, n in zip(first[length > SMALL].tolist(), length[length > SMALL].tolist(), strict=True):
            pairs = np.array(list(_forest(fp[start : start + n], own[start : start + n], bits)), np.int64).reshape(-1, 2) + start
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        size = np.repeat(length, length)
        rest = (np.repeat(first + length, length) - np.arange(len(key)))[size <= SMALL]
        at = np.flatnonzero(size <= SMALL)
        for d in range(1, SMALL):
            at, rest = at[rest > d], rest[rest > d]
            if not len(at):
                break
            met = at[(own[at] | own[at + d]) & (np.bitwise_count(fp[at] ^ fp[at + d]) <= bits)]
            a.append(met)
            b.append(met + d)
        if not a:
            return rep[:0], rep[:0]
        return rep[np.concatenate(a)], rep[np.concatenate(b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # rows of the key the last batch ended with

        def settle() -> Iterator[pa.RecordBatch]:
            if kept:
                a, b = within(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[1] = cols[1].view(np.uint64)
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # keys are sorted
            if cut or (kept and kept[-1][0][-1] != cols[0][0]):
                if cut:
                    kept.append([c[:cut] for c in cols])
                yield from settle()
            kept.append([c[cut:] for c in cols])
        yield from settle()

    ship(nodes.sparkSession)
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cells(nodes).repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def close_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """a, b, as a table: every document whose fingerprint others share with the first of these, and links between the firsts, enough of them to connect what all
    links connect. id_col: unique numbers without nulls."""
    fps = fingerprints(docs, id_col, text_col, size)
    nodes = table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    same = fps.join(nodes.where("n > 1"), "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    out = table(same.union(links(nodes.select("fp", "rep"), bits)), "close")
    drop(fps)
    drop(nodes)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """A row for each of docs: id, fp, component_id."""
    fps = fingerprints(docs, id_col, text_col, size)
    nodes = table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.where("rep is not null").select("fp", "rep"), bits))
    found = table(nodes.join(found.withColumnRenamed("id", "rep"), "rep", "left").where("n > 1 or component_id is not null").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "groups")
    drop(nodes)
    return fps.join(bounded(found), "fp", "left").select(F.col("doc_id").alias(id_col), "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
