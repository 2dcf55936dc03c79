"""Operator 9 for a Jaccard similarity: all pairs of texts at or above it, by word shingles.

First come SimHash fingerprints and their grid (`simhash`): texts of equal fingerprints and links of up to three bits, settled by both sets. Texts of
similarity 0.8 lie about seven bits apart, some well over ten, where cells of a grid hold next to everything; so what
the grid can't reach comes from a prefix filter, which loses none. It starts from the neighbourhoods that the fingerprints gave.
With all shingles in one order, two texts that overlap in o of their n and m
shingles share one of the first n - o + 1 and m - o + 1. The larger text asks with the n - ceil(t n) + 1
that any partner needs, the smaller one offers no more than partners of its own size or above need; so
a shingle that many texts share but none of them early enough brings no pair together. The order puts
shingles last that are common in a sample of the texts, or at which many texts would meet by the sample alone; any order gives the same pairs. Shingles at which
the same texts meet count as one. Of the texts
that meet at a shingle, bounds rule pairs out: sizes, the places of the shingle in both, and the Manhattan
distance of their counts of shingles by segment, which is at most the number of shingles that only one
of the two has. Long texts have more segments. What is left is settled by both sets.

So that a large group of copies costs no pair for each two of its members, every text is first compared
with one of those at each shingle, drawn anew in each of three rounds. Where the bounds leave such a pair, both are of one neighbourhood; at shingles where several neighbourhoods
still meet, texts of different ones are compared too, and what the bounds leave joins these. There the join itself takes a bound, so that texts that only share a
passage make no rows: segments that hold an odd number of one text's shingles and an even one of the other's hold one that only one has. Every similar pair then lies within a neighbourhood. The pairs that
the bounds left are settled by both sets, and what that hasn't joined within a neighbourhood block by block (`setsketch.within`): a
neighbourhood of texts just below the threshold costs work in the square of its size, but no rows. Components over the links so found equal those over all.

Defined results: ids are row numbers, so rows with null or repeated ids or repeated texts are rows of their own, and ties go to the smaller number; very
long texts count whole; a text of fewer words than a shingle is one shingle, a null or blank one the
shingle without words; an empty table gives no rows; other columns are ignored. Shingles are compared by
64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, drop, ship, table
from .components import components
from .hashing import shingle_hashes
from .setsketch import within
from .simhash import close_pairs

SIZE, SIMILARITY = 5, 0.8
#: Documents whose shingles are counted for the order, and common shingles that are broadcast (2 MB).
SAMPLE, COMMON = 10_000, 2**17
#: Texts that meet at a shingle from which it counts as common.
MANY = 8
#: Shingles a task counts at a time.
CHUNK = 2_000_000
#: Rounds of drawn heads.
ROUNDS = 3
#: Segments (by a hash's leading bits) whose shingles are counted for the lower bound, at least; up to this many are counted in one.
SEGMENTS, CLIP = 256, 127
#: Numbers of 64 bits that say which of as many segments as they have bits hold an odd number of shingles; so many more for texts of over FAR shingles.
ODD, MORE, FAR = [f"odd{i}" for i in range(16)], 128, 1024


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; one at least."""
    found = np.unique(shingle_hashes(text, size))
    return found if len(found) else np.zeros(1, np.uint64)


def segment_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes lie in each segment; a power of two of them, two to four hashes in each in the mean, else the bound would pass any two long texts."""
    bits = max(SEGMENTS, 1 << max(0, len(hashes).bit_length() - 2)).bit_length() - 1
    found = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(found, CLIP).astype(np.uint8)


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """The Manhattan distance of two texts' segment counts, in the coarser one's segments."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    n = min(len(x), len(y))
    x, y = (np.minimum(z.reshape(n, -1).sum(axis=1), CLIP) for z in (x, y))
    return int(np.abs(x - y).sum())


def odd_segments(hashes: np.ndarray, words: int = len(ODD)) -> np.ndarray:
    """Whether each of 64 * words segments holds an odd number of hashes, as bits. At most as many bits of two texts differ as hashes are in only one."""
    bits = (64 * words).bit_length() - 1
    found = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((found & 1).astype(np.uint8), bitorder="little").view("<i8")


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that come up often in a sample of rows (id, text), sorted, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            for text in batch.column(0):
                found.append(shingles(text.as_py() or b"", size))
                if sum(map(len, found)) > CHUNK:
                    yield out()
                    found = [np.zeros(0, np.uint64)]
        yield out()

    by = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(by)) == 0).select("text")
    counts = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("count")).where("count > 2")
    return _top(counts.withColumn("count", F.col("count") * by))


def _top(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON most frequent of (key, count), sorted by key."""
    top = counts.orderBy(F.desc("count"), "key").limit(COMMON).toArrow()  # `COMMON` rows
    key, n = top.column("key").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _order(rows: DataFrame, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Common hashes and how often they come up: those of the sample, and those at which many texts meet in the order that the sample alone gives, by
    exact count. The sample's share falls as the texts grow in number, so what it misses would bring ever more texts together."""
    key, n = _common(rows, size)
    met = prefixes(rows, size, similarity, (key, n)).groupBy("key").agg(F.count("*").alias("count"), F.max("offer").alias("offers"))
    more, m = _top(met.where(f"offers and count >= {MANY}").select("key", "count"))
    new = ~np.isin(more, key)
    key, n = np.concatenate((key, more[new])), np.concatenate((n, m[new]))
    order = np.argsort(key)
    return key[order], n[order]


def prefixes(rows: DataFrame, size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, id, n, at, offer: each text's first shingles, those of `common` (hashes, sorted, and counts) last, its number of shingles, the place of
    this one and whether texts of this size or larger may need it; dealt by key. The exchange carries n and at as one number and nothing else."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = shared.value
        for batch in batches:
            found = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingles(text.as_py() or b"", size)
                n = len(h)
                if len(key):
                    at = np.minimum(np.searchsorted(key, h), len(key) - 1)
                    h_count = np.where(key[at] == h, count[at], 0)
                    ordered = h[np.argsort(h_count, kind="stable")]
                else:
                    ordered = h
                p = n - int(np.ceil(similarity * n - 1e-9)) + 1
                found.append((ordered[:p].view(np.int64), np.full(p, i, np.int64), (n << 32) + np.arange(p, dtype=np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["key", "id", "place"])

    found = rows.select("id", "text").mapInArrow(run, "key long, id long, place long").repartition("key")
    found = found.select("key", "id", F.expr("cast(place >> 32 as int)").alias("n"), F.expr("cast(place & 4294967295L as int)").alias("at"))
    return found.withColumn("offer", F.expr(f"at < n - ceil({2 * similarity / (1 + similarity)}D * n - 1e-9D) + 1"))


def _may(a: str, b: str, similarity: float) -> Column:
    """Whether rows that meet can be similar enough. It holds at the first shingle two similar texts share."""
    t = similarity
    return F.expr(
        f"least({a}.n, {b}.n) >= {t}D * greatest({a}.n, {b}.n) - 1e-9D and least({a}.n - {a}.at, {b}.n - {b}.at) >= {t / (1 + t)}D * ({a}.n + {b}.n) - 1e-9D"
    )


class _Verify:
    """What the bound by segments and the sets say of pairs of rows (id, text)."""

    def __init__(self, rows: DataFrame, size: int, similarity: float) -> None:
        self.rows, self.size, self.similarity = rows, size, similarity

    def _texts(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(bounded(ids), "id", "left_semi").select("id", "text")

    def may(self, pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b) that the bound leaves, as a table."""
        size, most = self.size, (1 - self.similarity) / (1 + self.similarity)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingles(x.as_py() or b"", size) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([segment_counts(x).tobytes() for x in sets], pa.binary())], ["id", "n", "counts"])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m, x, y = (batch.column(i) for i in range(2, 6))
                apart = np.array([distance(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= most * (n.to_numpy().astype(float) + m.to_numpy()) + 1e-9))

        ids = table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
        counts = table(self._texts(ids).mapInArrow(count, "id long, n int, counts binary"), "counts")
        found = pairs.join(counts.toDF("a", "n", "x"), "a").join(counts.toDF("b", "m", "y"), "b")
        found = table(found.select("a", "b", "n", "m", "x", "y").mapInArrow(near, "a long, b long"), "may")
        drop(ids)
        drop(counts)
        return found

    def odd(self, asked: DataFrame) -> DataFrame:
        """id, ODD, far (MORE numbers of texts of over FAR shingles) of the ids in a written table, as a table."""
        size = self.size

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingles(x.as_py() or b"", size) for x in batch.column(1)]
                found = np.array([odd_segments(x) for x in sets], np.int64).reshape(-1, len(ODD))
                far = pa.array([odd_segments(x, MORE) if len(x) > FAR else None for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in found.T], far], ["id", *ODD, "far"])

        ids = table(asked.select("id").distinct(), "ids")
        out = table(self._texts(ids).mapInArrow(count, ", ".join(f"{c} long" for c in ("id", *ODD)) + ", far array<long>"), "odd")
        drop(ids)
        return out

    def sets(self, asked: DataFrame) -> DataFrame:
        """node, s of the ids asked for (node), as a table."""
        size = self.size

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py() or b"", size).view(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))], ["node", "s"])

        ids = table(asked.select(F.col("node").alias("id")).distinct(), "ids")
        out = table(self._texts(ids).mapInArrow(collect, "node long, s array<long>"), "sets")
        drop(ids)
        return out

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Of the written pairs (a, b), those whose sets are similar, as a table."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("o", F.size(F.array_intersect("x", "y")))
        out = table(both.where(F.col("o") / (F.size("x") + F.size("y") - F.col("o")) >= self.similarity).select("a", "b"), "links")
        drop(sets)
        return out


def groups(docs: DataFrame, id_col: str, text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """id, component_id of every document similar to another; component_id is the smallest id
    reachable. id_col: unique 64-bit numbers without nulls."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    by_key = W.partitionBy("key")
    me = F.struct("id", "n", "at")
    verify = _Verify(rows, size, similarity)
    close = close_pairs(rows, "id", "text", size)
    sure = verify.similar(close)
    met = prefixes(rows, size, similarity, _order(rows, size, similarity)).withColumns({"c": F.count("*").over(by_key), "offers": F.max("offer").over(by_key), "who": F.bit_xor(F.xxhash64("id")).over(by_key)})
    met = met.where("c > 1 and offers").groupBy(F.xxhash64("who", "c").alias("key"), "id")  # shingles at which the same texts meet are one
    met = table(met.agg(F.first("n").alias("n"), F.min("at").alias("at"), F.max("offer").alias("offer")), "met")
    around = table(components(sure), "around")
    left, near = table(met.join(around, "id", "left").withColumn("around", F.coalesce("component_id", "id")).drop("component_id"), "left"), sure
    for k in range(ROUNDS):  # heads drawn by hash, of the keys at which neighbourhoods still meet
        heads = table(left.groupBy("key").agg(F.min_by(F.struct("id", "n", "at", "around"), F.xxhash64(F.lit(k), "id")).alias("first")), "heads")
        stars = left.join(heads, "key").withColumn("own", me).where(F.col("first.around") != F.col("around")).where(_may("first", "own", similarity))
        stars = table(stars.select(F.least("first.id", "id").alias("a"), F.greatest("first.id", "id").alias("b")).distinct(), "stars")
        found = verify.may(stars)
        near = table(near.union(found), "near")
        around = table(components(near), "around")
        now = left.drop("around").join(around, "id", "left").withColumn("around", F.coalesce("component_id", "id")).drop("component_id")
        several = table(now.groupBy("key").agg(F.min("around").alias("lo"), F.max("around").alias("hi")).where("lo <> hi").select("key"), "several")
        left = table(now.join(several, "key"), "left")
    odd = verify.odd(left)
    asked = table(left.join(odd, "id"), "asked")  # the bound stands in the join, so that pairs that merely meet make no rows
    l, r = asked.alias("l"), asked.alias("r")
    most, apart = f"{(1 - similarity) / (1 + similarity)}D * (l.n + r.n) + 1e-9D", " + ".join(f"bit_count(l.{c} ^ r.{c})" for c in ODD)
    far = "aggregate(zip_with(l.far, r.far, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    meet = F.expr("l.key = r.key and l.offer and (l.n < r.n or l.n = r.n and r.offer and l.id < r.id) and l.around <> r.around") & _may("l", "r", similarity)
    pairs = l.join(r, meet & F.expr(f"{apart} <= {most} and coalesce({far} <= {most}, true)"))
    pairs = table(pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct(), "pairs")
    near = table(near.union(verify.may(pairs)), "near")
    around = table(components(near), "around")
    links = verify.similar(near)
    part = table(components(links), "part")
    sizes = table(met.select(F.col("id").alias("node"), "n").distinct(), "sizes")
    more = within(around, part, sizes, verify.sets, round(similarity * 1000), 1000)
    out = table(components(links.union(more)), "part")
    for x in (close, sure, met, near, left, odd, asked, pairs, around, links, part, sizes, more):
        drop(x)
    return out
