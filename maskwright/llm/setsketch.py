"""Near-duplicates by SetSketch registers: all texts whose sets of word shingles have a Jaccard similarity of at least
`least` in `out_of`.

A sketch has 256 registers. Each holds, for an exponential variate of its own for every shingle, the smallest of the
set's, put on a scale of powers of BASE and truncated to 16 bits: minima, so sketches of unions come from sketches; and two
sets agree in a register with a probability of at least their similarity. A shingle's variates are made in
ascending order, each for a register drawn without replacement, until no register of the set can still fall.

Equal sets are one node. Nodes meet in the bands (ROWS registers each) in which they agree. At a similarity of 0.85 a pair meets in
none of the 42 bands with a probability of (1 - 0.85^6)^42 = 2.3e-9, and less above. Pairs that
met are estimated jointly: from how many registers are larger, smaller and equal, and both sizes, the
likelihood of every similarity; a pair goes when the best one below the threshold is e^25 times as likely as the threshold, which happens to a pair at or above it with
a probability of about 1e-11. What is left is settled on the full sets.

So that a large group of near copies costs no pair for each two of its members, a node is first compared with the heads of
its bands, a band's head being the node that meets others oftenest in all its bands: of copies of one text, the one nearest to the others. Where
the likelihood leaves such a pair, both are of one neighbourhood. Nodes that meet in a band and are of different neighbourhoods are estimated too, unless their
registers' last bits rule them out, and neighbourhoods joined where the likelihood leaves a pair. So every link lies within a neighbourhood. Each node's pair with the
head it shares most bands with is settled on the sets; what is left are, within a neighbourhood, the pairs of nodes that this hasn't joined. They are settled
block by block: two blocks of nodes and their sets make one unit of work, which gives back a link for two components at most. A
neighbourhood whose nodes are just below the threshold to each other so costs units in the square of its size, but no rows. Components over
the links so found equal those over all links.

Defined results: A-Z are lowered; words stand between blanks (0x20, 0x09-0x0D); texts of fewer words than a shingle are one shingle of all; a text
without words or a null has an empty set, which links with nothing. Very long texts count whole. Rows that repeat an id or a text give a row each; component_id is the smallest id
reachable, a null id counting for none but linking its text like any other (null if no other id is there). Shingles are compared by 64-bit
hash, equal sets by 128 bits. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop, ship, table
from .components import components
from .hashing import mix, shingle_hashes

SIZE, LEAST, OUT_OF = 3, 85, 100
#: Registers (a power of two), those of a band, and bands.
REGISTERS, ROWS, BANDS = 256, 6, 42
#: The scale's base, and the rate that keeps the largest minima above zero.
BASE, RATE = 1.001, 20.0
#: Logarithm of the likelihoods' ratio from which a pair goes; last bits of the registers that may differ (19 expected at 0.85, over 46 with a probability of about 1e-8).
DOUBT, BITS = 25.0, 46
LAST = ["b0", "b1", "b2", "b3"]
#: Shingles whose variates are made at a time.
CHUNK = 500_000
#: Nodes and shingles of a block of a unit of work; distinct shingles that a unit counts at a time.
BLOCK, SHINGLES, COLUMNS = 256, 500_000, 8192

_SKETCH = "doc_id long, n long, d1 long, d2 long, b0 long, b1 long, b2 long, b3 long, registers binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text, size))


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    from xxhash import xxh3_128_intdigest

    x = xxh3_128_intdigest(h.astype("<u8").tobytes())
    return (x >> 64) - (1 << 63), (x & (2**64 - 1)) - (1 << 63)


def minima(h: np.ndarray, of: np.ndarray, sets: int, m: int = REGISTERS) -> np.ndarray:
    """[set, register]: the smallest variate of each set's members; member i, with hash h[i], is in set of[i]."""
    out = np.full(sets * m, np.inf)
    x = np.zeros(len(h))
    at = mix(h ^ _ODD)
    step = (at >> np.uint64(32)) | np.uint64(1)
    base = of.astype(np.int64) * m
    for j in range(m):
        if not len(h):
            break
        u = ((mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (m - j)
        np.minimum.at(out, base + ((at + np.uint64(j) * step) & np.uint64(m - 1)).astype(np.int64), x)
        if j < 8 or j % 4 == 0:
            live = x < out.reshape(sets, m).max(axis=1)[base // m]
            h, x, at, step, base = h[live], x[live], at[live], step[live], base[live]
    return out.reshape(sets, m)


def truncated(x: np.ndarray) -> np.ndarray:
    """Registers of minima, 16 bits each; an empty set's are zero."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, 65535).astype("<u2")


def _chance(x: np.ndarray) -> np.ndarray:
    """That one set's register is larger, x being the other's share it lacks."""
    return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)


def may_be_similar(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float, doubt: float = DOUBT) -> np.ndarray:
    """Whether pairs of sets with registers a[i], b[i] and sizes n[i], m[i] can have the similarity: by the joint likelihood of the
    counts of larger, smaller and equal registers."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = n / (n + m)
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(u, v)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _chance(np.maximum(u - v * j, 0)), _chance(np.maximum(v - u * j, 0))
        return up * np.log(p) + down * np.log(q) + (a.shape[1] - up - down) * np.log(np.clip(1 - p - q, 1e-12, 1))

    best = np.max([likelihood(np.minimum(most, least * k / 48)) for k in range(48)], axis=0)
    return best - likelihood(np.minimum(most, least)) <= doubt


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, n, d1, d2, b0 to b3, registers of each of docs, as a table: the size of its set, 128 bits of it, the last
    bits of its registers and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            k = truncated(minima(np.concatenate(sets), of, len(sets)))
            marks = np.array([digest(x) for x in sets], np.int64).reshape(-1, 2)
            bits = np.packbits((k & 1).astype(np.uint8), axis=1).view("<i8")
            found = [pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4)), pa.array([x.tobytes() for x in k], pa.binary())]
            return pa.RecordBatch.from_arrays(found, ["doc_id", "n", "d1", "d2", *LAST, "registers"])

        ids, sets, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                sets.append(shingle_set(text.as_py() or b"", size))
                held += len(sets[-1])
                if held >= CHUNK or len(sets) >= 2000:
                    yield out()
                    ids, sets, held = [], [], 0
        if sets:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return table(rows.mapInArrow(run, _SKETCH), "sketches")


def bands(nodes: DataFrame) -> DataFrame:
    """key, node: a row for each band of each node (node, registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)[:, : ROWS * BANDS].astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), k.shape[:2])
            for r in range(ROWS):
                key = mix(key * _ODD + k[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "key long, node long")


def _sizes(a: str, b: str, least: int, out_of: int) -> Column:
    return F.expr(f"{out_of} * least({a}, {b}) >= {least} * greatest({a}, {b})")


class _Confirm:
    """Which pairs of nodes are similar."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, least: int, out_of: int) -> None:
        self.docs, self.nodes, self.size, self.least, self.out_of = docs, nodes, size, least, out_of

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of the written pairs (a, b), those that may be similar by size and likelihood, as a table."""
        least = self.least / self.out_of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
                n, m = (batch.column(i).to_numpy() for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(a, b, n, m, least)))

        side = self.nodes.select("node", "n", "registers")
        both = pairs.select("a", "b").join(side.toDF("a", "n", "x"), "a").join(side.toDF("b", "m", "y"), "b").where(_sizes("n", "m", self.least, self.out_of))
        return table(both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"), "likely")

    def sets(self, asked: DataFrame) -> DataFrame:
        """node, s of the nodes asked for, as a table: their texts are found by id, and told from others of the id by the set's digest."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(x.as_py() or b"", size) for x in batch.column(0)]
                marks = np.array([digest(x) for x in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["d1", "d2", "s"])

        who = table(asked.join(self.nodes.drop("registers"), "node").select("node", "d1", "d2", F.col("doc_id").alias("__id")), "who")
        ids = table(who.select("__id").distinct(), "ids")
        texts = self.docs.join(bounded(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(F.col("text").cast("binary"))
        found = texts.mapInArrow(run, "d1 long, d2 long, s array<long>").join(bounded(who.select("node", "d1", "d2")), ["d1", "d2"])
        out = table(found.groupBy("node").agg(F.first("s").alias("s")), "sets")
        drop(who)
        drop(ids)
        return out

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Of the written pairs (a, b), those whose sets are similar, as a table."""
        asked = table(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")
        sets = self.sets(asked)
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("o", F.size(F.array_intersect("x", "y")))
        out = table(both.where(self.out_of * F.col("o") >= self.least * (F.size("x") + F.size("y") - F.col("o"))).select("a", "b"), "links")
        drop(asked)
        drop(sets)
        return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[i, j]: how many hashes left[i] and right[j] share."""
    both = np.concatenate([*left, *right])
    _, at, n = np.unique(both, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    shared = n[at] > 1
    at, of = np.unique(at[shared], return_inverse=True)[1], of[shared]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(at.max(initial=-1)) + 1, COLUMNS):
        here = (at >= low) & (at < low + COLUMNS)
        held = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        held[of[here], at[here] - low] = 1
        out += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def settle(least: int, out_of: int):
    """Links a, b between nodes of different components, one for two components, of the units (unit, side, part, node, s) of a task, which come by unit."""

    def unit(rows: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
        right = right or left  # a block with itself comes once
        n, m = (np.array([len(r[3]) for r in x], np.int64) for x in (left, right))
        p, q = (np.array([r[1] for r in x], np.int64) for x in (left, right))
        o = _overlaps([r[3] for r in left], [r[3] for r in right])
        near = (out_of * o >= least * (n[:, None] + m - o)) & (p[:, None] != q)
        joined = set()
        for i, j in zip(*np.nonzero(near), strict=True):
            ends = tuple(sorted((int(p[i]), int(q[j]))))
            if ends not in joined:
                joined.add(ends)
                yield left[i][2], right[j][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> pa.RecordBatch:
            found = list(unit(rows))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for key, side, part, node, s in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if key != now:
                    if rows:
                        yield close()
                    now, rows = key, []
                rows.append((side, part, node, s.values.to_numpy()))
        if rows:
            yield close()

    return run


def blocks_of(of: DataFrame) -> DataFrame:
    """group, block, whole, node, part of nodes (group, part, node, n): blocks of some BLOCK nodes and SHINGLES shingles. Large components
    have blocks of their own (whole: that component), small ones share blocks."""
    parts = of.groupBy("group", "part").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    parts = table(parts.withColumn("whole", F.when((F.col("c") >= BLOCK // 2) | (F.col("n") >= SHINGLES // 2), F.col("part"))), "parts")
    pieces = parts.groupBy("group", "whole").agg(F.ceil(F.greatest(F.sum("c") / BLOCK, F.sum("n") / SHINGLES)).alias("pieces"))
    pieces = table(pieces, "pieces")
    placed = of.drop("n").join(parts.select("group", "part", "whole"), ["group", "part"])
    placed = placed.join(pieces.toDF("__group", "__whole", "pieces"), (F.col("group") == F.col("__group")) & F.col("whole").eqNullSafe(F.col("__whole"))).drop("__group", "__whole")
    piece = F.pmod(F.xxhash64(F.when(F.col("whole").isNull(), F.col("part")).otherwise(F.col("node"))), F.col("pieces"))
    return table(placed.select("group", F.xxhash64("group", "whole", F.col("whole").isNull(), piece).alias("block"), "whole", "node", "part"), "blocks")


def within(around: DataFrame, part: DataFrame, sizes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: int, out_of: int) -> DataFrame:
    """Links a, b that join what the similar pairs within each neighbourhood join. around, part: id, component_id of nodes by neighbourhood and
    by the links so far; sizes: node, n; sets_of: from a table of nodes to node, s."""
    of = around.join(part.toDF("node", "part"), around["id"] == F.col("node"), "left").select(F.col("component_id").alias("group"), F.coalesce("part", "id").alias("part"), F.col("id").alias("node"))
    of = table(of.join(sizes, "node"), "members")
    several = table(of.groupBy("group").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("group"), "several")
    blocks = blocks_of(of.join(several, "group"))
    sets = sets_of(blocks.select("node"))
    one = blocks.select("group", "block", "whole").distinct()
    units = one.join(one.toDF("group", "other", "other_whole"), "group").where("block <= other and (whole is null or other_whole is null or whole <> other_whole)")
    units = table(units.select(F.monotonically_increasing_id().alias("unit"), "block", "other"), "units")
    sides = units.select("unit", F.lit(0).alias("side"), "block").union(units.where("block <> other").select("unit", F.lit(1), "other"))
    work = sides.join(blocks.select("block", "part", "node"), "block").join(sets, "node").select("unit", "side", "part", "node", "s")
    out = table(work.repartition("unit").sortWithinPartitions("unit").mapInArrow(settle(least, out_of), "a long, b long"), "more")
    for x in (of, several, blocks, sets, units):
        drop(x)
    return out


def links(docs: DataFrame, nodes: DataFrame, size: int, least: int, out_of: int) -> DataFrame:
    """a, b: links between the written nodes (node, doc_id, n, d1, d2, b0 to b3, registers), enough of them to connect what all links connect."""
    confirm = _Confirm(docs, nodes, size, least, out_of)
    every = table(bands(nodes), "bands")
    shared = table(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    some = table(every.join(shared, "key"), "some")
    drop(every)
    weights = table(some.groupBy("node").agg(F.sum("c").alias("weight")), "weights")
    heads = some.select("key", "node").join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("head"))
    heads = table(heads, "heads")
    met = table(some.select("key", "node").join(heads, "key"), "met")
    stars = table(met.where("head <> node").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).count(), "stars")
    near = confirm.likely(stars)
    around = table(components(near), "around")

    # Neighbourhoods that a band brings together though not by its head.
    left = met.join(around, met["node"] == around["id"], "left").select("key", "node", F.coalesce("component_id", "node").alias("around"))
    left = table(left, "left")
    open_keys = table(left.groupBy("key").agg(F.min("around").alias("lo"), F.max("around").alias("hi")).where("lo <> hi").select("key"), "open")
    asked = table(left.join(open_keys, "key").join(nodes.select("node", "n", *LAST), "node"), "asked")
    l, r = asked.alias("l"), asked.alias("r")
    apart = " + ".join(f"bit_count(l.{b} ^ r.{b})" for b in LAST)
    meet = F.expr(f"l.key = r.key and l.around < r.around and {apart} <= {BITS}") & _sizes("l.n", "r.n", least, out_of)
    pairs = table(l.join(r, meet).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct(), "pairs")
    bridges = confirm.likely(pairs)
    around = table(components(near.union(bridges)), "around")

    nearest = table(stars.join(near, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b"), "nearest")
    found = confirm.similar(nearest)
    part = table(components(found), "part")
    more = within(around, part, nodes.select("node", "n"), confirm.sets, least, out_of)
    for x in (shared, some, weights, heads, met, stars, left, open_keys, asked, pairs):
        drop(x)
    return found.union(more)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: int = LEAST, out_of: int = OUT_OF) -> DataFrame:
    """A row for each of docs: id, n_shingles, component_id, kept (whether its id is the component's)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = sketches(rows, "doc_id", "text", size)
    same = every.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), *(F.first(b).alias(b) for b in LAST), F.first("registers").alias("registers"))
    nodes = table(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
    of = table(components(links(rows, nodes, size, least, out_of)), "components")
    named = nodes.select("node", "d1", "d2", "doc_id", "copies").join(of, nodes["node"] == of["id"], "left").withColumn("part", F.coalesce("component_id", "node"))
    named = table(named.where("copies > 1 or component_id is not null").select("d1", "d2", "doc_id", "part"), "named")
    least_id = table(named.groupBy("part").agg(F.min("doc_id").alias("first")), "firsts")
    found = table(named.join(bounded(least_id), "part").select("d1", "d2", F.lit(True).alias("grouped"), "first"), "groups")
    out = every.drop("registers").join(bounded(found), ["d1", "d2"], "left")
    component = F.when(F.col("grouped"), F.col("first")).otherwise(F.col("doc_id"))
    out = out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    for x in (nodes, of, named, least_id):
        drop(x)
    return out
