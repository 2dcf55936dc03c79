"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order shuffled by a hash of their ids and texts, are cut into blocks of
`block` units of size. With weight w, a source's block j is released at slot floor(j / w) and
due at slot ceil((j + 1) / w). One block runs a slot; earliest deadline first among the released
ones meets every deadline, so at any slot t each source has run within one block of w t.

Weights are exact fractions, so the schedule repeats after as many slots as their common denominator
says. The driver works out one period, or what is needed of it, slot by slot, and hands it on
in parts of PART_SLOTS; every block's slot follows from its number alone. Weights that aren't given are
shares of all characters to the power alpha, in units of 1 / `grid`. A block's number comes from the sizes
before it: sums by (source, range of hashes), whose number grows with the table, then a running
sum within each range. No task sees a whole source. The driver holds a few numbers a source.

When a source has nothing left, a new epoch begins: the others go on in proportion to their weights, until
all blocks have slots. `in_mix` marks the documents of the first epoch, in which all weights hold.

Defined results: a null source is a source of its own; a null or empty text has size zero and
runs with the block its predecessor is in; a text longer than a block fills several; rows that
repeat an id or a text count each; sources without a target weight, of weight zero, or without a
character get null slots and aren't in the mix; weighted sources that the table lacks are passed over; an empty table
gives no rows; other columns pass through, except that mix_block, mix_slot, mix_rank and in_mix are replaced.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, scratch, table

BLOCK, GRID, PART_ROWS, PART_SLOTS = 100_000, 10_000, 10_000, 200_000
MIX = ("mix_block", "mix_slot", "mix_rank", "in_mix")
_SLOTS = "__name string, __epoch int, __at long, __slot long"


def quotas(weights: dict) -> dict:
    """Slots of each source in the shortest period that holds the weights exactly."""
    exact = {k: Fraction(str(v)) if isinstance(v, float) else Fraction(v) for k, v in weights.items() if v > 0}
    scale = lcm(*[x.denominator for x in exact.values()])
    units = {k: int(x * scale) for k, x in exact.items()}
    by = gcd(*units.values())
    return {k: n // by for k, n in units.items()}


def shares(sizes: dict, alpha: float, grid: int = GRID) -> dict:
    """Sizes to the power alpha in whole units, `grid` in all, by largest remainder, one each at least."""
    grid = max(grid, 8 * len(sizes))
    powers = {k: float(v) ** alpha for k, v in sizes.items()}
    total, rest = sum(powers.values()), grid - len(sizes)
    exact = {k: v / total * rest for k, v in powers.items()}
    out = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))[: grid - sum(out.values())]:
        out[k] += 1
    return out


def schedule(quota: dict) -> Iterator[tuple[object, int]]:
    """(source, block) by slot, for one period."""
    period = sum(quota.values())
    waiting = [(0, i, 0) for i in range(len(quota))]
    names = sorted(quota, key=str)
    ready: list[tuple[int, int, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // quota[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        yield names[i], j
        if j + 1 < quota[names[i]]:
            heapq.heappush(waiting, ((j + 1) * period // quota[names[i]], i, j + 1))


def epochs(quota: dict, blocks: dict, emit: Callable[[object, int, int, int], None]) -> list[tuple[dict, int, dict]]:
    """(quotas, first slot, first block of each source) of each epoch. blocks: each source's number of blocks, one
    at least. emit is called with (source, epoch, block, slot) for the slots of each epoch's period that come up,
    counted from the epoch's start."""
    left, start, done, out = dict(blocks), 0, Counter(), []
    while left:
        by = gcd(*[quota[k] for k in left])
        own = {k: quota[k] // by for k in left}
        period, run, ends = sum(own.values()), Counter(), {}
        out.append((own, start, {k: done[k] for k in left}))
        for t, (k, j) in enumerate(schedule(own)):
            if j >= left[k]:  # nothing is left of it within the first period
                stop = t
                break
            emit(k, len(out) - 1, j, t)
            run[k] += 1
            if j == left[k] % own[k]:
                ends[k] = t
        else:
            stop = min(left[k] // own[k] * period + t for k, t in ends.items())
            run = Counter({k: stop // period * q for k, q in own.items()})
            run.update(k for k, _ in islice(schedule(own), stop % period))
        start += stop
        done.update(run)
        left = {k: n - run[k] for k, n in left.items() if n > run[k]}
    return out


def plan(spark: SparkSession, quota: dict, blocks: dict) -> tuple[DataFrame, DataFrame, int]:
    """A row a source (name, blocks, first blocks and other facts of its epochs), a row for each
    slot of the epochs' periods, and where the first epoch ends."""
    path, waiting = scratch(spark, "slots"), []

    def write() -> None:
        spark.createDataFrame(waiting, _SLOTS).coalesce(1).write.mode("append").parquet(path)
        waiting.clear()

    def emit(*row: object) -> None:
        waiting.append(row)
        if len(waiting) >= PART_SLOTS:
            write()

    found = epochs(quota, blocks, emit)
    write()
    rows = []
    for k, n in blocks.items():
        own = [(froms[k], e, q[k], sum(q.values()), start) for e, (q, start, froms) in enumerate(found) if k in q]
        rows.append((k, n, [x[0] for x in own], [x[1:] for x in own]))
    of = spark.createDataFrame(rows, "__name string, __blocks long, __froms array<long>, __infos array<struct<epoch:int,quota:long,period:long,start:long>>")
    return table(of, "sources"), spark.read.schema(_SLOTS).parquet(path), found[1][1] if len(found) > 1 else 2**62


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, grid: int = GRID, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """docs with mix_block, mix_slot, mix_rank (order in the block) and in_mix. weights: by
    source; None: each source's share of all characters to the power alpha."""
    spark = docs.sparkSession
    parts = max(1, -(-docs.count() // PART_ROWS))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    part = F.least(F.floor(F.shiftrightunsigned(hashed, 1) / F.lit(2.0**63) * parts), F.lit(parts - 1)).cast("long")  # in order of the hashes as unsigned numbers
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    marked = docs.drop(*MIX).withColumns({"__name": name, "__hash": hashed, "__part": part, "__size": size})
    sums = table(marked.groupBy("__name", "__part").agg(F.sum("__size").alias("sum")), "sums")
    sizes = sums.groupBy("__name").agg(F.sum("sum").alias("n")).where("n > 0")
    if weights is not None:
        weights = {"null" if k is None else f"={k}": v for k, v in weights.items() if v > 0}
        asked = spark.createDataFrame([(k,) for k in weights], "__name string")
        sizes = sizes.join(F.broadcast(asked), "__name", "left_semi")  # as many as the caller gave
    totals = {r[0]: r[1] for r in sizes.orderBy("__name").collect()}  # a row a source
    quota = quotas({k: weights[k] for k in totals} if weights is not None else shares(totals, alpha, grid)) if totals else {}
    of, slots, whole = plan(spark, quota, {k: -(-n // block) for k, n in totals.items()})
    before = F.sum("sum").over(W.partitionBy("__name").orderBy("__part")) - F.col("sum")
    offsets = table(sums.select("__name", "__part", before.alias("__before")), "offsets")
    order = W.partitionBy("__name", "__part").orderBy(F.shiftrightunsigned("__hash", 1), "__hash", id_col, F.xxhash64(F.col(text_col)))
    placed = marked.join(bounded(offsets), ["__name", "__part"])
    placed = placed.withColumn("__sum", F.col("__before") + F.sum("__size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("__size"))
    placed = placed.join(bounded(of), "__name", "left")
    # A text of size zero behind a source's last block is in that block.
    placed = placed.withColumn("mix_block", F.least(F.floor(F.col("__sum") / block).cast("long"), F.col("__blocks") - 1))
    placed = placed.withColumn("__e", F.expr("size(filter(__froms, x -> x <= mix_block)) - 1")).withColumn("__info", F.expr("get(__infos, __e)")).withColumn("__j", F.expr("mix_block - get(__froms, __e)"))
    placed = placed.withColumns({"__epoch": F.col("__info.epoch"), "__at": F.expr("__j % __info.quota")}).join(bounded(slots), ["__name", "__epoch", "__at"], "left")
    placed = placed.withColumn("mix_slot", F.expr("__info.start + __j div __info.quota * __info.period + __slot")).withColumn("mix_rank", F.col("__sum") - F.col("mix_block") * block)
    placed = placed.withColumn("in_mix", F.coalesce(F.col("mix_slot") < whole, F.lit(False)))
    return placed.select(*[c for c in docs.columns if c not in MIX], *MIX)
