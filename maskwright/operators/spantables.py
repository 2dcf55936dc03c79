"""Spans as rows of tables: interval joins, matching of predicted and gold spans, labels of tokens.

Where `metrics.match` takes both sides as arrays of one row, these take tables of a row a span, of any size and with documents of any
length. Offsets are cut into slabs, so that no document is one task's: a span is compared within the slabs it touches.

Defined results: a null document is a document of its own; spans with a null end or start and empty ones overlap nothing (an
empty one can be matched exactly); rows that repeat are spans of their own; an empty table matches nothing. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .metrics import FAMILIES, normalize_category, rates

#: Characters of a bin of the interval join, and of a slab of the sweep.
BIN, SLAB = 64, 1 << 20


def _bins(start: str, end: str, width: int) -> Column:
    return F.expr(f"sequence({start} div {width}, greatest({start}, {end} - 1) div {width})")


def interval_join(left: DataFrame, right: DataFrame, doc: str, width: int = BIN, how: str = "inner") -> DataFrame:
    """Rows of both that share a document and overlap: all columns of left, and those of right as struct `other`. Both have `doc`, start and end. Each row
    goes to the bins that it touches; a pair is taken in the first bin that both touch, so it comes once. how: inner, or left for
    all rows of left."""
    l = left.withColumn("__key", F.sha2(F.to_json(F.struct(*left.columns)), 256)) if how == "left" else left  # noqa: E741  rows alike overlap alike
    lb = l.where("start < end").withColumn("__bin", F.explode(_bins("start", "end", width)))
    rb = right.where("start < end").select(F.col(doc).alias("__doc"), F.struct(*[c for c in right.columns]).alias("other"), F.explode(_bins("start", "end", width)).alias("__other_bin"))
    first = F.expr(f"__bin = greatest(start div {width}, other.start div {width})")
    meet = F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__bin") == F.col("__other_bin")) & (F.col("start") < F.col("other.end")) & (F.col("other.start") < F.col("end")) & first
    found = lb.join(rb, meet).drop("__bin", "__other_bin", "__doc")
    if how == "inner":
        return found
    none = l.join(found.select("__key"), "__key", "left_anti").withColumn("other", F.lit(None).cast(found.schema["other"].dataType))
    return found.unionByName(none).drop("__key")


def runs(spans: DataFrame, doc: str, width: int = SLAB) -> DataFrame:
    """spans with `run`: where the stretch of overlapping spans that the span is in begins. A sweep by start, of a slab at a time: what
    reaches over from earlier slabs comes from sums by slab."""
    of = spans.withColumn("__slab", F.expr(f"start div {width}"))
    before = W.partitionBy(doc, "__slab").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(doc).orderBy("__slab").rowsBetween(W.unboundedPreceding, -1)

    def carried(value: str, to: str) -> DataFrame:
        """What the slabs before each reach, at most; a row a slab."""
        return slabs.withColumn(to, F.max(value).over(earlier)).select(F.col(doc).alias("__doc"), F.col("__slab").alias("__own"), to)

    def carry(rows: DataFrame, held: DataFrame) -> DataFrame:
        return rows.join(held, F.col(doc).eqNullSafe(F.col("__doc")) & F.col("__slab").eqNullSafe(F.col("__own")), "left").drop("__doc", "__own")

    slabs = of.groupBy(doc, "__slab").agg(F.max("end").alias("__reach"))
    of = carry(of, carried("__reach", "__over")).withColumn("__end", F.greatest(F.max("end").over(before), "__over"))
    of = of.withColumn("__begin", F.when(F.col("__end").isNull() | (F.col("start") >= F.col("__end")), F.col("start"))).drop("__over", "__end")
    slabs = of.groupBy(doc, "__slab").agg(F.max("__begin").alias("__last"))
    upto = W.partitionBy(doc, "__slab").orderBy("start", "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    of = carry(of, carried("__last", "__from")).withColumn("run", F.greatest(F.max("__begin").over(upto), "__from"))
    return of.drop("__slab", "__begin", "__from")


def _greedy(exact: bool):
    """Settles the runs of a task's rows (document's hash, run, gold or not, order, start, end, category, document and what it goes with), which
    come by run."""

    def alike(a: str | None, b: str | None) -> bool:
        return a is not None and b is not None and (a == b or any(part in a and part in b for part in FAMILIES))

    def settle(predicted: list[tuple], gold: list[tuple]) -> Iterator[tuple]:
        gold.sort(key=lambda x: x[0])
        by_start = sorted(range(len(gold)), key=lambda i: gold[i][1])
        starts = [gold[i][1] for i in by_start]
        longest = max((g[2] - g[1] for g in gold), default=0)
        free = [True] * len(gold)
        for _, start, end, category in sorted(predicted, key=lambda x: x[0]):
            low, high = np.searchsorted(starts, [start if exact else start - longest, end if not exact else start + 1])
            near = sorted(i for i in by_start[low:high] if free[i] and alike(category, gold[i][3]))
            if exact:
                found = next((i for i in near if gold[i][1] == start and gold[i][2] == end), None)
            else:
                shared = [(min(end, gold[i][2]) - max(start, gold[i][1]), -i) for i in near]
                found = -max(shared)[1] if shared and max(shared)[0] > 0 else None
            if found is None:
                yield category, 0, 1, 0
            else:
                free[found] = False
                yield gold[found][3], 1, 0, 0
        for i, (_, _, _, category) in enumerate(gold):
            if free[i]:
                yield category, 0, 0, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, out, schema = None, ([], []), [], None

        def made() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], schema.field(i + 8).type) for i in range(len(schema) - 8)]
            cols += [pa.array([r[i - 4] for r in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays(cols, [*schema.names[8:], "category", "tp", "fp", "fn"])

        for batch in batches:
            schema = batch.schema
            for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                key = (r[0], r[1], *r[7:])
                if key != now:
                    out += [(*now[3:], *x) for x in settle(*sides)] if now else []
                    now, sides = key, ([], [])
                    if len(out) > 10_000:
                        yield made()
                        out = []
                sides[r[2]].append(r[3:7])
        if now:
            out += [(*now[3:], *x) for x in settle(*sides)]
            yield made()

    return run


def match_tables(predicted: DataFrame, gold: DataFrame, doc: str, order: str = "seq", mode: str = "overlap", by: list[str] | None = None) -> DataFrame:
    """*by, category, tp, fp, fn: a row for each predicted span and each gold span that none chose, as `metrics.match` gives them by document. Both tables
    have doc, `order` (the place of a span among its document's), start, end, category and the columns of `by`, which go with the document.

    Overlapping spans of a document form runs; predictions of one run can't want gold of another. Each run is settled in the predictions' order: the gold
    span that one overlaps most (the first of equals) and that is still free."""
    by = by or []
    side = lambda df, kind: df.select(*by, doc, F.lit(kind).alias("gold"), F.col(order).cast("long").alias("order"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), normalize_category(F.col("category")).alias("category"))
    rows = side(predicted, 0).unionByName(side(gold, 1))
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    bare = rows.where(~whole).select(*by, "category", F.lit(0).alias("tp"), (F.col("gold") == 0).cast("int").alias("fp"), F.col("gold").cast("int").alias("fn"))
    keyed = rows.where(whole).withColumn("__of", F.struct(doc, *by))  # spans of one document and group
    swept = runs(keyed, "__of").withColumn("__of", F.xxhash64(doc, F.col(doc).isNull(), *by))
    dealt = swept.withColumn("__doc", F.col(doc).cast("string")).repartition("__of", "run").sortWithinPartitions("__of", "run", "__doc", *by)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = dealt.select("__of", "run", "gold", "order", "start", "end", "category", "__doc", *by)
    shape = ", ".join([*(f"`{x}` {kinds[x]}" for x in by), "category string, tp int, fp int, fn int"])
    return named.mapInArrow(_greedy(mode == "exact"), shape).unionByName(bare)


def table_metrics(predicted: DataFrame, gold: DataFrame, doc: str, order: str = "seq", mode: str = "overlap", by: list[str] | None = None) -> DataFrame:
    """As `metrics.span_metrics`, over two tables of spans."""
    by = by or []
    sums = [F.sum(x).cast("long").alias(x) for x in ("tp", "fp", "fn")]
    per = match_tables(predicted, gold, doc, order, mode, by).groupBy(*by, "category").agg(*sums)
    return rates(per.unionByName(per.groupBy(*by).agg(*sums).withColumn("category", F.lit(None).cast("string"))))


def label_tokens(tokens: DataFrame, entities: DataFrame, doc: str, place: str = "i", order: str = "seq", width: int = BIN) -> DataFrame:
    """tokens (doc, `place` in the document, start, end) with `label`: B- where an entity starts, I- inside one or across an edge of one, O elsewhere, and
    null for tokens without text, as `labels.encode` gives them; of several entities the first by `order` counts."""
    # A document's first token begins its entity, as does one behind a token without text.
    before = W.partitionBy(doc, F.expr(f"{place} div 100000")).orderBy(place)
    edge = tokens.where(f"{place} % 100000 = 99999").select(F.col(doc).alias("__doc"), (F.col(place) + 1).alias("__next"), (F.col("start") == F.col("end")).alias("__edge"))
    rows = tokens.withColumn("__blank", F.lag(F.col("start") == F.col("end")).over(before))
    rows = rows.join(edge, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col(place) == F.col("__next")), "left").withColumn("__first", (F.col(place) == 0) | F.coalesce("__blank", "__edge", F.lit(False))).drop("__doc", "__next", "__blank", "__edge")
    met = interval_join(rows.select(doc, place, "start", "end", "__first"), entities.select(doc, "start", "end", "category", order), doc, width)
    met = met.where("start >= other.start or end <= other.end")  # a token that reaches beyond both ends isn't labelled
    inside = (F.col("start") >= F.col("other.start")) & (F.col("end") <= F.col("other.end"))
    begins = inside & ((F.col("start") == F.col("other.start")) | F.col("__first"))
    label = F.concat(F.when(begins, F.lit("B-")).otherwise(F.lit("I-")), F.col("other.category"))
    found = met.groupBy(F.col(doc).alias("__doc"), F.col(place).alias("__place")).agg(F.min_by(label, F.col(f"other.{order}")).alias("__label"))
    out = rows.join(found, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col(place) == F.col("__place")), "left")
    return out.withColumn("label", F.when(F.col("start") < F.col("end"), F.coalesce("__label", F.lit("O")))).drop("__doc", "__place", "__label", "__first")
