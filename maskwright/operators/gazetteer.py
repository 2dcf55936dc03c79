"""Names of a table of any size, found in texts.

Where a pattern holds its names itself (`patterns.CITY`), these come from a table: millions of cities, hospitals or persons. A text's word
sequences meet the names in a join by hash. A word starts sequences only if a bitmap says that a name may start so; the bitmap has a fixed size,
so what is broadcast doesn't grow with the names. Bits set by chance cost work and alter nothing.

A name stands where its words stand, written alike and between word edges, with white space of any length where it has some and its other signs
where it has those. Of names that begin at one place the longest counts; spans are taken from the left, none overlapping.

Defined results: null and empty texts have no spans; a null document is a document of its own, and rows that share an id count as one
text each only if the id tells them apart, so number rows that may repeat; names without a word, and null ones, stand nowhere; a name given
more than once has the first of its categories; empty tables give no spans; other columns don't matter. A very long text is one task's, which
reads it word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap of first words, as a power of two: 22 are half a megabyte.
BITS = 22
#: Rows of an Arrow batch that a task hands on.
ROWS = 4096

_WORD = re.compile(r"\w+")


def _words(name: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(name)]


def _phrase(text: str, start: int, end: int) -> str:
    return " ".join(text[start:end].split())


def _bit(count: int, first: str, bits: int) -> int:
    """Where the bitmap keeps names of so many words that begin with this one."""
    return crc32(f"{count} {first}".encode()) >> 32 - bits


def _known(names: DataFrame, name: str, category: str) -> DataFrame:
    """phrase, category, count (words), first (word); a row a name, from its first word to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"phrase": [], "category": [], "count": [], "first": []}
            for value, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = _words(value)
                if at:
                    for column, x in zip(out.values(), (_phrase(value, at[0][0], at[-1][1]), kind, len(at), value[slice(*at[0])]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("phrase", pa.string()), ("category", pa.string()), ("count", pa.int32()), ("first", pa.string())]))

    found = names.where(F.col(name).isNotNull()).select(F.col(name), F.col(category).cast("string")).mapInArrow(run, "phrase string, category string, count int, first string")
    return found.groupBy("phrase").agg(*[F.min(c).alias(c) for c in ("category", "count", "first")])


def _bitmap(known: DataFrame, bits: int) -> tuple[bytes, list[int]]:
    """The bitmap, and the numbers of words that names have. Each task sets bits of its own, and what comes to the driver is bounded by the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, own = set(), bytearray(1 << bits - 3)
        for batch in batches:
            for n, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lengths.add(n)
                at = _bit(n, first, bits)
                own[at >> 3] |= 1 << (at & 7)
        rows = [(0, i, own[i]) for i in range(len(own)) if own[i]] + [(1, n, 0) for n in lengths]
        for i in range(0, len(rows), ROWS):
            kind, at, byte = zip(*rows[i : i + ROWS], strict=True)
            yield pa.RecordBatch.from_pydict({"kind": kind, "at": at, "byte": byte}, pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("byte", pa.int32())]))

    rows = known.select("count", "first").mapInArrow(run, "kind int, at int, byte int").groupBy("kind", "at").agg(F.bit_or("byte").alias("byte")).collect()
    out = bytearray(1 << bits - 3)
    for r in rows:
        if r["kind"] == 0:
            out[r["at"]] = r["byte"]
    return bytes(out), sorted(r["at"] for r in rows if r["kind"] == 1)


def candidates(docs: DataFrame, doc: str, text: str, names: DataFrame, name: str = "name", category: str = "category", bits: int = BITS) -> DataFrame:
    """Every place of every name: doc, start, end, text, category; they may overlap."""
    known = _known(names, name, category)
    spark = docs.sparkSession
    bitmap, lengths = _bitmap(known, bits)
    held = spark.sparkContext.broadcast(bitmap)  # 2^bits bits, whatever the names

    kind = docs.schema[doc].dataType
    schema = f"{_quoted(doc)} {kind.simpleString()}, start int, end int, phrase string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = held.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows: list[tuple[int, int, int, str]] = []

            def flush():
                at, start, end, phrase = zip(*rows, strict=True)
                rows.clear()
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(phrase, pa.string())], names=[doc, "start", "end", "phrase"])

            for r in range(batch.num_rows):
                value = texts[r].as_py() or ""
                at = _words(value)
                for i, (start, stop) in enumerate(at):
                    first = value[start:stop]
                    for n in lengths:
                        if i + n > len(at):
                            break
                        bit = _bit(n, first, bits)
                        if seen[bit >> 3] >> (bit & 7) & 1:
                            end = at[i + n - 1][1]
                            rows.append((r, start, end, _phrase(value, start, end)))
                    if len(rows) >= ROWS:
                        yield flush()
            if rows:
                yield flush()

    sought = docs.where(F.col(text).isNotNull()).select(doc, F.col(text).alias("__text")).mapInArrow(run, schema)
    return sought.join(known.select("phrase", "category"), "phrase").select(doc, "start", "end", F.col("phrase").alias("text"), "category")


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def leftmost(spans: DataFrame, doc: str) -> DataFrame:
    """Of spans, from the left: the longest that begins at a place, none overlapping. Documents are dealt by hash and read in order, with one number kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = object(), 0
        for batch in batches:
            keep = []
            for d, start, end in zip(*(batch.column(c).to_pylist() for c in (doc, "start", "end")), strict=True):
                if d != last:
                    last, until = d, 0
                keep.append(start >= until)
                until = end if start >= until else until
            yield batch.filter(pa.array(keep, pa.bool_()))

    return spans.repartition(F.col(doc)).sortWithinPartitions(doc, "start", F.desc("end"), "category").mapInArrow(run, spans.schema)


def find_names(docs: DataFrame, doc: str, text: str, names: DataFrame, name: str = "name", category: str = "category", bits: int = BITS) -> DataFrame:
    """doc, start, end, text (white space as one blank), category: where names of the table stand. Offsets count code points; ends are exclusive."""
    return leftmost(candidates(docs, doc, text, names, name, category, bits), doc)
