"""Removal of repeated passages by a distributed merge sort of suffixes.

Which bytes lie in a string of `length` bytes that also starts earlier? Sorting every suffix would
move a hundred times the text, so suffixes are sorted that start at anchors: of each window of
`length` bytes, the place whose next `k` bytes hash lowest (k about a third of the length). Equal
windows have equal anchors at equal offsets, so two windows are equal where the suffixes from
their anchors agree to the window's end and the texts before them back to its start.

1. Anchors whose k bytes come up once can't be in a repeat and go no further. Those that come up
   twice in one batch are known at once; the others are counted by hash, a row a batch and hash,
   so a passage that a third of all documents share weighs no more than any other.
2. Each task sorts the suffixes (`length` bytes) at its other anchors. Of equal ones with equal
   texts before them the first stays; the rest are settled as repeats. The sorted run is cut at
   splitters and exchanged front-coded: common prefix with the one before, and what follows.
3. A task merges the runs of a key range by a loser tree that knows every candidate's common
   prefix with the last output: the longer prefix wins unseen, and only equal prefixes compare,
   from their end on. The merged order comes with all common prefixes, from which follow, for
   every offset, the anchors with equal windows; all but the first are repeats.
4. Repeats go back to their documents, which are cut there.

The text is shuffled once (steps 2 and 4 share it), by doc_id.

Defined results: a null text is empty, and texts shorter than `length` lose nothing; repeated
rows (id and text) are one document and give the same result each; rows of one id with
different texts share the ranges found in either; null ids are one id, the smallest; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

LENGTH = 100
#: Stands for a null id.
NO_ID = -(2**63)
#: Bytes of text worked on at a time, and anchors among which equal ones are found at once.
CHUNK, LOCAL = 400_000, 1_000_000
#: Suffixes in a run.
RUN = 150_000
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def kmer(length: int) -> int:
    """The largest power of two up to a third of the length."""
    return 1 << (max(1, length // 3).bit_length() - 1)


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(b: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in b (texts one after another, of those sizes) and hashes of the k bytes there."""
    k = kmer(length)
    w = length - k + 1
    if len(b) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, size = _TABLE[b], 1
    while size < k:
        h = h[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 2**64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h |= np.uint64(1)
    least = _sliding(h, w, np.minimum)
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(least)]
    least[np.arange(length, length + len(least)) > ends] = 0
    none = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((none, least, none)), w, np.maximum) == h)
    return at, h[at]


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, n = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(text.as_py() or b"")
            n += len(texts[-1])
            if n >= size:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of int32 values, cut at ends."""
    offsets = np.concatenate(([0], ends)).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def repeated_anchors(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, places (int32 in binary) of the anchors of rows (doc_id, text) whose k bytes come
    up again. A document has several rows."""
    names = ["key", "kind", "doc_id", "pos", "places"]

    def settle(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.concatenate(([True], s[1:] != s[:-1]))
        n = np.diff(np.concatenate((np.flatnonzero(first), [len(s)])))
        many = np.empty(len(h), bool)
        many[order] = np.repeat(n > 1, n)
        # Those that come up once here have yet to meet others; one of each of the rest tells them.
        rep = s[first][n > 1]
        one = ~many
        key = np.concatenate((h[one], rep)).view(np.int64)
        zero = np.zeros(len(rep), np.int64)
        kind = np.concatenate((np.zeros(int(one.sum()), np.int8), np.ones(len(rep), np.int8)))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(np.concatenate((doc[one], zero))), pa.array(np.concatenate((pos[one], zero)).astype(np.int32)), pa.nulls(len(key), pa.binary())], names)
        doc, pos = doc[many], pos[many]  # documents come one after another
        if len(doc):
            ends = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True]))) + 1
            ids = doc[ends - 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids * 0x9E3779B1), pa.array(np.full(len(ids), 2, np.int8)), pa.array(ids), pa.array(np.zeros(len(ids), np.int32)), _blobs(pos, ends)], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for ids, texts in _chunks(batches):
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            at, h = anchors(np.frombuffer(b"".join(texts), np.uint8), sizes, length)
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, at, side="right")
            found.append((h, np.array(ids, np.int64)[doc], at - (ends - sizes)[doc]))
            n += len(at)
            if n >= LOCAL:
                yield from settle(found)
                found, n = [], 0
        if n:
            yield from settle(found)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), _blobs(pos, np.arange(1, len(pos) + 1))], ["doc_id", "places"])

        last = None  # the last row met, which the next batch may repeat: key, kind, doc, pos, repeated
        for batch in batches:
            key, kind, doc, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            known = kind == 2
            if known.any():
                yield batch.select(["doc_id", "places"]).filter(pa.array(known))
                key, kind, doc, pos = key[~known], kind[~known], doc[~known], pos[~known]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if last is not None:
                if last[0] == key[0]:
                    again[0], last = True, (*last[:4], True)
                if last[4] and last[1] == 0:
                    yield out(np.array([last[2]]), np.array([last[3]]))
            last = (key[-1], kind[-1], doc[-1], pos[-1], bool(again[-1]))
            use = again & (kind == 0)
            use[-1] = False
            if use.any():
                yield out(doc[use], pos[use])
        if last is not None and last[4] and last[1] == 0:
            yield out(np.array([last[2]]), np.array([last[3]]))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = rows.mapInArrow(find, "key long, kind byte, doc_id long, pos int, places binary").repartition(n, "key").sortWithinPartitions("key")
    return moved.mapInArrow(pick, "doc_id long, places binary")


def front_code(strings: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted string with the one before, and all their rests."""
    n, width = strings.shape
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = strings[1:] != strings[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
    at = np.arange(width)
    return common, strings[(at >= common[:, None]) & (at < sizes[:, None])].tobytes()


def front_decode(common: list[int], sizes: list[int], rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for c, n in zip(common, sizes, strict=True):
        last = last[:c] + rest[at : at + n - c]
        at += n - c
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs of strings and their common prefixes. Returns, in order, the run of
    each string and its common prefix with the one before."""
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    at, now, known = [0] * leaves, [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - len(runs)), [0] * leaves

    def beats(a: int, b: int) -> bool:
        """Whether run a's string comes first; the loser's known prefix becomes that with the winner."""
        s, t = now[a], now[b]
        if s is None or t is None:
            return t is None
        ha, hb = known[a], known[b]
        if ha != hb:
            return ha > hb
        x, y = s[ha:], t[ha:]
        if x == y:
            known[b] = len(s)
            return True
        n = min(len(x), len(y))
        differ = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
        same = n - (differ.bit_length() + 7) // 8
        first = x < y
        known[b if first else a] = ha + same
        return first

    loser = [0] * leaves
    winner = list(range(leaves)) if leaves == 1 else [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        won = beats(a, b)
        winner[node], loser[node] = (a, b) if won else (b, a)
    best = winner[1] if leaves > 1 else 0
    order, prefix = [], []
    while now[best] is not None:
        order.append(best)
        prefix.append(known[best])
        strings, common = runs[best]
        at[best] += 1
        i = at[best]
        if i < len(strings):
            now[best], known[best] = strings[i], common[i]
        else:
            now[best] = None
        node = (best + leaves) >> 1
        while node:
            if not beats(best, loser[node]):
                best, loser[node] = loser[node], best
            node >>= 1
    return order, prefix


def repeats(doc: np.ndarray, pos: np.ndarray, prefix: np.ndarray, after: np.ndarray, before: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, least offset, largest offset) of the anchors with a window that starts earlier
    too. Members come in order of their suffixes; prefix: common with the one before; after,
    before: bytes there are from the anchor on and before it; left: those before it, backwards."""
    most = length - kmer(length)
    n = len(doc)
    by_left = np.argsort(left.view(f"S{most}").ravel() if most else np.zeros(n), kind="stable")
    differ = left[by_left][1:] != left[by_left][:-1]
    common = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), most))) if n > 1 else np.zeros(1, np.int64)
    by_start = np.lexsort((pos, doc))
    place = doc[by_start], pos[by_start]
    least, largest = np.full(n, length), np.full(n, -1)
    group = np.empty(n, np.int64)
    for offset in range(most + 1):
        fits = ((after >= length - offset) & (before >= offset))[by_start]
        group[by_left] = np.cumsum(common < offset)
        key = (np.cumsum(prefix < length - offset) * (n + 1) + group)[by_start][fits]
        if len(key) < 2:
            continue
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        rows = np.flatnonzero(fits)
        later = (place[0][rows[order]] != place[0][rows[head]]) | (place[1][rows[order]] != place[1][rows[head]])
        hit = by_start[rows[order[later]]]
        least[hit] = np.minimum(least[hit], offset)
        largest[hit] = offset
    hit = np.flatnonzero(largest >= 0)
    return hit, least[hit], largest[hit]


_RUNS = "key int, kind byte, id long, n int, doc binary, pos binary, after binary, common binary, rest binary, before binary, lefts binary"


def repeated_ranges(texts: DataFrame, marked: DataFrame, splitters: np.ndarray, length: int) -> DataFrame:
    """doc_id, start, end (bytes) of ranges to remove. texts: doc_id, text; marked: doc_id, places."""
    most = length - kmer(length)
    places = marked.groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    names = [x.split()[0] for x in _RUNS.split(", ")]
    pack = lambda b: len(b).to_bytes(4) + pa.compress(b, codec="zstd", asbytes=True)
    unpack = lambda b: pa.decompress(b[4:], int.from_bytes(b[:4]), codec="zstd", asbytes=True)
    types = [pa.int32(), pa.int8(), pa.int64(), pa.int32(), *[pa.binary()] * 7]

    def settled(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        blobs = [doc.astype(np.int64).tobytes(), start.astype(np.int32).tobytes(), end.astype(np.int32).tobytes()]
        row = [int(doc[0] % 1_000_003), 1, int(doc[0]), len(doc), *blobs, b"", b"", b"", b""]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    def run_of(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, pos, after, before, right, left = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pos, doc, before, left.view(f"S{most}").ravel(), after, right.view(f"S{length}").ravel()))
        doc, pos, after, before, right, left = (x[order] for x in (doc, pos, after, before, right, left))
        equal = (after[1:] == after[:-1]) & (before[1:] == before[:-1]) & (right[1:] == right[:-1]).all(axis=1) & (left[1:] == left[:-1]).all(axis=1)
        new = np.concatenate(([True], ~equal))
        head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        gone = (~new) & (after + before >= length) & ((doc != doc[head]) | (pos != pos[head]))
        if gone.any():
            yield settled(doc[gone], pos[gone] - before[gone], pos[gone] + after[gone])
        doc, pos, after, before, right, left = (x[new] for x in (doc, pos, after, before, right, left))
        ranges = np.searchsorted(splitters, right[:, :8].copy().view(">u8").ravel().astype(np.uint64), side="right")
        cuts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            common, rest = front_code(right[i:j], after[i:j])
            lefts = left[i:j][np.arange(most) < before[i:j, None]].tobytes()
            blobs = [doc[i:j].tobytes(), pos[i:j].astype(np.int32).tobytes(), after[i:j].astype(np.int16).tobytes(), common.astype(np.int16).tobytes(), pack(rest), before[i:j].astype(np.int16).tobytes(), pack(lefts)]
            row = [int(ranges[i]), 0, (int(doc[i]) * 1_000_003 + int(pos[i])) % 2**63, j - i, *blobs]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        ahead, back = np.arange(length, dtype=np.int32), np.arange(1, most + 1, dtype=np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column(2)[i].values
                if at is None or not len(at):
                    continue
                at = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in at]).astype(np.int64))
                text = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                at = at[at < len(text)]
                doc = batch.column(0)[i].as_py()
                for k in range(0, len(at), RUN):  # a text with many anchors comes in several runs
                    own = at[k : k + RUN]
                    lo, hi = max(0, int(own[0]) - most), min(len(text), int(own[-1]) + length)
                    padded = np.concatenate((np.zeros(most, np.uint8), text[lo:hi], np.zeros(length, np.uint8)))
                    place = own[:, None] - lo
                    found.append((np.full(len(own), doc), own, np.minimum(length, len(text) - own), np.minimum(most, own), padded[place + most + ahead], padded[place + most - back]))
                    n += len(own)
                    if n >= RUN:
                        yield from run_of(found)
                        found, n = [], 0
        if n:
            yield from run_of(found)

    def merged(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        runs, parts = [], []
        for r in rows:
            after, common, before = (np.frombuffer(r[x], np.int16).astype(np.int64) for x in ("after", "common", "before"))
            left = np.zeros((r["n"], most), np.uint8)
            left[np.arange(most) < before[:, None]] = np.frombuffer(unpack(r["lefts"]), np.uint8)
            runs.append((front_decode(common.tolist(), after.tolist(), unpack(r["rest"])), common.tolist()))
            parts.append((np.frombuffer(r["doc"], np.int64), np.frombuffer(r["pos"], np.int32).astype(np.int64), after, before, left))
        order, prefix = merge(runs)
        order = np.array(order)
        # Run r's strings come in their own order: the j-th time r wins is its j-th string.
        at = np.empty(len(order), np.int64)
        at[np.argsort(order, kind="stable")] = np.arange(len(order))
        doc, pos, after, before, left = (np.concatenate(x)[at] for x in zip(*parts, strict=True))
        hit, least, largest = repeats(doc, pos, np.array(prefix), after, before, left, length)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array((pos[hit] - largest).astype(np.int32)), pa.array((pos[hit] - least + length).astype(np.int32))], ["doc_id", "start", "end"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc"], np.int64)), pa.array(np.frombuffer(r["pos"], np.int32)), pa.array(np.frombuffer(r["after"], np.int32))], ["doc_id", "start", "end"])
                    continue
                if rows and rows[0]["key"] != r["key"]:
                    yield from merged(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from merged(rows)

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A left join, as the one that cuts the texts: both then read one exchange.
    runs = texts.join(places, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(sort, _RUNS)
    return runs.repartition(n, "key").sortWithinPartitions("kind", "key", "id").mapInArrow(combine, "doc_id long, start int, end int")


def splitters(rows: DataFrame, ranges: int) -> np.ndarray:
    """First eight bytes at which to cut the order of suffixes, from about 2,000 documents.
    They balance the ranges and don't bear on results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches, 10_000_000):
            b = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
            at = np.arange(0, len(b) - 8, 61)
            if len(at):
                values = np.sort(b[at[:, None] + np.arange(8)].copy().view(">u8").ravel().astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(values[:: max(1, len(values) // 2000)].view(np.int64))], ["v"])

    every = max(1, rows.count() // 2000)
    some = rows.where(F.pmod(F.xxhash64(F.lit("splitters"), "doc_id"), F.lit(every)) == 0)
    values = np.sort(np.array([r[0] for r in some.mapInArrow(run, "v long").collect()], np.int64).view(np.uint64))
    return np.unique(values[np.arange(1, ranges) * len(values) // ranges]) if len(values) else values


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    by_id = rows.repartition(n, "doc_id")
    ranges = repeated_ranges(by_id, repeated_anchors(rows, length), splitters(rows, 4 * n), length)
    cut = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                kept, at, removed, n_spans, last = [], 0, 0, 0, -1
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    start, end = max(s[0], 0), min(s[1], len(text))
                    if start > last:
                        n_spans += 1
                    if end > at:
                        kept.append(text[at : max(start, at)])
                        removed += end - max(start, at)
                        at = end
                    last = max(last, end)
                kept.append(text[at:])
                whole = b"".join(kept)
                out.append((i, len(text), removed, n_spans, hashlib.sha256(whole).hexdigest(), whole))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = by_id.join(cut, "doc_id", "left").select("doc_id", "text", "cut").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))).withColumnRenamed("doc_id", id_col)
