"""A linear sequence tagger: an averaged perceptron over words and their shapes, decoded by Viterbi.

Training runs in rounds. In each, every task goes over its own rows from the weights of the round before and returns what it changed; the
changes are averaged by how many texts each task had, in a shuffle by weight. The weights are hashed into 2^bits rows, so that model, broadcast and
what comes back to the driver have a size set by parameters and not by the corpus: 2^16 rows and 21 labels are 11 MB. The result
depends on how the rows lie in partitions (tasks are mixed), and on nothing else.

A window in which a wrong label should be another than O is corrected by `weight`, any other by 1, since most words are O.

Defined results: null and empty texts have no spans and teach nothing; a null array of spans counts as empty; spans that hold no word are passed over;
of spans that overlap, a word has the label of the first that holds it; repeated rows teach repeatedly; from an empty table comes a model that finds
nothing; other columns stay. Very long texts are cut into windows of WINDOW words, each read with EDGE words on either side.

Windows are hashed and decoded many at once. Training stays step by step: of windows decoded together those up to the first wrong one count, and the rest
are decoded again with the weights that it leaves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are labelled at once, and those read on either side of them.
WINDOW, EDGE = 1024, 32
#: Categories that a model can have at most.
MOST_CATEGORIES = 64
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


@dataclass(frozen=True)
class Model:
    """labels: O first; weights: 2^bits rows and then a row for each label before; a column a label."""

    labels: tuple[str, ...]
    weights: np.ndarray
    bits: int


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of letters, runs of digits, and other signs one by one, as (start, end) in code points."""
    return [m.span() for m in _TOKEN.finditer(text)]


@lru_cache(maxsize=100_000)
def _shape(word: str) -> str:
    """Xxx of a word: its kinds of signs, runs of more than three as three."""
    kinds = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", word)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", re.sub(r"\d", "0", kinds))


#: Words whose hashes are kept between batches, and windows that are hashed and decoded at once.
MOST_WORDS, AT_ONCE = 200_000, 256


def _zeros() -> np.ndarray:
    """[n, j, b]: CRC-32 of byte j being b, the others 0, after n further bytes of 0."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.empty((65, 4, 256), np.uint32)
    out[0] = [[b << 8 * j for b in range(256)] for j in range(4)]
    for n in range(1, 65):
        out[n] = (out[n - 1] >> 8) ^ table[out[n - 1] & 255]
    return out


_ZEROS = _zeros()


def _joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row, from that of each and the second's bytes: it is linear."""
    size = size.copy()
    while True:
        n = np.minimum(size, 64)
        first = _ZEROS[n, 0, first & 255] ^ _ZEROS[n, 1, first >> 8 & 255] ^ _ZEROS[n, 2, first >> 16 & 255] ^ _ZEROS[n, 3, first >> 24]
        size -= n
        if not size.any():
            return first ^ second


class _Words(dict):
    """Numbers of words, 0 for none, and in `table` what features are made of: CRC-32 and bytes of the word and its shape, and CRC-32 with what
    stands before and after it."""

    def __init__(self) -> None:
        self.table = np.zeros((1024, 17), np.int64)
        self[""]  # noqa: B018  its number is 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        low, shape = (x.encode("utf-8", "surrogatepass") for x in (word.lower(), _shape(word)))
        edges = [x.encode("utf-8", "surrogatepass") for x in (word.lower()[:3], word.lower()[-3:])]
        parts = (b"w " + low, b"s " + shape, b"a " + edges[0], b"z " + edges[1], b"p " + low, b"n " + low, b"q " + low + b" ", b"o " + low + b" ", b"t " + shape + b" ", b"u " + shape + b" ", b"v " + low + b" ", b"y " + low + b" ", low + b" ")
        self.table[n] = (crc32(low), len(low), crc32(shape), len(shape), *map(crc32, parts))
        return n


def _rows(windows: list[list[str]], bits: int, known: _Words) -> np.ndarray:
    """A row of hashed features for each word of windows: itself, its shape and edges, and the words around it within its window."""
    if len(known) > MOST_WORDS:
        known.clear()
        known.__init__()
    flat, at, end = [], [], 0
    for words in windows:
        flat += [0, 0, 0, *[known[w] for w in words]]
        at.append(np.arange(end + 3, end + 3 + len(words)))
        end += 3 + len(words)
    ids, at = np.array([*flat, 0, 0, 0]), np.concatenate(at) if at else np.zeros(0, np.int64)
    table = known.table
    own, low = table[ids[at]], {k: table[ids[at + k]] for k in (-3, -2, -1, 1, 2)}
    join = lambda first, of, i: _joined_crc(first, of[:, i], of[:, i + 1])
    # 0, 2: word and shape, each with its bytes behind it.
    third = _joined_crc(low[-3][:, 15], low[-2][:, 16], low[-2][:, 1] + 1)
    found = [
        np.full(len(at), crc32(b"bias")), own[:, 4], own[:, 5], own[:, 6], own[:, 7], low[-1][:, 8], low[1][:, 9],
        join(low[-2][:, 10], low[-1], 0), join(low[1][:, 11], low[2], 0), join(low[-1][:, 12], own, 2), join(own[:, 13], low[1], 2), join(low[-1][:, 14], own, 2), join(third, own, 2),
    ]
    return np.stack(found, axis=1).astype(np.int64) >> 32 - bits


def features(words: list[str], bits: int) -> np.ndarray:
    """`_rows` of one window."""
    return _rows([words], bits, _Words())


def gold_labels(at: list[tuple[int, int]], spans: list[dict], known: dict[str, int]) -> np.ndarray:
    """Numbers of the labels of tokens: B- where a span starts, I- within, by way of `labels` (known)."""
    out = np.zeros(len(at), dtype=np.int64)
    last = None
    ordered = [s for s in spans if s["start"] is not None and s["end"] is not None and s["category"] is not None and "B-" + s["category"] in known]
    ordered.sort(key=lambda s: (s["start"], -s["end"]))
    k, open_ = 0, None
    for i, (start, end) in enumerate(at):
        while k < len(ordered) and ordered[k]["start"] <= start:
            if open_ is None or open_["end"] <= ordered[k]["start"]:
                open_ = ordered[k]
            k += 1
        if open_ is not None and open_["end"] >= end:
            out[i] = known[("I-" if open_ is last else "B-") + open_["category"]]
            last = open_
    return out


def _decoded(emissions: np.ndarray, sizes: list[int], moves: np.ndarray, leads: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The best labels of sequences that stand one after the other, and (leads) by how much the best path beats those with another label at each
    place. emissions: a row a word; moves: from label (row) to label. The longest go first, so those that go on at a place are the first ones."""
    k, order = emissions.shape[1], sorted(range(len(sizes)), key=lambda j: -sizes[j])
    n, ends = sizes[order[0]], np.cumsum(sizes)
    on = np.bincount(sizes, minlength=n + 2)[::-1].cumsum()[::-1][1:].tolist()
    given = np.zeros((n, len(order), k), emissions.dtype)
    for place, j in enumerate(order):
        given[: sizes[j], place] = emissions[ends[j] - sizes[j] : ends[j]]
    ahead = given.copy()
    for i in range(1, n):
        c = on[i]
        ahead[i, :c] = (ahead[i - 1, :c, :, None] + moves).max(axis=1) + given[i, :c]
    # The path is traced, not read off place by place: equal paths must not be mixed.
    path, into = np.zeros((n, len(order)), np.int64), np.ascontiguousarray(moves.T)
    for i in range(n - 1, -1, -1):
        c, on_too = on[i], on[i + 1]
        path[i, :on_too] = (ahead[i, :on_too] + into[path[i + 1, :on_too]]).argmax(axis=1) if on_too else 0
        path[i, on_too:c] = ahead[i, on_too:c].argmax(axis=1)
    lead = np.zeros((n, len(order)), emissions.dtype)
    if leads and k > 1:
        back = np.zeros_like(given)
        for i in range(n - 2, -1, -1):
            c = on[i + 1]
            back[i, :c] = (moves + (given[i + 1, :c] + back[i + 1, :c])[:, None, :]).max(axis=2)
        total = ahead + back
        best = np.take_along_axis(total, path[:, :, None], 2)
        np.put_along_axis(total, path[:, :, None], -np.inf, 2)
        lead = best[:, :, 0] - total.max(axis=2)
    where = {j: place for place, j in enumerate(order)}
    return [path[: sizes[j], where[j]] for j in range(len(sizes))], [lead[: sizes[j], where[j]] for j in range(len(sizes))]


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_decoded` of one sequence."""
    (path,), (lead,) = _decoded(emissions, [len(emissions)], moves, True)
    return path, lead


def _legal(labels: tuple[str, ...]) -> np.ndarray:
    """0 where a label may follow another and a large negative number where not: I- follows B- or I- of its own category only."""
    out = np.zeros((len(labels), len(labels)), dtype=np.float32)
    for j, to in enumerate(labels):
        if to.startswith("I-"):
            out[[i for i, x in enumerate(labels) if x[2:] != to[2:] or x == "O"], j] = -1e6
    return out


def _windows(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(first word read, end of those read, first word labelled, end of those labelled)"""
    for at in range(0, n, WINDOW):
        end = min(n, at + WINDOW)
        yield max(0, at - EDGE), min(n, end + EDGE), at, end


def _batches(windows: Iterable[tuple], labels: int) -> Iterator[list[tuple]]:
    """Windows (words first) in lists, each small enough to be decoded at once."""
    held, most = [], 0
    for w in windows:
        longest = max(most, len(w[0]))
        if held and (len(held) >= AT_ONCE or (len(held) + 1) * labels * max(longest, labels) > 4_000_000):
            yield held
            held, longest = [], len(w[0])
        held.append(w)
        most = longest
    if held:
        yield held


def _teach(rows: Iterator[tuple[str, list[dict]]], model: Model, weight: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Texts read, weights afterwards, and their sum over all steps."""
    numbers = {x: i for i, x in enumerate(model.labels)}
    start, legal, known = 1 << model.bits, _legal(model.labels), _Words()
    now, weighed, steps, texts = model.weights.copy(), np.zeros_like(model.weights), 0, 0

    def windows() -> Iterator[tuple[list[str], np.ndarray]]:
        nonlocal texts
        for text, spans in rows:
            at = tokens(text)
            texts += bool(at)
            gold = gold_labels(at, spans, numbers)
            for first, until, _, _ in _windows(len(at)):
                yield [text[a:b] for a, b in at[first:until]], gold[first:until]

    size = 1
    for batch in _batches(windows(), len(model.labels)):
        every, ends = _rows([w for w, _ in batch], model.bits, known), np.cumsum([0, *[len(w) for w, _ in batch]])
        done = 0
        while done < len(batch):
            some = batch[done : done + size]
            paths, _ = _decoded(now[every[ends[done] : ends[done + len(some)]]].sum(axis=1), [len(w) for w, _ in some], now[start:] + legal, False)
            right = next((j for j, (path, (_, gold)) in enumerate(zip(paths, some, strict=True)) if (path != gold).any()), len(some))
            steps += right
            done += right
            if right == len(some):
                size = min(2 * size, AT_ONCE)
                continue
            size = max(1, right)
            steps += 1
            f, gold, path = every[ends[done] : ends[done + 1]], some[right][1], paths[right]
            done += 1
            wrong = np.flatnonzero(path != gold)
            step = np.float32(weight if gold[wrong].any() else 1.0)  # one for the whole window, so that rounds settle
            for labels, sign in ((gold, 1.0), (path, -1.0)):
                for target, by in ((now, 1.0), (weighed, float(steps - 1))):
                    np.add.at(target, (f[wrong], labels[wrong][:, None]), sign * by * step)
            moved = np.flatnonzero((path[1:] != gold[1:]) | (path[:-1] != gold[:-1]))
            for labels, sign in ((gold, 1.0), (path, -1.0)):
                for target, by in ((now, 1.0), (weighed, float(steps - 1))):
                    np.add.at(target, (start + labels[moved], labels[moved + 1]), sign * by * step)
    # What a step adds counts from that step on, so the mean is the end less each change times the steps before it.
    return texts, now, now - weighed / max(steps, 1)


def train(df: DataFrame, text_col: str = "text", spans_col: str = "spans", bits: int = 16, rounds: int = 4, weight: float = 5.0) -> Model:
    """A model of the categories in spans_col (array of struct with start, end, category). df is read once for the categories and once in each
    round; keep it cheap to read again."""
    found = df.select(F.explode(F.col(spans_col)["category"]).alias("c")).where("c is not null").distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    labels = ("O", *[f"{b}-{c}" for c in sorted(r["c"] for r in found) for b in ("B", "I")])
    n = len(labels)
    model = Model(labels, np.zeros(((1 << bits) + n, n), dtype=np.float32), bits)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(spans_col).alias("spans"))
    context, total = df.sparkSession.sparkContext, np.zeros_like(model.weights)
    for _ in range(rounds):
        held = context.broadcast(model)  # (2^bits + labels) x labels numbers

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            before = held.value
            pairs = ((t, s or []) for b in batches for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            texts, now, mean = _teach(pairs, before, weight)
            if not texts:
                return
            change, lasting = (now - before.weights).ravel(), (mean - before.weights).ravel()
            at = np.flatnonzero((change != 0) | (lasting != 0))
            schema = ["at", "change", "lasting", "texts"]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([0.0]), pa.array([0.0]), pa.array([texts], pa.int64())], names=schema)
            for i in range(0, len(at), 65_536):
                some = at[i : i + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(change[some].astype(np.float64) * texts), pa.array(lasting[some].astype(np.float64) * texts), pa.array(np.zeros(len(some), np.int64))], names=schema)

        sums = rows.mapInArrow(run, "at long, change double, lasting double, texts long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("change", "lasting", "texts")]).toPandas()
        held.unpersist()
        texts = int(sums["texts"].sum())
        if not texts:
            break
        sums = sums[sums["at"] >= 0]
        now, mean = model.weights.copy(), model.weights.copy()
        now.ravel()[sums["at"]] += (sums["change"] / texts).to_numpy(np.float32)
        mean.ravel()[sums["at"]] += (sums["lasting"] / texts).to_numpy(np.float32)
        total += mean
        model = Model(labels, now, bits)
    return Model(labels, total / max(rounds, 1), bits)


def label(texts: Iterable[str], model: Model, legal: np.ndarray, known: _Words) -> Iterator[list[tuple[int, int, str, float]]]:
    """start, end, label and confidence of each text's tokens."""
    start, texts = 1 << model.bits, iter(texts)
    while some := list(islice(texts, AT_ONCE)):
        out: list[list] = [[] for _ in some]
        windows = (([t[a:b] for a, b in at[first:until]], j, at, first, own, end) for j, t in enumerate(some) for at in [tokens(t)] for first, until, own, end in _windows(len(at)))
        for batch in _batches(windows, len(model.labels)):
            f = _rows([w[0] for w in batch], model.bits, known)
            paths, leads = _decoded(model.weights[f].sum(axis=1), [len(w[0]) for w in batch], model.weights[start:] + legal, True)
            for (_, j, at, first, own, end), path, lead in zip(batch, paths, leads, strict=True):
                sure = (1 / (1 + np.exp(-np.minimum(lead, 50.0)))).tolist()
                named = path.tolist()
                out[j] += [(*at[i], model.labels[named[i - first]], sure[i - first]) for i in range(own, end)]
        yield from out


def _joined(labelled: list[tuple[int, int, str, float]]) -> list[dict]:
    """Spans of labelled tokens. Where two windows disagree, an I- without its B- opens nothing."""
    out: list[dict] = []
    open_ = False
    for start, end, name, sure in labelled:
        if name.startswith("B-"):
            out.append({"start": start, "end": end, "category": name[2:], "confidence": sure})
        elif name != "O" and open_ and name[2:] == out[-1]["category"]:
            out[-1] |= {"end": end, "confidence": min(sure, out[-1]["confidence"])}
        open_ = name[2:] == out[-1]["category"] if out and name != "O" else False
    return out


def tag(df: DataFrame, model: Model, text_col: str = "text", out: str = "spans") -> DataFrame:
    """df with an array of spans (start, end, category, confidence: the least of its tokens', 0.5 to 1, by how far other labels are behind)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,category:string,confidence:double>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        legal, known = _legal(held.value.labels), _Words()
        for batch in texts:
            yield pd.Series([_joined(x) for x in label((t or "" for t in batch), held.value, legal, known)], dtype=object)

    return df.withColumn(out, run(F.col(text_col)))


def as_spans(found: Column, text: Column, source: str = "tagger") -> Column:
    """Found spans in the form that `detect.with_model_spans` takes."""
    whole = lambda s: F.struct(
        F.lit(None).cast("int").alias("seq"), s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"),
        F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["confidence"].alias("confidence"), F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("shifted_text"), F.lit(None).cast("string").alias("custom_token"),
    )
    return F.transform(found, whole)
