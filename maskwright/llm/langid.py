"""Language identification by words first, then shorter and shorter character n-grams.

A known word scores its log frequency in each language. An unseen word is cut, from its start,
into the longest character n-grams known (five down to one, with marks at the word's ends),
and scores their log frequencies. The language with the largest sum wins, with its share of
the posterior as score. Words are runs of letters (Unicode's letter categories; digits, number
signs and marks are none).

The model is fitted on about `max_docs` labelled documents a language, chosen by a hash of
their ids; every word and n-gram of theirs counts, at whatever frequency from `least` on. Words and
n-grams are known by 64-bit hashes of their characters, and only counts that aren't zero are
held (some 20 bytes each), so a worker needs a few MB besides the texts, which it goes through
in pieces of about PIECE characters.

Defined results: a null text or one without letters is `und` with score 0, and so is every
text if there is nothing to learn from; texts that fit all languages alike get the most
frequent one; null ids and languages are not learned from; repeated rows get the same answer; an empty
table gives no rows; other columns pass through, except that `lang_pred` and `lang_score` are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .hashing import mix, powers, runs

MAX_DOCS, LONGEST, SMOOTH = 4_000, 5, 0.5
PIECE = 250_000
#: Where a long text may be cut: characters that are in no word.
GAP = re.compile(r"[\W\d_]")


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of letters."""
    return runs(codes, _letters())


def grams(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """The n-grams of the words between marks, each word's places after those of the one before:
    where each word's places begin, how many there are, and for each n (n, hash, whether
    the word reaches that far) by place."""
    size = end - start + 2
    last = np.cumsum(size)
    first = last - size
    place = np.arange(last[-1] if len(last) else 0)
    marked = codes[np.clip(np.repeat(start - 1 - first, size) + place, 0, len(codes) - 1)] if len(place) else codes[:0]
    marked[first], marked[last - 1] = ord("<"), ord(">")
    room, value = np.repeat(last, size) - place, mix(marked.astype(np.uint64) + np.uint64(1))

    def run() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        up, total = powers(0)[0], np.zeros(len(place), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(place) >= n:
                total[: len(place) - n + 1] += value[n - 1 :] * up[n]
            yield n, mix(total + np.uint64(n)), room >= n

    return first, size, run()


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts in lower case, about PIECE characters at a time. A longer text comes in
    several pieces, cut between words."""
    rows, parts, n = [], [], 0
    for row, text in enumerate(texts):
        text, i = (text or "").lower(), 0
        while i < len(text):
            j = len(text)
            if j - i > PIECE:
                found = GAP.search(text, i + PIECE)
                j = found.start() if found else j
            rows.append(row)
            parts.append(text[i:j])
            n += j - i
            i = j
            if n >= PIECE:
                yield rows, parts
                rows, parts, n = [], [], 0
    if rows:
        yield rows, parts


def count_items(text: str) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(True, hashes, counts) of the words and (False, hashes, counts) of their n-grams."""
    codes = codes_of(text)
    start, end, key = words(codes)
    key, at, n = np.unique(key, return_index=True, return_counts=True)
    yield True, key, n
    _, size, found = grams(codes, start[at], end[at])
    weight = np.repeat(n, size)
    every = [(h[fits], weight[fits]) for _, h, fits in found]
    key, inverse = np.unique(np.concatenate([x[0] for x in every]), return_inverse=True)
    yield False, key, np.bincount(inverse, np.concatenate([x[1] for x in every]), len(key)).astype(np.int64)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, least: int = 1) -> dict:
    """The model. Rows without an id, a language or a text are not learned from."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(docs)
    if docs:
        share = F.create_map(*[F.lit(x) for lang, n in docs.items() for x in (lang, min(1.0, max_docs / n))])[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lang: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
            for _, parts in pieces(texts):
                for word, key, n in count_items("\n".join(parts)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), word)), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "item", "n"])

        waiting: dict[str, list[str]] = defaultdict(list)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting[lang].append(text)
                if sum(map(len, waiting[lang])) >= PIECE:
                    yield from out(lang, waiting.pop(lang))
        for lang, texts in waiting.items():
            yield from out(lang, texts)

    ship(spark)
    counts = rows.select("text", "lang").repartition(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(count, "lang string, word boolean, item long, n long")
    counts = counts.groupBy("word", "item", "lang").agg(F.sum("n").alias("n"))
    if least > 1:
        known = counts.groupBy("word", "item").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("word", "item")
        counts = counts.join(known, ["word", "item"], "left_semi")
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1 if langs else F.lit(0)
    got = counts.select("word", "item", number.cast("int").alias("lang"), "n").toArrow()  # what the sample holds
    word, item, lang, n = (got.column(i).to_numpy() for i in range(4))
    model: dict = {"langs": langs, "prior": np.log(np.array([docs[x] for x in langs], float) / max(1, sum(docs.values())))}
    for name, own in (("words", word), ("grams", ~word)):
        model[name] = Items.of(item[own].view(np.uint64), lang[own], n[own], len(langs))
    return model


class Items:
    """Hashes of words or n-grams, sorted, and what each adds to a language's sum beyond what
    any known item adds."""

    def __init__(self, key: np.ndarray, first: np.ndarray, lang: np.ndarray, gain: np.ndarray, base: np.ndarray) -> None:
        self.key, self.first, self.lang, self.gain, self.base = key, first, lang, gain, base

    @classmethod
    def of(cls, item: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int) -> Items:
        order = np.lexsort((lang, item))
        item, lang, n = item[order], lang[order], n[order]
        key, first = np.unique(item, return_index=True)
        total = np.bincount(lang, n, langs) + SMOOTH * len(key)
        return cls(key, np.concatenate((first, [len(item)])).astype(np.int64), lang.astype(np.int32), np.log1p(n / SMOOTH).astype(np.float32), np.log(SMOOTH / np.maximum(total, SMOOTH)))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it isn't known."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def add(self, total: np.ndarray, row: np.ndarray, item: np.ndarray) -> None:
        """Adds the items' log frequencies to total[row]."""
        rows, langs = total.shape
        total += np.bincount(row, minlength=rows)[:, None] * self.base
        owner, at = expand(self.first, item)
        total += np.bincount(row[owner] * langs + self.lang[at], self.gain[at], rows * langs).reshape(rows, langs)


def expand(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists whose borders are `first`: (place in which, place in the lists) of all
    members of the lists asked for."""
    size = first[which + 1] - first[which]
    owner = np.repeat(np.arange(len(which)), size)
    return owner, np.arange(len(owner)) + np.repeat(first[which] - (np.cumsum(size) - size), size)


def backoff(known: Items, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams each word is cut into: borders of the words' lists, and their members."""
    first, size, found = grams(codes, start, end)
    places = int(size.sum())
    item, step = np.full(places, -1), np.ones(places, np.int64)
    for n, h, fits in found:
        at = known.find(h)
        use = fits & (at >= 0)
        item[use], step[use] = at[use], n
    follow, used, borders = step.tolist(), [], [0]
    for i, n in zip(first.tolist(), size.tolist(), strict=True):
        stop = i + n
        while i < stop:
            used.append(i)
            i += follow[i]
        borders.append(len(used))
    members = item[np.array(used, np.int64)]
    kept = np.concatenate(([0], np.cumsum(members >= 0)))
    return kept[np.array(borders)], members[members >= 0]


def score(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by text and language, and the number of each text's words."""
    total, n_words = np.tile(model["prior"], (len(texts), 1)), np.zeros(len(texts), np.int64)
    for rows, parts in pieces(texts):
        codes = codes_of("\n".join(parts))
        start, end, key = words(codes)
        ends = np.cumsum([len(x) + 1 for x in parts])
        of = np.searchsorted(ends, start, side="right")
        found, part = model["words"].find(key), np.zeros((len(rows), len(model["langs"])))
        model["words"].add(part, of[found >= 0], found[found >= 0])
        new = np.flatnonzero(found < 0)
        if len(new):
            _, at, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            borders, members = backoff(model["grams"], codes, start[new[at]], end[new[at]])
            owner, place = expand(borders, inverse)
            model["grams"].add(part, of[new[owner]], members[place])
        np.add.at(total, rows, part)
        np.add.at(n_words, rows, np.bincount(of, minlength=len(rows)))
    return total, n_words


def predict(model: dict, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, its share of the posterior) of each text."""
    if not model["langs"]:
        return [("und", 0.0)] * len(texts)
    total, n_words = score(model, texts)
    best = total.argmax(axis=1)
    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [(model["langs"][b], s) if n else ("und", 0.0) for b, s, n in zip(best.tolist(), share.tolist(), n_words.tolist(), strict=True)]


def predictor(df: DataFrame, model: dict) -> Column:
    """A function of a text column: struct(lang, score)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(predict(shared.value, batch.tolist()), columns=["lang", "score"])

    return run


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score."""
    out = docs.drop("lang_pred", "lang_score").withColumn("__found", predictor(docs, model)(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("__found.lang"), "lang_score": F.col("__found.score")}).drop("__found")
