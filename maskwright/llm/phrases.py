"""Collocations: phrases of two to LONGEST words by how much oftener they come up than their parts would by chance.

Counts come from multikey three-way quicksort of suffix pointers. Every place in the texts is a suffix, its letters being words, cut behind
LONGEST words and where a piece ends. Suffixes are routed globally by their leading two words; a task then
sorts pointers to its suffixes by one word at a time: those below a pivot, equal to it and above it. The equal part's
size is the count of the phrase up to there, and only that part goes on to the next word. A part with
fewer than `least` occurrences holds no phrase to report and is abandoned, whichever it is.

Before they are routed, suffixes go whose leading words can't be frequent: words are counted first, then pairs of
frequent words; both sets are known to the tasks as bitmaps of fixed size (4 and 8 MB, whatever the corpus), whose chance hits cost
work and change no count. Equal suffixes of a task travel as one with their number, those of a bucket of leading pairs as one block. A pair that comes up more than
`HOT` times, and over 1/50,000 of all words, is dealt out by its whole suffixes; their counts are then sums over tasks.

Defined results: see `mine` for the rules. Null and empty texts have no words, a null language is `und`; texts of any length count whole, and
rows that repeat an id or a text count each; ids are not read, nor are other columns; an empty table gives no rows. Words are
compared by 64-bit hash within a task and as text between tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop, ship, table
from .hashing import PIECE, mix, runs

LEAST, LONGEST, TOP = 100, 5, 2000
#: Occurrences of a pair from which its suffixes are dealt out.
HOT = 2**18
#: Bits of the bitmaps of frequent words and pairs.
WORD_BITS, PAIR_BITS = 25, 26
#: Text a task works on at a time, in bytes; occurrences of suffixes in a bucket, which is sorted at a time.
CHUNK, SORTED = 32_000_000, 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What ends a piece, and what ends a word.
ENDS = np.array([chr(i) in ".,;:!?\n\v\f\r" for i in range(256)])
INSIDE = ~ENDS & np.array([chr(i) not in " \t" for i in range(256)])


class Words:
    """The words of texts of one language: hash, and whether the next word stands in the same piece."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        self.lang, self.text = lang, b"\n".join(texts).lower()  # a line's end also ends a piece
        starts, hashes, pieces, i, ended = [], [], [], 0, 0
        while i < len(self.text):
            j = min(len(self.text), i + PIECE)
            while j < len(self.text) and INSIDE[self.text[j]]:
                j += 1
            codes = np.frombuffer(self.text[i:j], np.uint8)
            start, _, h = runs(codes, INSIDE)
            ends = np.cumsum(ENDS[codes], dtype=np.int64)
            starts.append(start + i)
            hashes.append(h)
            pieces.append(ends[start] + ended)
            ended += int(ends[-1])
            i = j
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.h, piece = join(starts, np.int64), join(hashes, np.uint64), join(pieces, np.int64)
        self.next = np.append(piece[1:] == piece[:-1], False)[: len(piece)]

    def __len__(self) -> int:
        return len(self.h)

    def spelt(self, at: np.ndarray) -> pa.Array:
        """The words at the places given."""
        bounds = np.append(self.start, len(self.text)).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(bounds), pa.py_buffer(self.text)])
        found = every.take(pa.array(at)).cast(pa.binary())
        return pa.array([x.rstrip(b" \t.,;:!?\n\v\f\r") for x in found.to_pylist()], pa.binary())

    def word_keys(self) -> np.ndarray:
        return mix(self.h ^ _named(self.lang))

    def pair_keys(self) -> np.ndarray:
        """A key for each word and the next."""
        return mix(mix(self.h[:-1] + _ODD) * _ODD + self.h[1:] ^ _named(self.lang))


def _named(lang: str) -> np.uint64:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(lang.encode(), 1))


def _each(use: Callable[[Words], pa.RecordBatch]) -> Callable:
    """Hands `use` the words of every language, of some CHUNK bytes at a time. Rows are lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append(text.as_py())
                size += len(held[lang][-1])
                if size > CHUNK:
                    yield from (use(Words(*x)) for x in held.items())
                    held, size = {}, 0
        yield from (use(Words(*x)) for x in held.items())

    return run


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """The set of keys (key) as bits, 2^bits of them: bit key mod 2^bits."""
    at = F.expr(f"(key & {2**bits - 1}L) + 1")
    parts = keys.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = np.zeros(2**bits // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most 2^bits / 32768 rows of 4 KB
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def count_words(texts: DataFrame, least: int) -> DataFrame:
    """lang, word, n of the frequent words, and of all words of a language together (word null); key is what `Words.word_keys` gives."""

    def run(words: Words) -> pa.RecordBatch:
        _, first, n = np.unique(words.h, return_index=True, return_counts=True)
        key = words.word_keys()[first].view(np.int64)
        cols = [pa.array([words.lang] * (len(n) + 1), pa.string()), pa.array([None, *words.spelt(first).to_pylist()], pa.binary()), pa.array([0, *key.tolist()]), pa.array([len(words), *n.tolist()])]
        return pa.RecordBatch.from_arrays(cols, ["lang", "word", "key", "n"])

    found = texts.mapInArrow(_each(run), "lang string, word binary, key long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("key").alias("key"))
    return table(found.where(F.col("word").isNull() | (F.col("n") >= least)).withColumn("word", F.col("word").cast("string")), "words")


def count_pairs(texts: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """key, n of the frequent pairs of frequent words."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(words: Words) -> pa.RecordBatch:
        often = _in(shared.value, words.word_keys())
        key, n = np.unique(words.pair_keys()[(words.next & often)[:-1] & often[1:]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return table(texts.mapInArrow(_each(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")


def suffixes(texts: DataFrame, frequent: np.ndarray, pairs: np.ndarray, hot: np.ndarray, longest: int, buckets: int) -> DataFrame:
    """lang, bucket, dealt, block, n: the suffixes that begin with a frequent pair, as far as their pairs are frequent; equal ones of a task once. Those of a bucket
    travel as one block, a suffix a line, and n has how often each comes up. hot: keys of pairs, sorted, whose suffixes go to buckets one by one."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, pairs, hot))

    def run(words: Words) -> pa.RecordBatch:
        often, keys = _in(shared.value[0], words.word_keys()), words.pair_keys()
        lead = np.zeros(len(words) + longest, bool)
        lead[: len(keys)] = (words.next & often)[:-1] & often[1:] & _in(shared.value[1], keys)
        at = np.flatnonzero(lead)
        length, live, mark = np.ones(len(at), np.int64), np.ones(len(at), bool), words.h[at]
        for k in range(1, longest):
            live &= lead[at + k - 1]
            mark = np.where(live, mix(mark * _ODD + words.h[np.where(live, at + k, 0)]), mark)
            length += live
        _, first, n = np.unique(mark, return_index=True, return_counts=True)
        at, length = at[first], length[first]
        places, found = np.unique(np.concatenate([at + k for k in range(longest)])[np.concatenate([length > k for k in range(longest)])], return_inverse=True)
        spelt, out, used = words.spelt(places), [], 0
        for k in range(longest):
            there = length > k
            of = np.zeros(len(at), np.int64)
            of[there] = found[used : used + there.sum()]
            used += int(there.sum())
            out.append(spelt.take(pa.array(of, mask=~there)))
        joined = pc.binary_join_element_wise(*out, pa.scalar(b" ", pa.binary()), null_handling="skip") if len(at) else pa.array([], pa.binary())
        key, mark = keys[at], mark[first]
        spot = np.minimum(np.searchsorted(shared.value[2], key.view(np.int64)), max(0, len(shared.value[2]) - 1))
        dealt = shared.value[2][spot] == key.view(np.int64) if len(shared.value[2]) else np.zeros(len(at), bool)
        bucket = (mix(np.where(dealt, mark, key)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((dealt, bucket))
        bucket, dealt, n, joined = bucket[order], dealt[order], n[order].astype(np.int64), joined.take(pa.array(order))
        starts = np.flatnonzero(np.diff(2 * bucket + dealt, prepend=-1))
        bounds = np.append(starts, len(order))
        lines = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), joined)
        sizes = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(n)])
        cols = [pa.array([words.lang] * len(starts), pa.string()), pa.array(bucket[starts]), pa.array(dealt[starts]), pc.binary_join(lines, pa.scalar(b"\n", pa.binary())), sizes]
        return pa.RecordBatch.from_arrays(cols, ["lang", "bucket", "dealt", "block", "n"])

    return texts.mapInArrow(_each(run), "lang string, bucket long, dealt boolean, block binary, n binary")


def frequent_prefixes(letters: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to suffixes; letters[i] are the letters of suffix i, -1 behind its end, and n[i] how often
    it comes up. Yields a suffix, a length of two letters or more and the count of the suffixes that begin with these letters, where it is at least `least`."""
    pointers = np.arange(len(n))
    parts = [(0, len(n), 0)]
    while parts:
        low, high, depth = parts.pop()
        own = pointers[low:high].copy()
        if high - low == 1:  # nothing is left to sort
            total = int(n[own[0]])
            if total >= least:
                yield from ((int(own[0]), k, total) for k in range(max(2, depth + 1), 1 + int((letters[own[0]] >= 0).sum())))
            continue
        letter = letters[own, depth]
        pivot = np.partition(letter[[0, (high - low) // 2, -1]], 1)[1]
        less, equal = letter < pivot, letter == pivot
        more = ~(less | equal)
        pointers[low:high] = np.concatenate((own[less], own[equal], own[more]))
        weight = n[own]
        middle, upper = low + int(less.sum()), high - int(more.sum())
        if middle > low and weight[less].sum() >= least:
            parts.append((low, middle, depth))
        if high > upper and weight[more].sum() >= least:
            parts.append((upper, high, depth))
        total = int(weight[equal].sum())
        if pivot >= 0 and total >= least:
            if depth:
                yield int(pointers[middle]), depth + 1, total
            if depth + 1 < letters.shape[1]:
                parts.append((middle, upper, depth + 1))


def _sort(longest: int, least: int) -> Callable:
    """lang, phrase, n: the frequent phrases of the blocks of suffixes (lang, bucket, dealt, block, n) of a task, which come by bucket. Of suffixes
    that are dealt out, all phrases with what they count here."""

    def letters(suffix: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        split = pc.split_pattern(suffix, b" ")
        words = split.flatten().dictionary_encode()
        size = np.diff(split.offsets.to_numpy())
        out = np.full((len(suffix), longest), -1, np.int64)
        out[np.arange(longest) < size[:, None]] = words.indices.to_numpy(zero_copy_only=False)
        return out, words.dictionary.to_pylist()

    def settle(blocks: dict[tuple[str, bool], list[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
        for (lang, dealt), own in blocks.items():
            found, words = letters(pa.array(b"\n".join(x for x, _ in own).split(b"\n"), pa.binary()))
            n = np.frombuffer(b"".join(x for _, x in own), np.int64)
            out = [(b" ".join(words[x] for x in found[i, :k]), c) for i, k, c in frequent_prefixes(found, n, 1 if dealt else least)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, {}
        for batch in batches:
            for lang, bucket, dealt, block, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from settle(kept)
                    now, kept = bucket, {}
                kept.setdefault((lang, dealt), []).append((block, n))
        yield from settle(kept)

    return run


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of the phrases of two to `longest` words that come up `least` times, and lang, word, n of such words; there, word null has
    the number of all words. Both are tables in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where(F.length(text_col) > 0).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    words = count_words(texts, least)
    frequent = _bitmap(words.where("word is not null"), WORD_BITS)
    pairs = count_pairs(texts, frequent, least)
    most = max(HOT, (words.where("word is null").agg(F.sum("n")).first()[0] or 0) // 50_000)
    hot = np.sort(pairs.where(F.col("n") > most).select("key").toArrow().column("key").to_numpy())  # fewer than 50,000
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (pairs.agg(F.sum("n")).first()[0] or 0) // SORTED)
    found = suffixes(texts, frequent, _bitmap(pairs, PAIR_BITS), hot, longest, buckets).repartition("bucket").sortWithinPartitions("bucket")
    found = found.mapInArrow(_sort(longest, least), "lang string, phrase binary, n long")
    found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = table(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    drop(pairs)
    return out, words.drop("key")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then count, both descending, then text.

    A-Z are lowered, texts split at . , ; : ! ? and line ends into pieces, and those at blanks and tabs into words. a is how often the phrase comes up within
    pieces, n the number of the language's words. A cut behind the first k words gives the counts l and r of both parts and floor(1000 a n / (l r)); the
    lowest counts, and of equal ones the smallest k. A phrase goes if a longer one that holds it comes up in at least `share` percent of its places."""
    phrases, words = count_phrases(docs, text_col, lang_col, least, longest)
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")).union(words.where("word is not null").select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    counts = table(counts, "counts")
    size = F.size(F.split("phrase", " "))
    cuts = phrases.withColumn("size", size).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.selectExpr("lang", "phrase", "n as a", "k", "substring_index(phrase, ' ', k) as first", "substring_index(phrase, ' ', k - size) as rest")
    cuts = cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(counts.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(words.where("word is null").select("lang", "n")), "lang")  # a row for each language
    whole = lambda c: f"cast({c} as decimal(18, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000 as decimal(4, 0)) * ({whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 2)
    inner = inner.select("lang", "n", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
