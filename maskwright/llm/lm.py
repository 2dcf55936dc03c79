"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

Tokens are leaves of a tree of classes: a token's probability is the product, from the root down, of the
probabilities of the class (one of WAYS) that it is in, given the classes above and the text before. Each is
a softmax over the sum of a bias, the logarithm of the classes' training counts, and the weights of hashed
features: the last word, a skip back to the last of the COMMON most frequent words before it, and both (an
n-gram), each joined with the place in the tree. Frequent tokens are near the root, so features bear on the
token itself; from the LEVELS-th class on, of less than one token in some thousands, there is the bias only. The
`head` most frequent tokens have leaves of their own; all others share one, which another level
divides by hash; in the end such a token has its smoothed share of its group. Scores are log10
probabilities of whole texts.

Weights are trained in passes over all training rows, each in rounds of as many slices. The rows are dealt to slices and
parts by a hash of id and text; the number of parts follows from the number of tokens alone. In a round each part starts from the shared weights, makes
AdaGrad steps over mini-batches, and hands back its change of each feature's weights, which are averaged by how often
the feature came up: first within shards of features, each summed by one task, then put together. So scores do not depend on partitions
or cores. The number of hashed features grows with the tokens, up to 2^MOST_BITS (a bound: 32 MB of weights).

Token counts cover all training tokens. The head is broadcast, a fixed bound; texts' other tokens meet their counts
in a shuffle join. A worker works on about CHUNK tokens at a time, long texts in pieces of PIECE bytes that keep
their context, so memory depends on neither texts nor vocabulary. Tokens of a chunk are an Arrow array, of which only the distinct ones become objects in Python.

Defined results: a null or blank text is its end token alone; rows on which the condition is null
are not learned from; with no training rows all tokens have base probability one and the groups of unknown ones are
equally likely; rows that repeat an id or text give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table

WAYS, LEVELS, COMMON, PASSES, ROUNDS, HEAD = 16, 3, 1024, 1, 2, 2**18
#: A hashed feature for each so many training tokens, between these powers of two; rows of a shard; tokens of a part.
PER_FEATURE, LEAST_BITS, MOST_BITS, SHARD, PART = 256, 12, 20, 2**14, 8_000_000
RATE, BATCH, CHUNK, PIECE, SEED = 0.15, 32_768, 200_000, 1_000_000, 42
END = b""
#: Hash levels below the leaf that tokens outside the head share.
TAIL = 1
#: Rows that come up at most so often in a mini-batch are added up all together.
FEW = 8
#: Tokens of the piece before that a piece keeps as context.
BACK = 200
#: Distinct tokens of which Slots keep hashes, and a worker counts before it hands them on.
MEMO, FLUSH = 100_000, 200_000
BLANKS = b" \t\n\v\f\r"


def pieces(text: bytes | None) -> Iterator[tuple[list[bytes], int]]:
    """The text's tokens, in pieces, each with the number of tokens at its start that are context only."""
    text, i, last = text or b"", 0, []
    while len(text) - i > PIECE:
        j = i + PIECE
        while j < len(text) and text[j] not in BLANKS:
            j += 1
        found = last + text[i:j].lower().split()
        yield found, len(last)
        i, last = j, found[-BACK:]
    yield [*last, *text[i:].lower().split(), END], len(last)


def listed(tokens: pa.Array) -> list[bytes]:
    return tokens.to_numpy(zero_copy_only=False).tolist()


def hashes_of(tokens: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, tokens, repeat(SEED)), np.uint64, len(tokens))


class Head:
    """The most frequent tokens, numbered in order. Tokens are found among them by hash and compared, many at once: look-ups in a
    dictionary would go all over memory."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.head, self.tokens = len(tokens), pa.array(tokens, pa.binary())
        h = hashes_of(tokens)
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]
        self.twins = int(np.count_nonzero(self.sorted[1:] == self.sorted[:-1]))

    def number(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of distinct tokens. Those outside the head follow it, in order, for this call alone."""
        h = hashes_of(listed(tokens))
        order, at, ids = np.argsort(h), np.empty(len(h), np.int64), np.full(len(h), -1)
        place = np.searchsorted(self.sorted, h.take(order))
        for k in range(self.twins + 1 if self.head else 0):  # with equal hashes in the head, a token may be one of the next
            at[order] = self.order.take(np.minimum(place + k, self.head - 1))
            same = pc.equal(self.tokens.take(pa.array(at)), tokens).to_numpy(zero_copy_only=False)
            ids[same] = at[same]
        other = np.flatnonzero(ids < 0)
        ids[other] = self.head + np.arange(len(other))
        return ids, h


class Slots(defaultdict):
    """Token to slot number, one by one: the head's tokens first, then others as they come. A plain counterpart of Head; the operator works with Head."""

    def __init__(self, head: list[bytes] = ()) -> None:  # type: ignore[assignment]
        super().__init__(count().__next__)
        self.names: list[bytes] = []
        self.known = np.zeros(0, np.uint64)
        for token in head:
            self[token]
        self.hashes()
        self.head = len(self.names)
        self.number = Head(self.names).number

    def hashes(self) -> np.ndarray:
        """By slot. Only those new since the last call are converted and named."""
        if len(self) > len(self.names):
            new = list(islice(self, len(self.names), None))  # a dictionary keeps the order
            self.names += new
            self.known = np.concatenate((self.known, hashes_of(new)))
        return self.known

    def trim(self) -> None:
        """After hashes()."""
        if len(self.names) - self.head > MEMO:
            for token in self.names[self.head :]:
                del self[token]
            del self.names[self.head :]
            self.known = self.known[: self.head]
            self.default_factory = count(self.head).__next__


class Words(NamedTuple):
    """Tokens of texts one after another: how many each text has, each token's place among `names`, and the distinct ones."""

    lengths: np.ndarray
    code: np.ndarray
    names: pa.Array


def coded(tokens: pa.Array, lengths: np.ndarray) -> Words:
    found = tokens.dictionary_encode()
    return Words(lengths, found.indices.to_numpy(), found.dictionary)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of whole texts one after another, and how many each text has, as by pieces(), without an object for each token."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(text, "", " "))  # what stands after the last blank is END
    found = pc.ascii_split_whitespace(text)
    return found.flatten().view(pa.binary()), pc.list_value_length(found).to_numpy()


def read(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Rows of the texts' pieces in order, their tokens, how many each has and how many of these are context."""
    texts = texts.cast(pa.binary())
    long = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy() > PIECE).tolist()
    for a, b in zip([-1, *long], [*long, len(texts)], strict=True):
        if b > a + 1:
            tokens, lengths = split(texts.slice(a + 1, b - a - 1))
            yield np.arange(a + 1, b), tokens, lengths, np.zeros(len(lengths), np.int64)
        if b < len(texts):
            for found, skip in pieces(texts[b].as_py()):
                yield np.array([b]), pa.array(found, pa.binary()), np.array([len(found)]), np.array([skip])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Words, np.ndarray]]:
    """Rows, without their text, their tokens and how many of these are context, about CHUNK tokens at a time."""
    rows, tokens, lengths, skips, n = [], [], [], [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for at, found, sizes, skip in read(batch.column(0)):
            i, ends = 0, np.cumsum(sizes)
            while i < len(sizes):
                start = int(ends[i] - sizes[i])
                j = min(len(sizes), int(np.searchsorted(ends, start + CHUNK - n)) + 1)
                rows += [[c[k] for c in columns] for k in at[i:j].tolist()]
                tokens.append(found.slice(start, int(ends[j - 1]) - start))
                lengths.append(sizes[i:j])
                skips.append(skip[i:j])
                i, n = j, n + len(tokens[-1])
                if n >= CHUNK:
                    yield rows, coded(pa.concat_arrays(tokens), np.concatenate(lengths)), np.concatenate(skips)
                    rows, tokens, lengths, skips, n = [], [], [], [], 0
    if rows:
        yield rows, coded(pa.concat_arrays(tokens), np.concatenate(lengths)), np.concatenate(skips)


class Tree:
    """The tree of classes over tokens 0 to n - 1, in order of falling counts, and the tail as token n. Every token, and a group's unknown
    ones together, count half a time more, as in the base: without features a token's probability is the base's, but for the number of groups."""

    def __init__(self, counts: np.ndarray, groups: list[float]) -> None:
        mass = np.concatenate((counts + 0.5, [sum(groups)]))
        sums = np.concatenate(([0.0], np.cumsum(mass)))
        bias, todo = [], [(0, len(mass), 0)]
        above, digit = np.full(len(mass), -1), np.zeros(len(mass), np.int8)  # each token's last step
        up, way = [-1], [0]  # each node's own
        while todo:  # nodes are cut into WAYS runs of about equal mass
            a, b, node = todo.pop()
            while len(bias) <= node:
                bias.append(np.full(WAYS, -1e9, np.float32))
            k = np.arange(1, WAYS)
            cuts = np.searchsorted(sums, sums[a] + (sums[b] - sums[a]) * k / WAYS)
            # No run is empty while there are tokens for it.
            cuts = np.minimum(np.maximum.accumulate(np.minimum(np.maximum(cuts, a + k), np.maximum(b - WAYS + k, a)) - k) + k, b)
            edges = [a, *cuts.tolist(), b]
            for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if x == y:
                    continue
                bias[node][k] = np.log((sums[y] - sums[x]) / (sums[b] - sums[a]))
                if y - x == 1:
                    above[x], digit[x] = node, k
                else:
                    up.append(node)
                    way.append(k)
                    todo.append((x, y, len(up) - 1))
        self.tail = len(bias)  # the first node below the tail's leaf
        below = [np.log(np.reshape(groups, (WAYS**i, WAYS, -1)).sum(axis=2)).astype(np.float32) for i in range(TAIL)]
        self.bias = np.concatenate([np.stack(bias), *below])
        # Each token's steps, from its leaf up.
        steps, node, way_ = [], above.copy(), digit.astype(np.int64)
        tokens, up, way = np.arange(len(mass)), np.array(up), np.array(way)
        level = np.zeros(len(up), np.int64)
        for i in range(1, len(up)):  # a node comes after the one above
            level[i] = level[up[i]] + 1
        while len(tokens):
            steps.append((tokens, node, way_))
            on = up[node] >= 0
            tokens, node, way_ = tokens[on], up[node[on]], way[node[on]]
        token, node, way_ = (np.concatenate(x) for x in zip(*steps, strict=True))
        self.bias -= np.log(np.exp(self.bias).sum(axis=1, keepdims=True))
        # Steps below the levels with features have a constant probability.
        near = level[node] < LEVELS
        self.rest = np.bincount(token[~near], self.bias[node[~near], way_[~near]], len(mass))
        token, node, way_ = token[near], node[near], way_[near]
        order = np.argsort(token, kind="stable")
        self.first = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(mass)))))
        self.node, self.way = node[order].astype(np.int32), way_[order].astype(np.int32)

    def steps(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, node and way of the steps with features of tokens, by number (n or more: the tail) and hash."""
        n = len(self.first) - 2
        which = np.minimum(ids, n)
        first = self.first[which]
        size = self.first[which + 1] - first
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        at = np.arange(len(owner)) + (first - (np.cumsum(size) - size))[owner]
        owners, nodes, ways = [owner], [self.node[at]], [self.way[at]]
        rest, base, place = np.flatnonzero(ids >= n).astype(np.int32), self.tail, np.zeros(int((ids >= n).sum()), np.int32)
        for i in range(TAIL):
            digit = ((h[rest] >> np.uint64(8 * i)) & np.uint64(WAYS - 1)).astype(np.int32)
            owners.append(rest)
            nodes.append(base + place)
            ways.append(digit)
            base, place = base + WAYS**i, place * WAYS + digit
        return np.concatenate(owners), np.concatenate(nodes), np.concatenate(ways)


def group_of(h: np.ndarray) -> np.ndarray:
    """The group, below the tail's leaf, of tokens by hash."""
    out = np.zeros(len(h), np.int64)
    for i in range(TAIL):
        out = out * WAYS + ((h >> np.uint64(8 * i)) & np.uint64(WAYS - 1)).astype(np.int64)
    return out


def contexts(ids: np.ndarray, h: np.ndarray, first: np.ndarray, common: int) -> list[np.ndarray]:
    """Hashes of the last word, the last common one before it, and both. ids, h: numbers and hashes of the tokens
    of whole texts one after another; first: where the text of each token starts; common: tokens that count as common."""
    u, place = np.uint64, np.arange(len(h))
    padded = np.concatenate((np.zeros(2, u), h))
    one = np.where(place > first, padded[1:-1], u(0))
    last = np.maximum.accumulate(np.where(ids < common, place, -1))
    last = np.concatenate((np.full(2, -1), last[:-2]))[: len(h)]
    two = np.where(last >= first, h[np.maximum(last, 0)], u(0))
    return [one * u(0x9E3779B97F4A7C15), two * u(0xC2B2AE3D27D4EB4F) + u(1), one * u(0x165667B19E3779F9) ^ two * u(0xD6E8FEB86659FD93)]


def rows_of(context: list[np.ndarray], owner: np.ndarray, node: np.ndarray, bits: int) -> list[np.ndarray]:
    """The hashed features' rows at each step."""
    place, out = node.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD), []
    for c in context:
        x = c.take(owner)
        x ^= place
        x *= np.uint64(0x9FB21C651E98DF25)
        x >>= np.uint64(64 - bits)
        out.append(x.astype(np.int32))
    return out


def masses(bias: np.ndarray, weights: np.ndarray, node: np.ndarray, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each step: the classes' sums of bias and weights, exponentiated, and their sum. Biases are at most zero and
    weights small, so nothing overflows."""
    z = bias.take(node, axis=0)
    for f in at:
        z += weights.take(f, axis=0)
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)  # each row by itself: a matrix product's rounding would depend on the batch


def log_p(bias: np.ndarray, weights: np.ndarray, node: np.ndarray, at: list[np.ndarray], way: np.ndarray) -> np.ndarray:
    """The log probability of each step's way."""
    z, total = masses(bias, weights, node, at)
    return np.log(z[np.arange(len(way)), way] / total)


def step(bias: np.ndarray, weights: np.ndarray, square: np.ndarray, seen: np.ndarray, node: np.ndarray, at: list[np.ndarray], way: np.ndarray) -> None:
    """One AdaGrad step on a mini-batch, in place. Each row is read and written once, in order."""
    n, bits = len(way), len(way).bit_length()
    key = np.stack(at).astype(np.int64)
    key <<= 32
    key |= (np.arange(len(at)) << bits)[:, None] + np.arange(n)
    key = np.sort(key, axis=None)
    row, which = key >> 32, key & 0xFFFFFFFF
    begins = np.diff(row, prepend=-1) != 0
    starts = np.flatnonzero(begins)
    row, length = row.take(starts), np.diff(starts, append=len(key))
    place = np.empty(len(at) << bits, np.int64)  # of each feature of each step, among the rows
    place[which] = np.cumsum(begins) - 1
    which &= (1 << bits) - 1
    now = weights.take(row, axis=0)
    g, total = masses(bias, now, node, [x[:n] for x in place.reshape(len(at), -1)])
    g /= total[:, None]
    g[np.arange(n), way] -= 1
    size = np.einsum("ij,ij->i", g, g)
    # Most rows come up once, so their change is there; only the others are added up.
    one = which.take(starts)
    change, sums, many = g.take(one, axis=0), size.take(one), np.flatnonzero(length > 1)
    many = many[np.argsort(-length[many], kind="stable")]
    first, times = starts[many], length[many]
    k = int(np.searchsorted(-times, -FEW))
    if k:
        ends = np.cumsum(times[:k])
        begin = ends - times[:k]
        x = which.take(np.repeat(first[:k] - begin, times[:k]) + np.arange(ends[-1]))
        change[many[:k]] = np.add.reduceat(g.take(x, axis=0), begin, axis=0)
        sums[many[:k]] = np.add.reduceat(size.take(x), begin)
    first, times, many = first[k:], times[k:], many[k:]
    x = which.take(first + 1)
    more, mores = g.take(x, axis=0), size.take(x)
    for k in range(2, FEW):
        x = which.take(first[: np.searchsorted(-times, -k)] + k)
        more[: len(x)] += g.take(x, axis=0)
        mores[: len(x)] += size.take(x)
    change[many] += more
    sums[many] += mores
    seen[row] = seen.take(row) + length
    sums += square.take(row)
    square[row] = sums
    change *= (RATE / np.sqrt(sums + 1e-2))[:, None]
    now -= change
    whole = f"V{weights.itemsize * WAYS}"  # a row in one piece
    weights.view(whole)[:, 0][row] = now.view(whole)[:, 0]


def _rows(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"))


def count_tokens(rows: DataFrame) -> DataFrame:
    """token, c over rows of text, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(found.items())
            found.clear()
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64())], ["token", "n"])

        for _, texts, skips in chunks(batches):
            times = np.bincount(texts.code[counted(texts.lengths, skips)], minlength=len(texts.names))
            for token, n in zip(listed(texts.names), times.tolist(), strict=True):
                if n:
                    found[token] += n
            if len(found) > FLUSH:
                yield from flush()
        yield from flush()

    return table(rows.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")), "tokens")


def counted(lengths: np.ndarray, skips: np.ndarray) -> np.ndarray:
    """Of each token of the texts, whether it is more than context."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) >= np.repeat(first + skips, lengths)


def _batch(head: Head | Slots, tree: Tree, texts: Words | list[list[bytes]], skips: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Of the tokens that aren't context: number, hash, text; and the owner, node, way and rows of all steps."""
    if not isinstance(texts, Words):
        texts = coded(pa.array(chain.from_iterable(texts), pa.binary()), np.fromiter(map(len, texts), np.int64, len(texts)))
    lengths = texts.lengths
    ids, h = (x.take(texts.code) for x in head.number(texts.names))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    context, use = contexts(ids, h, (np.cumsum(lengths) - lengths)[doc], min(COMMON, head.head)), counted(lengths, skips)
    if not use.all():
        context, ids, h, doc = [c[use] for c in context], ids[use], h[use], doc[use]
    owner, node, way = tree.steps(ids, h)
    return ids, h, doc, owner, node, way, rows_of(context, owner, node, bits)


def train_pass(rows: DataFrame, head: list[bytes], tree: Tree, weights: np.ndarray) -> np.ndarray:
    """The weights after a pass over rows (text, part, h)."""
    n, bits = len(weights), len(weights).bit_length() - 1
    size = min(SHARD, n)
    shared = rows.sparkSession.sparkContext.broadcast((Head(head), tree, weights))
    names = ["shard", "part", "row", "change", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tree, start = shared.value
        part, state = None, None

        def out() -> Iterator[pa.RecordBatch]:
            w, _, seen = state
            for s in range(n // size):
                row = np.flatnonzero(seen[s * size : (s + 1) * size])
                if len(row):
                    change = (w[s * size + row] - start[s * size + row]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (row.astype(np.int32), change, seen[s * size + row])]], names)

        for rows, texts, skips in chunks(batches):
            parts = np.array([r[0] for r in rows])
            ends = np.cumsum(texts.lengths)
            for p in np.unique(parts).tolist():  # rows come in order of their parts
                if p != part:
                    if state is not None:
                        yield from out()
                    part, state = p, (start.copy(), np.zeros(n, np.float32), np.zeros(n, np.float32))
                a, b = np.flatnonzero(parts == p)[[0, -1]].tolist()
                part_of = Words(texts.lengths[a : b + 1], texts.code[ends[a] - texts.lengths[a] : ends[b]], texts.names)
                _, _, _, owner, node, way, at = _batch(head, tree, part_of, skips[a : b + 1], bits)
                for i in range(0, len(way), BATCH):
                    step(tree.bias, *state, node[i : i + BATCH], [f[i : i + BATCH] for f in at], way[i : i + BATCH])
        if state is not None:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, seen = None, np.zeros(0), np.zeros(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(sums / np.maximum(seen, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], ["shard", "change"])

        for batch in batches:
            for i in range(batch.num_rows):
                s, _, row, change, count = (c[i].as_py() for c in batch.columns)
                if s != now:
                    if now is not None:
                        yield out()
                    now, sums, seen = s, np.zeros((size, WAYS)), np.zeros(size)
                row, count = np.frombuffer(row, np.int32), np.frombuffer(count, np.float32).astype(float)
                sums[row] += np.frombuffer(change, np.float16).reshape(-1, WAYS).astype(float) * count[:, None]
                seen[row] += count
        if now is not None:
            yield out()

    moved = rows.select("text", "part").mapInArrow(run, "shard int, part long, row binary, change binary, seen binary")
    moved = moved.repartition(max(1, n // size), "shard").sortWithinPartitions("shard", "part").mapInArrow(merge, "shard int, change binary")
    out = weights.copy()
    for s, change in moved.collect():  # as many bytes as the weights
        out[s * size : (s + 1) * size] += np.frombuffer(change, np.float32).reshape(-1, WAYS)
    shared.unpersist()
    return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES, rounds: int = ROUNDS, head: int = HEAD, bits: int | None = None) -> DataFrame:
    """A row for each of docs: id, n_tokens, n_known, train_tokens, base_score, score. train:
    condition on docs; the model learns from rows where it is true. bits: hashed features, as a power of two;
    None: by the number of training tokens."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs, train, id_col, text_col)
    counts = count_tokens(rows.where("train"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    base_of = n + 0.5 * (v + 1)
    # The most frequent tokens, and no more bytes of them than a few MB: longer ones are in the tail.
    top = counts.where(F.octet_length("token") <= 256).orderBy(F.desc("c"), "token").limit(head).toArrow()  # `head` rows
    names, c = top.column("token").to_pylist(), top.column("c").to_numpy()
    least = (int(c[-1]), names[-1]) if names else (2**62, b"")
    in_head = (F.octet_length("token") <= 256) & ((F.col("c") > least[0]) | ((F.col("c") == least[0]) & (F.col("token") <= F.lit(least[1]))))
    rest = counts.where(~in_head)
    h = F.xxhash64("token")  # seed 42, as in Slots
    group = F.lit(0)
    for i in range(TAIL):
        group = group * WAYS + F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(WAYS - 1))
    sums = {r[0]: (r[1], r[2]) for r in rest.groupBy(group.alias("g")).agg(F.sum("c"), F.count("*")).collect()}  # WAYS**TAIL rows
    group_of_ = [sums.get(k, (0, 0))[0] + 0.5 * (sums.get(k, (0, 0))[1] + 1) for k in range(WAYS**TAIL)]
    tree = Tree(c, group_of_)
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (n // PER_FEATURE).bit_length()))
    weights = np.zeros((2**bits, WAYS), np.float32)
    if n:
        parts, h = max(8, -(-n // (PART * rounds))), F.xxhash64("doc_id", "text")
        dealt = rows.where("train").select("text", F.pmod(F.xxhash64(F.lit("part"), h), F.lit(parts)).alias("part"), h.alias("h"))
        for k in range(passes * rounds):
            own = dealt.where(F.pmod(F.xxhash64(F.lit("round"), "h"), F.lit(rounds)) == k % rounds)
            weights = train_pass(own.repartition(parts, "part").sortWithinPartitions("part", "h"), names, tree, weights)
    model = spark.sparkContext.broadcast((Head(names), c, tree, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, c, tree, w = model.value
        base = np.log10((c + 0.5) / base_of) if len(c) else np.zeros(1)
        names = ["rid", "doc_id", "token", "tf", "n_known", "base", "score"]
        for info, texts, skips in chunks(batches):
            ids, _, doc, owner, node, way, at = _batch(head, tree, texts, skips, bits)
            got = np.empty(len(way))
            for i in range(0, len(way), BATCH):
                got[i : i + BATCH] = log_p(tree.bias, w, node[i : i + BATCH], [f[i : i + BATCH] for f in at], way[i : i + BATCH])
            sums = np.bincount(owner, got, len(ids)) + tree.rest[np.minimum(ids, head.head)]
            scores = np.bincount(doc, sums / np.log(10), len(info))
            near = ids < head.head
            known = np.bincount(doc[near], minlength=len(info))
            n_tokens, base_sum = np.bincount(doc, minlength=len(info)), np.bincount(doc[near], base[ids[near]], len(info))
            none, rid = pa.nulls(len(info), pa.binary()), np.array([r[0] for r in info], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array([r[1] for r in info], pa.int64()), none, pa.array(n_tokens), pa.array(known), pa.array(base_sum.astype(np.float64)), pa.array(scores)], names)
            code = texts.code[counted(texts.lengths, skips)]
            pairs, tf = np.unique(doc[~near] * len(texts.names) + code[~near], return_counts=True)
            at_doc, at_code = np.divmod(pairs, len(texts.names))
            m = len(pairs)
            zero = np.zeros(m)
            yield pa.RecordBatch.from_arrays([pa.array(rid[at_doc]), pa.nulls(m, pa.int64()), texts.names.take(pa.array(at_code)), pa.array(tf.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], names)

    numbered = rows.select("text", F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"))
    seen = table(numbered.mapInArrow(run, "rid long, doc_id long, token binary, tf long, n_known long, base double, score double"), "scores")
    # Tokens beyond the head: their counts come by shuffle; those in no training text count 0.
    tail = seen.where("token is not null").select("rid", "token", "tf").join(rest, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    inner_of = F.element_at(F.array(*[F.lit(float(x)) for x in group_of_]), (group + 1).cast("int"))
    tail = tail.select("rid", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tf"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(float(base_of)))).alias("base"), (F.col("tf") * F.log10((F.col("c") + 0.5) / inner_of)).alias("score"))
    out = seen.where("token is null").drop("token").unionByName(tail).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum("tf").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select(F.col("doc_id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
