"""Token counts as rollups kept up to date by signed changes.

A change is a row (doc_id, sign, source, lang, tokenizer, tokens): +1 inserts a document's count,
-1 takes one back, and a revised count is a pair of both. A batch of changes is summed by
(source, lang, tokenizer), written to a folder of its own beside the others and renamed, in one step, to
a place under the batch's name that nothing else takes. Of several such places the first by name counts, so a batch that is
sent again, by one writer or by several at once, or was lost halfway, counts once. Totals are the sum of all
batches; compact(), of which one may run at a time, folds the batches it has listed into one snapshot that names them.

Defined results: a null text has no tokens and counts as a document; null source and language
are groups of their own; rows that repeat a document count each; groups whose documents have
all been taken back are left out; an empty batch commits and changes nothing; other columns
are ignored.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, delete, exists, scratch, ship, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]
_ENCODERS: dict = {}


def name_of(path: str) -> str:
    """A tokenizer's name is its file's."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def count_tokens(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens of each of docs; the tokenizer's name is its
    file's. The vocabulary (under 1 MB) is read by Spark and sent to the executors."""
    spark = docs.sparkSession
    url = path if re.match(r"\w+:", path) else f"file://{path}"
    ranks = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(url).select("content").first()[0]))
    ship(spark)
    name = name_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name, pattern) not in _ENCODERS:
            import tiktoken

            _ENCODERS[name, pattern] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}, special_tokens={})
        encode = _ENCODERS[name, pattern].encode_ordinary
        for batch in batches:
            n = [len(encode(x.as_py() or "")) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long").select("doc_id", "source", "lang", F.lit(name).alias("tokenizer"), "tokens")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select("doc_id", F.lit(sign).alias("sign"), *KEYS, "tokens")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The signed rows that turn the counts of `before` into those of `after`: inserts, deletes,
    and pairs for what was revised. Documents that are in both alike give none."""
    key = ["doc_id", *KEYS, "tokens"]
    net = signed(before, -1).unionByName(signed(after, 1)).groupBy(*key).agg(F.sum("sign").alias("sign"))
    return net.where("sign <> 0").select("doc_id", "sign", *KEYS, "tokens")


class Rollup:
    """Totals by source, language and tokenizer in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "rollup")

    def _move(self, a: str, b: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(a).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(path(b).getParent())
        return not exists(self.spark, b) and files.rename(path(a), path(b))

    def _list(self, kind: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def apply(self, batch: str, changed: DataFrame) -> bool:
        """Commits a batch; False if it was committed before."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError("a batch's name has letters, digits, _ and - only")
        if self._list(f"batches/{batch}") or batch in self._folded():
            return False
        sums = changed.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        own = scratch(self.spark, "x").rsplit("-", 1)[-1]
        stage = f"{self.path}/staging/{batch}-{own}"
        sums.coalesce(1).write.parquet(stage)  # a row a group
        self._move(stage, f"{self.path}/batches/{batch}/{own}")
        return self._list(f"batches/{batch}")[:1] == [own]

    def _folded(self) -> set[str]:
        last = self._list("snapshots")[-1:]
        return {x for s in last for r in self.spark.read.text(f"{self.path}/snapshots/{s}/names").collect() for x in json.loads(r[0])}

    def _batches(self) -> dict[str, str]:
        """Path of each batch that no snapshot names."""
        folded = self._folded()
        places = {b: self._list(f"batches/{b}") for b in self._list("batches") if b not in folded}
        return {b: f"{self.path}/batches/{b}/{found[0]}" for b, found in places.items() if found}

    def _sums(self, batches: dict[str, str]) -> DataFrame:
        paths = [*batches.values(), *(f"{self.path}/snapshots/{s}/sums" for s in self._list("snapshots")[-1:])]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        return self._sums(self._batches())

    def compact(self) -> None:
        """Folds all batches into a snapshot; their folders go once it is in place."""
        batches, folded, old = self._batches(), self._folded(), self._list("snapshots")
        stage = f"{self.path}/staging/{scratch(self.spark, 'snapshot').rsplit('/', 1)[-1]}"
        self._sums(batches).coalesce(1).write.parquet(f"{stage}/sums")
        self.spark.createDataFrame([(json.dumps(sorted(folded | set(batches))),)], "value string").coalesce(1).write.text(f"{stage}/names")
        if self._move(stage, f"{self.path}/snapshots/{len(old) and int(old[-1]) + 1:09d}"):
            for b in batches:
                delete(self.spark, f"{self.path}/batches/{b}")


def token_counts(docs: DataFrame, withdrawn: DataFrame | None = None, path: str = TOKENIZER) -> DataFrame:
    """Totals over docs after a first batch that inserts them, sent twice. With `withdrawn` (doc_id), three more
    batches delete these documents, insert them with an estimate of a token for four characters, and revise
    the estimates to their counts."""
    counts = table(count_tokens(docs, path), "counts")
    totals = Rollup(docs.sparkSession)
    for _ in range(2):
        totals.apply("insert", signed(counts, 1))
    if withdrawn is not None:
        ids = bounded(table(withdrawn.select(F.col("doc_id").cast("long")).distinct(), "withdrawn"))
        own = counts.join(ids, "doc_id", "left_semi")
        guess = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), (F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long").alias("tokens"))
        guess = guess.join(ids, "doc_id", "left_semi").select("doc_id", "source", "lang", F.lit(name_of(path)).alias("tokenizer"), "tokens")
        totals.apply("withdraw", signed(own, -1))
        totals.apply("estimate", signed(guess, 1))
        totals.apply("revise", changes(guess, own))
    return totals.totals()
