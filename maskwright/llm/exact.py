"""Exact dedup by an extendible-hash index on shared files.

Every text becomes an index entry (64-bit key, SHA-256, id). Entries of one key and digest
fold into a chain head before the shuffle, so a group of copies of any size costs one row a
map task. A directory over the leading key bits starts with one bucket and splits each
bucket that holds more than `capacity` heads, doubling itself whenever a bucket as deep as
the directory splits; a bucket whose heads share all directory bits chains instead. The splits follow from the
numbers of heads under all prefixes at once, as a table: the driver holds no slots. Owner
tasks write the heads bucket by bucket, each a range of keys, to the shared folder.

Chains are read from the buckets: keys with more than one row, whether copies or collisions. Their texts, and no
others, move; copies fold before they do, and are told apart by their bytes. A chain's head in its bucket
then names the row that stays, and one that holds several texts is divided by text.

Defined results: a null text counts as empty, all empty texts are copies of one another;
ids that repeat count as separate rows of one group, kept alike (keep_id is the largest id); a
null id is below all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, table

#: Heads in a bucket before it splits: about 10 MB of index.
CAPACITY = 100_000


def directory(counts: DataFrame, depth: int, capacity: int) -> DataFrame:
    """slot, bucket, local_depth for each of counts (slot, n: heads by their leading `depth` bits), after all
    splits. A bucket is a prefix of local_depth bits, numbered as 1 followed by it, whose heads fit while those of
    the prefix before don't; at `depth` bits it isn't split further, its heads chain."""
    prefixes = counts.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth"))
    prefixes = prefixes.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - local_depth)"))
    sums = table(prefixes.groupBy("local_depth", "prefix").agg(F.sum("n").alias("n")), "prefixes")
    split = sums.where(F.col("n") > capacity).select((F.col("local_depth") + 1).alias("local_depth"), F.explode(F.array(2 * F.col("prefix"), 2 * F.col("prefix") + 1)).alias("prefix"))
    ends = sums.where((F.col("n") <= capacity) | (F.col("local_depth") == depth))
    found = ends.join(split, ["local_depth", "prefix"], "left_semi").unionByName(ends.where("local_depth = 0"))
    found = table(found.select("local_depth", "prefix"), "ends")
    at = prefixes.select("slot", "local_depth", "prefix").join(bounded(found), ["local_depth", "prefix"])
    return table(at.select("slot", F.expr("shiftleft(1L, local_depth) + prefix").alias("bucket"), "local_depth"), "directory")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, heads by bucket, directory), each a table in the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    entries = table(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("sha")), "entries")
    heads = entries.groupBy("key", "sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    # Entries bound the heads; six more bits than an even spread needs leave room for uneven ones.
    depth = min(60, max(1, entries.count() // capacity).bit_length() + 6)
    heads = heads.withColumn("slot", F.shiftrightunsigned("key", 64 - depth))
    of = directory(table(heads.groupBy("slot").agg(F.count("*").alias("n")), "counts"), depth, capacity)
    placed = heads.join(bounded(of), "slot").drop("slot")
    return entries, table(placed.repartition("bucket").sortWithinPartitions("bucket", "key", "sha"), "buckets"), of


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each of docs: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    entries, heads, _ = build_index(docs, id_col, text_col, capacity)
    chains = table(heads.groupBy("bucket", "key").agg(F.sum("size").alias("n")).where("n > 1").select("bucket", "key"), "chains")
    # Byte comparison: only texts in chains move, and copies fold before they do.
    members = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text")).join(bounded(chains), "key")
    texts = members.groupBy("bucket", "key", F.unhex(F.sha2("text", 256)).alias("sha"), "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    texts = table(texts, "texts")
    found = texts.groupBy("bucket", "key", "sha").agg(F.count("*").alias("texts"))
    chained = table(heads.join(found, ["bucket", "key", "sha"]), "chained")
    one, several = chained.where("texts = 1").select("key", "sha", "keep_id", "size"), chained.where("texts > 1").select("bucket", "key", "sha")
    divided = None
    if not several.isEmpty():
        several = table(several, "several")
        of = texts.join(several, ["bucket", "key", "sha"], "left_semi")
        rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
        rows = rows.withColumns({"key": F.xxhash64("text"), "sha": F.unhex(F.sha2("text", 256))})
        divided = rows.join(of.select("key", "sha", "text", "keep_id", "size"), ["key", "sha", "text"]).select("id", "key", "sha", "keep_id", "size")
        entries = entries.join(several, ["key", "sha"], "left_anti")
    out = entries.join(bounded(table(one, "classes")), ["key", "sha"], "left").select("id", "key", "sha", "keep_id", "size")
    if divided is not None:
        out = out.unionByName(divided)
    keep = F.coalesce("keep_id", "id")
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
