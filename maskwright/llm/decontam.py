"""Benchmark decontamination by a positional inverted index of the training documents.

Words are runs of letters and digits (every character beyond ASCII counts as a letter) after
A-Z are lowered. The index holds one posting (term, row, position) for each document
word that also occurs in a test item: other words can't be part of a match, so an index serves the items
whose vocabulary it was built with. Documents are known by a number of their row. Postings are
written where they arise, in segments sorted by term, so indexing has no shuffle. A posting of
the end mark at each document's length records the number of its words, and its id.

A phrase is looked up from its rarest terms: their postings, each moved back by the term's
offset, are intersected; what is left is intersected with the lists of all other terms of the
phrase, read from the documents still in question only. A proximity query starts from its
rarest term's postings and joins the others by (document, block of positions).

Phrases and terms are joined by broadcast while a count shows them to be few, else by
shuffle; hot terms are then split by the adaptive join.

Defined results: a null or empty text has no words; very long texts are searched whole; rows without an id and rows that repeat one are
documents of their own; an item without an id is matched and not named; items without a word have no window; items that
share a window all count; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.spans import let
from .common import ascii_lower, bounded, table

#: Runs of the characters between words; A-Z, once lowered, are in words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In a document's words, after the last one. It is no word.
END = "\x00"
#: Words in a window.
WINDOW = 10
#: Lists intersected before the full ones.
RAREST = 2


def words(text: Column) -> Column:
    """A text's words. Splitting takes a tenth of the time of extracting; what stands before
    the first separator or behind the last may be empty."""

    def inner(w: Column) -> Column:
        first, last = (F.get(w, F.lit(0)) == "").cast("int"), (F.get(w, F.size(w) - 1) == "").cast("int")
        return F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))

    return let(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), inner)


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, a table in the shared folder: term, row, pos, and doc_id with the end marks only. vocabulary: word, term."""
    # The outer form: Spark would find the words twice to skip rows without any.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))  # numbered before they are exploded
    found = rows.select("row", "doc_id", F.posexplode_outer(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    found = found.select("row", "pos", ascii_lower(F.col("word")).alias("word"), F.when(F.col("word") == END, F.col("doc_id")).alias("doc_id"))
    return table(found.join(bounded(vocabulary), "word").select("term", "row", "pos", "doc_id").sortWithinPartitions("term"), "postings")


def documents(index: DataFrame) -> DataFrame:
    """row, doc_id, n_words of every document of the index."""
    return index.where(F.col("term") == F.xxhash64(F.lit(END))).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def vocabulary(items: DataFrame, text_col: str = "text") -> DataFrame:
    """The items' words and the end mark, with the 64-bit hash that stands for each."""
    found = items.select(F.explode(F.concat(words(F.col(text_col)), F.array(F.lit(END)))).alias("word"))
    found = found.union(items.sparkSession.createDataFrame([(END,)], "word string")).select(ascii_lower(F.col("word")).alias("word")).distinct()
    found = table(found.select("word", F.xxhash64("word").alias("term")), "vocabulary")
    if not found.groupBy("term").count().where("count > 1").isEmpty():
        raise ValueError("two test words share a hash")
    return found


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, win, k, term: the words of each window. An item of fewer words is one window."""
    got = items.select(F.col(id_col).alias("item_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(ascii_lower(w))).alias("w")).where(F.size("w") > 0)
    got = got.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("s"))
    got = table(got.select("item_id", F.slice("w", F.col("s") + 1, size).alias("w")).distinct(), "items")
    # Windows are numbered, not hashed: two never share a number.
    of = table(got.select("w").distinct().withColumn("win", F.monotonically_increasing_id()), "numbers")
    return table(got.join(of, "w").select("item_id", "win", F.posexplode("w").alias("k", "term")), "windows")


def phrase_matches(index: DataFrame, phrases: DataFrame, rarest: int = RAREST) -> DataFrame:
    """row, win, start, length of every exact occurrence of the phrases (win, k, term), as
    a table in the shared folder."""
    phrases = phrases.select("win", "k", "term").distinct()
    df = table(index.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    by_win = W.partitionBy("win")
    ranked = phrases.join(bounded(df), "term", "left").withColumns({"df": F.coalesce("df", F.lit(0))})
    ranked = ranked.withColumns({"r": F.row_number().over(by_win.orderBy("df", "k")), "length": F.count("*").over(by_win), "least": F.min("df").over(by_win)})
    ranked = table(ranked.where("least > 0"), "phrases")
    anchors = table(ranked.where(F.col("r") <= rarest).select("win", "k", "term", "r", "length"), "anchors")
    lists = index.join(bounded(anchors), "term").where("pos >= k").select("row", "win", (F.col("pos") - F.col("k")).alias("start"), "r", "length")
    both = lists.groupBy("row", "win", "start").agg(F.bit_or(F.expr("shiftleft(1L, r)")).alias("got"), F.first("length").alias("length"))
    met = table(both.where(F.expr(f"got = shiftleft(2L, cast(least(length, {rarest}) as int)) - 2")).select("row", "win", "start", "length"), "met")
    # All terms of what is left, against the documents still in question.
    todo = met.join(bounded(ranked.select("win", "k", "term")), "win").select("row", "win", "start", "length", "k", "term", (F.col("start") + F.col("k")).alias("pos"))
    asked = table(met.select("row").distinct(), "asked")
    terms = table(ranked.select("term").distinct(), "terms")
    lists = index.join(bounded(terms), "term", "left_semi").join(bounded(asked), "row", "left_semi")
    hits = todo.join(lists, ["row", "pos", "term"]).groupBy("row", "win", "start", "length").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("got"))
    return table(hits.where(F.expr("got = shiftleft(2L, cast(length as int) - 1) - 1")).drop("got"), "matches")


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """row, win, pos: positions of each query's rarest term (win, k, term) around which all
    its other distinct terms occur within `slop` words on either side."""
    queries = queries.select("win", "term").distinct()
    df = table(index.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    order = W.partitionBy("win").orderBy("df", "term")
    ranked = table(queries.join(bounded(df), "term", "left").withColumns({"df": F.coalesce("df", F.lit(0))}).withColumns({"r": F.row_number().over(order), "n": F.count("*").over(W.partitionBy("win"))}), "queries")
    first = index.join(bounded(ranked.where("r = 1").select("win", "term", "n")), "term").select("row", "win", "n", F.col("pos").alias("at"))
    rest = index.join(bounded(ranked.where("r > 1").select("win", "term", "r")), "term").select("row", "win", "pos", "r")
    block = first.select("*", F.explode(F.array(*[(F.col("at") / (slop + 1)).cast("int") + d for d in (-1, 0, 1)])).alias("block"))
    near = block.join(rest.withColumn("block", (F.col("pos") / (slop + 1)).cast("int")), ["row", "win", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    met = near.groupBy("row", "win", "at", "n").agg(F.count_distinct("r").alias("got")).where("got = n - 1").select("row", "win", F.col("at").alias("pos"))
    return met.unionByName(first.where("n = 1").select("row", "win", F.col("at").alias("pos")))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: id, n_words, n_hit, item_ids (sorted strings), contaminated."""
    if size > 62:
        raise ValueError("a window has at most 62 words")
    terms = vocabulary(items, text_col)
    index = build_index(docs, terms, id_col, text_col)
    wins = windows(items, size, text_col=text_col)
    matches = phrase_matches(index, wins)
    hit = matches.select("row", F.explode(F.sequence("start", (F.col("start") + F.col("length") - 1).cast("int"))).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    # The items are joined to what matched, a row a document and window.
    items_of = matches.select("row", "win").distinct().join(bounded(table(wins.select("win", F.col("item_id").cast("string").alias("item")).distinct(), "items")), "win").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = table(hit.join(items_of, "row"), "hits")
    out = documents(index).join(bounded(found), "row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_hit", "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def near_items(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id") -> DataFrame:
    """id, item_id, n_places: the documents in which all of an item's distinct words occur within `slop` words on either side of its
    rarest, and at how many places of that. A row for each document and item."""
    index = build_index(docs, vocabulary(items, text_col), id_col, text_col)
    asked = items.select(F.monotonically_increasing_id().alias("win"), F.col(item_id).alias("item_id"), words(F.col(text_col)).alias("w"))
    asked = asked.select("win", "item_id", F.explode("w").alias("word"))
    asked = table(asked.select("win", "item_id", F.xxhash64(ascii_lower(F.col("word"))).alias("term")).distinct(), "asked")
    found = table(proximity_matches(index, asked, slop).groupBy("row", "win").agg(F.count_distinct("pos").alias("n_places")), "near")
    of = asked.select("win", "item_id").distinct()
    return found.join(bounded(table(of, "items")), "win").join(documents(index), "row").select(F.col("doc_id").alias(id_col), "item_id", "n_places")
