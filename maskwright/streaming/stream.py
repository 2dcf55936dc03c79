"""The same chain on streams. Rows stand alone, so there is no state and no watermark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import mask
from ..plans.deidentify import deidentify, split_mapping


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(path)


def deidentify_stream(stream: DataFrame, out: str, mapping: str, checkpoint: str, id_col: str, text_col: str = "text", patient_col: str | None = None, available_now: bool = True, **options: Any) -> StreamingQuery:
    """Writes masked documents to `out` and what was masked to `mapping`, a batch's number in the
    path of each, so that a batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        masked = deidentify(batch, text_col, patient_col, **options).persist()  # two sinks, one run of the chain
        documents, originals = split_mapping(masked, id_col)
        documents.drop(text_col).write.mode("overwrite").parquet(f"{out}/batch={number}")
        originals.write.mode("overwrite").parquet(f"{mapping}/batch={number}")
        masked.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def rehydrate_stream(replies: DataFrame, mapping: DataFrame, id_col: str, response_col: str = "response") -> DataFrame:
    """Replies, streamed or not, restored by the mapping rows (id, token, original) of their ids. A token that
    comes with several originals, as when an id repeats, takes the largest."""
    one = mapping.where("token is not null").groupBy(id_col, "token").agg(F.max("original").alias("original"))
    held = one.groupBy(id_col).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "original")))).alias("__held"))
    joined = replies.join(held, id_col, "left")
    return joined.withColumn("final_text", mask.rehydrate(F.col(response_col), F.coalesce("__held", F.create_map().cast("map<string,string>")))).drop("__held")
