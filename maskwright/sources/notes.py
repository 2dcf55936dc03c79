"""Where notes come from and where results go."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<start:int,end:int,text:string,category:string,surrogate:string,shifted_date:string>"
CORPUS = f"test_case_id string, specialty string, note_type string, adversarial_tags array<string>, raw_text string, entities array<{ENTITY}>, expected_masked_text string, date_shift_days int"
SEGMENT = "struct<text:string,category:string,surrogate:string,format:string>"


def read_corpus(spark: SparkSession, source: str | list[dict]) -> DataFrame:
    """Annotated notes from a JSON file (one list, or an object a line) or from a list."""
    if isinstance(source, list):
        return spark.createDataFrame(source, CORPUS)
    return spark.read.schema(CORPUS).option("multiLine", True).json(source)


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, text of whole text files. From a .json file: its clinical_note, else its text, else all
    of it. A file is read by one task; files that can't be decoded as text aren't meant."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    own = F.coalesce(F.try_variant_get(F.try_parse_json("raw"), "$.clinical_note", "string"), F.try_variant_get(F.try_parse_json("raw"), "$.text", "string"), F.col("raw"))
    return raw.select("path", F.when(F.lower("path").endswith(".json"), own).otherwise(F.col("raw")).alias("text"))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any source that Spark reads: parquet, orc, csv, json, text, jdbc."""
    return spark.read.format(fmt).options(**options).load(path)


def split_notes(lines: Iterable[str]) -> list[str]:
    """Notes from typed lines; an empty line ends one."""
    out: list[str] = []
    now: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            now.append(line.rstrip("\n"))
        elif now:
            out.append("\n".join(now))
            now = []
    return out


def build_notes(df: DataFrame, segments_col: str = "segments", days: Column | None = None) -> DataFrame:
    """df with raw_text, entities and expected_masked_text from segments (text, category, surrogate,
    format); a segment with a category is an identifier. Dates whose format is given are moved, in
    it, by days (45 unless given); those that don't fit it stay."""
    days = F.lit(45) if days is None else days

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        moved = F.coalesce(F.call_function("date_format", F.date_add(F.try_to_timestamp(s["text"], s["format"]).cast("date"), days), s["format"]), s["text"])
        entity = F.struct(acc["at"].alias("start"), end.alias("end"), s["text"].alias("text"), s["category"].alias("category"), s["surrogate"].alias("surrogate"), F.when((s["category"] == "DATE") & s["format"].isNotNull(), moved).alias("shifted_date"))
        return F.struct(end.alias("at"), F.when(s["category"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(entity))).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ENTITY}>").alias("found"))
    segments = F.col(segments_col)
    return df.withColumns({
        "raw_text": F.array_join(F.transform(segments, lambda s: s["text"]), ""),
        "entities": F.aggregate(segments, zero, step)["found"],
        "expected_masked_text": F.array_join(F.transform(segments, lambda s: F.when(s["category"].isNull(), s["text"]).otherwise(s["surrogate"])), ""),
    })


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def comparison(metrics: DataFrame, engine: str = "engine", names: tuple[str, ...] = ("regex", "ner", "core")) -> DataFrame:
    """One row a metric, one column an engine. metrics: engine and a column for each metric."""
    values = [c for c in metrics.columns if c != engine]
    long = metrics.unpivot([engine], values, "metric", "value")
    return long.groupBy("metric").pivot(engine, list(names)).agg(F.first("value"))


def markdown(table: DataFrame) -> str:
    """A table small enough to read, such as comparison()'s nine rows, in Markdown; rows come one by one."""
    rows = table.toLocalIterator()
    head = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*head, *["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]])
