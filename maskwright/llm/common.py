"""What the operators share: shared-folder tables, bounded broadcasts, ASCII case folding."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast if it has at most this many rows (some 100 bytes each in the hash table besides
#: what they hold) and its strings and arrays at most that many bytes. Larger sides are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000
ROW = "__row"
#: Text that a Python worker gets at a time, in bytes and rows.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset and the
    master is local, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="maskwright-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: What `passing` has yet to delete, innermost last.
_PASSING: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/maskwright/{name}-{uuid.uuid4().hex}"
    if _PASSING:
        _PASSING[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the paths and tables made within when it ends. Results that read them must be written elsewhere by then."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            delete(spark, path)


def write(df: DataFrame, path: str) -> None:
    """Writes df as Parquet. The shuffle files of the write go when it ends, since nothing reads them again; else they stay until the driver's garbage collector
    finds them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    path = scratch(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes a table() that is no longer read."""
    delete(df.sparkSession, df.table_path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small enough, else as it is. df is a written table, so
    that the count reads footers only; strings and arrays, if any, are measured."""
    if df.count() > rows:
        return df
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    if wide and (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0) > most:
        return df
    return F.broadcast(df)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (a written table with the one column)."""
    return docs.join(bounded(ids), id_col, "left_anti")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row in ROW, which stays the same whenever it is read; docs itself if it has them. What is read from Parquet files
    as they are is numbered by file and place; all else is written."""
    if ROW in docs.columns:
        return docs
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        found = docs.select("*", "_metadata.file_path", "_metadata.row_index").toDF(*docs.columns, "__file", "__at")
        files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # a name for each file
        named = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "__file string, __k long")
        return found.join(F.broadcast(named), "__file").select(*docs.columns, (F.col("__k") * 2**40 + F.col("__at")).alias(ROW))
    return table(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. lower() also folds other letters, so it serves
    only where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: executors fetch it as a zip file, once. Arrow
    batches are held to BATCH_BYTES, since rows with long texts would make them as large as they come."""
    context = spark.sparkContext
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}", str(2**31 - 1)))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    if getattr(context, "_maskwright", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="maskwright-")) / "maskwright.zip"
    with zipfile.ZipFile(path, "w") as out:
        for x in sorted(package.rglob("*.py")):
            out.write(x, x.relative_to(package.parent))
    context.addPyFile(str(path))
    context._maskwright = True
