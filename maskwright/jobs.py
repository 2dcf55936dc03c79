"""spark-submit mains: deidentify, rehydrate, summarize, ask, benchmark, health.

    spark-submit maskwright/jobs.py deidentify --input notes.parquet --output masked --mapping kept-apart --id note_id
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import labels
from maskwright.plans import evaluate, gateway
from maskwright.plans.deidentify import deidentify, split_mapping
from maskwright.sources import notes
from maskwright.streaming.stream import rehydrate_stream


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maskwright")
    jobs = out.add_subparsers(dest="job", required=True)
    for name in ("deidentify", "rehydrate", "summarize", "ask", "benchmark", "health"):
        job = jobs.add_parser(name)
        if name == "health":
            continue
        job.add_argument("--input", required=True)
        job.add_argument("--format", default="parquet")
        job.add_argument("--output", required=True)
        job.add_argument("--mode", default="error", choices=["error", "overwrite", "append", "ignore"])
        job.add_argument("--id", default="id")
        job.add_argument("--text", default="response" if name == "rehydrate" else "raw_text" if name == "benchmark" else "text")
        if name in ("deidentify", "rehydrate"):
            job.add_argument("--mapping", required=True, help="where the originals are kept, apart from the documents")
        if name != "rehydrate":
            job.add_argument("--patient")
            job.add_argument("--salt")
        if name == "ask":
            job.add_argument("--question", required=True)
        if name == "benchmark":
            job.add_argument("--gold", default="entities")
            job.add_argument("--match", default="overlap", choices=["overlap", "exact"])
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Runs a job; returns what it has written (for health, what it knows)."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"maskwright {a.job}").getOrCreate()
    if a.job == "health":
        return labels.model_cards(spark).select("key", "total_parameters", "under_1b_ceiling", F.lit(spark.version).alias("spark"))
    df = spark.read.format(a.format).load(a.input)
    options = {"salt": a.salt} if getattr(a, "salt", None) else {}
    if a.job == "deidentify":
        documents, originals = split_mapping(deidentify(df, a.text, a.patient, **options), a.id)
        originals.write.mode(a.mode).parquet(a.mapping)
        out = documents.drop(a.text)
    elif a.job == "rehydrate":
        out = rehydrate_stream(df, spark.read.parquet(a.mapping), a.id, a.text)
    elif a.job == "benchmark":
        run = evaluate.runs(df, a.id, a.text, a.gold, a.patient)
        evaluate.by_category(run, a.match).write.mode(a.mode).parquet(f"{a.output}/by_category")
        out = evaluate.summary(run, a.match)
        out.write.mode(a.mode).parquet(f"{a.output}/summary")
        out = spark.read.parquet(f"{a.output}/summary")
        print(notes.markdown(notes.comparison(out, names=evaluate.ENGINES).orderBy("metric")))
        return out
    else:
        out = gateway.summarize(df, a.text, patient_col=a.patient, **options) if a.job == "summarize" else gateway.ask(df, a.question, a.text, patient_col=a.patient, **options)
        out = out.select(a.id, "masked_text", "raw_response", "final_text", "leak_check_passed", "entity_count")
    out.write.mode(a.mode).parquet(a.output)
    return spark.read.parquet(a.output)


if __name__ == "__main__":
    main()
