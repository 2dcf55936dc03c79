"""Token labels for sequence models: from spans to labels and back, and the model cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import let

_SPAN = "struct<start:int,end:int,category:string,confidence:double>"


def encode(tokens: Column, entities: Column) -> Column:
    """Labels of tokens (array of start, end): B- where an entity starts, I- inside one or across
    an edge of one, O elsewhere; null for tokens without text."""

    def label(t: Column, i: Column) -> Column:
        def one(e: Column) -> Column:
            inside = (t["start"] >= e["start"]) & (t["end"] <= e["end"])
            touches = ((t["start"] >= e["start"]) & (t["start"] < e["end"])) | ((t["end"] > e["start"]) & (t["end"] <= e["end"]))
            before = F.get(tokens, i - 1)
            begins = (t["start"] == e["start"]) | (i == 0) | (before["start"] == before["end"])
            return F.when(inside & begins, F.concat(F.lit("B-"), e["category"])).when(inside | touches, F.concat(F.lit("I-"), e["category"]))

        found = F.filter(F.transform(entities, one), lambda x: x.isNotNull())
        return F.when(t["start"] < t["end"], F.coalesce(F.get(found, F.lit(0)), F.lit("O")))

    return F.transform(tokens, label)


def decode(tokens: Column) -> Column:
    """Spans of labelled tokens (array of start, end, label, confidence): B- opens one, I- of the same
    category goes on with the lower confidence, I- of another opens one if one is open; any other
    label closes. Tokens without text are passed over."""

    def step(acc: Column, t: Column) -> Column:
        category = F.substring(t["label"], F.lit(3), F.length(t["label"]))
        fresh = F.struct(t["start"].alias("start"), t["end"].alias("end"), category.alias("category"), t["confidence"].cast("double").alias("confidence"))
        last = acc["open"]
        done = F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        on = F.struct(last["start"].alias("start"), t["end"].alias("end"), category.alias("category"), F.least(last["confidence"], t["confidence"].cast("double")).alias("confidence"))
        inner = t["label"].startswith("I-") & last.isNotNull()
        return (
            F.when(t["start"] == t["end"], acc)
            .when(inner & (last["category"] == category), F.struct(acc["done"].alias("done"), on.alias("open")))
            .when(t["label"].startswith("B-") | inner, F.struct(done.alias("done"), fresh.alias("open")))
            .otherwise(F.struct(done.alias("done"), F.lit(None).cast(_SPAN).alias("open")))
        )

    zero = F.struct(F.array().cast(f"array<{_SPAN}>").alias("done"), F.lit(None).cast(_SPAN).alias("open"))
    return let(F.aggregate(tokens, zero, step), lambda r: F.when(r["open"].isNull(), r["done"]).otherwise(F.concat(r["done"], F.array(r["open"]))))


#: Key, name, architecture, backbone, embeddings, encoder, heads, hidden, layers, classifier, total, MB in 16 bits, MB in 8.
CARDS = [
    ("deberta-v3-base", "deberta-v3-base-deid", "DeBERTa-v3 Token Classification with Disentangled Attention", "microsoft/deberta-v3-base", 38_400_000, 85_940_000, 12, 768, 12, 35_000, 124_400_000, 248.8, 124.4),
    ("bio-clinicalbert", "bio-clinicalbert-deid", "Clinical BERT Token Classification", "emilyalsentzer/Bio_ClinicalBERT", 23_326_464, 84_951_552, 12, 768, 12, 32_256, 108_310_272, 216.6, 108.3),
    ("deberta-v3-small", "deberta-v3-small-deid", "Lightweight DeBERTa-v3 Token Classification", "microsoft/deberta-v3-small", 22_100_000, 21_965_000, 12, 768, 6, 35_000, 44_100_000, 88.2, 44.1),
    ("roberta-base", "roberta-base-biomedical-deid", "RoBERTa Token Classification", "roberta-base", 39_472_896, 85_054_464, 12, 768, 12, 35_000, 124_645_632, 249.3, 124.6),
]
BUDGET = 1_000_000_000


def model_cards(spark: SparkSession) -> DataFrame:
    """The known sequence models, with their share of the parameter budget."""
    cards = spark.createDataFrame(CARDS, "key string, model_name string, architecture string, backbone string, embeddings long, encoder_layers long, attention_heads int, hidden_dim int, num_layers int, classifier_head long, total_parameters long, memory_fp16_mb double, memory_int8_mb double")
    n = F.col("total_parameters")
    return cards.withColumns({"total_parameters_formatted": F.concat(F.format_number(n, 0), F.lit(" ("), F.format_string("%.1f", n / 1e6), F.lit("M)")), "under_1b_ceiling": n < BUDGET, "utilization_pct": F.concat(F.format_string("%.2f", n * 100 / BUDGET), F.lit("%"))})


def find_card(name: str) -> str:
    """The key of the card that a name means; the first card if none."""
    sought = name.lower().replace("_", "-")
    keys = [c[0] for c in CARDS]
    return next((k for k in keys if k == sought), next((k for k in keys if k in sought or sought in k), keys[0]))
