"""Sinks: annotated records as JSON lines and CoNLL, predictions, masked texts, and metrics with their provenance."""

from __future__ import annotations

import json
import platform

import pyspark
from pyspark.sql import DataFrame, functions as F

from veilframe.sources.tagging import tags_of, tokens_of


def write_dataset(df: DataFrame, path: str, split: str = "split") -> None:
    """Records (id, template_id, subset, text, spans, split) as JSON lines under path/jsonl and as CoNLL sentences under path/conll, in one folder for each split.

    Null texts are left out. Spans are written as start, stop and type, as read_gold takes them. The records are spread over as many files as they have
    partitions; nothing is gathered.
    """
    d = df.filter("text is not null")
    spans = F.transform("spans", lambda s: F.struct(s["start_pos"].alias("start"), s["end_pos"].alias("stop"), s["entity_type"].alias("type")))
    line = F.to_json(F.struct("id", "template_id", "subset", "text", spans.alias("spans")))
    d.select(line.alias("value"), split).write.partitionBy(split).text(f"{path}/jsonl")
    tokens = tokens_of(F.col("text"))
    t = d.select(split, "text", "spans", tokens.alias("tokens")).withColumn("tags", tags_of(F.col("tokens"), F.col("spans")))
    words = F.transform("tokens", lambda x: F.substring("text", x["start_pos"] + 1, x["end_pos"] - x["start_pos"]))
    rows = F.zip_with(words, F.col("tags"), lambda w, g: F.concat(w, F.lit("\t"), g))
    t.filter(F.size("tokens") > 0).select(F.concat(F.array_join(rows, "\n"), F.lit("\n")).alias("value"), split).write.partitionBy(split).text(f"{path}/conll")


def write_predictions(df: DataFrame, path: str, ms: float | None = None) -> None:
    """Predictions (id, spans, anonymized) as JSON lines that read_predictions takes; ms: the time of the batch for each row, if measured."""
    spans = F.transform("spans", lambda s: F.array(s["start_pos"], s["end_pos"]))
    df.select("id", spans.alias("spans"), F.lit(ms).cast("double").alias("ms"), "anonymized").write.json(path)


def write_masked(df: DataFrame, path: str) -> None:
    """Masked texts with the number of entities by type as a JSON summary; the answer of a service, for whole tables. df: id, anonymized, entities_found."""
    kinds = F.array_distinct(F.transform("entities_found", lambda e: e["entity_type"]))
    counts = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter("entities_found", lambda e: e["entity_type"] == k)))))
    df.select("id", "anonymized", F.to_json(counts).alias("summary")).write.parquet(path)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows of a table, and a digest of their contents that doesn't depend on their order; in one pass."""
    h = df.select(F.xxhash64(*[F.col(c) if not isinstance(f.dataType, pyspark.sql.types.MapType) else F.to_json(c) for c, f in zip(df.columns, df.schema)]).alias("h"))
    n, a, b = h.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 31)))).first()
    return n, f"{(a or 0) & (2**64 - 1):016x}{b or 0:x}"


def write_report(metrics: DataFrame, path: str, inputs: dict[str, DataFrame], settings: dict[str, str] | None = None) -> None:
    """A small table of metrics as JSON lines under path/metrics, and where it comes from (rows and digests of the inputs, versions, settings) under path/provenance."""
    spark = metrics.sparkSession
    facts = {k: dict(zip(("rows", "digest"), fingerprint(d))) for k, d in inputs.items()}
    about = {"inputs": facts, "versions": {"spark": spark.version, "python": platform.python_version()}, "settings": settings or {}}
    metrics.write.json(f"{path}/metrics")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").write.text(f"{path}/provenance")
