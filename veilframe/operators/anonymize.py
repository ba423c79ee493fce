"""Texts to masked texts: detection, policy, choice among overlaps, numbering, splicing, and back; also over JSON and tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.operators.persons import filter_names
from veilframe.operators.recognizers import LONGEST_TEXT, detect
from veilframe.operators.spans import by_start, disabled_types, empty_spans, in_policy, mapping_of, numbered, resolve_overlaps, restored, spliced, without

def entities(text: Column, disable: Column | None = None, names: tuple[str, ...] | None = None, extra: Column | None = None, lexicon: Column | None = None) -> Column:
    """Entities of a text after policy, name filter and choice among overlaps, numbered; none for null and blank texts."""
    spans = in_policy(detect(text, names, extra))
    if disable is not None:
        spans = without(spans, disabled_types(disable))
    if lexicon is not None:
        spans = filter_names(text, spans, lexicon)
    blank = text.isNull() | ~text.rlike(r"[^\s\p{Z}]")
    return F.when(blank, numbered(empty_spans(), text)).otherwise(numbered(resolve_overlaps(spans), text))


def anonymize(df: DataFrame, column: str, disable: Column | None = None, names: tuple[str, ...] | None = None, extra: Column | None = None, lexicon: Column | None = None, return_mapping: bool = True) -> DataFrame:
    """Adds anonymized, entities_found and mapping for a text column.

    Null stays null; texts without entities are unchanged. Without return_mapping the values are blanked and the mapping is empty.
    Each rule looks only at texts that its own hint, a plain pattern, is found in.
    """
    out = df.withColumn("entities_found", entities(F.col(column), disable, names, extra, lexicon))
    out = out.withColumn("anonymized", F.when(F.size("entities_found") == 0, F.col(column)).otherwise(spliced(F.col(column), F.col("entities_found"))))
    out = out.withColumn("mapping", mapping_of(F.col("entities_found")))
    return out if return_mapping else redacted(out)


def redacted(df: DataFrame) -> DataFrame:
    """Values of entities blanked, the mapping emptied."""
    return df.withColumn("entities_found", F.transform("entities_found", lambda e: e.withField("value", F.lit("")))).withColumn("mapping", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def deanonymize(df: DataFrame, text: str, mapping: str) -> DataFrame:
    """Adds deanonymized and replaced (the number of placeholders put back). A null mapping changes nothing."""
    r = restored(F.col(text), F.coalesce(F.col(mapping), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return df.withColumn("__r", r).withColumn("deanonymized", F.col("__r.deanonymized")).withColumn("replaced", F.col("__r.replaced")).drop("__r")


def checked_requests(df: DataFrame, text: str, most: int = LONGEST_TEXT) -> DataFrame:
    """Adds error: 'empty', 'too_long' or null, by the number of code points."""
    n = F.length(text)
    return df.withColumn("error", F.when(F.col(text).isNull() | (n == 0), "empty").when(n > most, "too_long"))


def json_strings(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, path, ordinal, value) of each string value of a JSON column, in the order of the text; keys aren't touched. Broken JSON and null give none."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, path string, ordinal int, value string"

    def walk(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[id_col], pdf[column]):
                try:
                    doc = json.loads(t) if t else None
                except ValueError:
                    continue
                for k, (p, v) in enumerate(_strings(doc, "$")):
                    rows.append((i, p, k, v))
            yield pd.DataFrame(rows, columns=[id_col, "path", "ordinal", "value"])

    return df.select(id_col, column).filter(F.col(column).isNotNull()).mapInPandas(walk, schema)


def _strings(x, path):
    if isinstance(x, str):
        yield path, x
    elif isinstance(x, dict):
        for k, v in x.items():
            yield from _strings(v, f"{path}.{k}")
    elif isinstance(x, list):
        for k, v in enumerate(x):
            yield from _strings(v, f"{path}[{k}]")


def _rebuilt(x, values):
    if isinstance(x, str):
        return next(values)
    if isinstance(x, dict):
        return {k: _rebuilt(v, values) for k, v in x.items()}
    if isinstance(x, list):
        return [_rebuilt(v, values) for v in x]
    return x


def anonymize_json(df: DataFrame, id_col: str, column: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(id, anonymized, n_entities) of a JSON column: string values masked one by one (numbers of placeholders restart in each), all else in order as it was.

    Ids must be unique. The strings go through the native rules; only taking apart and putting together is Python. Broken JSON and null come back unchanged.
    """
    strings = json_strings(df, id_col, column)
    masked = anonymize(strings, "value", names=names).select(id_col, "ordinal", "anonymized", F.size("entities_found").alias("n"))
    per = masked.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ordinal", "anonymized"))).alias("parts"), F.sum("n").cast("int").alias("n_entities"))
    joined = df.select(id_col, column).join(per, id_col, "left").select(id_col, column, F.transform("parts", lambda p: p["anonymized"]).alias("parts"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))

    @F.pandas_udf(T.StringType())
    def build(source: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for s, p in zip(source, parts):
            if p is None or s is None:
                out.append(s)
            else:
                out.append(json.dumps(_rebuilt(json.loads(s), iter(list(p))), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return joined.select(id_col, build(column, "parts").alias("anonymized"), "n_entities")


def row_context(cells: DataFrame, row_key: str, order: str, text: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """Cells of table rows masked in the context of their row: entities are found in the cells joined by spaces and then replaced by value in each
    cell, the longest first; of a value found twice the later placeholder counts. Adds masked."""
    joined = cells.groupBy(row_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.coalesce(x[text], F.lit(""))), " ").alias("__row"))
    found = joined.withColumn("__e", entities(F.col("__row"), names=names)).select(row_key, "__e")
    last = F.filter("__e", lambda e, i: ~F.exists(F.slice("__e", i + 2, F.greatest(F.size("__e") - i - 1, F.lit(0))), lambda k: k["value"] == e["value"]))
    ranked = F.array_sort(F.transform(last, lambda e: F.struct((-F.length(e["value"])).alias("a"), e["value"].alias("value"), e["placeholder"].alias("placeholder"))))
    both = cells.join(found.withColumn("__v", ranked), row_key, "left")
    return both.withColumn("masked", F.when(F.col(text).isNull(), None).otherwise(F.aggregate(F.coalesce("__v", F.array().cast("array<struct<a:int,value:string,placeholder:string>>")), F.col(text), lambda t, e: F.replace(t, e["value"], e["placeholder"])))).drop("__e", "__v")


def word_boxes(words: DataFrame, doc: str, order: str, text: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """Words of pages with the offsets they have in the words joined by spaces, and whether an entity overlaps them (hit): the boxes to paint over."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("start_pos", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("int")).withColumn("end_pos", (F.col("start_pos") + F.length(text)).cast("int"))
    lines = words.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("__t"))
    found = lines.withColumn("__e", by_start(F.transform(entities(F.col("__t"), names=names), lambda e: F.struct(e["entity_type"], e["start_pos"], e["end_pos"], e["score"])))).select(doc, "__e")
    return placed.join(found, doc, "left").withColumn("hit", F.exists("__e", lambda e: (e["start_pos"] < F.col("end_pos")) & (F.col("start_pos") < e["end_pos"]))).drop("__e")
