"""References to records that do not exist, or that came to exist only later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Reference:
    """child_table.field refers to parent_table's key."""

    child_table: str
    field: str
    parent_table: str
    child_key: str = "id"
    child_time: str = "created_at"
    parent_key: str = "id"
    parent_time: str = "created_at"


#: The references of the chat tables.
CHAT_REFERENCES = (
    Reference("messages", "conversation_id", "conversations"),
    Reference("messages", "contact_id", "contacts"),
    Reference("conversations", "contact_id", "contacts"),
)

_KEY = ["parent_table", "key"]


def _children(tables: dict[str, DataFrame], references: tuple[Reference, ...]) -> DataFrame:
    parts = [
        tables[r.child_table].select(
            F.lit(r.child_table).alias("child_table"), F.lit(r.field).alias("child_field"), F.lit(r.parent_table).alias("parent_table"),
            F.col(r.child_key).cast("long").alias("child_id"), F.col(r.field).cast("long").alias("key"), F.col(r.child_time).alias("ref_time"),
        ).filter("key is not null")
        for r in references
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parents(tables: dict[str, DataFrame], references: tuple[Reference, ...]) -> DataFrame:
    seen = dict.fromkeys((r.parent_table, r.parent_key, r.parent_time) for r in references)
    parts = [
        tables[t].select(F.lit(t).alias("parent_table"), F.col(k).cast("long").alias("key"), F.col(at).alias("parent_time")).filter("key is not null")
        for t, k, at in seen
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suspect_keys(tables: dict[str, DataFrame], references: tuple[Reference, ...] = CHAT_REFERENCES) -> DataFrame:
    """Keys that some row refers to and that have no parent, or one created after the earliest reference.

    Tagged parent and child keys are united in long form and grouped by parent table and key. Both
    sides are reduced to minima and flags before the shuffle (map-side), so that a key holding a
    third of all rows arrives as one row per task. Of several parent rows with one key the earliest
    time counts; a parent without a time is never late.
    """
    none = F.lit(None)
    child = _children(tables, references).select(*_KEY, F.lit(0).alias("is_parent"), F.lit(1).alias("is_child"), "ref_time", none.cast("timestamp_ntz").alias("parent_time"))
    parent = _parents(tables, references).select(*_KEY, F.lit(1).alias("is_parent"), F.lit(0).alias("is_child"), none.cast("timestamp_ntz").alias("ref_time"), "parent_time")
    ntz = lambda df: df.withColumn("ref_time", F.col("ref_time").cast("timestamp_ntz")).withColumn("parent_time", F.col("parent_time").cast("timestamp_ntz"))
    keys = ntz(child).unionByName(ntz(parent)).groupBy(*_KEY).agg(
        F.max("is_parent").alias("has_parent"), F.max("is_child").alias("has_child"), F.min("ref_time").alias("first_ref"), F.min("parent_time").alias("parent_time"),
    )
    return keys.filter((F.col("has_child") == 1) & ((F.col("has_parent") == 0) | (F.col("parent_time") > F.col("first_ref")))).select(*_KEY, "has_parent", "parent_time")


def orphan_references(tables: dict[str, DataFrame], references: tuple[Reference, ...] = CHAT_REFERENCES) -> DataFrame:
    """One row per referring row and field whose target is absent ('missing') or was created later ('late').

    Columns: child_table, child_field, parent_table, child_id, key, ref_time, reason. Null
    references are no case. A referring row without a time is a case only if the target is absent.
    Rows delivered twice count once; of copies that differ in time, the earliest counts. Child rows
    without an id give one row with a null child_id per key and time. Other columns of the
    tables are ignored. The join that finds the rows of the suspect keys meets only those keys; where
    one of them is hot, adaptive execution splits its partition (the children are the split side).
    """
    suspects = suspect_keys(tables, references)
    rows = _children(tables, references).withColumn("ref_time", F.col("ref_time").cast("timestamp_ntz"))
    hit = rows.join(suspects, _KEY).filter((F.col("has_parent") == 0) | (F.col("parent_time") > F.col("ref_time")))
    hit = hit.withColumn("reason", F.when(F.col("has_parent") == 0, "missing").otherwise("late"))
    return hit.groupBy("child_table", "child_field", "parent_table", "child_id", "key").agg(F.min("ref_time").alias("ref_time"), F.min("reason").alias("reason"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphan_references per referring table, field, target and month of the referring row (null: no time)."""
    return (
        found.withColumn("month", F.date_format(F.date_trunc("month", "ref_time"), "yyyy-MM"))
        .groupBy("child_table", "child_field", "parent_table", "month")
        .agg(F.sum((F.col("reason") == "missing").cast("long")).alias("n_missing"), F.sum((F.col("reason") == "late").cast("long")).alias("n_late"))
    )
