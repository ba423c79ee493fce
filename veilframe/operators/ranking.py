"""Row numbers and running sums within keys of any size, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veilframe.session import written


def spread_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank", size: str | None = None, size_out: str = "before") -> DataFrame:
    """Adds the position of each row within its keys in the given order, from 1.

    The rows are range-partitioned by keys and order, so that a key holding a third of all rows
    is spread over many tasks; each partition numbers its own rows and adds the count (and, with
    `size`, the sum of that column) of the key's rows in earlier partitions. The range-partitioned
    rows are written once, because the ranges come from a sample and must not be drawn anew. The
    partial counts are one row per partition and key that the partition holds. The order must be
    total within the keys for a repeatable result; nulls sort first. An empty input gives an empty
    result.
    """
    part, local = "__part", "__local"
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "ranked")
    within = Window.partitionBy(part, *keys).orderBy(*order)
    agg = [F.count(F.lit(1)).alias("__n")] + ([F.sum(F.coalesce(F.col(size), F.lit(0))).alias("__s")] if size else [])
    parts = ranged.groupBy(part, *keys).agg(*agg)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__off", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    if size:
        offsets = offsets.withColumn("__soff", F.coalesce(F.sum("__s").over(earlier), F.lit(0)))
    # Only keys that go over a border of partitions have an offset; the others need none.
    renamed = {c: f"__o{i}" for i, c in enumerate([part, *keys])}
    offsets = offsets.filter("__off > 0").select(*[F.col(c).alias(n) for c, n in renamed.items()], *[c for c in ("__off", "__soff") if c in offsets.columns])
    ranked = ranged.withColumn(local, F.row_number().over(within))
    if size:
        ranked = ranked.withColumn("__sum", F.sum(F.coalesce(F.col(size), F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    on = F.col(part) == F.col(renamed[part])
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(renamed[k]))
    joined = ranked.join(offsets, on, "left").drop(*renamed.values())
    joined = joined.withColumn(out, (F.col(local) + F.coalesce(F.col("__off"), F.lit(0))).cast("long"))
    if size:
        joined = joined.withColumn(size_out, F.coalesce(F.col("__sum"), F.lit(0)) + F.coalesce(F.col("__soff"), F.lit(0)))
    return joined.drop(part, local, "__off", "__sum", "__soff")
