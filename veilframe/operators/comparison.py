"""Comparing two systems on the same gold spans: counts by type, rates side by side, leaks by parts of names, rules of acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.operators.evaluation import precision_recall_f, safe_ratio, type_matches
from veilframe.operators.spans import find_spans, touched

#: The rates that two systems are compared by: name, how it is made of the counts, and whether less is better.
RATES = ("precision", "recall", "f1", "full_masked_rate", "extra_masks", "missed_names", "neg_person_rate", "clean_mask_rate", "leak_rate")


def paired_predictions(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, before, after) spans of the ids both systems have. An id that only one has is an error: the systems were not run on the same texts."""
    missing = unequal_keys(before, after, key)
    if not missing.isEmpty():
        raise ValueError(f"predictions of one system only: {[r[key] for r in missing.limit(5).collect()]}")
    return before.select(key, F.col("spans").alias("before")).join(after.select(key, F.col("spans").alias("after")), key)


def unequal_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, only_in): keys that one of two tables lacks; none, if the tables may be compared. Null is a key."""
    x = a.select(F.col(key).alias("__a"), F.lit(1).alias("__x")).distinct()
    y = b.select(F.col(key).alias("__b"), F.lit(1).alias("__y")).distinct()
    j = x.join(y, F.col("__a").eqNullSafe(F.col("__b")), "full").filter("__x is null or __y is null")
    return j.select(F.coalesce("__a", "__b").alias(key), F.when(F.col("__y").isNull(), "a").otherwise("b").alias("only_in"))


def type_counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(entity_type, tp, fp, fn) over all rows: gold spans matched, in order, by the first unused prediction of their type that meets them."""
    kinds = F.array_distinct(F.concat(F.transform(gold, lambda s: s["entity_type"]), F.transform(predicted, lambda s: s["entity_type"])))
    one = df.select(F.explode(kinds).alias("entity_type"), F.col(gold).alias("g"), F.col(predicted).alias("p"))
    own = lambda c: F.filter(c, lambda s: s["entity_type"] == F.col("entity_type"))
    one = one.select("entity_type", own("g").alias("g"), own("p").alias("p")).withColumn("tp", type_matches(F.col("g"), F.col("p")))
    return one.groupBy("entity_type").agg(*[F.sum(c).cast("long").alias(n) for n, c in (("tp", F.col("tp")), ("fp", F.size("p") - F.col("tp")), ("fn", F.size("g") - F.col("tp")))])


def type_scores(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """(level, entity_type, tp, fp, fn, precision, recall, f): of each type, 'micro' of the sums and 'macro', the mean over types with any count.

    Precision and recall without a denominator are 1, F of two zeros is 0.
    """
    some = counts.filter("tp + fp + fn > 0")

    def rated(t: DataFrame, level: str) -> DataFrame:
        p, r, f = precision_recall_f(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), beta, 1.0)
        return t.select(F.lit(level).alias("level"), "entity_type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f"))

    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    types = rated(some, "type")
    micro = rated(some.agg(*sums).withColumn("entity_type", F.lit(None).cast("string")), "micro")
    macro = types.agg(*sums, *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f")]).select(F.lit("macro").alias("level"), F.lit(None).cast("string").alias("entity_type"), "tp", "fp", "fn", "precision", "recall", "f")
    return types.unionByName(micro).unionByName(macro)


def system_rates(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """RATES of a table of counts: those of evaluation.COUNTS, n_clean and clean_hit (texts without any mark, and those changed), n_values and n_leaked."""
    sums = ("tp", "n_pred", "n_gold", "full", "n_neg", "neg_hit", "n_clean", "clean_hit", "n_values", "n_leaked")
    t = counts.groupBy(*(by or [])).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    p, r, f = precision_recall_f(F.col("tp"), F.col("n_pred"), F.col("n_gold"))
    rates = {
        "precision": p, "recall": r, "f1": f, "full_masked_rate": safe_ratio(F.col("full"), F.col("n_gold")), "extra_masks": (F.col("n_pred") - F.col("tp")).cast("double"),
        "missed_names": (F.col("n_gold") - F.col("full")).cast("double"), "neg_person_rate": safe_ratio(F.col("neg_hit"), F.col("n_neg")),
        "clean_mask_rate": safe_ratio(F.col("clean_hit"), F.col("n_clean")), "leak_rate": safe_ratio(F.col("n_leaked"), F.col("n_values")),
    }
    return t.select(*(by or []), *[rates[k].alias(k) for k in RATES])


def side_by_side(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metric, before, after, difference) of two tables of rates."""
    def long(t: DataFrame, name: str) -> DataFrame:
        return t.select(*(by or []), F.explode(F.create_map(*[x for k in RATES for x in (F.lit(k), F.col(k))])).alias("metric", name))

    keys = [*(by or []), "metric"]
    a, b = long(before, "before"), long(after, "after").select(*[F.col(k).alias(f"__{k}") for k in keys], "after")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, on).select(*keys, "before", "after", (F.col("after") - F.col("before")).alias("difference"))


def part_leaks(masked: Column, value: Column) -> Column:
    """Whether a part of a name longer than two characters (parts are parted by spaces and dots) still stands in the masked text."""
    parts = F.filter(F.split(value, r"[\s.]+"), lambda w: F.length(w) > 2)
    return F.exists(parts, lambda w: F.instr(masked, w) > 0)


def comparable_verdicts(verdicts: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts with 'na' where the pair of data set and metric is in a table of those that can't be compared."""
    x = excluded.select(*keys).distinct().withColumn("__na", F.lit(True))
    return verdicts.join(x, keys, "left").withColumn("verdict", F.when(F.col("__na"), "na").otherwise(F.col("verdict"))).drop("__na")


def acceptance(metrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """(criterion, metric, value, bound, passed) of rules laid down beforehand.

    metrics: metric, value. criteria: criterion, metric, relation ('>=', '>', '<=', '<'), bound. A metric that wasn't measured fails.
    """
    v, b = F.col("value"), F.col("bound")
    held = F.when(F.col("relation") == ">=", v >= b - 1e-12).when(F.col("relation") == ">", v > b).when(F.col("relation") == "<=", v <= b + 1e-12).when(F.col("relation") == "<", v < b)
    return criteria.join(metrics, "metric", "left").select("criterion", "metric", "value", "bound", F.coalesce(held, F.lit(False)).alias("passed"))


def contained(inner: Column, outer: Column) -> Column:
    """The spans of `inner` that lie within a span of `outer`."""
    return F.filter(inner, lambda s: F.exists(outer, lambda o: (o["start_pos"] <= s["start_pos"]) & (s["end_pos"] <= o["end_pos"])))


def crossing(text: Column, spans: Column, border: str) -> Column:
    """The spans that a border (a Java pattern: a line break, a sentence end) stands inside of."""
    at = find_spans(text, border, "BORDER", 1.0)
    return F.filter(spans, lambda s: F.exists(at, lambda b: (s["start_pos"] < b["end_pos"]) & (b["start_pos"] < s["end_pos"])))


def three_ways(found: Column, gold: Column, negative: Column, damaged: Column) -> Column:
    """struct<missed, false_alarms, damaged>: gold spans nothing found meets, found spans on stretches marked as no names, and found spans that meet a damaged stretch."""
    return F.struct(
        F.size(F.filter(gold, lambda s: ~touched(s, found))).alias("missed"),
        F.size(F.filter(found, lambda s: touched(s, negative))).alias("false_alarms"),
        F.size(F.filter(found, lambda s: touched(s, damaged))).alias("damaged"),
    )


def name_form(value: Column) -> Column:
    """'initials', or the number of words of a name."""
    return F.when(value.rlike(r"\p{Lu}\."), "initials").otherwise(F.size(F.filter(F.split(value, r"[\s.]+"), lambda w: w != "")).cast("string"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that the seed and the key give: the same rows on any partitioning. A sampling operator: the limit is its purpose."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def seeded_splits(df: DataFrame, key: str, shares: dict[str, int], seed: int = 0) -> DataFrame:
    """Adds `split`, by the first eight hex digits of a digest of seed and key; shares in percent, the last split takes the rest."""
    u = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(100))
    names = list(shares)
    out, upto = F.lit(names[-1]), sum(shares[n] for n in names[:-1])
    for n in reversed(names[:-1]):
        out = F.when(u < upto, n).otherwise(out)
        upto -= shares[n]
    return df.withColumn("split", out)
