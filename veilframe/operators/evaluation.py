"""Measuring detection: matches of gold and predicted spans, counts by cluster, rates, intervals, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.operators.spans import fully_covered, touched

#: The sums that a cluster is reduced to.
COUNTS = ("tp", "n_pred", "n_gold", "tp_overlap", "full", "n_neg", "neg_hit")


def safe_ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is 0. Two conventions are in use: 0 (default) and 1."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b == 0, 1).otherwise(b))


def precision_recall_f(tp: Column, pred: Column, gold: Column, beta: float = 1.0, empty: float = 0.0) -> tuple[Column, Column, Column]:
    p, r = safe_ratio(tp, pred, empty), safe_ratio(tp, gold, empty)
    b2 = beta * beta
    return p, r, safe_ratio((1 + b2) * p * r, b2 * p + r, 0.0)


def supported(spans: Column) -> Column:
    """Spans of types that count: not OTHER_..."""
    return F.filter(spans, lambda s: ~s["entity_type"].startswith("OTHER_"))


def canonical_type(label: Column, mapping: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(table[label], F.concat(F.lit("OTHER_"), label))


def strict_matches(gold: Column, predicted: Column) -> Column:
    """Spans equal in both ends, each once."""
    ends = lambda spans: F.transform(spans, lambda s: F.struct(s["start_pos"].alias("a"), s["end_pos"].alias("b")))
    return F.size(F.array_intersect(ends(gold), ends(predicted)))


def greedy_matches(gold: Column, predicted: Column) -> Column:
    """Number of one-to-one matches of overlapping spans, taken by length of overlap (falling), then place in gold, then in predicted."""
    pairs = F.flatten(F.transform(gold, lambda g, i: F.filter(F.transform(predicted, lambda p, j: F.struct(
        (F.greatest(g["start_pos"], p["start_pos"]) - F.least(g["end_pos"], p["end_pos"])).alias("o"), i.alias("i"), j.alias("j"))), lambda x: x["o"] < 0)))
    zero = F.array().cast("array<struct<o:int,i:int,j:int>>")
    used = lambda acc, x: F.exists(acc, lambda k: (k["i"] == x["i"]) | (k["j"] == x["j"]))
    return F.size(F.aggregate(F.array_sort(pairs), zero, lambda acc, x: F.when(used(acc, x), acc).otherwise(F.concat(acc, F.array(x)))))


def type_matches(gold: Column, predicted: Column) -> Column:
    """Number of gold spans matched, in order, by the first unused prediction of their type that meets them."""
    zero = F.array().cast("array<int>")

    def step(acc: Column, g: Column) -> Column:
        free = F.filter(F.transform(predicted, lambda p, j: F.struct(j.alias("j"), p.alias("p"))), lambda x: ~F.array_contains(acc, x["j"]) & (x["p"]["entity_type"] == g["entity_type"]) & (x["p"]["start_pos"] < g["end_pos"]) & (g["start_pos"] < x["p"]["end_pos"]))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.get(free, F.lit(0))["j"]))).otherwise(acc)

    return F.size(F.aggregate(gold, zero, step))


def example_counts(df: DataFrame, text: str, gold: str, predicted: str) -> DataFrame:
    """Adds the COUNTS of each example; null spans count as none. An example without any gold span (of any type) is negative."""
    none = F.array().cast(df.schema[gold].dataType)
    g, p = supported(F.coalesce(F.col(gold), none)), F.coalesce(F.col(predicted), F.array().cast(df.schema[predicted].dataType))
    neg = F.size(F.coalesce(F.col(gold), none)) == 0
    return df.withColumns({
        "tp": strict_matches(g, p), "n_pred": F.size(p), "n_gold": F.size(g), "tp_overlap": greedy_matches(g, p),
        "full": F.size(F.filter(g, lambda s: fully_covered(F.col(text), s, p))), "n_neg": neg.cast("int"), "neg_hit": (neg & (F.size(p) > 0)).cast("int"),
    })


def cluster_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Strict and overlap precision, recall, F1 and F2, share fully masked, leaked, false alarms on negatives, over all rows or by columns."""
    t = counts.groupBy(*(by or [])).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    p, r, f1 = precision_recall_f(F.col("tp"), F.col("n_pred"), F.col("n_gold"))
    _, _, f2 = precision_recall_f(F.col("tp"), F.col("n_pred"), F.col("n_gold"), 2.0)
    po, ro, fo = precision_recall_f(F.col("tp_overlap"), F.col("n_pred"), F.col("n_gold"))
    return t.withColumns({
        "precision": p, "recall": r, "f1": f1, "f2": f2, "precision_overlap": po, "recall_overlap": ro, "f1_overlap": fo,
        "full_masked_rate": safe_ratio(F.col("full"), F.col("n_gold")), "leaked": F.col("n_gold") - F.col("full"), "neg_fp_rate": safe_ratio(F.col("neg_hit"), F.col("n_neg")),
    })


def joined_predictions(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Gold with the predictions of its id, of several the last by seq; none where there is no prediction."""
    last = predictions.groupBy(key).agg(F.max_by("spans", "seq").alias("predicted"))
    return gold.join(last, key, "left")


#: The chances of at most 0, 1, 2 ... in a Poisson distribution of mean 1; beyond the last the count is 8.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253)


def bootstrap(clusters: DataFrame, key: str, n_iter: int = 1000, seed: int = 0, other: DataFrame | None = None) -> DataFrame:
    """(metric, mean, lo, hi, p): intervals (2.5 and 97.5 percentiles) of strict F1 and share fully masked over clusters drawn with replacement; with
    `other`, of the differences on the same draws, with a two-sided p.

    Each cluster is in each draw as often as a Poisson count of mean 1 says, which is taken from a hash of the seed, its key and the draw; so
    clusters of any number are summed where they lie, and one row of sums of each draw is shuffled. No clusters: no rows.
    """
    paired = other is not None
    both = clusters if not paired else clusters.join(other.select(key, *[F.col(c).alias(f"o_{c}") for c in COUNTS]), key, "full")
    fields = [*COUNTS, *([f"o_{c}" for c in COUNTS] if paired else [])]
    drawn = both.select(key, *fields).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), "draw"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    times = F.lit(len(_POISSON))
    for k in range(len(_POISSON) - 1, -1, -1):
        times = F.when(F.col("u") < _POISSON[k], k).otherwise(times)
    drawn = drawn.withColumn("u", u).withColumn("times", times).filter("times > 0")
    sums = drawn.groupBy("draw").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("times")).alias(c) for c in fields])

    def metrics(prefix: str) -> dict[str, Column]:
        c = {x: F.col(prefix + x) for x in COUNTS}
        return {"f1": precision_recall_f(c["tp"], c["n_pred"], c["n_gold"])[2], "full_masked_rate": safe_ratio(c["full"], c["n_gold"])}

    a = metrics("")
    d = {k: v - metrics("o_")[k] for k, v in a.items()} if paired else a
    values = sums.select(F.explode(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])).alias("metric", "v"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("v") <= 0).cast("double")), F.avg((F.col("v") >= 0).cast("double"))))
    return values.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"), p.alias("p"))


def verdict(lo: Column, hi: Column, lower_is_better: Column) -> Column:
    """'win', 'loss' or 'tie' by the sign of an interval, turned where lower is better."""
    up, down = lo > 0, hi < 0
    return F.when(up, F.when(lower_is_better, "loss").otherwise("win")).when(down, F.when(lower_is_better, "win").otherwise("loss")).otherwise("tie")


def gate_violations(metrics: DataFrame, thresholds: DataFrame, key: str = "dataset") -> DataFrame:
    """Rows of metrics over a ceiling (leak_rate, neg_any_mask_rate) or under a floor (person_full_masked), with the names of what is violated; tolerance 1e-9."""
    j = metrics.join(thresholds, key)
    bad = F.filter(F.array(
        F.when(F.col("leak_rate") > F.col("max_leak_rate") + 1e-9, "leak_rate"), F.when(F.col("neg_any_mask_rate") > F.col("max_neg_any_mask_rate") + 1e-9, "neg_any_mask_rate"),
        F.when(F.col("person_full_masked") < F.col("min_person_full_masked") - 1e-9, "person_full_masked"),
    ), lambda x: x.isNotNull())
    return j.withColumn("violated", bad).filter(F.size("violated") > 0)


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Gold type by the type of the prediction that overlaps it most (the first on ties; NONE without one), counted."""
    g = df.select(F.explode(gold).alias("g"), F.col(predicted).alias("p"))
    best = F.array_max(F.transform(F.filter("p", lambda p: (p["start_pos"] < F.col("g.end_pos")) & (F.col("g.start_pos") < p["end_pos"])), lambda p, j: F.struct((F.least(p["end_pos"], F.col("g.end_pos")) - F.greatest(p["start_pos"], F.col("g.start_pos"))).alias("o"), (-j).alias("j"), p["entity_type"].alias("t"))))
    return g.select(F.col("g.entity_type").alias("gold_type"), F.coalesce(best["t"], F.lit("NONE")).alias("predicted_type")).groupBy("gold_type", "predicted_type").count()


def taxonomy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Correct (equal), partial (overlapping only), missing (gold) and spurious (predicted) spans of each row."""
    c = strict_matches(F.col(gold), F.col(predicted))
    part = F.size(F.filter(gold, lambda s: touched(s, F.col(predicted)))) - c
    spurious = F.size(F.filter(predicted, lambda s: ~touched(s, F.col(gold))))
    return df.withColumns({"correct": c, "partial": F.greatest(part, F.lit(0)), "missing": F.size(gold) - c - F.greatest(part, F.lit(0)), "spurious": spurious})
