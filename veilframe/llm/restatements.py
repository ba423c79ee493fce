"""Records that restate one another with small edits: a MinHash LSH forest with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from veilframe.llm.wordsets import jaccard, word_records
from veilframe.session import written

#: Trees of the forest, and the longest and shortest prefix of a tree's label.
TREES, LONGEST, SHORTEST = 48, 4, 1
#: Share of all similar pairs to be found before the prefixes are no longer shortened.
TARGET_RECALL = 0.999
#: A word is common if this share of the record classes has it; the others count as equally rare.
COMMON_SHARE = 1e-3
#: At most so many words are held as common ones.
COMMON_BOUND = 200_000
#: Members of a leaf that are compared pair by pair; larger leaves are first split by shared rare words.
LEAF = 100


def common_words(classes: DataFrame) -> dict[int, int]:
    """The number of classes that have each common word.

    The number of common words is at most the mean number of words over the least share, and the least share
    is raised where that would go over COMMON_BOUND; so what is broadcast is bounded for any corpus.
    """
    n, total = classes.agg(F.count(F.lit(1)), F.sum(F.size("set"))).first()
    if not n:
        return {}
    share = max(COMMON_SHARE, total / n / COMMON_BOUND)
    rows = classes.select(F.explode("set").alias("w")).groupBy("w").count().filter(F.col("count") >= max(2, share * n)).collect()
    return {r["w"]: r["count"] for r in rows}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """MinHash: for each set and hash, the least hash of its words, as a label.

    Two sets have the same label with the probability of their Jaccard similarity, whatever words they share.
    """
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets).view(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out = np.empty((len(sets), n_hashes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n_hashes):
            out[:, k] = np.minimum.reduceat(_mix(flat + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)), starts)
    return out


def least_recall(threshold: float, depth: int, trees: int) -> float:
    """The chance that a pair just at the threshold shares a leaf of some tree; more alike pairs have a higher one."""
    return 1 - (1 - threshold**depth) ** trees


def word_bits(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two numbers: a bit is set if a word falls on it. Of two sets, the one has at least as many words that the other lacks as it has such bits."""
    lengths = np.array([len(s) for s in sets])
    flat = _mix(np.concatenate(sets).view(np.uint64))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    bit = np.uint64(1) << (flat & np.uint64(63))
    high = (flat >> np.uint64(6)) & np.uint64(1)
    return np.stack([np.bitwise_or.reduceat(np.where(high == k, bit, np.uint64(0)), starts) for k in (0, 1)], axis=1).view(np.int64)


def forest_leaves(classes: DataFrame, depth: int, trees: int = TREES) -> DataFrame:
    """(leaf, cid, size, b0, b1) for each class and tree: the tree's labels cut to a prefix of `depth`, the number of words, and word_bits."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 4000):
                part = pdf.iloc[i : i + 4000]
                sets = [np.asarray(s, dtype=np.int64) for s in part["set"]]
                sig = signatures(sets, trees * depth).reshape(len(sets), trees, depth)
                with np.errstate(over="ignore"):
                    bits = word_bits(sets)
                    key = np.broadcast_to(_mix(np.arange(1, trees + 1, dtype=np.uint64)), (len(sets), trees)).copy()
                    for d in range(depth):
                        key = _mix(key * np.uint64(31) + sig[:, :, d])
                size = np.array([len(s) for s in sets], dtype=np.int32)
                yield pd.DataFrame({"leaf": key.view(np.int64).ravel(), "cid": np.repeat(part["cid"].to_numpy(), trees), "size": np.repeat(size, trees), "b0": np.repeat(bits[:, 0], trees), "b1": np.repeat(bits[:, 1], trees)})

    return classes.select("cid", "set").mapInPandas(emit, "leaf long, cid long, size int, b0 long, b1 long")


def _pairs_of(leaves: DataFrame, threshold: float) -> DataFrame:
    """The pairs within each bounded leaf that sizes and bits allow to be similar, once for each leaf that has them."""
    member = F.struct("cid", "size", "b0", "b1")
    g = leaves.groupBy("leaf").agg(F.array_sort(F.collect_set(member)).alias("ids"))
    one = g.select("ids", F.posexplode("ids").alias("i", "x"))
    two = one.select("x", F.explode(F.slice("ids", F.col("i") + 2, F.greatest(F.size("ids") - F.col("i") - 1, F.lit(0)))).alias("y"))
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}.{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{k}")))) for k in ("b0", "b1")), F.lit(0))
    shared = F.least(F.col("x.size") - lacks("x", "y"), F.col("y.size") - lacks("y", "x"))
    return two.filter(shared >= threshold / (1 + threshold) * (F.col("x.size") + F.col("y.size")) - 1e-9).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))


def similar_classes(classes: DataFrame, threshold: float, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """(a, b, share): pairs of classes (cid, set) whose sets have a Jaccard similarity of `threshold` or more.

    The labels aren't weighted: a pair collides with its Jaccard similarity, so the recall of the prefixes is known
    beforehand and holds for each pair, also in a group of near-copies that holds much of the corpus. The longest
    prefix whose recall at the threshold reaches the target is taken (0.9999 for the defaults); where none does,
    there are more trees. It is shortened further while the estimated recall is below the target.
    The estimate is that of unseen species: with f1 and f2 the similar pairs met in one and two trees, f1^2 / (2 f2)
    are expected to be unseen. Candidates whose sizes and word bits can't reach the threshold go at once, the others are verified exactly. A leaf with more than LEAF members is
    split by the rare words that a similar pair must share (prefix filter from rare to common), which loses no pair.
    """
    common = common_words(classes)
    sets = classes.select("cid", "set")
    if least_recall(threshold, SHORTEST, trees) < target:
        trees = math.ceil(math.log(1 - target) / math.log(1 - threshold**SHORTEST))
    for depth in range(LONGEST, SHORTEST - 1, -1):
        if least_recall(threshold, depth, trees) < target and depth > SHORTEST:
            continue
        leaves = forest_leaves(classes, depth, trees).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("leaf"))).filter("n > 1")
        leaves = written(leaves, "leaves")
        met = _pairs_of(leaves.filter(F.col("n") <= LEAF), threshold)
        large = leaves.filter(F.col("n") > LEAF)
        if not large.isEmpty():
            met = met.unionByName(_split_large(large, sets, common, threshold))
        hits = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"))
        near = hits.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b")
        near = near.filter(F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb")) - 1e-9)
        near = near.withColumn("share", jaccard(F.col("sa"), F.col("sb"))).filter(F.col("share") >= threshold)
        near = written(near.select("a", "b", "share", "hits"), "similar")
        seen, f1, f2 = near.agg(F.count(F.lit(1)), F.count_if(F.col("hits") == 1), F.count_if(F.col("hits") == 2)).first()
        unseen = f1 * f1 / (2 * f2) if f2 else f1 * (f1 - 1) / 2
        if not seen or seen / (seen + unseen) >= target:
            break
    return near.select("a", "b", "share")


def _split_large(large: DataFrame, sets: DataFrame, common: dict[int, int], threshold: float) -> DataFrame:
    """Candidate pairs of large leaves, once for each leaf that has them: members that share a word of their prefixes in the order from rare to common.

    A pair is taken at the first word both prefixes have, if the sizes are near enough and enough words are left behind it in both sets; no similar pair fails
    this. Words go by 32 bits; a coincidence in two prefixes could lose a pair, with a chance of about one in ten million, far below that of the forest itself.
    """
    known = sets.sparkSession.createDataFrame(list(common.items()) or [(0, 0)], "w long, n_classes long")
    member = large.select("cid").distinct().join(sets, "cid").withColumn("need", F.size("set") - F.ceil(threshold * F.size("set") - 1e-9) + 1)
    words = member.select("cid", "need", F.size("set").alias("size"), F.explode("set").alias("w")).join(known, "w", "left")
    order = Window.partitionBy("cid").orderBy(F.coalesce("n_classes", F.lit(0)), F.hash("w"), "w")
    prefix = words.withColumn("k", F.row_number().over(order)).filter("k <= need").groupBy("cid", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.hash("w").alias("w")))), lambda x: x["w"]).alias("prefix"))
    left = large.select("leaf", "cid").join(prefix, "cid").select("leaf", "cid", "size", "prefix", F.posexplode("prefix").alias("k", "w"))
    left = left.withColumn("rest", F.col("size") - F.col("k"))  # this word and those behind it
    x = left.select("leaf", "w", F.col("cid").alias("a"), F.col("size").alias("na"), F.col("rest").alias("ra"), F.col("prefix").alias("pa"))
    y = left.select("leaf", "w", F.col("cid").alias("b"), F.col("size").alias("nb"), F.col("rest").alias("rb"), F.col("prefix").alias("pb"))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (F.least("ra", "rb") >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    pairs = x.join(y, ["leaf", "w"]).filter(near)
    return pairs.filter(F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("w")).select("a", "b")


def record_classes(records: DataFrame) -> DataFrame:
    """cid, cls, set: one row per distinct word set, numbered once."""
    return written(records.groupBy("cls").agg(F.first("set").alias("set")).withColumn("cid", F.monotonically_increasing_id()), "classes")


def restatement_pairs(df: DataFrame, id_col: str = "rec_id", text_col: str = "text", threshold: float = 0.65) -> DataFrame:
    """(id_a, id_b, share): pairs of different ids, smaller first, whose texts share `threshold` of their distinct words.

    Records without words have no pair; rows repeating an id count once. Records with one word set are one class in
    the forest and are paired at the end, since the result names ids.
    """
    records = written(word_records(df, id_col, text_col), "records")
    classes = record_classes(records)
    near = similar_classes(classes, threshold)
    members = records.select("rec_id", "cls").distinct().join(classes.select("cls", "cid"), "cls").select("cid", "rec_id")
    ends = near.unionByName(classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("share")))
    out = ends.join(members.select(F.col("cid").alias("a"), F.col("rec_id").alias("x")), "a").join(members.select(F.col("cid").alias("b"), F.col("rec_id").alias("y")), "b").filter("x <> y")
    out = out.filter("a <> b or x < y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "share")
    return out.groupBy("id_a", "id_b").agg(F.max("share").alias("share"))


def restatement_groups(df: DataFrame, id_col: str = "rec_id", text_col: str = "text", threshold: float = 0.65) -> DataFrame:
    """(rec_id, group_id, n_links): each record with words, the least class of its connected group, and its class's similar classes.

    Groups are found on class pairs: each class takes the least label of its neighbours, then follows
    labels of labels, until nothing changes; every round is written to the shared folder.
    """
    records = written(word_records(df, id_col, text_col), "records")
    classes = record_classes(records)
    near = similar_classes(classes, threshold)
    links = written(near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("g")).withColumnRenamed("a", "v"), "label")
    while True:
        step = links.join(label.select(F.col("v").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m")).withColumnRenamed("a", "v")
        new = label.join(step, "v").select("v", F.least("g", "m").alias("n"), "g")
        jump = new.select(F.col("v").alias("n"), F.col("n").alias("nn"))
        new = written(new.join(jump, "n", "left").select("v", F.least(F.col("n"), F.coalesce("nn", "n")).alias("new"), "g"), "label")
        label = new.select("v", F.col("new").alias("g"))
        if new.filter("new <> g").isEmpty():
            break
    degree = links.groupBy(F.col("a").alias("cid")).agg(F.count(F.lit(1)).alias("n_links"))
    out = records.select("rec_id", "cls").distinct().join(classes.select("cls", "cid"), "cls")
    out = out.join(label.select(F.col("v").alias("cid"), "g"), "cid", "left").join(degree, "cid", "left")
    return out.select("rec_id", F.coalesce("g", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
