"""Mixing sources to target shares of all tokens, into shards by a multivariate hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from veilframe.operators.ranking import spread_rank
from veilframe.session import written

#: Documents of a block, which goes to one shard as a whole, and tokens of a shard, about.
BLOCK_DOCS, SHARD_TOKENS = 16, 2_000_000
#: Numbers in the plan at most (shards times sources): 64 MB on the driver and in each worker. With more, each row of the plan is a group of shards.
PLAN_NUMBERS = 8_000_000
#: Target sources at most; more are an error.
MAX_SOURCES = 10_000


def _draw(rng: np.random.Generator, have: np.ndarray, take: int) -> np.ndarray:
    """How many of each colour are among `take` drawn without replacement: one hypergeometric draw for each colour from what is left.

    numpy draws hypergeometrically below 10^9 items; above, the count of a colour is drawn from the normal distribution of the same mean and
    variance and rounded within its bounds. The sums stay exact.
    """
    out = np.zeros_like(have)
    rest, left = int(have.sum()), int(take)
    for k, n in enumerate(have.tolist()):
        other = rest - n
        if left <= 0:
            break
        if rest < 10**9:
            x = int(rng.hypergeometric(n, other, left)) if n and other else min(n, left)
        else:
            p = n / rest
            sd = np.sqrt(max(left * p * (1 - p) * ((rest - left) / max(rest - 1, 1)), 0.0))
            x = round(rng.normal(left * p, sd))
        x = min(max(x, left - other, 0), n, left)
        out[k] = x
        rest, left = other, left - x
    return out


def splitting_tree(blocks: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): exact quotas by recursive multivariate hypergeometric draws.

    A node with s shards gives its left half floor(s/2)/s of its blocks, drawn without replacement from those
    of all sources; so every source is spread evenly up to chance, and the columns sum to the blocks.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    stack = [(0, shards, np.asarray(blocks, dtype=np.int64))]
    while stack:
        first, s, have = stack.pop()
        if s == 1:
            out[first] = have
            continue
        left = s // 2
        draw = _draw(rng, have, int(have.sum()) * left // s)
        stack += [(first, left, draw), (first + left, s - left, have - draw)]
    return out


def mix_plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take of each source.

    Without a total it is the largest at which each source that has any token reaches its share within its repeats. With a
    total, a source that can't reach its share gives all it has times its repeats. Sources without documents give nothing.
    """
    room = {s: available.get(s, 0) * max(0, reps) for s, (_, reps) in targets.items()}
    if total is None:
        bounds = [room[s] / share for s, (share, _) in targets.items() if share > 0 and room[s] > 0]
        total = math.floor(min(bounds)) if bounds else 0
    return {s: min(room[s], round(share * total)) for s, (share, _) in targets.items() if share > 0}


def mix_sources(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, block_docs: int = BLOCK_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, position, doc_id, copy_no, source, n_tokens): the mix, documents whole.

    sized: doc_id, source, n_tokens. Documents of sources without a target, of no source or of no tokens aren't used. Of each source whole
    rounds of all its documents are used as the quota asks, and of the last round the documents first in a random order, to the nearest document; no document
    is used more than max_repeats times. Positions in the random order and running sums are taken over many tasks (spread_rank). Targets that
    repeat a source: the first by share counts; null shares or repeats count as 0. Equal inputs and seeds give equal mixes.
    """
    spark = sized.sparkSession
    want: dict[str, tuple[float, int]] = {}
    if targets.select("source").distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    for r in targets.filter("source is not null").select("source", F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("m")).orderBy("source", F.desc("s"), F.desc("m")).collect():
        want.setdefault(r["source"], (r["s"], r["m"]))
    sized = written(sized.select("doc_id", "source", "n_tokens").filter("n_tokens > 0"), "sizes")  # once: the ranges of spread_rank come from a pass of their own
    wanted = spark.createDataFrame([(s,) for s in want] or [("",)], "source string")
    docs = sized.join(wanted, "source", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    ranked = written(spread_rank(docs, ["source"], ["h", "doc_id"], "rank", size="n_tokens", size_out="before"), "order")
    facts = {r["source"]: (r["t"], r["n"]) for r in ranked.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    quota = mix_plan({s: t for s, (t, _) in facts.items()}, want, total)
    rows = [(s, int(quota.get(s, 0) // facts[s][0]), int(quota.get(s, 0) % facts[s][0]), int(want[s][1]), facts[s][1]) for s in facts]
    rounds = spark.createDataFrame(rows or [("", 0, 0, 0, 0)], "source string, whole int, part long, most int, n long")
    used = ranked.join(F.broadcast(rounds), "source")  # one row per target, at most MAX_SOURCES
    nearest = (F.col("before") + F.col("n_tokens") / 2 <= F.col("part")) & (F.col("whole") < F.col("most"))
    used = used.withColumn("copies", F.col("whole") + nearest.cast("int")).filter("copies > 0")
    used = used.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("seq", (F.col("copy_no") - 1) * F.col("n") + F.col("rank") - 1)
    used = used.select("doc_id", "source", "n_tokens", "copy_no", "seq", F.floor(F.col("seq") / block_docs).alias("block"))
    size = {r["source"]: (r["b"], r["t"]) for r in used.groupBy("source").agg((F.max("block") + 1).alias("b"), F.sum("n_tokens").alias("t")).collect()}
    names = sorted(size)
    tokens = sum(t for _, t in size.values())
    shards = max(1, math.ceil(tokens / shard_tokens))
    groups = max(1, min(shards, PLAN_NUMBERS // max(1, len(names))))
    per = -(-shards // groups)  # shards of a group: a block goes to one of them by its number in the group
    tree = splitting_tree(np.array([size[s][0] for s in names], dtype=np.int64), groups, seed) if names else np.zeros((1, 0), dtype=np.int64)
    ends = {s: np.cumsum(tree[:, k]) for k, s in enumerate(names)}
    shared = spark.sparkContext.broadcast((ends, {s: size[s][0] for s in names}, seed))  # at most PLAN_NUMBERS numbers

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, n_blocks, seed = shared.value
        for pdf in batches:
            shard = np.zeros(len(pdf), dtype=np.int64)
            for s, rows in pdf.groupby("source", sort=False).indices.items():
                p = permuted(pdf["block"].to_numpy()[rows], n_blocks[s], seed)
                group = np.searchsorted(ends[s], p, side="right")
                inside = p - np.where(group > 0, ends[s][group - 1], 0)
                shard[rows] = group * per + (inside + group) % per
            yield pdf.assign(shard=shard)[["shard", "doc_id", "copy_no", "source", "n_tokens"]]

    placed = used.mapInPandas(assign, "shard long, doc_id long, copy_no int, source string, n_tokens long")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"), "doc_id", "copy_no")
    return placed.withColumn("position", F.row_number().over(local)).select("shard", "position", "doc_id", "copy_no", "source", "n_tokens")


def permuted(block: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudo-random permutation of 0..n-1: rounds of a keyed Feistel network over the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for k in range(4):
                f = (b + np.uint64(seed * 4 + k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    x = once(block.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def mix_report(mix: DataFrame, targets: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per target source: target_share, tokens, documents, most uses of one document, reached_share, and whether the share is reached within `tolerance` of it."""
    per = mix.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k")).groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("k").cast("int").alias("most_uses"))
    goal = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = goal.join(per, "source", "left").fillna({"n_tokens": 0, "n_documents": 0, "most_uses": 0})
    total = per.agg(F.sum("n_tokens").alias("total"))
    out = rows.crossJoin(F.broadcast(total)).withColumn("reached_share", F.when(F.col("total") > 0, F.col("n_tokens") / F.greatest("total", F.lit(1))).otherwise(0.0))
    return out.withColumn("reached", F.abs(F.col("reached_share") - F.col("target_share")) <= tolerance * F.col("target_share") + 1e-12).drop("total")
