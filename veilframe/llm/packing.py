"""Filling containers of fixed capacity with texts, by exact complements of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veilframe.llm.tokens import token_count
from veilframe.operators.ranking import spread_rank
from veilframe.session import written


#: Kinds of containers at most; more are an error, since each document goes into every kind.
MAX_KINDS = 1000


class Complements:
    """Which gaps one, two or three lengths fill exactly, under the counts of what is still there.

    The sums of singles, pairs and triples are bit sets over 0..capacity. They are built over the lengths present and
    may name sums of lengths used up meanwhile; a find is therefore verified against the counts, and the
    sets are built anew after REBUILD lengths have run out, or when eight first lengths of a triple fail; the search then goes on to the end.
    """

    REBUILD = 64

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.capacity = len(counts) - 1
        self._build()

    def _build(self) -> None:
        present = np.flatnonzero(self.counts > 0)
        self.gone = 0
        n = self.capacity + 1
        full = (1 << n) - 1
        one = 0
        for x in present:
            one |= 1 << int(x)
        two = three = 0
        for x in present:
            two |= (one << int(x)) & full
        for x in present:
            three |= (two << int(x)) & full
        self.sums = [_bits(v, n) for v in (one, two, three)]

    def use(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if self.counts[length] == 0:
            self.gone += 1
            if self.gone >= self.REBUILD:
                self._build()

    def _has(self, lengths: tuple[int, ...], used: dict[int, int]) -> bool:
        need = dict(used)
        for x in lengths:
            need[x] = need.get(x, 0) + 1
            if need[x] > self.counts[x]:
                return False
        return True

    def fill(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three lengths whose sum is the gap, with copies left beside those used; the largest first."""
        if gap <= 0 or gap > self.capacity:
            return None
        if self.sums[0][gap] and self._has((gap,), used):
            return (gap,)
        there = np.flatnonzero(self.counts[: gap + 1] > 0)[::-1]
        if self.sums[1][gap]:
            for a in there[self.counts[gap - there] > 0]:
                if 2 * a >= gap and self._has((int(a), gap - int(a)), used):
                    return (int(a), gap - int(a))
        if self.sums[2][gap]:
            tried = 0
            for a in there[self.sums[1][gap - there]]:
                if 3 * a < gap:
                    break
                rest = gap - int(a)
                b = there[there <= min(rest, int(a))]
                for x in b[self.counts[rest - b] > 0]:
                    if 2 * x < rest:
                        break
                    t = (int(a), int(x), rest - int(x))
                    if self._has(t, used):
                        return t
                tried += 1
                if tried >= 8 and self.gone:  # the sets name lengths used up
                    self._build()
                    return self.fill(gap, used)
        return None


def _bits(value: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(value.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n].astype(bool)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ((length, copies) pairs) and how many containers take each; the lengths are 1..capacity.

    A container is filled from the largest length down until one, two or three lengths fill its gap exactly; the same
    pattern is then used as often as the counts allow. What no complement fills exactly is closed when nothing fits, or
    placed by best fit at the end. The work depends on the number of distinct lengths, not on that of items.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in histogram.items():
        counts[x] += n
    ex = Complements(counts)
    out: list[tuple[list[tuple[int, int]], int]] = []
    loose: list[list] = []
    while counts.any():
        used: dict[int, int] = {}
        gap, exact = capacity, False
        while True:
            more = ex.fill(gap, used) if used or counts[capacity] else None
            if more:
                for x in more:
                    used[x] = used.get(x, 0) + 1
                gap, exact = 0, True
                break
            fits = np.flatnonzero(counts[: gap + 1] > 0)[::-1]
            x = next((int(x) for x in fits if counts[x] > used.get(int(x), 0)), 0)
            if not x:
                break
            used[x] = used.get(x, 0) + 1
            gap -= x
            if gap == 0:
                exact = True
                break
        times = min(int(counts[x]) // k for x, k in used.items())
        for x, k in used.items():
            ex.use(x, k * times)
        pattern = sorted(used.items(), reverse=True)
        if exact or times > 1 or gap * 50 <= capacity:
            out.append((pattern, times))
        else:
            loose.append([gap, pattern])
    return out + [(p, 1) for p in _best_fit(loose, capacity)]


def _best_fit(loose: list[list], capacity: int) -> list[list[tuple[int, int]]]:
    """Take the containers that were closed with much room apart again and place their items by best fit, largest first."""
    items = sorted((x for _, p in loose for x, k in p for _ in range(k)), reverse=True)
    room: list[tuple[int, int]] = []  # gap and number of each container, in order
    bins: list[dict[int, int]] = []
    for x in items:
        i = bisect_left(room, (x, -1))
        if i == len(room):
            gap, no = capacity, len(bins)
            bins.append({})
        else:
            gap, no = room.pop(i)
        bins[no][x] = bins[no].get(x, 0) + 1
        insort(room, (gap - x, no))
    return [sorted(d.items(), reverse=True) for d in bins]


def sized_documents(documents: DataFrame, size: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens) of the documents that have a token; null and empty texts have none and are left out."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (size if size is not None else token_count(F.col("text"))).cast("long").alias("n_tokens"))
    return d.filter("n_tokens > 0")


def pack_documents(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, container_no, doc_id, piece_no, n_pieces, n_tokens): every document in containers of each capacity.

    Only a document over the capacity is split, in pieces of the capacity and a rest. Numbers of containers run from 1 in each name; each
    container holds at most its capacity. The plan is made on the histogram of lengths, which has at most as many entries as the capacity; items
    then take their places by their rank among the items of their length (spread_rank, so a length that a third of all items have is no hot task).
    Containers of a capacity under 1 or null, or of no name, are ignored; so are documents without tokens. More than MAX_KINDS kinds of containers are an error.
    """
    spark = sized.sparkSession
    kinds = containers.select("container_name", F.col("capacity_tokens").cast("long").alias("cap")).filter("container_name is not null and cap >= 1").distinct()
    rows = kinds.limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    limits = {r["container_name"]: r["cap"] for r in rows}
    kinds_of = F.array(*[F.struct(F.lit(r["container_name"]).alias("container_name"), F.lit(r["cap"]).alias("cap")) for r in rows]) if rows else F.array().cast("array<struct<container_name:string,cap:bigint>>")
    sized = written(sized, "sizes")  # once: the sizes are read for the counts and for the ranks
    full = F.floor(F.col("n_tokens") / F.col("cap"))
    rest = F.col("n_tokens") - full * F.col("cap")
    pieces = (
        sized.select("doc_id", "n_tokens", F.inline(kinds_of))  # the few kinds of containers, for each document
        .withColumn("n_pieces", (full + F.when(rest > 0, 1).otherwise(0)).cast("int"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
        .withColumn("size", F.when(F.col("piece_no") <= full, F.col("cap")).otherwise(rest).cast("int"))
        .select("container_name", "size", "doc_id", "piece_no", "n_pieces")
    )
    items = spread_rank(pieces, ["container_name", "size"], ["doc_id", "piece_no"], "rank")
    hist: dict[str, dict[int, int]] = {}
    for r in pieces.groupBy("container_name", "size").count().collect():  # at most `capacity` rows of each name
        hist.setdefault(r["container_name"], {})[r["size"]] = r["count"]
    table: dict[tuple[str, int], tuple[list[int], list[int], list[int]]] = {}
    for name, h in hist.items():
        base = 0
        taken: dict[int, int] = {}
        for pattern, times in plan(h, limits[name]):
            for x, k in pattern:
                first, per, at = table.setdefault((name, x), ([], [], []))
                first.append(taken.get(x, 0))
                per.append(k)
                at.append(base)
                taken[x] = taken.get(x, 0) + k * times
            base += times
    packed = {key: tuple(np.array(v, dtype=np.int64) for v in parts) for key, parts in table.items()}
    shared = spark.sparkContext.broadcast(packed)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shared.value
        for pdf in batches:
            no = np.zeros(len(pdf), dtype=np.int64)
            for key, rows in pdf.groupby(["container_name", "size"], sort=False).indices.items():
                first, per, at = places[key[0], int(key[1])]
                r = pdf["rank"].to_numpy()[rows] - 1
                k = np.searchsorted(first, r, side="right") - 1
                no[rows] = at[k] + (r - first[k]) // per[k] + 1
            yield pd.DataFrame({"container_name": pdf["container_name"], "container_no": no, "doc_id": pdf["doc_id"], "piece_no": pdf["piece_no"], "n_pieces": pdf["n_pieces"], "n_tokens": pdf["size"]})

    return items.mapInPandas(place, "container_name string, container_no long, doc_id long, piece_no int, n_pieces int, n_tokens int")


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container name: containers used, the least possible number, items, tokens, share of room filled, containers filled exactly."""
    kinds = containers.select("container_name", F.col("capacity_tokens").cast("long").alias("cap")).distinct()
    one = packed.groupBy("container_name", "container_no").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return one.join(kinds, "container_name").groupBy("container_name", "cap").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.count_if(F.col("t") == F.col("cap")).alias("n_exact"), F.count_if(F.col("t") > F.col("cap")).alias("n_over"),
    ).withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("cap"))).withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("cap"))).withColumnRenamed("cap", "capacity_tokens")
