import numpy as np
from pyspark.sql import functions as F

from veilframe.llm import mixing
from veilframe.llm.mixing import _draw, mix_plan, mix_report, mix_sources, permuted, splitting_tree
from veilframe.llm.packing import Complements, pack_documents, packing_report, plan


def _best_fit_decreasing(h, cap):
    gaps = []
    for x in sorted((x for x, k in h.items() for _ in range(k)), reverse=True):
        b = min((i for i in range(len(gaps)) if gaps[i] >= x), key=lambda i: gaps[i], default=None)
        if b is None:
            gaps.append(cap - x)
        else:
            gaps[b] -= x
    return len(gaps)


def test_plan_uses_every_item_once():
    rng = np.random.default_rng(0)
    for cap, n in ((10, 0), (10, 50), (97, 3000), (512, 3000)):
        h = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, cap + 1, n), return_counts=True))}
        used, bins = {}, 0
        for pattern, times in plan(h, cap):
            assert sum(x * k for x, k in pattern) <= cap
            bins += times
            for x, k in pattern:
                used[x] = used.get(x, 0) + k * times
        assert used == h
        assert bins <= _best_fit_decreasing(h, cap) * 1.005 + 1


def test_pack_documents(spark):
    rows = [(1, 5), (2, 5), (3, 7), (4, 3), (5, 25), (6, 10), (7, 0), (8, None)]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens long").filter("n_tokens > 0")
    kinds = spark.createDataFrame([("ten", 10), ("big", 100), (None, 5), ("bad", 0)], "container_name string, capacity_tokens int")
    p = pack_documents(sized, kinds)
    assert p.groupBy("container_name", "container_no").agg(F.sum("n_tokens").alias("t")).join(kinds, "container_name").filter("t > capacity_tokens").isEmpty()
    per = {(r["container_name"], r["doc_id"]): (r["t"], r["n"]) for r in p.groupBy("container_name", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(per[k, d] == (n, 3 if (k, d) == ("ten", 5) else 1) for k in ("ten", "big") for d, n in rows if n)
    rep = {r["container_name"]: r for r in packing_report(p, kinds).collect()}
    assert rep["ten"]["n_containers"] == 6 and rep["big"]["n_containers"] == 1
    assert pack_documents(sized.limit(0), kinds).count() == 0


def test_tree_and_permutation():
    t = splitting_tree(np.array([100, 7, 0, 53]), 13, 1)
    assert (t.sum(axis=0) == [100, 7, 0, 53]).all() and t.sum(axis=1).max() - t.sum(axis=1).min() <= 3
    for n in (1, 2, 5, 64, 1000):
        assert sorted(permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_mix(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else None, 10) for i in range(600)] + [(1000, "c", 10), (1001, "a", None)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("z", 0.0, 2)], "source string, target_share double, max_repeats int")
    m = mix_sources(docs, targets, block_docs=4, shard_tokens=500)
    rep = {r["source"]: r for r in mix_report(m, targets).collect()}
    assert rep["a"]["reached"] and rep["b"]["reached"] and rep["b"]["most_uses"] <= 3 and rep["a"]["most_uses"] == 1
    assert m.select("shard", "position").distinct().count() == m.count() and m.select("doc_id", "copy_no").distinct().count() == m.count()
    assert m.select("shard").distinct().count() > 1
    assert mix_sources(docs.limit(0), targets).count() == 0
    assert mix_plan({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 200) == {"a": 100, "b": 20}


def test_exact_triple_is_found_behind_used_up_ones():
    counts = np.zeros(4001, dtype=np.int64)
    for i in range(10):
        counts[[3000 - 2**i, 2**i]] = 1
    counts[[1000, 2400]], counts[800] = 1, 2
    ex = Complements(counts)
    ex.use(1000, 1)  # the ten larger first lengths need it
    assert ex.fill(4000, {}) == (2400, 800, 800)


def test_draws_of_any_size_are_exact():
    rng = np.random.default_rng(3)
    for have in ([5, 0, 7], [10**9, 3, 10**9 + 1], [10**12, 5 * 10**10, 0, 17], [1]):
        have = np.array(have, dtype=np.int64)
        for take in (0, 1, int(have.sum()) // 2, int(have.sum())):
            d = _draw(rng, have, take)
            assert d.sum() == take and (d >= 0).all() and (d <= have).all()
    t = splitting_tree(np.array([10**12, 4 * 10**10, 7]), 64)
    assert (t.sum(axis=0) == [10**12, 4 * 10**10, 7]).all()
    assert abs(t[:, 0] / (10**12 / 64) - 1).max() < 1e-3


def test_more_shards_than_the_plan_has_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PLAN_NUMBERS", 4)
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(1200)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    per = [r["t"] for r in mix_sources(docs, targets, block_docs=2, shard_tokens=600).groupBy("shard").agg(F.sum("n_tokens").alias("t")).collect()]
    assert sum(per) == 12000 and len(per) == 20 and max(per) <= 900
