import random

from pyspark.sql import functions as F

from veilframe.operators.corpus import accepted_in_order, near_duplicates
from veilframe.operators.evaluation import COUNTS, bootstrap


def _shingles(text, n=3):
    w = text.split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else set(w)


def _texts(seed=1):
    r = random.Random(seed)
    shared = [f"s{i}" for i in range(9)]  # a stretch that a third of the texts have
    out = []
    for i in range(120):
        base = [f"w{r.randrange(400)}" for _ in range(14)]
        if i % 3 == 0:
            base = shared + base[:3]
        if i % 5 == 4:
            base = out[-1][1].split()
            base[r.randrange(len(base))] = f"x{i}"
        out.append((i, " ".join(base)))
    return [*out, (500, ""), (501, None), (502, out[0][1]), (503, "w1")]


def test_near_duplicates_equal_brute_force(spark):
    rows = _texts()
    sets = {}
    for i, t in rows:
        if t:
            sets.setdefault(frozenset(_shingles(t)), i)
    ids = {v: k for k, v in sets.items()}
    want = {(a, b) for a in ids for b in ids if a < b and len(ids[a] & ids[b]) / len(ids[a] | ids[b]) >= 0.6}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("sh", F.lit("x"))
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates(df, "doc_id").collect()}
    assert got == want and want
    assert near_duplicates(df.limit(0), "doc_id").count() == 0


def test_accepted_in_order_is_the_greedy_choice(spark):
    r = random.Random(2)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(40, 58)}
    want, kept = {}, set()
    for i in range(60):
        want[i] = not any((j, i) in pairs for j in kept)
        if want[i]:
            kept.add(i)
    p = spark.createDataFrame(sorted(pairs), "id_a long, id_b long")
    t = spark.createDataFrame([(i,) for i in range(60)], "k long")
    assert {x["k"]: x["kept"] for x in accepted_in_order(p, t, "k").collect()} == want
    assert all(x["kept"] for x in accepted_in_order(p.limit(0), t, "k").collect())


def test_bootstrap_interval_holds_the_value(spark):
    r = random.Random(3)
    rows = []
    for i in range(200):
        g = r.randint(1, 6)
        tp = sum(r.random() < 0.8 for _ in range(g))
        rows.append((f"c{i}", tp, tp + (r.random() < 0.3), g, tp, tp, 1, 0))
    c = spark.createDataFrame(rows, "k string, " + ", ".join(f"{x} long" for x in COUNTS))
    b = {x["metric"]: x for x in bootstrap(c, "k", 400).collect()}
    share = sum(x[1] for x in rows) / sum(x[3] for x in rows)
    x = b["full_masked_rate"]
    assert x["lo"] < share < x["hi"] and abs(x["mean"] - share) < 0.01 and 0.02 < x["hi"] - x["lo"] < 0.12
    assert bootstrap(c.limit(0), "k", 10).count() == 0
    worse = c.withColumn("full", F.greatest(F.col("full") - 1, F.lit(0)))
    d = {x["metric"]: x for x in bootstrap(c, "k", 200, other=worse).collect()}
    assert d["full_masked_rate"]["lo"] > 0 and d["full_masked_rate"]["p"] < 0.05 and d["f1"]["lo"] == d["f1"]["hi"] == 0
