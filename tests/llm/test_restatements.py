import random

import numpy as np

from veilframe.llm import restatements
from veilframe.llm.restatements import restatement_groups, restatement_pairs


def _records():
    rng = random.Random(3)
    common = [f"общее{i}" for i in range(12)]
    out = []
    for g in range(60):
        base = rng.sample(common, 6) + [f"редкое{g}x{i}" for i in range(10)]
        for v in range(rng.choice((1, 2, 3))):
            w = base[:]
            for _ in range(v):
                w[rng.randrange(len(w))] = f"правка{g}x{v}x{rng.randrange(10**9)}"
            rng.shuffle(w)
            out.append((len(out), " ".join(w)))
    return out


def _brute(rows):
    s = [(i, frozenset(t.split())) for i, t in rows]
    return {(i, j) for i, a in s for j, b in s if i < j and len(a & b) / len(a | b) >= 0.65}


def test_pairs_are_those_of_brute_force(spark):
    rows = _records()
    got = {(r["id_a"], r["id_b"]) for r in restatement_pairs(spark.createDataFrame(rows, "rec_id long, text string")).collect()}
    assert got == _brute(rows)


def test_large_leaves_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(restatements, "LEAF", 2)
    rows = _records()
    got = {(r["id_a"], r["id_b"]) for r in restatement_pairs(spark.createDataFrame(rows, "rec_id long, text string")).collect()}
    assert got == _brute(rows)


def test_edges_and_groups(spark):
    rows = [(1, "а б в г", 0), (1, "а б в г", 0), (2, "Г, В, Б, А", 0), (3, None, 0), (4, "", 0), (5, "?!", 0), (6, "д е ж з", 0)]
    df = spark.createDataFrame(rows, "rec_id long, text string, cid int")
    assert [(r["id_a"], r["id_b"]) for r in restatement_pairs(df).collect()] == [(1, 2)]
    assert restatement_pairs(df.limit(0)).count() == 0
    g = {r["rec_id"]: r["group_id"] for r in restatement_groups(df).collect()}
    assert g[1] == g[2] != g[6] and set(g) == {1, 2, 6}


def test_group_of_edited_copies_holding_a_third_is_found(spark):
    """Near-copies that share only words a third of the corpus has, one word edited in each (similarity 0.91)."""
    hot = [f"общее{i}" for i in range(20)]
    rows = [(i, " ".join([*hot, f"правка{i}"])) for i in range(150)]
    rows += [(i, " ".join(f"редкое{i // 2}x{j}" for j in range(20)) + f" конец{i}") for i in range(150, 450)]
    got = {(r["id_a"], r["id_b"]) for r in restatement_pairs(spark.createDataFrame(rows, "rec_id long, text string")).collect()}
    want = _brute(rows)
    assert len(want) == 150 * 149 // 2 + 150
    assert got <= want and len(got) >= 0.999 * len(want)


def test_pairs_of_large_leaves_count_true_hits(spark):
    """A pair is met once for each large leaf that has it, however many rare words it shares."""
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [7, 8, 9, 10])], "cid long, set array<long>")
    large = spark.createDataFrame([(leaf, c) for leaf in (10, 11) for c in (1, 2, 3)], "leaf long, cid long")
    assert [tuple(r) for r in restatements._split_large(large, sets, {}, 0.5).collect()] == [(1, 2)] * 2


def test_pairs_alike_in_common_words_only_are_found(spark):
    """300 pairs that share 14 of 20 words of a stock of 40 common ones (similarity 0.70), beside 300 pairs of rare words."""
    rng = random.Random(8)
    stock = [f"общее{i}" for i in range(40)]
    rows, want = [], set()
    for k in range(300):
        w = rng.sample(stock, 14)
        for own in ("а", "б"):
            rows.append((len(rows), " ".join([*w, *(f"{own}{k}x{i}" for i in range(3))])))
        want.add((len(rows) - 2, len(rows) - 1))
    for k in range(300):
        for own in ("а", "б"):
            rows.append((len(rows), " ".join([*(f"редкое{k}x{i}" for i in range(14)), *(f"{own}{k}y{i}" for i in range(3))])))
        want.add((len(rows) - 2, len(rows) - 1))
    got = {(r["id_a"], r["id_b"]) for r in restatement_pairs(spark.createDataFrame(rows, "rec_id long, text string")).collect()}
    assert want <= got == _brute(rows)


def test_bits_never_say_that_more_words_are_lacking_than_are():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 300))) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: len(s) * 2 // 3 + 1], rng.integers(-(2**62), 2**62, 5)])) for s in sets]
    bits = restatements.word_bits(sets).view(np.uint64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(bits[i] & ~bits[j]).sum() <= len(set(a.tolist()) - set(b.tolist()))
