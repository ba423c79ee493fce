"""Comparing collections of texts: held-out overlap, disjoint word lists, nearest frames, near duplicates by shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.functions.text import array_jaccard, collapsed, shingles, word_set
from veilframe.session import written


def not_held_out(df: DataFrame, held_out: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text doesn't equal a held-out text in lower case with white space collapsed; rows with null text stay."""
    keys = held_out.select(collapsed(F.col(text)).alias("__k")).filter("__k is not null").distinct()
    return df.withColumn("__k", collapsed(F.col(text))).join(keys, "__k", "left_anti").drop("__k")


def first_copies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Of the rows with equal collapsed text the one with the least key; rows without text are left out."""
    k = df.withColumn("__k", F.sha2(collapsed(F.col(text)), 256)).filter("__k is not null")
    return k.groupBy("__k").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies")).drop("__k")


def shared_words(a: DataFrame, b: DataFrame, word: str = "word") -> DataFrame:
    """Words in both lists: none, if the lists are disjoint."""
    return a.select(F.lower(word).alias(word)).intersect(b.select(F.lower(word).alias(word)))


def nearest_frames(frames: DataFrame, known: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, best_key, best): for each frame the known frame of the highest word-set Jaccard (the least key on ties); 0 and null without a shared word.

    Frames meet over their words, so no pair without a shared word is looked at.
    """
    a = frames.select(F.col(key).alias("a"), word_set(F.col(text)).alias("wa"))
    b = known.select(F.col(key).alias("b"), word_set(F.col(text)).alias("wb"))
    left = a.select("a", F.size("wa").alias("na"), F.explode("wa").alias("w"))
    right = b.select("b", F.size("wb").alias("nb"), F.explode("wb").alias("w"))
    pairs = left.join(right, "w").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    scored = pairs.withColumn("s", F.col("k") / (F.col("na") + F.col("nb") - F.col("k")))
    best = scored.groupBy("a").agg(F.max(F.struct(F.col("s"), (-F.col("b")).alias("nb_"))).alias("m"))
    return a.select("a").join(best, "a", "left").select(F.col("a").alias(key), (-F.col("m.nb_")).alias("best_key"), F.coalesce("m.s", F.lit(0.0)).alias("best"))


def near_duplicates(df: DataFrame, key: str, text: str = "text", threshold: float = 0.6, n: int = 3) -> DataFrame:
    """(id_a, id_b, similarity): pairs of distinct texts whose n-word shingles have a Jaccard of `threshold` or more, and exact copies by representative.

    An exact prefix filter: texts in order of a shingle's frequency, rare first, share one of the first
    size - ceil(threshold * size) + 1 shingles if they are similar; so frequent shingles pair nothing. A shared shingle counts only if enough
    shingles are left behind it in both texts. Texts with equal shingle sets are one
    class, named by its least key; pairs are between classes. Members of a class are in duplicate_classes. Shingles are
    compared by 64-bit hashes; the classes are written once.
    """
    s = df.select(F.col(key).alias("id"), shingles(F.col(text), n).alias("sh")).filter(F.size("sh") > 0)
    s = s.select("id", F.array_sort(F.transform("sh", lambda g: F.xxhash64(g))).alias("sh")).withColumn("h", F.md5(F.array_join(F.col("sh").cast("array<string>"), ",")))
    c = written(s.groupBy("h").agg(F.min("id").alias("id"), F.any_value("sh").alias("sh")).select("id", "sh"), "classes")
    freq = c.select(F.explode("sh").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    # Shingles that only one text has come first and pair nothing; of the others as many as the prefix still has room for.
    long = c.select("id", F.size("sh").alias("size"), F.explode("sh").alias("g")).join(freq, "g")
    many = long.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("rare"))
    alone = F.col("size") - F.size("rare")
    room = (F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1 - alone).cast("int")
    prefix = many.filter(room > 0).select("id", "size", alone.alias("alone"), F.posexplode(F.slice("rare", F.lit(1), room)).alias("i", "x")).select("id", "size", F.col("x.g").alias("g"), (F.col("size") - F.col("alone") - F.col("i")).alias("rest"))
    prefix = written(prefix, "prefixes")
    a = prefix.select("g", F.col("id").alias("id_a"), F.col("size").alias("na"), F.col("rest").alias("ra"))
    b = prefix.select("g", F.col("id").alias("id_b"), F.col("size").alias("nb"), F.col("rest").alias("rb"))
    enough = F.least("ra", "rb") >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    cand = a.join(b, "g").filter((F.col("id_a") < F.col("id_b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & enough).select("id_a", "id_b").distinct()
    both = cand.join(c.select(F.col("id").alias("id_a"), F.col("sh").alias("sa")), "id_a").join(c.select(F.col("id").alias("id_b"), F.col("sh").alias("sb")), "id_b")
    return both.withColumn("similarity", array_jaccard(F.col("sa"), F.col("sb"))).filter(F.col("similarity") >= threshold).select("id_a", "id_b", "similarity")


def duplicate_classes(df: DataFrame, key: str, text: str = "text", n: int = 3) -> DataFrame:
    """Each text with words, and the least key of the texts with the same shingle set (class_id)."""
    s = df.select(key, F.array_sort(shingles(F.col(text), n)).alias("sh")).filter(F.size("sh") > 0).withColumn("h", F.sha2(F.array_join("sh", "\x01"), 256))
    return s.join(s.groupBy("h").agg(F.min(key).alias("class_id")), "h").select(key, "class_id", "sh")


def accepted_in_order(pairs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, kept): texts kept when they are taken in order of key and dropped if similar to one kept before.

    In each round the texts without an open earlier similar text are kept, and those similar to them dropped; only the pairs between texts
    still open are written on. There are as many rounds as the longest chain of decisions has steps.
    """
    edges = pairs.select(F.least("id_a", "id_b").alias("before"), F.greatest("id_a", "id_b").alias("id"))
    edges = written(edges.filter("before <> id").distinct(), "open")
    dropped = edges.select("id").limit(0)
    while not edges.isEmpty():
        first = edges.select("before").distinct().join(edges.select(F.col("id").alias("before")).distinct(), "before", "left_anti")
        out = written(edges.join(first, "before", "left_semi").select("id").distinct(), "dropped")
        dropped = dropped.unionByName(out)
        edges = edges.join(out, "id", "left_anti").join(out.select(F.col("id").alias("before")), "before", "left_anti")
        edges = written(edges.select("before", "id"), "open")
    gone = dropped.withColumn("gone", F.lit(True))
    return texts.select(F.col(key).alias("id")).distinct().join(gone, "id", "left").select(F.col("id").alias(key), F.col("gone").isNull().alias("kept"))
