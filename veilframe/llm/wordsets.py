"""Records as sequences and sets of words, independent of letter case, punctuation, spacing and invisible characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.llm.lookalikes import folded


def words_of(folded_text: Column) -> Column:
    """The runs of letters and digits, as 64-bit hashes in order."""
    return F.transform(F.filter(F.split(folded_text, r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def word_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rec_id, words (in order), set (distinct, sorted), cls (a digest of the set) of each distinct record.

    Rows that repeat an id and a text count once; of one id with several texts each text is a record.
    Null ids, null texts and texts without a word have no words to compare and are left out.
    """
    r = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text")).filter("rec_id is not null and text is not null")
    r = r.withColumn("words", words_of(folded("text"))).filter(F.size("words") > 0)
    r = r.withColumn("set", F.array_sort(F.array_distinct("words")))
    return r.select("rec_id", "words", "set", F.md5(F.concat_ws(",", F.col("set").cast("array<string>"))).alias("cls"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / F.greatest(union, F.lit(1))).otherwise(0.0)
