"""Between spans and BIO tags of tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.operators.spans import empty_spans, find_spans


def tokens_of(text: Column) -> Column:
    """Words and single signs with offsets."""
    return find_spans(text, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", "T", 1.0)


def tags_of(tokens: Column, spans: Column) -> Column:
    """B-type for a token at a span's start, I-type for one inside, else O."""

    def tag(t: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start_pos"] <= t["start_pos"]) & (t["end_pos"] <= s["end_pos"]))
        first = F.get(inside, F.lit(0))
        return F.when(F.size(inside) == 0, "O").otherwise(F.concat(F.when(first["start_pos"] == t["start_pos"], "B-").otherwise("I-"), first["entity_type"]))

    return F.transform(tokens, tag)


def spans_of_tags(text: Column, words: Column, tags: Column) -> Column:
    """Spans of BIO tags; each word is searched after the one before, as it is and then in lower case. Null if a word isn't found."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), empty_spans().alias("out"), F.lit("O").alias("last"))
    pairs = F.arrays_zip(words.alias("w"), tags.alias("t"))

    def step(a: Column, x: Column) -> Column:
        rest = F.substring(text, a["at"] + 1, F.length(text))
        i = F.instr(rest, x["w"])
        j = F.when(i > 0, i).otherwise(F.instr(F.lower(rest), F.lower(x["w"])))
        s, kind = (a["at"] + j - 1).cast("int"), F.substring(x["t"], F.lit(3), F.length(x["t"]))
        e = (s + F.length(x["w"])).cast("int")
        last = F.element_at(a["out"], -1)
        new = F.struct(kind.alias("entity_type"), s.alias("start_pos"), e.alias("end_pos"), F.lit(1.0).alias("score"))
        grown = F.struct(last["entity_type"].alias("entity_type"), last["start_pos"].alias("start_pos"), e.alias("end_pos"), F.lit(1.0).alias("score"))
        goes_on = x["t"].startswith("I-") & (a["last"] != "O") & (F.size(a["out"]) > 0) & (last["entity_type"] == kind)
        out = F.when(x["t"] == "O", a["out"]).when(goes_on, F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(grown))).otherwise(F.concat(a["out"], F.array(new)))
        return F.struct(F.when(j > 0, e).otherwise(a["at"]).cast("int").alias("at"), (a["ok"] & (j > 0)).alias("ok"), F.when(j > 0, out).otherwise(a["out"]).alias("out"), x["t"].alias("last"))

    return F.aggregate(pairs, zero, step, lambda a: F.when(a["ok"], a["out"]))
