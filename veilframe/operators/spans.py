"""Spans of a text as arrays of structs, and what is computed on them, in expressions only.

A span is struct<entity_type, start_pos, end_pos, score>; offsets count code points from 0 and exclude the end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.functions.text import let

SPAN = "struct<entity_type:string,start_pos:int,end_pos:int,score:double>"
SPANS = f"array<{SPAN}>"
#: Placeholder of each type; any other type is <PII>. Types that are never masked.
PLACEHOLDERS = {
    "PERSON": "<PERSON>", "PHONE_NUMBER": "<PHONE>", "EMAIL_ADDRESS": "<EMAIL>", "INN": "<INN>", "SNILS": "<SNILS>", "PASSPORT": "<PASSPORT>",
    "DATE_OF_BIRTH": "<DATE_OF_BIRTH>", "CREDIT_CARD": "<CREDIT_CARD>", "ADDRESS": "<ADDRESS>",
}
NEVER_MASKED = ("LOCATION", "NRP")
POLICY = (*PLACEHOLDERS, "PII")


def empty_spans() -> Column:
    return F.array().cast(SPANS)


#: Two characters that Unicode keeps out of texts; they mark the matches. Where a text has them, they count as U+FFFD.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _parts(pattern: str) -> tuple[str, str, str]:
    """What stands before, in and after the first capturing group of a pattern."""
    depth, start, i, in_class = 0, -1, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "(" and not in_class:
            if start < 0 and pattern[i + 1 : i + 2] != "?":
                start, depth = i, 0
            elif start >= 0:
                depth += 1
        elif c == ")" and not in_class and start >= 0:
            if depth == 0:
                return pattern[:start], pattern[start + 1 : i], pattern[i + 1 :]
            depth -= 1
        i += 1
    raise ValueError("no group in the pattern")


def find_spans(text: Column, pattern: str, entity: str, score: float, group: int = 0) -> Column:
    """All matches of a Java pattern as spans; with group=1 the span is that of the pattern's only capturing group.

    The matches are marked in one pass of the pattern, and the offsets follow from the lengths between the marks; all of it is
    native. Null and empty texts have no spans.
    """
    before, inner, after = _parts(pattern) if group else ("", pattern, "")
    flags = ""
    if group and before.startswith("(?iu)"):
        flags, before = "(?iu)", before[5:]
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "\ufffd\ufffd"), F.lit(f"{flags}({before})({inner})({after})"), F.lit(f"$1{_OPEN}$2{_CLOSE}$3"))

    def step(a: Column, part: Column) -> Column:
        end = (a["at"] + F.instr(part, _CLOSE) - 1).cast("int")
        found = F.struct(F.lit(entity).alias("entity_type"), a["at"].alias("start_pos"), end.alias("end_pos"), F.lit(float(score)).alias("score"))
        return F.struct((a["at"] + F.length(part) - 1).cast("int").alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

    def spans(parts: Column) -> Column:
        first = F.struct(F.length(F.element_at(parts, 1)).cast("int").alias("at"), empty_spans().alias("out"))
        found = F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), first, step, lambda a: a["out"])
        return F.when(F.size(parts) > 1, F.filter(found, lambda s: s["start_pos"] < s["end_pos"])).otherwise(empty_spans())

    return let(F.split(marked, _OPEN, -1), spans)


def value_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start_pos"] + 1, span["end_pos"] - span["start_pos"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start_pos"] < b["end_pos"]) & (b["start_pos"] < a["end_pos"])


def in_policy(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~s["entity_type"].isin(*NEVER_MASKED))


def disabled_types(asked: Column) -> Column:
    """The types of a caller's list that can be switched off: trimmed, upper case, known. Unknown ones are ignored; nothing is ever switched on."""
    return F.array_intersect(F.transform(F.coalesce(asked, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), F.array(*[F.lit(x) for x in POLICY]))


def listed_types(form: Column) -> Column:
    """The types named in a form field such as "PERSON, INN": parted by commas, without spaces and empty items. Null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(form, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def without(spans: Column, types: Column) -> Column:
    """Spans whose type isn't switched off; a type without a placeholder of its own goes by PII."""
    kind = lambda s: F.when(s["entity_type"].isin(*PLACEHOLDERS), s["entity_type"]).otherwise("PII")
    return F.filter(spans, lambda s: ~F.array_contains(types, kind(s)))


def resolve_overlaps(spans: Column) -> Column:
    """Greedy choice: by score, then length (both falling), then start, then place in the input; a span is kept if it meets none kept before. In order of start."""
    ranked = F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("a"), (s["start_pos"] - s["end_pos"]).alias("b"), s["start_pos"].alias("c"), i.alias("d"), s.alias("s")))
    kept = F.aggregate(F.array_sort(ranked), F.array().cast(SPANS), lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x["s"])), acc).otherwise(F.concat(acc, F.array(x["s"]))))
    return by_start(kept)


def by_start(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start_pos"].alias("a"), s["end_pos"].alias("b"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def numbered(spans: Column, text: Column) -> Column:
    """Entities in order with value and placeholder: the first of a placeholder bare, then _2, _3 and so on from the left.

    Types that share a placeholder share its numbers.
    """
    table = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    base = F.transform(spans, lambda s: F.struct(s.alias("s"), F.coalesce(table[s["entity_type"]], F.lit("<PII>")).alias("p")))

    def named(all_: Column, x: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda y: y["p"] == x["p"]))
        p = F.when(n == 1, x["p"]).otherwise(F.concat(F.substring(x["p"], F.lit(1), F.length(x["p"]) - 1), F.lit("_"), n.cast("string"), F.lit(">")))
        s = x["s"]
        return F.struct(s["entity_type"].alias("entity_type"), s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), F.round(s["score"], 2).alias("score"), value_of(text, s).alias("value"), p.alias("placeholder"))

    return let(base, lambda all_: F.transform(all_, lambda x, i: named(all_, x, i)))


def spliced(text: Column, entities: Column) -> Column:
    """The text with each entity (in order, disjoint) replaced by its placeholder."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, e: F.struct(e["end_pos"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, e["start_pos"] - a["at"]), e["placeholder"]).alias("out"))
    return F.aggregate(entities, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def mapping_of(entities: Column) -> Column:
    return F.map_from_entries(F.transform(entities, lambda e: F.struct(e["placeholder"], e["value"])))


def restored(text: Column, mapping: Column) -> Column:
    """struct<deanonymized, replaced>: every placeholder of the mapping replaced, the longest first, one after another."""
    keys = F.array_sort(F.transform(F.map_entries(mapping), lambda e: F.struct((-F.length(e["key"])).alias("a"), e["key"].alias("key"), e["value"].alias("value"))))
    zero = F.struct(text.alias("t"), F.lit(0).alias("n"))

    def step(a: Column, e: Column) -> Column:
        count = (F.length(a["t"]) - F.length(F.replace(a["t"], e["key"], F.lit("")))) / F.greatest(F.length(e["key"]), F.lit(1))
        return F.struct(F.replace(a["t"], e["key"], e["value"]).alias("t"), (a["n"] + count.cast("int")).alias("n"))

    return F.aggregate(keys, zero, step, lambda a: F.struct(a["t"].alias("deanonymized"), a["n"].alias("replaced")))


def normal_spans(text: Column, spans: Column) -> Column:
    """Distinct spans without white space at their ends; empty ones dropped; in order."""

    def trimmed(s: Column) -> Column:
        v = value_of(text, s)
        left = F.length(v) - F.length(F.regexp_replace(v, r"^[\s\p{Z}]+", ""))
        right = F.length(v) - F.length(F.regexp_replace(v, r"[\s\p{Z}]+$", ""))
        return F.struct(s["entity_type"].alias("entity_type"), (s["start_pos"] + left).cast("int").alias("start_pos"), (s["end_pos"] - right).cast("int").alias("end_pos"), s["score"].alias("score"))

    return by_start(F.array_distinct(F.filter(F.transform(spans, trimmed), lambda s: s["start_pos"] < s["end_pos"])))


def merged(text: Column, spans: Column, gap: str) -> Column:
    """Spans of one type whose gap in the text matches the pattern become one, with the higher score. Input in order."""
    fits = lambda a, s: (F.element_at(a, -1)["entity_type"] == s["entity_type"]) & (F.element_at(a, -1)["end_pos"] <= s["start_pos"]) & F.substring(text, F.element_at(a, -1)["end_pos"] + 1, s["start_pos"] - F.element_at(a, -1)["end_pos"]).rlike(f"^(?:{gap})$")

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["entity_type"].alias("entity_type"), last["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), F.greatest(last["score"], s["score"]).alias("score"))
        return F.when(F.size(a) == 0, F.array(s)).when(fits(a, s), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(spans, empty_spans(), step)


def merge_glued(text: Column, spans: Column) -> Column:
    """Parts of a name with nothing but spaces and dots between them become one span."""
    return merged(text, spans, r"[\s.]*")


def merge_hyphened(text: Column, spans: Column) -> Column:
    """Spans with exactly one hyphen or dash between them become one."""
    return merged(text, spans, "[-‐–]")


def drop_nested(spans: Column) -> Column:
    """Spans inside one of the same type that is longer (or equal and before it) are dropped."""
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct((s["start_pos"] - s["end_pos"]).alias("a"), s["start_pos"].alias("b"), i.alias("c"), s.alias("s"))))
    inside = lambda s, k: (k["entity_type"] == s["entity_type"]) & (k["start_pos"] <= s["start_pos"]) & (s["end_pos"] <= k["end_pos"])
    return by_start(F.aggregate(ranked, empty_spans(), lambda acc, x: F.when(F.exists(acc, lambda k: inside(x["s"], k)), acc).otherwise(F.concat(acc, F.array(x["s"])))))


def unioned(spans: Column) -> Column:
    """The union of spans as disjoint intervals, types aside; touching ones are joined."""
    s = F.array_sort(F.transform(spans, lambda x: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"))))
    zero = F.array().cast("array<struct<start_pos:int,end_pos:int>>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.struct(last["start_pos"].alias("start_pos"), F.greatest(last["end_pos"], x["end_pos"]).alias("end_pos"))
        return F.when(F.size(a) == 0, F.array(x)).when(x["start_pos"] <= last["end_pos"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(s, zero, step)


def fully_covered(text: Column, gold: Column, predicted: Column) -> Column:
    """Whether every word in the gold span is covered whole by the union of the predicted spans."""
    words = find_spans(value_of(text, gold), r"[\p{L}\p{N}_]+", "W", 1.0)
    inside = lambda w, p: (p["start_pos"] <= gold["start_pos"] + w["start_pos"]) & (gold["start_pos"] + w["end_pos"] <= p["end_pos"])
    return let(unioned(predicted), lambda u: F.forall(words, lambda w: F.exists(u, lambda p: inside(w, p))))


def touched(gold: Column, predicted: Column) -> Column:
    return F.exists(predicted, lambda p: overlaps(gold, p))


def leaked(masked: Column, value: Column) -> Column:
    """Whether a value, without outer spaces, still stands in the masked text."""
    v = F.trim(value)
    return (v != "") & (F.instr(masked, v) > 0)


def highlighted(text: Column, entities: Column) -> Column:
    """The text with each entity as ⟦value|TYPE⟧, for review."""
    marked = F.transform(entities, lambda e: e.withField("placeholder", F.concat(F.lit("⟦"), value_of(text, e), F.lit("|"), e["entity_type"], F.lit("⟧"))))
    return spliced(text, marked)
