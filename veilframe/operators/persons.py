"""Filters of falsely found names, and repair of name spans given by a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions.text import let
from veilframe.operators.spans import value_of

NAME_LEAST, COMMON_LEAST = 0.35, 0.5
_SUFFIX = r"(?iu)(ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына|ский|ская|цкий|цкая|енко|ук|юк|ович|евич|овна|евна)(а|у|ым|ом|ой|е|ы)?$"
#: A role word up to two words before, in the same phrase and not over quotation marks.
_ROLE = (
    r"(?iu)(?<!\p{L})(клиент|абонент|заявител|получател|отправител|исполнител|сотрудник|менеджер|оператор|специалист|директор|врач|ответственн|подписа|подпис|подготовил|уважаем|гражданин|гражданк|господин|госпож|зовут|фамили|имя|фио|от)\p{L}{0,4}"
    r"(?:[^\p{L}\p{N}_.!?\n«»\"“”„]+[\p{L}\p{N}_]+){0,2}[^\p{L}\p{N}_.!?\n«»\"“”„]{0,3}$"
)
_ADDRESS_LEFT = r"(?iu)(?<!\p{L})(ул|улиц[аеы]|пер|переулок|пр|проспект|б-р|бульвар|наб|набережная|шоссе|площадь|пл|г|город|пос|село|станция|метро)[.\s]*$"
_ADDRESS_RIGHT = r"(?iu)^[.\s]*(улиц[аеы]|ул\.|переулок|проспект|бульвар|набережная|шоссе|площадь|д\.|дом)(?!\p{L})"
#: Characters before and after a name in which the word next to it is looked for, and in which a role or an address word is.
NEAR, ROLE_NEAR, ADDRESS_LEFT_NEAR, ADDRESS_RIGHT_NEAR = 40, 50, 18, 14


def _words(v: Column) -> Column:
    return F.filter(F.split(v, r"[^\p{L}\-]+"), lambda w: w != "")


def _before(text: Column, span: Column, n: int) -> Column:
    return F.substring(text, F.greatest(span["start_pos"] - n, F.lit(0)) + 1, F.least(span["start_pos"], F.lit(n)))


def _neighbours(text: Column, span: Column) -> Column:
    """The words right before and after a span with nothing but spaces between; '' for none."""
    left = F.regexp_extract(_before(text, span, NEAR), r"([\p{L}]+)[ \t]+$", 1)
    right = F.regexp_extract(F.substring(text, span["end_pos"] + 1, F.lit(NEAR)), r"^[ \t]+([\p{L}]+)", 1)
    return F.array(left, right)


def rule_of(text: Column, span: Column, lexicon: Column) -> Column:
    """The rule by which a PERSON span is dropped, or null; by rules F1 to F5 in their order.

    lexicon: map from a lower-case word to struct<given, surn, common> scores. F1: no letters. F2: one word of at most three
    letters that isn't name-like. F3: one longer common noun without a role word before it. F4: several words, all common or short, not all
    short. F5: an address word right before, in or after. An initial with a dot switches F2 to F4 off, and so does, for one word, a name-like word
    next to it; a surname ending or a role word protects a word. Words outside the lexicon count as neither.
    """
    v = value_of(text, span)
    words = _words(v)
    low = lambda w: F.lower(w)
    name_like = lambda w: (w != "") & (w.rlike(_SUFFIX) | F.coalesce(lexicon[low(w)]["given"] + lexicon[low(w)]["surn"] >= NAME_LEAST, F.lit(False)))
    common = lambda w: ~w.rlike(_SUFFIX) & F.coalesce(lexicon[low(w)]["common"] >= COMMON_LEAST, F.lit(False)) & ~name_like(w)
    short = lambda w: (F.length(w) <= 3) & ~name_like(w)
    one, first = F.size(words) == 1, F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    safe = v.rlike(r"(?u)(?<!\p{L})\p{Lu}\.") | (one & F.exists(_neighbours(text, span), name_like))
    f1 = ~v.rlike(r"\p{L}")
    f2 = one & short(first)
    f3 = one & (F.length(first) > 3) & common(first) & ~_before(text, span, ROLE_NEAR).rlike(_ROLE)
    f4 = (F.size(words) >= 2) & F.forall(words, lambda w: common(w) | short(w)) & ~F.forall(words, short)
    f5 = _before(text, span, ADDRESS_LEFT_NEAR).rlike(_ADDRESS_LEFT) | F.substring(text, span["end_pos"] + 1, F.lit(ADDRESS_RIGHT_NEAR)).rlike(_ADDRESS_RIGHT)
    return F.when(f1, "F1").when(~safe & f2, "F2").when(~safe & f3, "F3").when(~safe & f4, "F4").when(f5, "F5")


def keeps_name(text: Column, span: Column, lexicon: Column) -> Column:
    """Whether a PERSON span stands (see rule_of)."""
    return rule_of(text, span, lexicon).isNull()


def reject_reason(df: DataFrame, key: str, text: str, spans: str, lexicon: DataFrame) -> DataFrame:
    """(key, start_pos, end_pos, reason) of every PERSON span: the rule that drops it, or null.

    lexicon: word, given, surn, common, a table of any size; only the words that stand in or next to a span are looked up, by a join, and a row's own
    few words travel with it as a map. Keys that repeat are joined as one.
    """
    one = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.explode(F.filter(spans, lambda s: s["entity_type"] == "PERSON")).alias("__s"))
    one = one.select("__key", "__text", F.col("__s.start_pos").alias("__a"), F.col("__s.end_pos").alias("__b"))
    span = F.struct(F.col("__a").alias("start_pos"), F.col("__b").alias("end_pos"))
    asked = F.array_distinct(F.transform(F.filter(F.concat(_words(value_of(F.col("__text"), span)), _neighbours(F.col("__text"), span)), lambda w: w != ""), lambda w: F.lower(w)))
    words = one.select("__key", "__a", "__b", F.explode(asked).alias("word")).distinct()
    known = words.join(lexicon.select(F.lower("word").alias("word"), F.struct("given", "surn", "common").alias("__x")).groupBy("word").agg(F.max("__x").alias("__x")), "word")
    maps = known.groupBy("__key", "__a", "__b").agg(F.map_from_entries(F.collect_list(F.struct("word", "__x"))).alias("__lex"))
    on = [F.col("__key").eqNullSafe(F.col("k")), F.col("__a") == F.col("a"), F.col("__b") == F.col("b")]
    j = one.join(maps.select(F.col("__key").alias("k"), F.col("__a").alias("a"), F.col("__b").alias("b"), "__lex"), on, "left")
    lex = F.coalesce("__lex", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<given:double,surn:double,common:double>>")))
    return j.select(F.col("__key").alias(key), F.col("__a").alias("start_pos"), F.col("__b").alias("end_pos"), rule_of(F.col("__text"), span, lex).alias("reason"))


def filter_names(text: Column, spans: Column, lexicon: Column) -> Column:
    return F.filter(spans, lambda s: (s["entity_type"] != "PERSON") | keeps_name(text, s, lexicon))


#: Field names that a model glues to a name.
LABEL_WORDS = ("имя", "фамилия", "отчество", "фио", "клиент", "клиентка", "получатель", "отправитель", "тел", "телефон", "почта", "паспорт", "инн", "снилс", "адрес", "дата", "рождения", "email", "номер", "карта", "договор", "заказ")


def clean_name_spans(text: Column, spans: Column) -> Column:
    """Spans of a model brought to word borders: marks at the ends cut off, the last word completed to the right and the first to the
    left, a dot after a final initial taken in; spans with under two letters, label words and spans within another are dropped."""

    def repaired(s: Column) -> Column:
        v = value_of(text, s)
        lead = F.length(F.regexp_extract(v, r"^[^\p{L}]*", 0))
        trail = F.length(F.regexp_extract(v, r"[^\p{L}]*$", 0))
        a, b = s["start_pos"] + lead, s["end_pos"] - trail
        more_left = F.length(F.regexp_extract(F.substring(text, F.lit(1), a), r"\p{L}*$", 0))
        more_right = F.length(F.regexp_extract(F.substring(text, b + 1, F.length(text)), r"^\p{L}*", 0))
        a2, b2 = a - more_left, b + more_right
        dot = F.substring(text, F.greatest(b2 - 1, F.lit(1)), F.lit(3)).rlike(r"^(?:[^\p{L}]\p{Lu}\.|\p{Lu}\.)") & (F.substring(text, b2 + 1, F.lit(1)) == ".")
        return F.struct(s["entity_type"].alias("entity_type"), a2.cast("int").alias("start_pos"), (b2 + dot.cast("int")).cast("int").alias("end_pos"), s["score"].alias("score"))

    has_letters = F.filter(spans, lambda s: F.length(F.regexp_replace(value_of(text, s), r"[^\p{L}]", "")) >= 2)
    fixed = F.array_distinct(F.transform(has_letters, repaired))
    spans_ = F.filter(fixed, lambda s: ~F.lower(value_of(text, s)).isin(*LABEL_WORDS))
    inside = lambda s, k: (k["start_pos"] <= s["start_pos"]) & (s["end_pos"] <= k["end_pos"]) & ((k["start_pos"] < s["start_pos"]) | (s["end_pos"] < k["end_pos"]))
    return let(spans_, lambda named: F.filter(named, lambda s: ~F.exists(named, lambda k: inside(s, k))))
