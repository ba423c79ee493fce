"""Made-up records: values with right check digits, filled templates with exact spans, and typing errors outside protected spans."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from veilframe.functions.checks import INN10
from veilframe.functions.text import let

#: Neighbours on a Russian keyboard, for slips of the finger.
KEYS = {"а": "вп", "о": "рл", "е": "нк", "и": "мт", "н": "ег", "т": "иь", "р": "по", "с": "чм", "л": "од", "в": "ыа"}


def hashed_digits(seed: Column, n: int, salt: str = "") -> Column:
    """n decimal digits that depend on the seed only."""
    return F.lpad((F.pmod(F.xxhash64(F.lit(salt), seed), F.lit(10**n))).cast("string"), n, "0")


def made_inn(seed: Column) -> Column:
    """A tax number of ten digits with the right check digit."""

    def whole(nine: Column) -> Column:
        total = F.lit(0)
        for i, w in enumerate(INN10):
            total = total + F.substring(nine, i + 1, 1).cast("int") * w
        return F.concat(nine, (total % 11 % 10).cast("string"))

    return let(hashed_digits(seed, 9, "inn"), whole)


def made_snils(seed: Column) -> Column:
    """An insurance number with the right check number, in the form ddd-ddd-ddd dd."""

    def whole(nine: Column) -> Column:
        total = F.lit(0)
        for i in range(9):
            total = total + F.substring(nine, i + 1, 1).cast("int") * (9 - i)
        check = F.lpad((total % 101 % 100).cast("string"), 2, "0")
        return F.concat_ws("-", F.substring(nine, 1, 3), F.substring(nine, 4, 3), F.concat(F.substring(nine, 7, 3), F.lit(" "), check))

    return let(hashed_digits(seed, 9, "snils"), whole)


def made_phone(seed: Column) -> Column:
    d = hashed_digits(seed, 9, "phone")
    return F.concat(F.lit("+7 9"), F.substring(d, 1, 2), F.lit(" "), F.substring(d, 3, 3), F.lit("-"), F.substring(d, 6, 2), F.lit("-"), F.substring(d, 8, 2))


def filled(template: Column, values: Column) -> Column:
    """struct<text, spans>: slots {TYPE} of a template filled in turn with values (array of struct<entity_type, value>), spans exact by construction.

    A slot beyond the values stays as it is, without a span.
    """
    parts = F.split(template, r"\{[A-Z_]+\}", -1)
    n = F.least(F.size(parts) - 1, F.size(values))
    zero = F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("text"), F.array().cast("array<struct<entity_type:string,start_pos:int,end_pos:int>>").alias("spans"))
    items = F.arrays_zip(F.slice(values, F.lit(1), n).alias("v"), F.slice(parts, F.lit(2), n).alias("p"))

    def step(a: Column, x: Column) -> Column:
        s = F.length(a["text"])
        span = F.struct(x["v"]["entity_type"].alias("entity_type"), s.cast("int").alias("start_pos"), (s + F.length(x["v"]["value"])).cast("int").alias("end_pos"))
        return F.struct(F.concat(a["text"], x["v"]["value"], x["p"]).alias("text"), F.concat(a["spans"], F.array(span)).alias("spans"))

    return F.aggregate(items, zero, step)


def corrupt_text(text: str, protected: list[tuple[int, int]], seed: int, per: int = 55) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """Typing errors outside the protected spans, about one per `per` characters of each stretch of over 8: a letter dropped, swapped, doubled, mistyped,
    ё for е, a comma lost, a case changed. Gives the text, the protected spans at their new offsets, and the damaged ranges."""
    rng = random.Random(seed)
    out, new, damaged = "", [], []
    at = 0
    for a, b in [*sorted(protected), (len(text), len(text))]:
        part = list(text[at:a])
        marks: list[int] = []
        if len(part) > 8:
            for _ in range(max(1, len(part) // per)):
                spots = [i for i in range(1, len(part) - 1) if part[i].isalpha() or part[i] == ","]
                if not spots:
                    break
                i = rng.choice(spots)
                c, op = part[i], rng.randrange(7)
                if c == ",":
                    part[i] = ""
                elif op == 0:
                    part[i] = ""
                elif op == 1 and part[i + 1].isalpha():
                    part[i], part[i + 1] = part[i + 1], part[i]
                elif op == 2:
                    part[i] = c + c
                elif op == 3:
                    part[i] = rng.choice(KEYS.get(c.lower(), c))
                elif op == 4:
                    part[i] = {"е": "ё", "ё": "е"}.get(c, c)
                else:
                    part[i] = c.swapcase()
                marks.append(i)
        base = len(out)
        for i in marks:
            s = base + sum(map(len, part[:i]))
            damaged.append((s, s + max(1, len(part[i]))))
        out += "".join(part)
        if b > a:
            new.append((len(out), len(out) + b - a))
            out += text[a:b]
        at = b
    return out, new, damaged


CORRUPTED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("damaged", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


@F.pandas_udf(CORRUPTED)
def corrupted(text: pd.Series, spans: pd.Series, seed: pd.Series) -> pd.DataFrame:
    """corrupt_text over columns: text, array of [start, end], seed."""
    rows = []
    for t, s, k in zip(text, spans, seed):
        if t is None:
            rows.append((None, None, None))
        else:
            x, n, d = corrupt_text(t, [tuple(p) for p in (s if s is not None else [])], int(k))
            rows.append((x, [list(p) for p in n], [list(p) for p in d]))
    return pd.DataFrame(rows, columns=["text", "spans", "damaged"])


def rejections(similarity: Column, missing: Column, negatives: Column, damaged: Column, length: Column) -> Column:
    """The names of the checks a made record fails, in order: too_similar, missed_span, false_alarm, damaged_span, too_short."""
    return F.filter(F.array(
        F.when(similarity >= 0.6, "too_similar"), F.when(missing > 0, "missed_span"), F.when(negatives > 0, "false_alarm"), F.when(damaged > 0, "damaged_span"), F.when(length < 20, "too_short"),
    ), lambda x: x.isNotNull())


def made_email(seed: Column) -> Column:
    return F.concat(F.lit("user"), hashed_digits(seed, 6, "mail"), F.lit("@mail.test"))


def made_passport(seed: Column) -> Column:
    d = hashed_digits(seed, 10, "passport")
    return F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 6))


def made_birth_date(seed: Column) -> Column:
    """A date dd.mm.yyyy between 1940 and 2005 that the calendar has."""
    return F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), F.pmod(F.xxhash64(F.lit("birth"), seed), F.lit(24000)).cast("int")), "dd.MM.yyyy")


def made_card(seed: Column) -> Column:
    """A card number of sixteen digits with the right Luhn digit, in fours."""

    def whole(d: Column) -> Column:
        total = F.lit(0)
        for i in range(15):
            x = F.substring(d, i + 1, 1).cast("int") * (2 if i % 2 == 0 else 1)
            total = total + F.when(x > 9, x - 9).otherwise(x)
        n = F.concat(d, ((10 - total % 10) % 10).cast("string"))
        return F.concat_ws(" ", *[F.substring(n, 4 * k + 1, 4) for k in range(4)])

    return let(F.concat(F.lit("4"), hashed_digits(seed, 14, "card")), whole)


#: Street names for made addresses.
STREETS = ("Садовая", "Лесная", "Полевая", "Речная", "Школьная", "Южная", "Северная", "Озёрная")


def made_address(seed: Column) -> Column:
    h = F.pmod(F.xxhash64(F.lit("address"), seed), F.lit(1_000_000))
    street = F.element_at(F.array(*[F.lit(s) for s in STREETS]), (h % len(STREETS) + 1).cast("int"))
    return F.concat(F.lit("ул. "), street, F.lit(", д. "), (h % 150 + 1).cast("string"), F.lit(", кв. "), (h % 311 + 1).cast("string"))


def person_forms(given: Column, patronymic: Column, surname: Column) -> Column:
    """Map from the name of a form to a person's name in it: full, surname_first, given_surname, given_patronymic, initials_before, initials_after, surname, lower, upper."""
    i, o = F.concat(F.substring(given, 1, 1), F.lit(".")), F.concat(F.substring(patronymic, 1, 1), F.lit("."))
    full = F.concat_ws(" ", given, patronymic, surname)
    forms = {
        "full": full, "surname_first": F.concat_ws(" ", surname, given, patronymic), "given_surname": F.concat_ws(" ", given, surname), "given_patronymic": F.concat_ws(" ", given, patronymic),
        "initials_before": F.concat(i, o, F.lit(" "), surname), "initials_after": F.concat_ws(" ", surname, i, o), "surname": surname, "lower": F.lower(full), "upper": F.upper(full),
    }
    return F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), v)])


def glued(text: Column, spans: Column, seed: Column, percent: int = 12) -> Column:
    """struct<text, spans>: at about `percent` of the spans the white space before them is taken out, so that the word before is glued to the value; spans are moved along."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start_pos"].cast("int").alias("start_pos"), s["end_pos"].cast("int").alias("end_pos"), s["entity_type"].alias("entity_type"))))
    zero = F.struct(text.alias("text"), F.lit(0).alias("gone"), F.array().cast("array<struct<entity_type:string,start_pos:int,end_pos:int>>").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        at = s["start_pos"] - a["gone"]
        cut = (F.pmod(F.xxhash64(F.lit("glue"), seed, s["start_pos"]), F.lit(100)) < percent) & (at > 1) & (F.substring(a["text"], at, F.lit(1)) == " ") & F.substring(a["text"], at - 1, F.lit(1)).rlike(r"\p{L}")
        n = cut.cast("int")
        moved = F.struct(s["entity_type"], (at - n).cast("int").alias("start_pos"), (s["end_pos"] - a["gone"] - n).cast("int").alias("end_pos"))
        t = F.when(cut, F.concat(F.substring(a["text"], F.lit(1), at - 1), F.substring(a["text"], at + 1, F.length(a["text"])))).otherwise(a["text"])
        return F.struct(t.alias("text"), (a["gone"] + n).cast("int").alias("gone"), F.concat(a["spans"], F.array(moved)).alias("spans"))

    return F.aggregate(ordered, zero, step, lambda a: F.struct(a["text"].alias("text"), a["spans"].alias("spans")))


def mixed_parts(key: Column, shares: dict[str, int], salt: str = "mix") -> Column:
    """The part of a mixture a row belongs to, by a hash of its key; shares in percent, the last part takes the rest."""
    u = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(100))
    names = list(shares)
    out, upto = F.lit(names[-1]), sum(shares[n] for n in names[:-1])
    for n in reversed(names[:-1]):
        out = F.when(u < upto, n).otherwise(out)
        upto -= shares[n]
    return out
