"""Check digits and digit counts, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.functions.text import let

#: Weights of the check digits of tax numbers.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def digits_of(c: Column) -> Column:
    """The ASCII digits of a text, in order."""
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    return F.try_to_number(F.substring(d, i + 1, 1), F.lit("9")).cast("int")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(d, i) * w
    return total


def is_inn(c: Column) -> Column:
    """Whether the digits are a tax number of 10 or 12 digits with right check digits; null for null."""

    def right(d: Column) -> Column:
        ten = (F.length(d) == 10) & (_weighted(d, INN10) % 11 % 10 == _digit(d, 9))
        twelve = (F.length(d) == 12) & (_weighted(d, INN12_FIRST) % 11 % 10 == _digit(d, 10)) & (_weighted(d, INN12_SECOND) % 11 % 10 == _digit(d, 11))
        return F.coalesce(ten, F.lit(False)) | F.coalesce(twelve, F.lit(False))

    return F.when(c.isNotNull(), let(digits_of(c), right))


def is_snils(c: Column) -> Column:
    """Whether the digits are an insurance number of 11 digits with the right check number; null for null."""

    def right(d: Column) -> Column:
        # The check number is the weighted sum modulo 101, with 100 as 0.
        rest = _weighted(d, tuple(range(9, 0, -1))) % 101 % 100
        return F.coalesce((F.length(d) == 11) & (rest == _digit(d, 9) * 10 + _digit(d, 10)), F.lit(False))

    return F.when(c.isNotNull(), let(digits_of(c), right))


def is_luhn(c: Column) -> Column:
    """Whether the digits pass the Luhn test; false without digits, null for null."""
    d = F.reverse(digits_of(c))
    n = F.transform(F.split(d, ""), lambda x, i: F.when(x == "", 0).when(i % 2 == 1, (x.try_cast("int") * 2) % 10 + F.floor(x.try_cast("int") * 2 / 10)).otherwise(x.try_cast("int")))
    total = F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.cast("bigint"), F.lit(0)))
    return F.when(c.isNull(), None).otherwise((F.length(d) > 0) & (total % 10 == 0))


def digit_count(c: Column) -> Column:
    return F.length(digits_of(c))
