"""Text normalisation, word sets and similarity, and inflection of names, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\s\p{Z}]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row; an expression named often, or in a lambda, is otherwise computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapsed(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends: the key for equal texts."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", ""))


def plain_yo(c: Column) -> Column:
    return F.translate(c, "ёЁ", "еЕ")


def word_list(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(word_list(c))


def shingles(c: Column, n: int = 3) -> Column:
    """The distinct n-word shingles; of a text with fewer words, its distinct words."""

    def grams(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, made).otherwise(w))

    return let(word_list(c), grams)


def array_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def frame_of(text: Column, spans: Column) -> Column:
    """The text with each span (start_pos, end_pos, entity_type; disjoint, in order) replaced by <TYPE>, lower case, ё as е."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, lambda a, s: F.struct(
        s["end_pos"].cast("int").alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start_pos"] - a["at"]), F.lit("<"), s["entity_type"], F.lit(">")).alias("out"),
    ))
    return plain_yo(F.lower(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))))


#: Endings of surnames in -ов/-ев/-ин by case (masculine, feminine), patronymics in -вич/-вна.
SURNAME_MASC = {"nom": "", "gen": "а", "dat": "у", "acc": "а", "ins": "ым", "prep": "е"}
SURNAME_FEM = {"nom": "а", "gen": "ой", "dat": "ой", "acc": "у", "ins": "ой", "prep": "ой"}
PATRONYMIC_MASC = {"nom": "", "gen": "а", "dat": "у", "acc": "а", "ins": "ем", "prep": "е"}
PATRONYMIC_FEM = {"nom": "а", "gen": "ы", "dat": "е", "acc": "у", "ins": "ой", "prep": "е"}


def decline_surname(base: Column, gender: Column, case: Column) -> Column:
    """A surname in -ов, -ев, -ёв, -ин, -ын (given in the masculine nominative) in gender 'm' or 'f' and case; others stay."""
    regular = base.rlike("(?iu)(ов|ев|ёв|ин|ын)$")
    masc = F.create_map(*[F.lit(x) for kv in SURNAME_MASC.items() for x in kv])
    fem = F.create_map(*[F.lit(x) for kv in SURNAME_FEM.items() for x in kv])
    return F.when(~regular, base).otherwise(F.concat(base, F.when(gender == "f", fem[case]).otherwise(masc[case])))


def decline_patronymic(base: Column, gender: Column, case: Column) -> Column:
    """A patronymic (given in the nominative, -вич or -вна) in a case."""
    masc = F.create_map(*[F.lit(x) for kv in PATRONYMIC_MASC.items() for x in kv])
    fem = F.create_map(*[F.lit(x) for kv in PATRONYMIC_FEM.items() for x in kv])
    return F.when(gender == "f", F.concat(F.regexp_replace(base, "а$", ""), fem[case])).otherwise(F.concat(base, masc[case]))


#: Endings by case (nom, gen, dat, acc, ins, prep) of adjectival surnames (after -ск-, -цк-), of masculine words in a
#: consonant and in -й or -ь, of words in -а, in -я and in -ия, and of feminine ones in -ь.
CASES = ("nom", "gen", "dat", "acc", "ins", "prep")
ADJECTIVE_MASC, ADJECTIVE_FEM = ("ий", "ого", "ому", "ого", "им", "ом"), ("ая", "ой", "ой", "ую", "ой", "ой")
HARD_MASC, SOFT_MASC = ("", "а", "у", "а", "ом", "е"), (None, "я", "ю", "я", "ем", "е")
FIRST_A, FIRST_YA, FIRST_IYA, SOFT_FEM = ("а", "ы", "е", "у", "ой", "е"), ("я", "и", "е", "ю", "ей", "е"), ("я", "и", "и", "ю", "ей", "и"), ("ь", "и", "и", "ь", "ью", "и")


def _ending(case: Column, forms: tuple[str | None, ...], nominative: Column | None = None) -> Column:
    out = nominative if nominative is not None else F.lit(forms[0])
    for c, f in zip(CASES[1:], forms[1:]):
        out = F.when(case == c, f).otherwise(out)
    return out


def decline_given(name: Column, gender: Column, case: Column) -> Column:
    """A first name (nominative) in a case: in -а, -я, -ия, a consonant, -й and -ь. Other names, and feminine ones in a consonant, stay."""
    stem, last = F.substring(name, F.lit(1), F.length(name) - 1), F.substring(name, -1, 1)
    sibilant = stem.rlike("(?iu)[гкхжчшщ]$")
    a = F.concat(stem, F.when(sibilant & (case == "gen"), "и").otherwise(_ending(case, FIRST_A)))
    soft = F.when(gender == "f", F.concat(stem, _ending(case, SOFT_FEM))).otherwise(F.concat(stem, _ending(case, SOFT_MASC, last)))
    hard = F.when(gender == "f", name).otherwise(F.concat(name, _ending(case, HARD_MASC)))
    return (
        F.when(name.rlike("(?iu)ия$"), F.concat(stem, _ending(case, FIRST_IYA))).when(last == "я", F.concat(stem, _ending(case, FIRST_YA))).when(last == "а", a)
        .when(last == "й", F.when(gender == "f", name).otherwise(F.concat(stem, _ending(case, SOFT_MASC, last)))).when(last == "ь", soft).when(last.rlike("(?iu)[бвгджзклмнпрстфхцчшщ]"), hard).otherwise(name)
    )


def decline_family(base: Column, gender: Column, case: Column) -> Column:
    """A surname given in the masculine nominative, of any kind: in -ов and the like (decline_surname), adjectival in -ский and -цкий, in a consonant, -й or -ь (feminine ones stay); others stay."""
    stem = F.substring(base, F.lit(1), F.length(base) - 2)
    adjective = F.concat(stem, F.when(gender == "f", _ending(case, ADJECTIVE_FEM)).otherwise(_ending(case, ADJECTIVE_MASC)))
    consonant = base.rlike("(?iu)[бвгджзйклмнпрстфхцчшщь]$")
    return (
        F.when(base.rlike("(?iu)(ов|ев|ёв|ин|ын)$"), decline_surname(base, gender, case)).when(base.rlike("(?iu)(ск|цк)ий$"), adjective)
        .when(consonant, F.when(gender == "f", base).otherwise(decline_given(base, F.lit("m"), case))).otherwise(base)
    )
