"""One consistent form for text that looks the same but is written with different characters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from veilframe.session import written

#: Letters of two scripts that look the same (Latin, Cyrillic).
LATIN_CYRILLIC = (
    "aа", "cс", "eе", "iі", "jј", "oо", "pр", "sѕ", "xх", "yу", "hһ", "dԁ", "qԛ", "wԝ", "ëё", "ïї",
    "AА", "BВ", "CС", "EЕ", "HН", "IІ", "JЈ", "KК", "MМ", "OО", "PР", "SЅ", "TТ", "XХ", "YУ", "ËЁ", "ÏЇ",
)
#: Greek letters, and the Latin letters that look the same.
GREEK_LATIN = ("οo", "νv", "ΑA", "ΒB", "ΕE", "ΖZ", "ΗH", "ΙI", "ΚK", "ΜM", "ΝN", "ΟO", "ΡP", "ΤT", "ΥY", "ΧX")

_TO_CYRILLIC = {p[0]: p[1] for p in LATIN_CYRILLIC}
_TO_LATIN = {p[1]: p[0] for p in LATIN_CYRILLIC}
_GREEK_TO_LATIN = {p[0]: p[1] for p in GREEK_LATIN}
_LATIN_TO_GREEK = {p[1]: p[0] for p in GREEK_LATIN}
_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)
_ZWJ = "\u200d"


def _script(c: str) -> str:
    n = ord(c)
    if c.isascii():
        return "Latin" if c.isalpha() else ""
    if 0x370 <= n <= 0x3FF or 0x1F00 <= n <= 0x1FFF:
        return "Greek"
    if 0x400 <= n <= 0x52F or 0x1C80 <= n <= 0x1C8F or 0x2DE0 <= n <= 0x2DFF or 0xA640 <= n <= 0xA69F:
        return "Cyrillic"
    if unicodedata.category(c)[0] != "L":
        return ""
    return unicodedata.name(c, "OTHER ").split(" ")[0].capitalize()


def _forms() -> dict[str, dict[str, str]]:
    """For each look-alike letter, its spelling by script."""
    out: dict[str, dict[str, str]] = {}
    for latin, cyr in LATIN_CYRILLIC:
        out[latin] = {"Latin": latin, "Cyrillic": cyr}
    for greek, latin in GREEK_LATIN:
        out.setdefault(latin, {"Latin": latin})["Greek"] = greek
    for forms in list(out.values()):
        for c in forms.values():
            out[c] = forms
    return out


_FORMS = _forms()


def _base_table() -> dict[int, str | None]:
    """Invisible characters removed, spaces made one space, wide and narrow forms made ordinary."""
    t: dict[int, str | None] = {}
    for n in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFEFF, 0xFFA0):
        t[n] = None
    for a, b in ((0x202A, 0x202F), (0x2066, 0x2070), (0xFE00, 0xFE10), (0xE0100, 0xE01F0)):
        t |= dict.fromkeys(range(a, b))
    for n in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        t[n] = " "
    for n in (0x2010, 0x2011):
        t[n] = "-"
    for n in (*range(0xFF01, 0xFFBF), *range(0xFFE0, 0xFFEF)):
        d = unicodedata.decomposition(chr(n))
        if d.startswith(("<wide>", "<narrow>")):
            t[n] = "".join(chr(int(x, 16)) for x in d.split()[1:])
    return t


_BASE = _base_table()
_JOINER = re.compile("(?<![←-⯿\U0001f000-\U0001faff])‍|‍(?![←-⯿\U0001f000-\U0001faff])")


@lru_cache(maxsize=200_000)
def _resolve(token: str) -> tuple[str, frozenset[str], bool]:
    """The scripts in which the whole token can be spelled, and whether it has letters of several scripts.

    The script set of a letter is its own script and those with a letter of the same look; the sets
    are intersected over the token. Digits and letters without a script don't narrow it.
    """
    common: frozenset[str] | None = None
    own = set()
    for c in token:
        s = _script(c)
        if not s:
            continue
        own.add(s)
        here = frozenset(_FORMS[c]) if c in _FORMS else frozenset((s,))
        common = here if common is None else common & here
    return token, common or frozenset(), len(own) > 1


def _spell(token: str, script: str) -> str:
    return "".join(_FORMS[c].get(script, _FORMS[c]["Latin"]) if c in _FORMS else c for c in token)


@lru_cache(maxsize=200_000)
def _fixed_spelling(token: str) -> tuple[str | None, str]:
    """The spelling of a token that one script settles (or None), and its script."""
    _, scripts, mixed = _resolve(token)
    letters = [c for c in token if _script(c)]
    if not letters:
        return token, ""
    if len(scripts) == 1:
        s = next(iter(scripts))
        return _spell(token, s), s
    if not scripts and mixed:
        # No script spells all of it: each look-alike takes the script of the settled letter before it, else after it.
        settled = [next(iter(_FORMS[c])) if c in _FORMS and len(_FORMS[c]) == 1 else (_script(c) if c not in _FORMS else "") for c in token]
        out, last = [], next((s for s in settled if s), "Latin")
        for c, s in zip(token, settled):
            last = s or last
            out.append(_FORMS[c].get(last, _FORMS[c]["Latin"]) if c in _FORMS else c)
        return "".join(out), ""
    if not scripts:
        return token, ""
    return None, ""  # a whole-script confusable


#: Characters that _base_table changes, or that composition may change.
_CHANGED = re.compile("[" + "".join(re.escape(chr(n)) for n in sorted(_BASE) if n < 0xFE00) + "\u0300-\u036f\u1100-\u11ff\ufe00-\uffef\U000e0100-\U000e01ef]")
#: What a text has none of if it stays as it is: other letters than Cyrillic ones, and Cyrillic letters beside digits.
_OPEN = re.compile(r"[^\x00-@\[-`{-~\xab\xbb\u0400-\u045f\u2013\u2014\u2116\u2026\u20bd]|[\u0400-\u045f][0-9]|[0-9][\u0400-\u045f]")


#: A letter that only one script can spell; a text of one script with such a letter stays as it is.
_SETTLED = re.compile("[" + "".join(c for c in map(chr, (*range(65, 91), *range(97, 123), *range(0x400, 0x460))) if c.isalpha() and len(_FORMS.get(c, {})) < 2) + "]")
_LETTER = re.compile(r"[^\W\d_]")


#: Letters that Cyrillic and Latin share, and what a text has none of if only a vote of its tokens could change it.
_SHARED = "".join(sorted(c for c in _FORMS if c.isascii()))
_STRANGE = re.compile(r"[^\x00-\x7f\xab\xbb\u0400-\u045f\u2013\u2014\u2116\u2026\u20bd]")
_MIXED = re.compile(rf"[A-Za-z0-9][\u0400-\u045f]|[\u0400-\u045f][A-Za-z0-9]|(?<![A-Za-z0-9])[{_SHARED}]+(?![A-Za-z0-9])")
_LATIN_RUN = re.compile(r"[A-Za-z]+")
_CYRILLIC_RUN = re.compile("[\u0400-\u045f]*[" + "".join(c for c in map(chr, range(0x400, 0x460)) if c.isalpha() and len(_FORMS.get(c, {})) < 2) + "][\u0400-\u045f]*")


def consistent_form(text: str | None) -> str | None:
    """The form in which texts of the same look are equal.

    Null stays null and the empty text empty. Letter case, punctuation, the number of spaces and
    the letter ё are kept: they are visible. Invisible characters go (a joiner inside an emoji
    sequence is kept), spaces of any width become spaces, wide and narrow forms become ordinary
    ones and accents are composed. Each token is then spelled in the only script that can spell
    it. A token that two scripts can spell (a whole-script confusable) takes Latin if it has digits, as
    codes do, else the script of most settled tokens of the text, Cyrillic on a tie; this depends
    on the look alone, so equal looks give equal forms. Idempotent.
    """
    if text is None or ((text.isascii() or not _OPEN.search(text)) and (_SETTLED.search(text) or not _LETTER.search(text))):
        return text
    # Plain Cyrillic with Latin words and codes, each in one script, and no fewer Cyrillic words than Latin ones: the usual text.
    if not _STRANGE.search(text) and not _MIXED.search(text) and len(_LATIN_RUN.findall(text)) <= len(_CYRILLIC_RUN.findall(text)):
        return text
    t = text
    if _CHANGED.search(t):
        t = t.translate(_BASE)
    if _ZWJ in t:
        t = _JOINER.sub("", t)
    t = unicodedata.normalize("NFC", t)
    votes = {"Cyrillic": 0, "Latin": 0}
    spans, open_ = [], False
    for m in _TOKEN.finditer(t):
        tok = m.group()
        new, s = _fixed_spelling(tok)
        if s in votes:
            votes[s] += 1
        open_ |= new is None
        spans.append((m.start(), m.end(), tok, new))
    main = "Latin" if votes["Latin"] > votes["Cyrillic"] else "Cyrillic"
    out, at = [], 0
    for a, b, tok, new in spans:
        if new is None:
            new = _spell(tok, "Latin" if any(c.isdigit() for c in tok) else main)
        if new != tok:
            out += [t[at:a], new]
            at = b
    return unicodedata.normalize("NFC", "".join([*out, t[at:]])) if out else t


_ACCENT = re.compile("[\u0300-\u036f]")


def fold_text(text: str | None) -> str:
    """consistent_form with compatibility forms resolved, lower case and without loose accents: for comparing words."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKC", consistent_form(text) or "").lower()
    return unicodedata.normalize("NFC", "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Me", "Cf"))) if not t.isprintable() or _ACCENT.search(t) else t


@F.pandas_udf(T.StringType())
def consistent(s: pd.Series) -> pd.Series:
    return s.map(consistent_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def normalize_lookalikes(df: DataFrame, column: str, out: str = "consistent") -> DataFrame:
    """Adds the consistent form of a text column. Any other columns stay; `out` replaces a column of that name."""
    return df.withColumn(out, consistent(F.col(column)))


def lookalike_pairs(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Pairs (id_a, id_b), smaller first, of rows whose texts look the same but differ in characters.

    Texts without anything visible look like nothing and are no case, nor are nulls. Equal strings are
    no pair. Rows with one id and one text count once. The groups are reduced to those with more
    than one spelling by minimum and maximum (map-side) before any row is joined, so frequent texts
    with one spelling never meet; spellings are joined as distinct texts, and rows only to the pairs
    of spellings.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("raw")).filter("id is not null and raw is not null")
    rows = rows.withColumn("form", consistent("raw")).filter(F.col("form").rlike(r"[^\s]"))
    # Written, so that the forms are computed once for both uses.
    rows = rows.select("id", F.xxhash64("raw").alias("raw_h"), F.xxhash64(F.lit(1), F.col("raw")).alias("raw_g"), F.md5("form").alias("form_h"))
    rows = written(rows, "forms")
    keys = rows.groupBy("form_h").agg(F.min("raw_h").alias("lo"), F.max("raw_h").alias("hi"), F.min("raw_g").alias("lo2"), F.max("raw_g").alias("hi2"))
    keys = keys.filter("lo <> hi or lo2 <> hi2").select("form_h")
    near = written(rows.join(keys, "form_h", "left_semi").distinct(), "near")
    # Distinct spellings are paired, and only then the rows of each.
    spelling = near.select("form_h", "raw_h", "raw_g").distinct()
    a = spelling.select("form_h", F.col("raw_h").alias("ra"), F.col("raw_g").alias("ga"))
    b = spelling.select("form_h", F.col("raw_h").alias("rb"), F.col("raw_g").alias("gb"))
    pairs = a.join(b, "form_h").filter("ra < rb or (ra = rb and ga < gb)")
    out = pairs.join(near.select("form_h", F.col("raw_h").alias("ra"), F.col("raw_g").alias("ga"), F.col("id").alias("x")), ["form_h", "ra", "ga"])
    out = out.join(near.select("form_h", F.col("raw_h").alias("rb"), F.col("raw_g").alias("gb"), F.col("id").alias("y")), ["form_h", "rb", "gb"])
    return out.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
