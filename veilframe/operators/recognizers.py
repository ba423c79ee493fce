"""Rule recognisers: patterns with score, group, digit counts, gate, check and context, run as native expressions.

Patterns are Java patterns, used with (?iu); digits are ASCII digits. Order in RECOGNIZERS settles ties of score, length and start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from veilframe.functions.checks import digit_count, is_inn, is_snils
from veilframe.operators.spans import empty_spans, find_spans, value_of

#: Score that a context word adds, the least score then, and the characters before a span that are looked at.
CONTEXT_GAIN, CONTEXT_LEAST, CONTEXT_WINDOW = 0.35, 0.4, 50
#: Whole texts longer than this aren't looked at by the request operators.
LONGEST_TEXT = 50_000


@dataclass(frozen=True)
class Recognizer:
    """One rule. group: the part of a match that is the entity. digits: allowed digit counts. gate: what the text must contain."""

    name: str
    entity: str
    patterns: tuple[tuple[str, float], ...]
    group: int = 0
    digits: tuple[int, ...] = ()
    gate: str = ""
    check: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    hint: str = ""

    def spans(self, text: Column) -> Column:
        found = [find_spans(text, f"(?iu){p}", self.entity, s, self.group) for p, s in self.patterns]
        out = found[0] if len(found) == 1 else F.concat(*found)
        if self.digits:
            out = F.filter(out, lambda s: digit_count(value_of(text, s)).isin(*self.digits))
        if self.check:
            # A right check raises the score to 1, a wrong one drops the span.
            out = F.transform(F.filter(out, lambda s: self.check(value_of(text, s))), lambda s: s.withField("score", F.lit(1.0)))
        if self.context:
            words = "(?iu)(" + "|".join(self.context) + ")"

            def lifted(s: Column) -> Column:
                begin = F.greatest(s["start_pos"] - CONTEXT_WINDOW, F.lit(0))
                near = F.substring(text, begin + 1, s["start_pos"] - begin).rlike(words)
                return s.withField("score", F.when(near, F.least(F.lit(1.0), F.greatest(s["score"] + CONTEXT_GAIN, F.lit(CONTEXT_LEAST)))).otherwise(s["score"]))

            out = F.transform(out, lifted)
        cond = F.lit(True)
        for g in (self.hint, self.gate):
            if g:
                cond = cond & text.rlike(f"(?iu){g}")
        return F.when(cond, out).otherwise(empty_spans()) if self.hint or self.gate else F.coalesce(out, empty_spans())


_SEP = r"[\s().\-–]{0,3}"
_WORD = r"[\p{L}\p{N}_]"
_GAP = r"[^\p{L}\p{N}.!?]{0,6}"
_GAP2 = rf"(?:{_GAP}\p{{L}}+){{0,2}}{_GAP}"
_DIG = lambda n: rf"(?<![0-9]){n}(?![0-9])"
_MONTH = "(?:январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)[а-я]*"
_CAP = r"(?-i:[А-ЯЁ])[а-яё]+(?:-(?-i:[А-ЯЁ])[а-яё]+)?"
#: Words after a keyword that begin the name of another number.
_OTHER = r"(?!заказ|договор|трек|заявк|обращени|сч[её]т|артикул|накладн|тикет)"
_FAR = rf"(?:{_GAP}{_OTHER}\p{{L}}+){{0,5}}{_GAP}"
_STREET = r"(?<!\p{L})(?:ул(?:ица|ице|ицы|\.)?|пр(?:оспект[а-я]*|-т|осп\.|\.)|пер(?:еулок|еулке|\.)?|наб(?:ережная|ережной|\.)?|б-р|бульвар|шоссе|ш(?:\.|(?=\s))|проезд|площадь|пл\.|тупик|алл(?:ея|ее|\.))"
_STREET_LOW = r"(?<!\p{L})(?:ул(?:ица|ице|ицы|\.)?|пр(?:оспект|осп\.|\.)|пер(?:еулок|\.)|наб\.|б-р|бульвар|алл(?:ея|\.))"
_CITY = r"(?:(?<!\p{L})(?:г|гор|город|пос|посёлок|с|село|д|деревня)[.\s]\s*)?"
_UNIT = r"(?!\s*(?:раз|минут|час|дн[яейю]|день|недел|месяц|год|лет|руб|р\b|₽|%|шт|человек|тыс|процент|этаж|км|кг|июн|июл|янв|фев|мар|апр|ма[йя]|авг|сен|окт|ноя|дек))"
_NUMBER = r"[0-9]{1,4}(?:к[0-9]{1,3}|[а-я](?![\p{L}]))?(?:[/\-][0-9]{1,4})?(?![0-9])"
_HOUSE = rf"(?:(?:д(?:ом)?[.\s]?\s*)?{_NUMBER})"
_TAIL = r"(?:[,\s]{1,2}(?:к(?:орп(?:ус)?)?|стр(?:оение)?|под(?:ъезд)?|эт(?:аж)?|кв(?:артира)?|оф(?:ис)?|домофон)[.\s]?\s*[0-9]{1,4})*"
_INDEX = r"(?:[0-9]{6},?\s*)?"
#: Names of streets: with a number, a year or an ordinal before the word.
_NAME = rf"(?:[0-9]{{1,3}}(?:-?(?:я|й|ая|ый|летия))?\s+(?:лет\s+|летия\s+)?)?{_CAP}(?:\s{_CAP})?"
_ADJ = r"(?:ская|цкая|чная|ная|вая|тая|лая|рая|шая|жая|няя|кая|ский|цкий|ный|вый|чный|ский|ское|ное|вое)"
_MAILEND = r"[A-Za-zА-Яа-я]{2,}"
_PASS = r"[0-9]{2}[\s\-]?[0-9]{2}[\s\-№/]{0,4}[0-9]{3}\s?[0-9]{3}"
_IDCARD = r"(?:паспорт[а-я]*|удостоверени[а-я]+ личности)"
_TO_DOC = r"(?:(?!заказ|договор|трек|заявк)[^0-9]){0,60}"

RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer("rx_phone_plus7", "PHONE_NUMBER", ((rf"(?<![0-9])\+7{_SEP}[0-9]{{3}}{_SEP}[0-9]{{3}}{_SEP}[0-9]{{2}}{_SEP}[0-9]{{2}}(?![0-9])", 0.90),), hint=r"\+7"),
    Recognizer("rx_phone_8", "PHONE_NUMBER", ((rf"(?<![0-9+])8{_SEP}[0-9]{{3}}{_SEP}[0-9]{{3}}{_SEP}[0-9]{{2}}{_SEP}[0-9]{{2}}(?![0-9])", 0.85),), hint="8"),
    Recognizer("rx_phone_mobile_grouped", "PHONE_NUMBER", ((r"(?<![0-9+])9[0-9]{2}[\s.\-–)]{1,2}[0-9]{3}[\s.\-–]{1,3}[0-9]{2}[\s.\-–]{1,3}[0-9]{2}(?![0-9])", 0.60),), hint="9[0-9]{2}"),
    Recognizer("rx_phone_intl", "PHONE_NUMBER", ((r"(?<![0-9\p{L}])\+(?!7)[1-9][0-9]{0,2}(?:[\s().\-–]{0,2}[0-9]){7,12}(?![0-9])", 0.70),), hint=r"\+[1-9]"),
    Recognizer("rx_phone_mobile9", "PHONE_NUMBER", ((_DIG(r"(?<!\+)[78]9[0-9]{9}"), 0.60),), hint="[78]9[0-9]{9}"),
    Recognizer("rx_phone_bare", "PHONE_NUMBER", ((_DIG(r"(?<!\+)9[0-9]{9}"), 0.50),), hint="9[0-9]{9}"),
    Recognizer("rx_phone_anch", "PHONE_NUMBER", ((rf"(?<!\p{{L}})(?:тел(?:ефон[а-я]*)?|моб(?:ильный)?|номер телефона|звон[а-я]+|whatsapp|phone){_GAP2}(\+?[0-9](?:{_SEP}[0-9]){{9,10}})(?![0-9])", 0.75), (rf"(?<!\p{{L}})(?:тел(?:ефон[а-я]*)?|моб(?:ильн[а-я]+)?|звон[а-я]+|позвон[а-я]+|набер[а-я]+|контакт[а-я]*|связ[а-я]+){_FAR}(\+?[78](?:{_SEP}[0-9]){{10}})(?![0-9])", 0.75)), group=1, digits=(10, 11), hint="тел|моб|звон|набер|контакт|связ|whatsapp|phone"),
    Recognizer("rx_inn", "INN", ((_DIG("[0-9]{12}"), 0.5), (_DIG("[0-9]{10}"), 0.4)), check=is_inn, context=("инн", "налогоплательщик"), hint="[0-9]{10}"),
    Recognizer("rx_inn_anch", "INN", ((rf"(?:(?<!\p{{L}})инн|(?-i:ИНН)(?!\p{{L}})){_GAP2}([0-9](?:[\s.\-]?[0-9]){{9,11}})(?![0-9])", 0.90), (rf"(?<!\p{{L}})идентификационн[а-я]+ номер{_GAP2}([0-9](?:[\s.\-]?[0-9]){{9,11}})(?![0-9])", 0.90)), group=1, digits=(10, 12), hint="инн|идентификационн"),
    Recognizer("rx_snils", "SNILS", ((_DIG(r"[0-9]{3}-[0-9]{3}-[0-9]{3}[ \-][0-9]{2}"), 0.85), (_DIG("[0-9]{3} [0-9]{3} [0-9]{3} [0-9]{2}"), 0.80)), check=is_snils, context=("снилс", "страхов"), hint=r"[0-9]{3}[ \-][0-9]{3}"),
    Recognizer("rx_snils_anch", "SNILS", ((rf"(?:снилс|страхов[а-я]+ (?:номер|свидетельств[а-я]+)|пенсионн[а-я]+ (?:номер|страховани[а-я]+)){_GAP2}([0-9](?:[\s.\-–—]{{0,2}}[0-9]){{10}})(?![0-9])", 0.90),), group=1, digits=(11,), hint="снилс|страхов|пенсион"),
    Recognizer("rx_snils_grouped", "SNILS", ((_DIG(r"[0-9]{3}[\s.\-][0-9]{3}[\s.\-][0-9]{3}[\s.\-][0-9]{2}"), 0.60),), hint=r"[0-9]{3}[\s.\-][0-9]{3}"),
    Recognizer("rx_passport_word", "PASSPORT", ((_DIG(r"[0-9]{2}\s?[0-9]{2}\s?(?:номер|№)\s?[0-9]{3}\s?[0-9]{3}"), 0.70),), context=("паспорт", "серия", "серии"), hint="номер|№"),
    Recognizer("rx_passport_anch", "PASSPORT", ((rf"{_IDCARD}{_GAP2}({_PASS})(?![0-9])", 0.85), (rf"сери[яию]{_GAP}([0-9]{{2}}\s?[0-9]{{2}}[\s,]*(?:номер|№)[\s№]*[0-9]{{3}}\s?[0-9]{{3}})(?![0-9])", 0.85), (rf"сери[а-я]+ и номер[а-я]*{_GAP}({_PASS})(?![0-9])", 0.85), (rf"паспорт[а-я]*{_GAP}номер{_GAP}([0-9]{{6}}[\s,]*сери[яию][\s№]*[0-9]{{2}}\s?[0-9]{{2}})(?![0-9])", 0.85)), group=1, digits=(10,), hint="паспорт|сери|удостоверени"),
    Recognizer("rx_passport_doc", "PASSPORT", ((rf"{_IDCARD}{_TO_DOC}(?<![0-9])({_PASS})(?![0-9])", 0.60), (rf"{_IDCARD}{_TO_DOC}(?<![0-9]){_PASS}(?![0-9]){_TO_DOC}(?<![0-9])({_PASS})(?![0-9])", 0.60)), group=1, gate="паспорт|удостоверени"),
    Recognizer("rx_passport_num", "PASSPORT", ((r"паспорт.{0,40}?(?:номер|№)\s*([0-9]{3}\s?[0-9]{3})(?![0-9])", 0.60),), group=1, gate="паспорт"),
    Recognizer("rx_email", "EMAIL_ADDRESS", ((r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", 0.90),), hint="@"),
    Recognizer("rx_email_spaced", "EMAIL_ADDRESS", ((rf"[\w.+\-]+\s{{1,2}}@\s{{0,2}}[\w\-]+(?:\s{{0,2}}\.\s{{0,2}}[\w\-]+)*?\s{{0,2}}\.\s{{0,2}}{_MAILEND}", 0.86),), hint="@"),
    Recognizer("rx_email_obf", "EMAIL_ADDRESS", ((rf"(?:[a-z0-9.+\-_]+\s){{0,2}}[\w.+\-]+\s?(?:\(\s?(?:собака|at)\s?\)|\[(?:собака|at)\]|\sсобака\s|\sat\s)\s?[\w\-]+\s?(?:\(\s?(?:точка|dot)\s?\)|\[(?:точка|dot)\]|\sточка\s|\sdot\s)\s?{_MAILEND}", 0.85),), hint=r"собака|[\s(\[]at[\s)\]]"),
    Recognizer("rx_dob", "DATE_OF_BIRTH", ((_DIG(r"(?:0?[1-9]|[12][0-9]|3[01])[./\-](?:0?[1-9]|1[0-2])[./\-](?:19|20)[0-9]{2}"), 0.40),), context=("рожд", "родил", "д\\.р", "birth"), hint=r"[./\-](?:19|20)[0-9]{2}"),
    Recognizer("rx_dob_anch", "DATE_OF_BIRTH", ((rf"(?:дат[аыу] рожд[а-я]*|родил[а-я]+|г\.\s?р\.){_GAP2}([0-9]{{1,4}}[.\-/][0-9]{{1,2}}[.\-/][0-9]{{1,4}})(?![0-9])", 0.70), (rf"(?:дат[аыу] рожд[а-я]*|родил[а-я]+)(?:{_GAP}\p{{L}}+){{0,3}}{_GAP}([0-9]{{8}})(?![0-9])", 0.70)), group=1, digits=(6, 7, 8), hint="рожд|родил|г\\.\\s?р"),
    Recognizer("rx_dob_text", "DATE_OF_BIRTH", ((rf"(?:рожд[а-я]*|родил[а-я]+){_GAP2}([0-9]{{1,2}}\s+{_MONTH}\s+(?:19|20)[0-9]{{2}})(?![0-9])", 0.70), (rf"([0-9]{{1,2}}\s+{_MONTH}\s+(?:19|20)[0-9]{{2}})(?=\s*(?:г(?:ода?)?\.?\s*)?(?:г\.\s?р|рожд))", 0.70)), group=1, digits=(5, 6), hint="рожд|родил|г\\.\\s?р"),
    Recognizer("rx_card16", "CREDIT_CARD", ((_DIG(r"[0-9]{4}[ .\-]{0,2}[0-9]{4}[ .\-]{0,2}[0-9]{4}[ .\-]{0,2}[0-9]{4}"), 0.70), (_DIG(r"[0-9]{2}(?:[ \-][0-9]{2}){7}"), 0.55)), context=("карт", "card", "visa", "mastercard"), hint="[0-9]{4}|[0-9]{2}[ \\-][0-9]{2}"),
    Recognizer("rx_card_anch", "CREDIT_CARD", ((rf"(?:карт[аыеуо][а-я]*|card){_GAP2}([0-9](?:[\s.\-]{{0,2}}[0-9]){{11,18}})(?![0-9])", 0.80),), group=1, digits=tuple(range(12, 20)), hint="карт|card"),
    Recognizer("rx_card_masked", "CREDIT_CARD", ((r"(?<![0-9*])[0-9*•XХ]{4}(?:[ \-]?[0-9*•XХ]{4}){3}(?![0-9*])", 0.75),), digits=tuple(range(4, 13)), hint="[*•XХ]{4}"),
    Recognizer("rx_addr_marker", "ADDRESS", ((rf"{_INDEX}{_CITY}(?:{_CAP},?\s+)?{_STREET}\s*{_NAME},?\s*{_HOUSE}{_TAIL}", 0.95), (rf"{_STREET_LOW}\s*(?-i:[а-яё]{{4,}})\s+{_HOUSE}{_UNIT}{_TAIL}", 0.95)), hint="ул|пр|пер|наб|б-р|бульв|шоссе|ш|проезд|пл|тупик|алл"),
    Recognizer("rx_addr_reverse", "ADDRESS", ((rf"{_INDEX}(?:{_CITY}{_CAP},?\s+)?{_CAP}\s+{_STREET},?\s*{_HOUSE}{_TAIL}", 0.95),), hint="ул|пр|пер|наб|б-р|бульв|шоссе|проезд|пл|тупик|алл"),
    Recognizer("rx_addr_reverse_lower", "ADDRESS", ((rf"(?<!\p{{L}})(?-i:[а-яё]+(?:ая|ый|ой|ий))\s+{_STREET},?\s*{_HOUSE}{_TAIL}", 0.95),), hint="ая|ый|ой|ий"),
    Recognizer("rx_addr_lower_full", "ADDRESS", ((r"(?<!\p{L})(?:(?:город|г\.)\s*)?\p{L}{3,},?\s+(?:улица|ул\.?)\s*\p{L}+,?\s*(?:дом\s*)?[0-9]{1,4}[а-я]?,?\s*(?:квартира|кв\.?)\s*[0-9]{1,4}", 0.95), (rf"(?<!\p{{L}})\p{{L}}{{3,}},\s+[а-яё]+{_ADJ},?\s+(?:дом\s*)?{_NUMBER},?\s*(?:квартира|кв\.?)\s*[0-9]{{1,4}}", 0.95)), hint="кв"),
    Recognizer("rx_addr_bare", "ADDRESS", ((rf"(?<![\p{{L}}\p{{N}}\-])(?:[0-9]{{1,2}}-(?:я|й|ая|ый)\s)?(?!(?:Перв|Втор|Трет)[а-яё]+\s)(?-i:[А-ЯЁ])[а-яё]+{_ADJ},?\s+{_HOUSE}{_UNIT}(?![.,][0-9]){_TAIL}", 0.95), (rf"(?<![\p{{L}}\p{{N}}\-])(?-i:[А-ЯЁ])[а-яё]+[ья]я\s+[0-9]{{1,4}}к[0-9]{{1,3}}(?![0-9\p{{L}}]){_TAIL}", 0.95)), hint="[яйе],?\\s+[0-9д]"),
    Recognizer("rx_ip", "IP_ADDRESS", ((r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", 0.60),), hint=r"[0-9]\.[0-9]"),
    Recognizer("rx_url", "URL", ((r"https?://[^\s<>\"]+", 0.60),), hint="http"),
    Recognizer("rx_iban", "IBAN_CODE", ((r"(?<![A-Za-z0-9])(?-i:[A-Z]{2})[0-9]{2}(?-i:[A-Z0-9]{11,30})(?![A-Za-z0-9])", 0.50),), hint="[A-Z]{2}[0-9]{2}"),
    Recognizer("rx_crypto", "CRYPTO", ((r"(?<![A-Za-z0-9])(?-i:bc1[a-z0-9]{25,59}|0x[0-9a-fA-F]{40}|[13][1-9A-HJ-NP-Za-km-z]{25,34})(?![A-Za-z0-9])", 0.50),), hint="[A-Za-z0-9]{26}"),
    Recognizer("rx_date_time", "DATE_TIME", ((_DIG(r"(?:0?[1-9]|[12][0-9]|3[01])[./\-](?:0?[1-9]|1[0-2])[./\-](?:19|20)[0-9]{2}(?:\s[0-2]?[0-9]:[0-5][0-9])?"), 0.60), (_DIG(r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[T\s][0-2][0-9]:[0-5][0-9](?::[0-5][0-9])?)?"), 0.60)), hint=r"[./\-][0-9]{1,2}[./\-]"),
    Recognizer("rx_person_fio", "PERSON", ((r"(?-i:[А-ЯЁ][а-яё]+(?:ов|ев|ёв|ин|ын|ова|ева|ина|ский|ская)[а-яё]{0,2})\s(?-i:[А-ЯЁ][а-яё]+)\s(?-i:[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|ична))[а-яё]{0,2}", 0.90), (r"(?<!\p{L})(?-i:[А-ЯЁ][а-яё]+)\s(?-i:[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|ична))(?:[а-яё]{0,2})(?:\s(?-i:[А-ЯЁ][а-яё]+(?:ов|ев|ёв|ин|ын|ова|ева|ина|ский|ская)[а-яё]{0,2}))?", 0.90)), hint="ович|евич|овна|евна|ична"),
    Recognizer("rx_person_initials", "PERSON", ((r"(?<!\p{L})(?-i:[А-ЯЁ])\.\s?(?:(?-i:[А-ЯЁ])\.\s?)?(?-i:[А-ЯЁ][а-яё]+)", 0.85), (r"(?<!\p{L})(?-i:[А-ЯЁ][а-яё]+(?:ов|ев|ёв|ин|ын|ова|ева|ина|ский|ская)[а-яё]{0,2})\s(?-i:[А-ЯЁ])\.(?:\s?(?-i:[А-ЯЁ])\.)?", 0.85)), hint=r"\."),
)
BY_NAME = {r.name: r for r in RECOGNIZERS}


def detect(text: Column, names: tuple[str, ...] | None = None, extra: Column | None = None) -> Column:
    """All spans of the named recognisers (all by default), in their order; extra: spans of a model or another source, taken in last."""
    parts = [r.spans(text) for r in RECOGNIZERS if names is None or r.name in names]
    return F.coalesce(F.concat(*parts, *([extra] if extra is not None else [])), empty_spans())


def anchored(text: Column, keyword: str, entity: str, score: float, digits: tuple[int, ...], gate: str = "") -> Column:
    """Numbers with an allowed digit count up to two words after a keyword (a Java pattern); they don't cross a sentence end."""
    r = Recognizer("kw", entity, ((rf"(?<!\p{{L}})(?:{keyword}){_GAP2}([0-9](?:[\s.\-]{{0,2}}[0-9])*)", score),), group=1, digits=digits, gate=gate)
    return r.spans(text)
