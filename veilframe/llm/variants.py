"""Variants of labelled records, made by rule: what the records lack, but the task defines.

Everything is put together from the clauses and values of labelled records and from general facts (cue words of a kind, ways to write
dates, numbers and addresses); no sentence of any table that is to be searched is used.
"""

from __future__ import annotations

import random
import re

Example = tuple[str, list[tuple[int, int, str]]]

#: Cues before and after a date of birth.
BIRTH_BEFORE = ("дата рождения", "дата рождения:", "родился", "родилась", "рождён", "д.р.", "год рождения", "born", "born on", "date of birth", "geboren am", "Geburtsdatum", "дата народження", "народився", "народилась")
BIRTH_AFTER = ("г.р.", "года рождения", "г. рождения", "р. н.")
#: Words before a date that is no birth.
DATE_BEFORE = ("от", "до", "с", "на", "к", "после", "перенесено на", "срок", "by", "until", "since", "on", "from", "bis", "am", "vom", "seit", "від", "до", "з", "")
#: Kinds of numbers that are no personal data.
OTHER_KINDS = (
    "договор", "договору", "договора", "договоре", "заказ", "заказа", "заказу", "заказе", "счёт", "счёта", "счёту", "чек", "чеку", "чеке", "заявка", "заявки", "заявке", "заявку", "тикет", "тикета", "обращение", "обращения", "обращению",
    "артикул", "артикулу", "трек-номер", "накладная", "квитанция", "полис", "лицевой счёт", "номер заказа", "номер договора", "номер заявки", "контракт", "акт", "акту", "справка", "счёт-фактура",
    "order", "invoice", "ticket", "contract", "case", "reference", "Bestellung", "Rechnung", "Vertrag", "Vorgang", "замовлення", "договір", "рахунок", "звернення",
)
#: Cues of each kind of number, before it.
CUED = {
    "INN": ("ИНН", "инн", "ИНН:", "инн:", "ИНН плательщика", "мой ИНН", "ІПН"),
    "SNILS": ("СНИЛС", "снилс", "снилс:", "СНИЛС:", "мой снилс", "страховой номер"),
    "PASSPORT": ("паспорт", "Паспорт", "паспорт:", "мой паспорт", "паспорт РФ", "паспортные данные", "passport"),
    "CREDIT_CARD": ("карта", "карту", "карты", "на карту", "карта:", "номер карты", "card", "my card", "Karte", "картка"),
    "PHONE_NUMBER": ("телефон", "тел.", "тел", "тел:", "тел.:", "номер", "мой номер", "звоните", "перезвоните на", "phone", "call", "please call", "Telefon", "телефон:", "контактный номер", "моб."),
    "EMAIL_ADDRESS": ("почта", "email", "e-mail", "мой email", "почту", "пишите на", "на", "email:", "mail", "E-Mail", "пошта"),
    "ADDRESS": ("адрес", "адрес:", "по адресу", "адресу", "доставка", "доставьте", "живу", "address", "my address is", "address is", "deliver to", "ship to", "Adresse", "Adresse ist", "адреса"),
}
#: What stands before or after a person's name, in the languages of the chats.
NAME_BEFORE = ("меня зовут", "это", "получатель", "получатель:", "заявитель", "клиент", "оператор", "менеджер", "специалист", "с вами", "от", "для", "передайте", "ответственный", "контакт", "с уважением,", "my name is", "this is", "I am", "ich heiße", "mein Name ist", "мене звати", "Frau", "Herr", "Mr.", "господин", "госпожа", "уважаемый", "фамилия", "")
NAME_AFTER = (", добрый день", ", здравствуйте", ", ваш запрос принят", " ответит", " звонил", " звонила", " просит перезвонить", " на связи", " ждёт", "", "", "?", ".", "!")
#: What a capitalised or quoted word after it is the name of, but no person.
FIRMS = ("магазин", "магазина", "магазине", "ООО", "АО", "ПАО", "ИП-сеть", "компания", "компании", "фирма", "бренд", "бренда", "марка", "марки", "тариф", "тарифу", "тарифа", "книга", "книги", "роман", "фильм", "альбом", "отдел", "группа", "группу", "товар", "модель", "кафе", "салон", "аптека", "shop", "brand", "store", "Firma", "крамниця", "сервис", "сервиса", "поставщик", "поставщика", "приложения", "приложении", "товары", "товара", "товаров", "фирмы", "книгу", "склад", "город", "города", "городе", "пункт", "приложение", "телефон", "смартфон", "ноутбук", "принтер", "пылесос", "холодильник", "phone", "laptop")
#: Polite phrases without a name.
PHRASES = ("Добрый день", "Здравствуйте", "Спасибо большое", "Good morning", "Kind regards", "Dear Sir or Madam", "Guten Tag", "Guten Morgen", "Vielen Dank", "Mit freundlichen Grüßen", "Доброго дня", "Дякую", "Hello", "Hi there", "Thank you")
#: Common words of the other languages of the chats.
COMMON = {
    "en": "the a of and in to is was has have had been not for with since at by from my your our it this that again last week yet why when where still please any because more than again after before".split(),
    "de": "der die das und in zu ist war hat haben nicht für mit seit von mein Ihre es dieser noch wann wo warum bitte wieder nach vor mehr als bei auf den dem ein eine keine".split(),
    "uk": "і в на що не є був була з за від моя ваша це ще знову чому коли де будь ласка після до більше ніж для але або та вже".split(),
}
_MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
_STREETS = ("Street", "St.", "Avenue", "Ave.", "Lane", "Road", "Rd.", "Square", "Drive")
_UNITS = ("flat", "apt", "apt.", "apartment", "suite", "unit")
_MONEY = ("руб.", "рублей", "р", "р.", "₽", "EUR", "$", "грн", "UAH")
_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".split()))


def latin(text: str) -> str:
    """A Cyrillic name in Latin letters, by the usual table."""
    return "".join((_LATIN[c.lower()].replace("_", "").capitalize() if c.isupper() else _LATIN[c.lower()].replace("_", "")) if c.lower() in _LATIN else c for c in text)


class Text:
    """A text put together piece by piece, with the spans of its entities."""

    def __init__(self) -> None:
        self.text, self.spans = "", []

    def add(self, piece: str, spans: list[tuple[int, int, str]] = (), glue: str = " ") -> Text:  # noqa: B006
        if piece:
            if self.text and not self.text[-1].isspace():
                self.text += glue
            n = len(self.text)
            self.text += piece
            self.spans += [(a + n, b + n, t) for a, b, t in spans]
        return self

    def entity(self, value: str, kind: str, glue: str = " ") -> Text:
        return self.add(value, [(0, len(value), kind)], glue)

    def done(self) -> Example:
        return self.text, self.spans


def clauses(example: Example) -> list[Example]:
    """The stretches of a text between marks of punctuation outside its entities."""
    text, spans = example
    cuts = [m.start() for m in re.finditer(r"[.;,!?:](?=\s|$)", text) if not any(a <= m.start() < b for a, b, _ in spans)]
    out, at = [], 0
    for c in [*cuts, len(text)]:
        a = at + len(text[at:c]) - len(text[at:c].lstrip())
        if a < c:
            out.append((text[a:c], [(x - a, y - a, t) for x, y, t in spans if a <= x and y <= c]))
        at = c + 1
    return out


def a_date(r: random.Random, born: bool) -> str:
    y = r.randint(1935, 2007) if born or r.random() < 0.12 else r.randint(2005, 2032)
    d, m = r.randint(1, 28), r.randint(1, 12)
    return r.choice((f"{d:02}.{m:02}.{y}",) * 4 + (f"{d:02}/{m:02}/{y}", f"{d:02}-{m:02}-{y}", f"{y}-{m:02}-{d:02}", f"{d} {_MONTHS[m - 1]} {y}", f"{d} {_MONTHS[m - 1]} {y} года", f"{d} {_MONTHS[m - 1]} {y} г.", f"{d}.{m:02}.{y}"))


def a_number(r: random.Random) -> str:
    """A number of an order, contract or the like, in any grouping."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    head = str(r.randint(1, 9))
    form = r.choice((6, 7, 7, 8, 9, 10, 10, 10, 11, 12, 12, "226", "46", "3322", "3332", "44", "code"))
    if isinstance(form, int):
        return head + digits(form - 1)
    if form == "code":
        return "".join(r.choice("ABCDEFGHKLMNRSTXZ") for _ in range(2)) + digits(r.randint(4, 8))
    sep = r.choice(" -")
    return sep.join(digits(int(n)) if i else head + digits(int(n) - 1) for i, n in enumerate(form))


def an_address(r: random.Random, word: str) -> str:
    """An address as written in English, German or Ukrainian; word: the name of the street."""
    w = latin(word).capitalize()
    n, k = r.randint(1, 990), r.randint(1, 400)
    return r.choice((
        f"{n} {w} {r.choice(_STREETS)}, {r.choice(_UNITS)} {k}", f"{n} {w} {r.choice(_STREETS)}", f"{w}straße {n}", f"{w}str. {n}, Wohnung {k}",
        f"вул. {word.capitalize()}ська, буд. {n}, кв. {k}", f"вул. {word.capitalize()}ська {n}",
    ))


def variants(examples: list[Example], n: int, seed: int = 11) -> list[Example]:
    """About n variants of the labelled examples, the same each time."""
    r = random.Random(seed)
    values: dict[str, list[str]] = {}
    plain, cued = [], []
    for e in examples:
        for a, b, t in e[1]:
            values.setdefault(t, []).append(e[0][a:b])
        for c in clauses(e):
            (cued if c[1] else plain).append(c)
    if not plain or not values:
        return []
    persons = sorted(set(values.get("PERSON", ())))
    full = [p for p in persons if " " in p.strip()]
    given = sorted({w.capitalize() for p in full for w in re.findall(r"[^\W\d_]{4,}", p) if not re.search(r"(?:ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына|ой|ым|вич|вна|вны|ну|ым|ому)$", w.lower())})
    surnames = sorted({w for p in full for w in re.findall(r"[^\W\d_]{4,}(?:ов|ев|ин|ова|ева|ина)\b", p) if w[0].isupper() and not w.isupper()})
    low = sorted({w for t, _ in plain for w in re.findall(r"\b[^\W\d_A-Z]{2,}\b", t) if w.islower()})
    odd = sorted({w for t, _ in plain for w in re.findall(r"\b[^\W\d_]{4,}\b", t)[1:] if w[0].isupper()}) or ["Вектор"]

    def clause() -> Example:
        return r.choice(plain)

    def words(lo: int, hi: int) -> str:
        return " ".join(r.choice(low) for _ in range(r.randint(lo, hi))) if low else ""

    def value(kind: str) -> str | None:
        return r.choice(values[kind]) if values.get(kind) else None

    def person() -> str:
        p = r.choice(persons)
        part = bool(full) and r.random() < 0.2
        if part:
            p = r.choice(surnames) if surnames and r.random() < 0.5 else r.choice(re.findall(r"[^\W\d_]{4,}", r.choice(full)) or [p])
            p = p.capitalize()
        if not part and " " in p and r.random() < 0.18:
            p = latin(p).title()
        if r.random() < 0.08 and len(p.split()) == 2 and "." not in p:
            p = ", ".join(reversed(p.split()))
        return p

    def money() -> str:
        n = r.randint(10, 99999)
        return f"{n // 1000} {n % 1000:03} {r.choice(_MONEY)}" if n > 999 and r.random() < 0.5 else f"{n} {r.choice(_MONEY)}"

    def around(t: Text) -> Example:
        """Other clauses before and after, at times."""
        out = Text()
        if r.random() < 0.4:
            out.add(clause()[0] + r.choice(".,;?!"))
        out.add(*t.done())
        if r.random() < 0.5:
            out.add(r.choice((".", ",", ";", "?", "!", " –", "")), glue="").add(clause()[0], glue=" ")
        if r.random() < 0.3:
            out.add(r.choice(".?!"), glue="")
        return out.done()

    def other_date() -> Example:
        t = Text().add(r.choice((clause()[0], f"{words(1, 3)} {r.choice(OTHER_KINDS)} {a_number(r)}", words(2, 5).capitalize())))
        t.add(r.choice(DATE_BEFORE)).add(a_date(r, False))
        return around(t.add(r.choice((words(1, 3), f"{r.choice(FIRMS)} {r.choice(odd)}", "", f"{r.choice(OTHER_KINDS)} {a_number(r)}"))))

    def recased(e: Example) -> Example:
        """At times in capitals or small letters throughout."""
        x = r.random()
        low_names = all(" " in e[0][a:b] for a, b, k in e[1] if k == "PERSON")  # a name of one word in small letters could be any word
        t = e[0].upper() if x < 0.05 else e[0].lower() if x < 0.1 and low_names else e[0]
        return (t, e[1]) if len(t) == len(e[0]) else e

    def value_then_date() -> Example:
        """Where an entity ends, if a date follows that is no birth."""
        k = r.choice(("ADDRESS", "ADDRESS", "PHONE_NUMBER", "EMAIL_ADDRESS"))
        t = Text().add(words(1, 4)).entity(value(k) or an_address(r, r.choice(odd)), k if value(k) else "ADDRESS")
        return around(t.add(r.choice(("", "", *DATE_BEFORE))).add(a_date(r, False)))

    def birth() -> Example:
        t = Text().add(r.choice((words(0, 2), "")))
        if r.random() < 0.3 and persons:
            t.entity(person(), "PERSON").add(r.choice((",", "")), glue="")
        if r.random() < 0.65:
            t.add(r.choice(BIRTH_BEFORE)).entity(a_date(r, True), "DATE_OF_BIRTH")
        else:
            if r.random() < 0.4 and value("PASSPORT"):
                t.add(r.choice(CUED["PASSPORT"])).entity(value("PASSPORT"), "PASSPORT").add(",", glue="")
            t.entity(a_date(r, True), "DATE_OF_BIRTH").add(r.choice(BIRTH_AFTER))
        return around(t.add(r.choice(("", f", {words(1, 4)}", f", {r.choice(OTHER_KINDS)} {a_number(r)}")), glue=""))

    def listed() -> Example:
        """Values in a row, as in a form: a person and what belongs to them."""
        t = Text().add(r.choice(("", "", "", "данные", "вот данные", "данные:", "записать", "мои данные:")))
        sep = r.choice((",", ",", ";", "", "", "\n"))
        kinds = r.sample([k for k in ("PHONE_NUMBER", "EMAIL_ADDRESS", "ADDRESS", "DATE_OF_BIRTH", "SNILS") if values.get(k)], k=min(r.randint(1, 3), sum(map(bool, values.values()))) if values else 0)
        for i, k in enumerate(["PERSON", *sorted(kinds, key=lambda k: (k != "DATE_OF_BIRTH", k != "SNILS", r.random()))]):
            while k == "SNILS" and "DATE_OF_BIRTH" not in kinds and re.fullmatch(r"[78]9\d{9}", v := value(k) or "") and r.random() < 0.98:
                pass  # after a name alone, such digits are a telephone
            v = v if k == "SNILS" and "DATE_OF_BIRTH" not in kinds else (person() if persons else "") if k == "PERSON" else a_date(r, True) if k == "DATE_OF_BIRTH" else value(k)
            if v:
                t.add(sep, glue="") if i else None
                if r.random() < 0.3 and k in CUED:
                    t.add(cue(k))
                t.entity(v, k)
        return t.done() if r.random() < 0.6 else around(t)

    def bare() -> Example:
        """A field with one value or two, or one that only looks like it."""
        k = r.choice(("PERSON", "PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS", "ADDRESS", "none", "none"))
        if k == "none":
            return Text().add(r.choice((f"{r.choice(FIRMS)} «{r.choice(odd)}»", f"{r.choice(FIRMS)} {r.choice(odd)}", f"{r.choice(PHRASES)}", f"доб. {r.randint(10, 999)}", words(1, 2).capitalize(), f"{words(1, 1)} {r.randint(1, 999)}", r.choice(odd)))).done()
        v = person() if k == "PERSON" and persons else value(k)
        t = Text()
        if not v:
            return clause()
        t.entity(v, k)
        if r.random() < 0.3:
            k2 = r.choice(("PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS"))
            v2 = person() if k2 == "PERSON" and persons else value(k2)
            if v2 and r.random() < 0.5:
                t.add(r.choice((",", ";", " /", ".", "")), glue="").entity(v2, k2)
            elif v2:
                t.add("(").entity(v2, k2, "").add(")", glue="")
        return t.done()

    def named() -> Example:
        """A name in any surroundings."""
        t = Text().add(r.choice((r.choice(NAME_BEFORE), r.choice(NAME_BEFORE), words(1, 3), f"{words(1, 2)} {r.choice(OTHER_KINDS)} {a_number(r)} {words(0, 1)}".strip())))
        if r.random() < 0.5 and t.text:
            t.text = t.text[:1].upper() + t.text[1:]
        t.entity(person(), "PERSON")
        if r.random() < 0.5:
            t.add(r.choice(NAME_AFTER), glue="")
        else:
            t.add(r.choice((",", "", ".", "?")), glue="").add(r.choice((clause()[0], words(1, 4), f"{r.choice(CUED['PHONE_NUMBER'])}")))
        return around(t)

    def cue(k: str) -> str:
        c = r.choice(CUED[k])
        return c if c[-1] in ":." or r.random() < 0.7 else c + ":"

    def cue_and_value() -> Example:
        k = r.choice([k for k in CUED if values.get(k)] or ["PERSON"])
        if k == "PERSON":
            return named()
        t = Text().add(r.choice((words(0, 2), ""))).add(cue(k))
        v = an_address(r, r.choice(odd)) if k == "ADDRESS" and r.random() < 0.35 else value(k)
        t.entity(v, k, "" if r.random() < (0.5 if t.text[-1:] == ":" else 0.08) else " ")
        k2 = r.choice([x for x in CUED if values.get(x)])
        if r.random() < 0.25:
            t.add(r.choice(("", "", "и", ","))).add(cue(k2))
            t.entity(value(k2), k2, "" if t.text[-1:] == ":" and r.random() < 0.5 else " ")
        return around(t.add(r.choice(("", f", {words(1, 3)}", f" {words(1, 3)}", f", {r.choice(OTHER_KINDS)} {a_number(r)}")), glue=""))

    def other_number() -> Example:
        """Numbers that are no documents, also where the word for a document is near."""
        t = Text()
        if r.random() < 0.3:
            t.add(r.choice(CUED[r.choice(("INN", "SNILS", "PASSPORT", "CREDIT_CARD", "PHONE_NUMBER"))])).add(words(1, 3))
        t.add(words(0, 2)).add(r.choice(OTHER_KINDS) + r.choice((" ", " ", " № ", " №", " N", " #")) + a_number(r))
        tail = r.choice((words(1, 4), f"{r.choice(CUED['PASSPORT'])} {words(1, 2)}", money(), f"{r.choice(low) if low else ''} {money()}", f"{r.randint(2, 40)} дней", f"в {r.randint(8, 21)}:{r.randint(10, 59)}", f"версия {r.randint(1, 30)}.{r.randint(1, 60)}", ""))
        return around(t.add(tail))

    def amount() -> Example:
        return around(Text().add(words(0, 3)).add(money()).add(r.choice((words(1, 3), f"{words(1, 1)} {r.choice(odd)}", ""))))

    def goods() -> Example:
        """Capitalised words that are no names, in any surroundings."""
        w = r.choice(odd) if r.random() < 0.5 else f"{r.choice(odd)} {r.choice(odd)}"
        t = Text().add(r.choice((words(1, 3), words(1, 3).capitalize(), f"{words(1, 2)} {r.choice(OTHER_KINDS)} {a_number(r)}", words(1, 1))))
        return around(t.add(r.choice((w, w, f"{w},", f"«{w}»"))).add(r.choice((words(1, 4), f"{r.choice(OTHER_KINDS)} {a_number(r)}", money(), ""))))

    def firm() -> Example:
        """Names of firms, towns, books and goods, even when they are given names."""
        w = r.choice(given) if given and r.random() < 0.5 else r.choice(surnames) if surnames and r.random() < 0.4 else r.choice(odd)
        two = f" и {r.choice(given or odd)}" if r.random() < 0.15 else ""
        quoted = r.choice(("«{}»", "«{}»", "\"{}\"")).format(w + two)
        t = Text().add(words(0, 2))
        head = r.choice(FIRMS)
        return around(t.add(f"{head if t.text or r.random() < 0.3 else head[:1].upper() + head[1:]} {quoted if r.random() < 0.75 or w in given else w}").add(words(1, 4)))

    def again() -> Example:
        """One name more than once in a text, far apart: what the links between like words are learnt from."""
        p = person()
        t = Text().add(r.choice(NAME_BEFORE)).entity(p, "PERSON").add(",", glue="").add(clause()[0]).add(".", glue="")
        if r.random() < 0.5:
            t.add(clause()[0]).add(".", glue="")
        return t.add(words(1, 2).capitalize()).entity(p, "PERSON").add(words(0, 2)).done()

    def foreign() -> Example:
        """Other languages, and in them what is no person: firms, towns and goods."""
        lang = r.choice(sorted(COMMON))
        some = lambda lo, hi: " ".join(r.choice(COMMON[lang]) for _ in range(r.randint(lo, hi)))
        w = r.choice(odd) if lang == "uk" else latin(r.choice(odd)).capitalize()
        t = Text().add(r.choice((some(1, 4).capitalize(), f"{r.choice(PHRASES)}, {some(1, 3)}", f"{r.choice(OTHER_KINDS).capitalize()} {a_number(r)} {some(0, 2)}")))
        t.add(w).add(some(1, 4)).add(r.choice(("", "", f"{r.choice(OTHER_KINDS)} {a_number(r)}", money(), f"{r.choice(FIRMS)} {latin(r.choice(odd)).capitalize()}")))
        return around(t)

    rules = (other_date, other_date, value_then_date, birth, birth, listed, listed, bare, bare, named, named, named, cue_and_value, cue_and_value, cue_and_value, other_number, other_number, amount, firm, firm, goods, goods, goods, again, foreign, foreign)
    return [recased(rules[i % len(rules)]()) for i in range(n)]
