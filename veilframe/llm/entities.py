"""Personal data in free text: a skip-chain CRF over word and number forms, fitted on labelled records, and typed placeholders."""

from __future__ import annotations

import gc
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilframe.llm import crf
from veilframe.llm.lookalikes import _BASE, consistent_form
from veilframe.llm.variants import variants

#: Labelled records that the model is fitted on, about, of each labelled table (those with the least hashes).
SAMPLE_RECORDS = 1200
#: Placeholder of each type.
PLACEHOLDERS = {
    "PERSON": "<PERSON>", "PHONE_NUMBER": "<PHONE>", "EMAIL_ADDRESS": "<EMAIL>", "INN": "<INN>", "SNILS": "<SNILS>",
    "PASSPORT": "<PASSPORT>", "DATE_OF_BIRTH": "<DATE_OF_BIRTH>", "CREDIT_CARD": "<CREDIT_CARD>", "ADDRESS": "<ADDRESS>",
}
LABELS = ["O", *[f"{p}-{t}" for t in sorted(PLACEHOLDERS) for p in "BI"]]
_N_FEATURES = 1 << 16
#: Rule-made variants for each labelled record of the sample.
VARIANTS = 3

_S = r"[ \t]"
_SEP = r"[ \t.()\-–—]{0,3}"
#: Shapes of numbers and addresses of mail; the name says the shape, not the meaning.
_MAIL = re.compile(
    rf"(?P<mail>[\w.+\-]+{_S}*(?:@|\((?:собака|[aа][tт])\)|\[(?:собака|[aа][tт])\]|\bсобака\b|\b[aа][tт]\b){_S}*[\w\-]+(?:{_S}*(?:\.|\((?:точка|dot)\)|\[(?:точка|dot)\]|\bточка\b|\bdot\b){_S}*[A-Za-zА-Яа-я\-]{{2,}})+)",
    re.IGNORECASE,
)
_MAIL_SIGN = re.compile(r"@|\bсобака\b|[(\[ ][aа][tт][)\] ]", re.IGNORECASE)  # a form in capitals may have come out in Cyrillic letters
_FORMS = re.compile(
    "(?=[0-9+])(?:" + "|".join((
        rf"(?P<card>(?<!\d)\d{{4}}(?P<cs>[ .\-]{{0,2}})\d{{4}}(?P=cs)\d{{4}}(?P=cs)\d{{4}}(?!\d))",
        rf"(?P<plus>\+{_S}?\d(?:{_SEP}\d){{9,13}}(?!\d))",
        r"(?P<date>(?<!\d)(?:\d{1,2}[./\-]\d{1,2}[./\-](?:19|20)\d\d|(?:19|20)\d\d-\d\d-\d\d|\d{1,2} (?:янв|фев|мар|апр|ма[йя]|июн|июл|авг|сен|окт|ноя|дек)[а-я]* (?:19|20)\d\d(?: ?г(?:\.|ода?)?)?)(?!\d))",
        r"(?P<g3332>(?<!\d)\d{3}[\-. ]\d{3}[\-. ]\d{3}[\-. ]\d{2}(?!\d))",
        rf"(?P<eight>(?<![\d+])[78](?:[ .\-–]?\(?[ ]?9\d\d[ ]?\)?)(?:{_SEP}\d){{7}}(?!\d))",
        r"(?P<g3322>(?<!\d)9\d{2}[ \-]\d{3}[ \-]\d\d[ \-]\d\d(?!\d))",
        r"(?P<pass>(?<!\d)(?:\d{4} ?№ ?\d{6}|\d\d \d\d ?№ ?\d{3} ?\d{3}|\d\d ?\d\d,? номер \d{3} ?\d{3})(?!\d))",
        r"(?P<g226>(?<!\d)\d\d \d\d \d{6}(?!\d))",
        r"(?P<g2268>(?<!\d)\d\d-\d\d-\d{6}(?:\d\d)?(?!\d))",
        r"(?P<g46>(?<!\d)\d{4}[ \-]\d{6}(?!\d))",
        r"(?P<g48>(?<!\d)\d{4} \d{8}(?!\d))",
        r"(?P<n>(?<![\d.,\-/:])[0-9]{5,}(?![0-9]))",
    )) + ")",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"(\s*)(\d+|[^\W\d_]+|[^\w\s]|_)")
_DIGITS = re.compile(r"\d.?\d")
#: Words that tell the kind of a number or name near them, by the kind.
_CUE_WORDS = {
    "inn": "инн іпн", "snils": "снилс", "passport": "паспорт паспорта паспорте паспортные passport серия серии серию",
    "card": "карта карту карты карте card karte картка картку", "phone": "телефон телефону тел моб phone call telefon звоните перезвоните позвоните номеру",
    "birth": "рождения родился родилась рожд рожден рождён born birth geboren geburtsdatum народження народився народилась р",
    "mail": "почта почту почте email mail пошта", "address": "адрес адресу адреса address adresse",
    "other": "договор договора договору договоре заказ заказа заказу заказе артикул артикула заявка заявки заявке заявку чек чека чеку чеке трек тикет тикета обращение обращения обращению счёт счёта счёту контракт квитанция полис накладная накладной накладную код акт ticket order invoice contract case bestellung rechnung vertrag vorgang замовлення договір рахунок звернення",
    "org": "магазин магазина магазине ооо ао пао компания компании фирма бренд бренда марка марки тариф тарифу тарифа отдел группа группу книга книги роман товар модель модели поставщик поставщика сервис сервиса приложение приложения приложении товары товара товаров фирмы книгу shop brand store firma крамниця крамниці аптека кафе салон",
    "town": "город городе города г пос село деревня склад склада пункт пункте місто міста",
    "street": "ул улица улице улицы пер переулок переулке наб набережная проспект пр просп шоссе площадь пл бульвар б street lane avenue road square drive straße str вул вулиця проезд тупик",
    "house": "дом д кв квартира оф офис корпус корп стр под эт flat apt apartment suite wohnung буд",
    "name": "зовут name получатель получателя заявитель клиент оператор менеджер специалист контакт фамилия фамилию ответственный heiße звати frau herr mr свяжитесь проверил",
}
CUES = {w: k for k, ws in _CUE_WORDS.items() for w in ws.split()}
_SUFFIX = (
    ("patr", re.compile(r"(?:ович|евич|ович[аеу]|евич[аеу]|овичем|евичем|овн[ауые]|евн[ауые]|овной|евной|инична)$")),
    ("fam", re.compile(r"(?:ов|ев|ёв|ин|ын)$")),
    ("famf", re.compile(r"(?:ова|ева|ёва|ина|ына)$")),
    ("famo", re.compile(r"(?:овым|евым|ёвым|иным|ыным|овой|евой|ёвой|иной|ыной|ову|еву|ину|ове|еве|ине)$")),
    ("adj", re.compile(r"(?:ая|ый|ий|ой|ое|ого|ую)$")),
    ("vl", re.compile(r"(?:вль|бор|горск|ецк|поль|ино|овка|ань|град|ville|stad|burg|mont|ford)$")),
)


def aligned_form(text: str) -> tuple[str, list[int] | None]:
    """consistent_form with, for each of its characters, the offset in the text it came from (null: the same offsets)."""
    new = consistent_form(text)
    if new == text:
        return text, None
    chars: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        for x in _BASE.get(ord(c), c) or "":
            chars.append(x)
            at.append(i)
    out: list[str] = []
    where: list[int] = []
    for c, i in zip(chars, at):
        if out and unicodedata.combining(c) and len(joined := unicodedata.normalize("NFC", out[-1] + c)) == 1:
            out[-1] = joined
        else:
            out.append(c)
            where.append(i)
    # The spelling by script changes letters one by one, so only its result must have the same length.
    spelled = consistent_form("".join(out)) or ""
    return (spelled, where) if len(spelled) == len(where) else ("".join(out), where)


def _word_class(w: str, known: frozenset[str], names: frozenset[str]) -> tuple[str, str, str]:
    low = w.lower()
    shape = "x" if w == low else "X" if len(w) == 1 else "XX" if w.isupper() else "Xx" if w[0].isupper() and w[1:] == low[1:] else "xX"
    suffix = next((n for n, p in _SUFFIX if len(low) > 3 and p.search(low)), "")
    script = "l" if low.isascii() else "c"
    return "@@" if low in names else low if low in known or low in CUES else "?", shape, suffix + script


class Lexicon(dict):
    """Token -> number of its class; `classes` has the classes by number, `ties` the key of a token by which like words are linked ('' for none)."""

    def __init__(self, known: frozenset[str], names: frozenset[str]):
        super().__init__()
        self.known, self.names = known, names
        self.classes: list[tuple[str, str, str, str, str]] = []
        self.numbers: dict[tuple, int] = {}
        self.ties = _Ties(self)

    def number(self, c: tuple) -> int:
        n = self.numbers.get(c)
        if n is None:
            n = self.numbers[c] = len(self.classes)
            self.classes.append(c)
        return n

    def __missing__(self, w: str) -> int:
        if w[0].isalpha():
            c = (*_word_class(w, self.known, self.names), "", "")
        elif w[0].isdigit():
            c = ("#", str(min(len(w), 7)), "", "", "")
        else:
            c = (w, "", "", "", "")
        n = self[w] = self.number(c)
        return n


class _Ties(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str) -> str:
        key = ""
        if len(w) >= 4 and self.lexicon.classes[self.lexicon[w]][0] in ("?", "@@"):
            key = w.lower()[: max(4, len(w) - 2)] if len(w) > 5 else w.lower()
        self[w] = key
        return key


@dataclass(frozen=True)
class Sentence:
    """Tokens with the white space before each, and for each the number of its class, twice, and one more after white space: all that the features look at."""

    gaps: tuple[str, ...]
    words: tuple[str, ...]
    classes: tuple[int, ...]

    @property
    def spans(self) -> list[tuple[int, int]]:
        ends = list(accumulate(map(len, chain.from_iterable(zip(self.gaps, self.words)))))
        return list(zip(ends[::2], ends[1::2]))


def _snils_digits(w: str) -> bool:
    """Whether the last two of eleven digits are the check digits of a SNILS."""
    return sum((9 - i) * int(c) for i, c in enumerate(w[:9])) % 101 % 100 == int(w[9:])


def analyse(text: str, lexicon: Lexicon) -> Sentence:
    """Tokens of a text in consistent form. Equal tuples of classes get equal labels (but for skip links)."""
    pairs = _TOKEN.findall(text)
    if not pairs:
        return Sentence((), (), ())
    gaps, words = zip(*pairs)
    cs = list(map(lexicon.__getitem__, words))
    hits = [(m.start(), m.end(), m.lastgroup) for m in _FORMS.finditer(text)] if _DIGITS.search(text) else []
    if _MAIL_SIGN.search(text):
        mails = [(m.start(), m.end(), "mail") for m in _MAIL.finditer(text)]
        hits = sorted(mails + [h for h in hits if not any(a < h[1] and h[0] < b for a, b, _ in mails)])
    if hits:
        ends = list(accumulate(map(len, chain.from_iterable(pairs))))
        starts, ends = ends[::2], ends[1::2]
        for lo, hi, form in hits:
            i = bisect_left(starts, lo)
            if form == "date":
                y = re.search(r"(?:19|20)\d\d", text[lo:hi])
                form = "date_old" if y and int(y.group()) < 2008 else "date_new"
            elif form == "n":
                w, n = text[lo:hi], hi - lo
                form = f"n{min(n, 20)}"
                if n == 11 and _snils_digits(w):
                    form += "s"
                elif n in (10, 11):
                    form += "p" if w[0] in "78" and w[1] == "9" or n == 10 and w[0] == "9" and w[1] not in "68" else ""
            pos = "B" if i < len(starts) and (starts[i] == lo or not i or ends[i - 1] <= lo) else "I"
            while i < len(starts) and starts[i] < hi:
                cs[i] = lexicon.number((*lexicon.classes[cs[i]][:3], form, pos))
                pos = "I"
                i += 1
    return Sentence(gaps, words, tuple([2 * c + 1 if g else 2 * c for c, g in zip(cs, gaps)]))


def _id(x: str, memo: dict[str, int] = {}) -> int:  # noqa: B006 - a table of few fixed strings
    if x not in memo:
        if len(memo) > 100_000:
            memo.clear()
        memo[x] = zlib.crc32(x.encode())
    return memo[x]


def _columns(s: Sentence, lexicon: Lexicon) -> list[tuple[int, ...]]:
    """Per token the numbers that features are made of: word, shape, suffix, form, place in it, gap, cues before and after, kind."""
    c = [lexicon.classes[x >> 1] for x in s.classes]
    n = len(c)
    last = [""] * n
    second = [""] * n
    after = [""] * n
    cues = [(i, q) for i, x in enumerate(c) if (q := CUES.get(x[0]))]
    for k, (i, q) in enumerate(cues):
        stop = cues[k + 1][0] if k + 1 < len(cues) else n - 1
        for j in range(i + 1, min(i + 9, stop, n - 1) + 1):
            last[j] = f"{q}{(j - i) // 3}"
        if k + 1 < len(cues):
            until = cues[k + 2][0] if k + 2 < len(cues) else n - 1
            for j in range(cues[k + 1][0] + 1, min(i + 9, until, n - 1) + 1):
                second[j] = q
    near = [(i, q) for i, q in cues if q in ("street", "house", "birth", "town")]
    for k, (i, q) in enumerate(near):
        for j in range(max(i - 8, near[k - 1][0] if k else 0, 0), i):
            after[j] = f"{q}{(i - j) // 3}"
    return [
        (_id(x[0]), _id(x[1] + "|"), _id(x[2] + "/"), _id(x[3]), _id(x[4] + "."), g & 1, _id(a), _id(b + "2"), _id(d + ">"), _id(x[0] if x[0] != "?" else x[1] + x[2]), 0 if x[0].isalpha() or x[0] in ("?", "@@", "#") else _id(x[0]))
        for x, g, a, b, d in zip(c, s.classes, last, second, after)
    ]


def features(sentences: list[Sentence], lexicon: Lexicon) -> list[np.ndarray]:
    """Hashed features of each token of each sentence, from the classes of the tokens around it only."""
    edge = (_id("^"), *[_id("")] * 10)
    rows: list[tuple[int, ...]] = [edge] * 3
    starts = []
    for s in sentences:
        starts.append(len(rows))
        rows += _columns(s, lexicon)
        rows += [edge] * 3
    m = np.array(rows, dtype=np.uint64)
    w, sh, su, fo, po, gap, la, l2, af, kind, sign = m.T

    def back(x: np.ndarray, k: int) -> np.ndarray:
        return np.roll(x, k)

    p1, p2, p3, n1, n2 = back(w, 1), back(w, 2), back(w, 3), back(w, -1), back(w, -2)
    look = sh * np.uint64(31) + su
    lp1, lp2, ln1 = back(look, 1), back(look, 2), back(look, -1)
    form = fo * np.uint64(31) + po
    groups = (
        (w,), (look,), (form,), (p1,), (n1,), (lp1, look), (ln1, look), (p2, p1), (n1, n2), (p1, w), (w, n1), (form, la), (fo, p1), (fo, p2), (la, kind), (af, kind), (af, la, sh),
        (lp1, look, ln1), (lp2, lp1, look), (look, n2), (p3, sh), (form, n1), (gap, back(sign, 1), sh), (back(sign, 1), su), (fo, l2), (fo, af, la), (la, af, form), (kind, la, l2),
    )
    out = np.empty((len(rows), len(groups)), dtype=np.int64)
    with np.errstate(over="ignore"):
        for k, parts in enumerate(groups):
            h = np.full(len(rows), k * 0x9E3779B1 + 1, dtype=np.uint64)
            for x in parts:
                h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, k] = (h % np.uint64(_N_FEATURES - 1)).astype(np.int64) + 1
    return [out[a : a + len(s.words)] for a, s in zip(starts, sentences)]


def skip_links(s: Sentence, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Pairs of distant tokens that are the same word, or a long word and its inflection: capitalised or name-like ones, each linked to the one before."""
    keys = list(map(lexicon.ties.__getitem__, s.words))
    named = list(filter(None, keys))
    if len(set(named)) == len(named):
        return []
    last: dict[str, int] = {}
    out = []
    for i, key in enumerate(keys):
        if key:
            if key in last and i - last[key] > 1:
                out.append((last[key], i))
            last[key] = i
    return out


def labels_of(s: Sentence, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(s.words), dtype=np.int64)
    places = s.spans
    for a, b, t in spans:
        inside = [i for i, (x, z) in enumerate(places) if x < b and z > a]
        for k, i in enumerate(inside):
            y[i] = LABELS.index(f"{'I' if k else 'B'}-{t}")
    return y


def spans_of(s: Sentence, y: np.ndarray) -> list[tuple[int, int, str]]:
    if not y.any():
        return []
    out: list[list] = []
    for (a, b), k in zip(s.spans, y):
        if k:
            lab = LABELS[k]
            if lab[0] == "I" and out and out[-1][2] == lab[2:] and out[-1][3]:
                out[-1][1] = b
            else:
                out.append([a, b, lab[2:], True])
        elif out:
            out[-1][3] = False
    return [(a, b, t) for a, b, t, _ in out]


@dataclass
class Tagger:
    model: crf.CRF
    known: frozenset[str]
    names: frozenset[str]
    lexicon: Lexicon | None = field(default=None, repr=False)
    cache: dict[tuple, np.ndarray] = field(default_factory=dict, repr=False)
    seen: dict[str, list] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"model": self.model, "known": self.known, "names": self.names, "lexicon": None, "cache": {}, "seen": {}}

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Entity spans (start, end, type) of each text, as offsets in it. Repeated texts are looked at once while they are remembered."""
        if len(self.seen) > 100_000:
            self.seen.clear()
        new = list({t for t in texts if t and t not in self.seen})
        self.seen.update(zip(new, self._tag(new)))
        return [self.seen[t] if t else [] for t in texts]

    def _tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if self.lexicon is None or len(self.lexicon) > 300_000 or len(self.cache) > 200_000:
            self.lexicon = Lexicon(self.known, self.names)
            self.cache.clear()  # its keys are the lexicon's numbers
        jobs: list[tuple[int, list[int] | None, Sentence]] = []
        todo: dict[tuple, tuple[Sentence, list]] = {}
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        keys = []
        for d, text in enumerate(texts):
            if not text:
                continue
            form, where = aligned_form(text)
            s = analyse(form, self.lexicon)
            if not s.words:
                continue
            links = skip_links(s, self.lexicon)
            key = (s.classes, tuple(links)) if links else s.classes
            jobs.append((d, where, s))
            keys.append(key)
            if key not in self.cache and key not in todo:
                todo[key] = (s, links)
        pending = sorted(todo.items(), key=lambda x: len(x[1][0].words))
        fresh: dict[tuple, np.ndarray] = {}
        for part in crf.by_size(pending, [len(x[1][0].words) for x in pending]):
            for (key, _), y in zip(part, crf.decode(self.model, features([s for _, (s, _) in part], self.lexicon), [k for _, (_, k) in part])):
                fresh[key] = y
        for (d, where, s), key in zip(jobs, keys):
            y = fresh.get(key)
            if y is None:
                y = self.cache[key]
            for a, b, t in spans_of(s, y):
                a0, b0 = (a, b) if where is None else (where[a], where[b - 1] + 1)
                while where is not None and b0 < len(texts[d]) and unicodedata.combining(texts[d][b0]):
                    b0 += 1
                out[d].append((a0, b0, t))
        self.cache.update(fresh)
        return out


def fit(examples: list[tuple[str, list[tuple[int, int, str]]]]) -> Tagger:
    """A tagger from texts with spans (start, end, type), and VARIANTS rule-made variants for each."""
    gc.disable()
    try:
        return _fit(examples)
    finally:
        gc.enable()


def _fit(examples: list[tuple[str, list[tuple[int, int, str]]]]) -> Tagger:
    forms = []
    for text, spans in [*examples, *variants(examples, VARIANTS * len(examples))]:
        form, where = aligned_form(text)
        if where is not None:
            back = {}
            for k, i in enumerate(where):
                back.setdefault(i, k)
            to = lambda p: next((back[i] for i in range(p, len(text)) if i in back), len(form))  # noqa: E731, B023
            spans = [(to(a), to(b), t) for a, b, t in spans]
        forms.append((form, spans))
    count: dict[str, int] = {}
    inside: dict[str, int] = {}
    for form, spans in forms[: len(examples)]:
        seen = {}
        for m in re.finditer(r"[^\W\d_]+", form.lower()):
            seen[m.group()] = any(t == "PERSON" and x <= m.start() < y for x, y, t in spans)
        for w, person in seen.items():
            count[w] = count.get(w, 0) + 1
            inside[w] = inside.get(w, 0) + person
    known = frozenset(w for w, n in count.items() if n >= 4 and inside[w] <= n / 2)
    names = frozenset(w for w, n in count.items() if n >= 3 and len(w) > 2 and inside[w] > n / 2)
    lexicon = Lexicon(known, names)
    sentences = [analyse(form, lexicon) for form, _ in forms]
    pairs = [(s, spans) for s, (_, spans) in zip(sentences, forms) if s.words]
    docs = list(zip(features([s for s, _ in pairs], lexicon), [labels_of(s, spans) for s, spans in pairs])) if pairs else []
    skips = [skip_links(s, lexicon) for s, _ in pairs]
    if not docs:
        k = len(LABELS)
        return Tagger(crf.CRF(LABELS, np.zeros((_N_FEATURES, k)), np.zeros((k, k)), np.where(np.arange(k) == 0, 1.0, 0.0), 0.0), known, names)
    return Tagger(crf.fit(docs, LABELS, _N_FEATURES, skips, epochs=5), known, names)


def _sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    total = df.select(F.approx_count_distinct(key)).first()[0]
    rate = min(1.0, n / max(1, total))
    return df if rate >= 1 else df.filter(F.pmod(F.xxhash64(F.lit("labelled"), F.col(key)), F.lit(1_000_000)) < int(rate * 1_000_000))


def labelled_examples(values: DataFrame, spans: DataFrame, n: int = SAMPLE_RECORDS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Examples of a bounded sample: about n records of each table.

    values: rec_id, text, entity_type, entity_value, one row per entity; the offsets given there don't hold, so each
    value is searched in its text, and records with a value that isn't there are left out. spans: rec_id, text, spans.
    """
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    by: dict[tuple, list] = {}
    for r in _sampled(values.select("rec_id", "text", "entity_type", "entity_value"), "rec_id", n).filter("text is not null").distinct().collect():
        by.setdefault((r["rec_id"], r["text"]), []).append((r["entity_type"], r["entity_value"]))
    for (_, text), entities in sorted(by.items()):
        found, ok = [], True
        for t, v in entities:
            if t not in PLACEHOLDERS or not v:
                continue
            hits = [m.start() for m in re.finditer(re.escape(v), text)]
            ok &= bool(hits)
            found += [(a, a + len(v), t) for a in hits]
        if ok:
            out.append((text, found))
    seen = set()
    for r in sorted(_sampled(spans.select("rec_id", "text", "spans"), "rec_id", n).filter("text is not null and spans is not null").collect(), key=lambda r: (r["rec_id"], r["text"])):
        if (r["rec_id"], r["text"]) not in seen:
            seen.add((r["rec_id"], r["text"]))
            out.append((r["text"], [(s["start_pos"], s["stop_pos"], s["entity_type"]) for s in r["spans"] if s["entity_type"] in PLACEHOLDERS]))
    return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, t in spans:
        out += [text[at:a], PLACEHOLDERS[t]]
        at = b
    return "".join([*out, text[at:]])


def find_personal_data(df: DataFrame, id_col: str, columns: list[str], tagger: Tagger) -> DataFrame:
    """(row_id, field, masked, spans) of each row and text column in which something was found.

    spans: start_pos, end_pos (code points, end excluded), entity_type, in order, without overlap. masked is the text with
    typed placeholders; everything else of it is unchanged. Null and empty texts have nothing. Equal texts under one
    id count once. The fitted tagger is broadcast; its size is fixed by the number of features.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    schema = "row_id long, field string, masked string, spans array<struct<start_pos:int,end_pos:int,entity_type:string>>"
    long = df.select(F.col(id_col).cast("long").alias("row_id"), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "text"))
    long = long.filter("text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        gc.disable()  # nothing here is cyclic, and the remembered tokens are many objects to look through
        try:
            for b in batches:
                for i in range(0, len(b), 2000):
                    part = b.slice(i, 2000)
                    texts = part.column("text").to_pylist()
                    found = tagger.tag(texts)
                    at = [k for k, spans in enumerate(found) if spans]
                    flat = [x for k in at for x in found[k]]
                    lo, hi, kinds = zip(*flat) if flat else ((), (), ())
                    parts = [pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(kinds, pa.string())]
                    structs = pa.StructArray.from_arrays(parts, ["start_pos", "end_pos", "entity_type"])
                    ends = pa.array([0, *accumulate(len(found[k]) for k in at)], pa.int32())
                    picked = part.take(pa.array(at, pa.int64()))
                    masked = pa.array([mask(texts[k], found[k]) for k in at], pa.string())
                    yield pa.RecordBatch.from_arrays([picked.column("row_id"), picked.column("field"), masked, pa.ListArray.from_arrays(ends, structs)], ["row_id", "field", "masked", "spans"])
        finally:
            gc.enable()

    return long.mapInArrow(run, schema)
