"""Values in unusual forms that must not stay in a masked text, and numbers that must."""

from pyspark.sql import functions as F

from veilframe.operators.anonymize import anonymize
from veilframe.operators.spans import find_spans, value_of

LEAKS = [
    # addresses as they are written in chats
    ("Мастер нужен сюда: Кленовая 52", ["Кленовая 52"]),
    ("Отправьте в Пензу, Озёрная 8 кв 3", ["Озёрная 8"]),
    ("Нахожусь на пр. Космонавтов 77 кв. 21", ["Космонавтов 77"]),
    ("Мой адрес: ш Волоколамское 19", ["Волоколамское 19"]),
    ("привезти на алл. Тополиная 4", ["Тополиная 4"]),
    ("Склад, наб. 30 лет Победы 6", ["30 лет Победы 6"]),
    ("Томск, 2-я Лесная 15", ["2-я Лесная 15"]),
    ("адрес: ул. полевая 33", ["полевая 33"]),
    ("омск, луговая 9, кв 41", ["луговая 9"]),
    ("заберите с Заводская 120к3", ["Заводская 120к3"]),
    ("ул. 9 Января 55 кв. 118 подъезд 2", ["9 Января 55"]),
    # numbers in dirty forms
    ("Вот мой ИНН — 502938475610 для справки.", ["502938475610"]),
    ("Проверьте по ИНН 50-2938-475610.", ["50-2938-475610"]),
    ("ИНН: 50 29 38 47 56 10 из письма.", ["50 29 38 47 56 10"]),
    ("ИНН: 77.4321.098765 по договору.", ["77.4321.098765"]),
    ("ИНН: №502938475610 в карточке.", ["502938475610"]),
    ("ИНН: 5 0 2 9 3 8 4 7 5 6 1 0.", ["5 0 2 9 3 8 4 7 5 6 1 0"]),
    ("СНИЛС — 201-334-578 62 в анкете.", ["201-334-578 62"]),
    ("СНИЛС: 201-334-578-62 проверьте.", ["201-334-578-62"]),
    ("СНИЛС 20133457862 для кабинета.", ["20133457862"]),
    ("СНИЛС: 201—334—578 62 запомните.", ["201—334—578 62"]),
    ("СНИЛС № 201-334-578 62 в письме.", ["201-334-578 62"]),
    ("Паспорт: серия 46 15, номер 712 905.", ["46 15", "712 905"]),
    ("Паспорт: серия № 4615, номер № 712905.", ["4615", "712905"]),
    ("Паспорт РФ: 46-15 №712 905 новый.", ["46-15 №712 905"]),
    ("Паспорт: 46 15 № 712905 получен.", ["46 15 № 712905"]),
    ("паспорт 4615712905 для визита.", ["4615712905"]),
    ("Мобильный номер мой теперь 79037654321.", ["79037654321"]),
    ("Карта банка, которой платил: 41 02 55 60 71 88 93 14.", ["41 02 55 60 71 88 93 14"]),
    ("Дата рождения указана как 05111987.", ["05111987"]),
    ("ПетровИНН5029384756 прислал отчёт.", ["5029384756"]),
    ("ПетровСНИЛС20133457862 прислал.", ["20133457862"]),
    ("Паспорт4615712905 гостя", ["4615712905"]),
    ("Запрос по ИНН заявителя 502938475610.", ["502938475610"]),
    ("Сверьте СНИЛС работника: 20133457862.", ["20133457862"]),
    ("Паспорт: номер 712905, серия 4615.", ["712905"]),
    ("Карта: 4102.5560.7188.9314 для возврата.", ["4102.5560.7188.9314"]),
    ("Наберите: 7-903-765 43 21.", ["7-903-765 43 21"]),
    ("Почта: anna.orlova собака inbox точка ru.", ["anna.orlova", "inbox"]),
    ("Адрес почты: anna.orlova at inbox dot ru жду.", ["inbox"]),
    ("Почта: anna orlova собака inbox точка ru.", ["anna orlova", "inbox"]),
    ("Карта Maestro: 6304985123470 привязана.", ["6304985123470"]),
    ("Карта Amex: 378282246310005 активна.", ["378282246310005"]),
    # farther from the keyword
    ("Как быть с моим паспортом? 4615 712905 не принимают", ["4615 712905"]),
    ("Шлю паспорт. Реквизиты: 4615-712905", ["4615-712905"]),
    ("Паспорта наши: у меня 4615 712905, у мужа 4612 908771", ["4615 712905", "4612 908771"]),
    ("Забыла паспорт, номер 712 905, помогите", ["712 905"]),
    ("Впишите серию и номер: 4615712905", ["4615712905"]),
    ("паспорт 46 15/712905 выдан в 2020", ["712905"]),
    ("Для удостоверения личности сообщите данные: 4615 712905", ["4615 712905"]),
    ("Телефон для связи с отделом кадров 74951112233", ["74951112233"]),
    ("Звонить можно по номеру 78123334455 до обеда", ["78123334455"]),
    ("Контакт для экстренных случаев 84957778899", ["84957778899"]),
    # the group of a match, not an equal number before it
    ("Паспорт 123456 номер 123456", ["номер 123456"]),
]

KEPT = [
    "Петрова 2 раза писала", "было 5 Мая 2021", "в 3 Отдела 4 человека", "Пункт 7 устава", "Раздел 9 приложения", "Вторая 10 минут платная", "Живу в Перми",
    "Номер договора: BX-2018-55190 в силе.", "Код клиента: TR-1988-3307 в базе.", "Номер заказа: ORD-771204 собран.", "Заказ номер 78234567890 готов.", "Трек-номер 2345678901 в дороге.",
    "договор №21 43 658709 подписан", "Номер заказа 2345 678901 не найден", "Паспорт получен, заказ 78234567890 оплачен", "Трек-номер 23456789012, заказ 56123890",
]


def test_nothing_leaks(spark):
    rows = anonymize(spark.createDataFrame([(t, v) for t, v in LEAKS], "text string, v array<string>"), "text").collect()
    leaks = [(r["text"], r["anonymized"]) for r in rows if any(v in r["anonymized"] for v in r["v"])]
    assert leaks == []


def test_harmless_numbers_stay(spark):
    rows = anonymize(spark.createDataFrame([(t,) for t in KEPT], "text string"), "text").collect()
    assert [(r["text"], r["anonymized"]) for r in rows if r["anonymized"] != r["text"]] == []


def test_offsets_of_groups(spark):
    df = spark.createDataFrame([("😀 no 7 no 8; x 7 no 9",), ("",), (None,), ("﷐no 5﷑",), ("нет",)], "text string")
    spans = find_spans(F.col("text"), "no ([0-9])", "N", 0.5, 1)
    got = [[] if r["v"] is None else r["v"] for r in df.select(F.transform(spans, lambda s: F.struct(value_of(F.col("text"), s), s["start_pos"])).alias("v")).collect()]
    assert [[(a, b) for a, b in x] for x in got] == [[("7", 5), ("8", 10), ("9", 20)], [], [], [("5", 4)], []]
