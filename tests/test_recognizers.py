import pytest
from pyspark.sql import functions as F

from veilframe.operators.anonymize import anonymize, anonymize_json, deanonymize, redacted, row_context, word_boxes
from veilframe.operators.persons import clean_name_spans, filter_names
from veilframe.operators.recognizers import RECOGNIZERS, BY_NAME, anchored
from veilframe.operators.spans import SPANS

CASES = [
    ("rx_phone_plus7", "Телефон: +7 999 123 45 67", ["+7 999 123 45 67"]),
    ("rx_phone_plus7", "+7(912)0369487 и +7.984.072.21.43", ["+7(912)0369487", "+7.984.072.21.43"]),
    ("rx_phone_8", "звоните 8-987-059-46-06", ["8-987-059-46-06"]),
    ("rx_phone_mobile_grouped", "номер 914-048-90-89 утром", ["914-048-90-89"]),
    ("rx_phone_intl", "call +44 45 0205 353 now", ["+44 45 0205 353"]),
    ("rx_phone_mobile9", "тел 79161234567", ["79161234567"]),
    ("rx_phone_bare", "9161234567", ["9161234567"]),
    ("rx_phone_anch", "телефон для связи 495 123 45 67", ["495 123 45 67"]),
    ("rx_inn", "код 7707083893 и 7707083894", ["7707083893"]),
    ("rx_inn_anch", "ИНН клиента 7701234560", ["7701234560"]),
    ("rx_snils", "123-456-789 64 и 123-456-789 65", ["123-456-789 64"]),
    ("rx_snils_anch", "СНИЛС 97158050936 в деле", ["97158050936"]),
    ("rx_snils_grouped", "808.442.116-83", ["808.442.116-83"]),
    ("rx_passport_word", "4515 номер 123456", ["4515 номер 123456"]),
    ("rx_passport_anch", "паспорт 4515 123456 выдан", ["4515 123456"]),
    ("rx_passport_doc", "Паспорт выдан давно, 4515 123456", ["4515 123456"]),
    ("rx_passport_num", "паспорт, номер 123456", ["123456"]),
    ("rx_email", "a.b@mail.ru, c@d.example.", ["a.b@mail.ru", "c@d.example"]),
    ("rx_email_spaced", "ivan @ mail . ru", ["ivan @ mail . ru"]),
    ("rx_email_obf", "ivan собака mail точка ru", ["ivan собака mail точка ru"]),
    ("rx_dob", "15.03.1990 и 31/12/2001", ["15.03.1990", "31/12/2001"]),
    ("rx_dob_anch", "Дата рождения: 15.03.1990", ["15.03.1990"]),
    ("rx_dob_text", "родился 27 января 1995", ["27 января 1995"]),
    ("rx_card16", "4276 1234 5678 9012", ["4276 1234 5678 9012"]),
    ("rx_card_anch", "карта 4276 1234 5678", ["4276 1234 5678"]),
    ("rx_card_masked", "4276 **** **** 9012", ["4276 **** **** 9012"]),
    ("rx_addr_marker", "г. Москва, ул. Ленина, д. 5, кв. 12", ["г. Москва, ул. Ленина, д. 5, кв. 12"]),
    ("rx_addr_reverse", "Невская улица 69, оф. 286", ["Невская улица 69, оф. 286"]),
    ("rx_addr_reverse_lower", "живу садовая улица 5", ["садовая улица 5"]),
    ("rx_addr_lower_full", "город заречье улица садовая дом 117 квартира 125", ["город заречье улица садовая дом 117 квартира 125"]),
    ("rx_addr_bare", "жду: Садовая д. 5", ["Садовая д. 5"]),
    ("rx_ip", "10.0.0.1", ["10.0.0.1"]),
    ("rx_url", "https://a.example/x y", ["https://a.example/x"]),
    ("rx_iban", "DE89370400440532013000", ["DE89370400440532013000"]),
    ("rx_crypto", "кошелёк 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", ["1BoatSLRHtKNngkdXEeobR76b53LETtpyT"]),
    ("rx_date_time", "встреча 12.08.2024 10:30 и 2024-08-13", ["12.08.2024 10:30", "2024-08-13"]),
    ("rx_person_fio", "Иванов Иван Иванович пришёл", ["Иванов Иван Иванович", "Иван Иванович"]),
    ("rx_person_initials", "подписал И. И. Иванов", ["И. И. Иванов"]),
]


def test_each_recognizer(spark):
    for name in {c[0] for c in CASES}:
        rows = [(i, c[1], c[2]) for i, c in enumerate(CASES) if c[0] == name]
        df = spark.createDataFrame(rows, "i int, text string, want array<string>").withColumn("s", BY_NAME[name].spans(F.col("text")))
        got = df.select("i", "want", "text", F.transform("s", lambda s: F.substring("text", s["start_pos"] + 1, s["end_pos"] - s["start_pos"])).alias("got")).collect()
        for r in got:
            assert r["got"] == r["want"], (name, r["text"], r["got"])


def test_all_rules_have_a_case():
    assert {r.name for r in RECOGNIZERS} == {c[0] for c in CASES}


END_TO_END = [
    ("ИНН: 772012345670", "ИНН: <INN>"),
    ("СНИЛС 123-456-789 64", "СНИЛС <SNILS>"),
    ("Паспорт серия 4515 номер 123456", "Паспорт серия <PASSPORT>"),
    ("Телефон: +7 999 123 45 67", "Телефон: <PHONE>"),
    ("Номер карты 4276 1234 5678 9012", "Номер карты <CREDIT_CARD>"),
    ("Дата рождения: 15.03.1990", "Дата рождения: <DATE_OF_BIRTH>"),
    ("Адрес: г. Москва, ул. Ленина, д. 5, кв. 12", "Адрес: <ADDRESS>"),
    ("Телефон +79991234567, почта test@mail.ru, ИНН 7701234560", "Телефон <PHONE>, почта <EMAIL>, ИНН <INN>"),
    ("Номер заказа 1234 567890 не приходит", None),
    ("Ваш трек-номер 1234567890 в пути.", None),
    ("Сегодня хорошая погода", None),
    ("", None),
    ("   ", None),
    ("😀 пишите a@b.ru и c@d.ru", "😀 пишите <EMAIL> и <EMAIL_2>"),
]


def test_end_to_end_and_back(spark):
    df = anonymize(spark.createDataFrame([(i, t, w or t) for i, (t, w) in enumerate(END_TO_END)] + [(99, None, None)], "i int, text string, want string"), "text")
    back = deanonymize(df, "anonymized", "mapping")
    for r in back.collect():
        assert r["anonymized"] == r["want"], (r["text"], r["anonymized"])
        assert r["deanonymized"] == r["text"]
    assert all(not r["mapping"] and all(e["value"] == "" for e in r["entities_found"]) for r in redacted(df).collect())


def test_disable_only_narrows(spark):
    df = spark.createDataFrame([("a@b.ru +7 999 123 45 67", [" email_address ", "nonsense", "LOCATION"]), ("a@b.ru", None)], "text string, off array<string>")
    got = [r["anonymized"] for r in anonymize(df, "text", disable=F.col("off")).collect()]
    assert got == ["a@b.ru <PHONE>", "<EMAIL>"]


def test_json_keeps_order_and_other_values(spark):
    src = '{"b": "пишите a@b.ru", "a": [1.0, true, null, "x@y.ru и z@y.ru"], "n": {"k@k.ru": "нет"}}'
    r = anonymize_json(spark.createDataFrame([(1, src), (2, "broken {"), (3, None)], "id int, doc string"), "id", "doc").orderBy("id").collect()
    assert r[0]["anonymized"] == '{"b": "пишите <EMAIL>", "a": [1.0, true, null, "<EMAIL> и <EMAIL_2>"], "n": {"k@k.ru": "нет"}}'
    assert r[0]["n_entities"] == 3 and r[1]["anonymized"] == "broken {" and r[2]["anonymized"] is None


def test_row_context_and_boxes(spark):
    cells = spark.createDataFrame([("r", 1, "ИНН"), ("r", 2, "7701234560"), ("r", 3, "сумма 10")], "row string, col int, text string")
    assert [r["masked"] for r in row_context(cells, "row", "col", "text").orderBy("col").collect()] == ["ИНН", "<INN>", "сумма 10"]
    words = spark.createDataFrame([("p", i, w) for i, w in enumerate("почта a@b.ru тел +7 999 123 45 67".split())], "doc string, n int, text string")
    assert [r["hit"] for r in word_boxes(words, "doc", "n", "text").orderBy("n").collect()] == [False, True, False, True, True, True, True, True]


def test_name_filter_and_repair(spark):
    lex = F.create_map(F.lit("заказ"), F.struct(F.lit(0.0).alias("given"), F.lit(0.0).alias("surn"), F.lit(0.9).alias("common")), F.lit("волк"), F.struct(F.lit(0.0).alias("given"), F.lit(0.0).alias("surn"), F.lit(0.9).alias("common")))
    cases = [("123", 0, 3, False), ("Он ушёл", 0, 2, False), ("Заказ пришёл", 0, 5, False), ("клиент Волк пришёл", 7, 11, True), ("Иванов пришёл", 0, 6, True), ("ул. Ленина, 5", 4, 10, False), ("А. Заказ", 0, 8, True)]
    df = spark.createDataFrame([(t, [("PERSON", a, b, 0.9)], k) for t, a, b, k in cases], f"text string, s {SPANS}, keep boolean")
    for r in df.withColumn("got", filter_names(F.col("text"), F.col("s"), lex)).collect():
        assert bool(r["got"]) == r["keep"], r["text"]
    df = spark.createDataFrame([("звонил Петров И. сам", [("PERSON", 8, 12, 0.9)]), ("клиент Клиент", [("PERSON", 7, 13, 0.9)])], f"text string, s {SPANS}")
    got = [[r["text"][x["start_pos"] : x["end_pos"]] for x in r["c"]] for r in df.withColumn("c", clean_name_spans(F.col("text"), F.col("s"))).collect()]
    assert got == [["Петров"], []]


def test_keyword_anchor(spark):
    df = spark.createDataFrame([("полис ОМС 1234567890123456",), ("полис. 1234567890123456",)], "text string")
    got = [len(r["s"]) for r in df.withColumn("s", anchored(F.col("text"), "полис", "ID", 0.7, (16,))).collect()]
    assert got == [1, 0]
