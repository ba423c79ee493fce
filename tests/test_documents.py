import io
import zipfile

from pyspark.sql import functions as F

from veilframe.functions import synth
from veilframe.functions.text import decline_family, decline_given
from veilframe.operators.documents import limit_error, masked_documents, paragraphs_of
from veilframe.operators.spans import listed_types
from veilframe.sources.readers import occurrences

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx():
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    inner = f"<w:tbl><w:tr><w:tc>{p('СНИЛС')}</w:tc><w:tc>{p('123-456-789 64')}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc>{p('ИНН')}</w:tc><w:tc>{p('7701234560')}</w:tc><w:tc>{inner}</w:tc></w:tr></w:tbl>"
    gone = "<w:p><w:del><w:r><w:delText>тайна</w:delText></w:r></w:del><w:ins ><w:r><w:t>видно</w:t></w:r></w:ins></w:p>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('Почта iv', 'an@ma', 'il.ru жду')}{table}{gone}{p()}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('тел +7 999 123 45 67')}</w:hdr>")
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Пётр Ильин</dc:creator></cp:coreProperties>')
        z.writestr("word/media/a.bin", b"\x00\x01")
    return b.getvalue()


def test_documents_are_masked_and_written_back(spark):
    rows = [("a", bytearray(_docx())), ("b", bytearray(b"no zip")), ("c", bytearray(b"")), ("d", None)]
    got = {r["path"]: r for r in masked_documents(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"a": None, "b": "broken", "c": "empty", "d": "empty"}
    assert got["a"]["n_entities"] == 4 and got["a"]["tracked_insertions"] and got["b"]["masked"] is None
    back = spark.createDataFrame([("a", bytearray(got["a"]["masked"]))], "path string, content binary")
    texts = [r["text"] for r in paragraphs_of(back).orderBy("part", "paragraph").collect()]
    assert texts == ["Почта <EMAIL> жду", "ИНН", "<INN>", "СНИЛС", "<SNILS>", "видно", "", "тел <PHONE>"]
    with zipfile.ZipFile(io.BytesIO(got["a"]["masked"])) as z:
        assert "Ильин" not in z.read("docProps/core.xml").decode() and "тайна" not in z.read("word/document.xml").decode() and z.read("word/media/a.bin") == b"\x00\x01"
    big = limit_error(spark.createDataFrame([(bytearray(b"xx"), 3), (bytearray(b"x"), 500)], "content binary, pages int"), most=1, pages="pages").collect()
    assert [r["error"] for r in big] == ["too_large", "too_many_pages"]


def test_names_in_cases(spark):
    rows = [("Иван", "m", "gen", "Ивана"), ("Сергей", "m", "ins", "Сергеем"), ("Никита", "m", "dat", "Никите"), ("Ольга", "f", "gen", "Ольги"), ("Мария", "f", "prep", "Марии"), ("Любовь", "f", "ins", "Любовью"), ("Илья", "m", "acc", "Илью"), ("Карен", "f", "gen", "Карен")]
    df = spark.createDataFrame(rows, "n string, g string, c string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", decline_given(F.col("n"), F.col("g"), F.col("c"))).collect())
    rows = [("Орловский", "m", "gen", "Орловского"), ("Орловский", "f", "acc", "Орловскую"), ("Мельник", "m", "ins", "Мельником"), ("Мельник", "f", "dat", "Мельник"), ("Коваль", "m", "dat", "Ковалю"), ("Иванов", "f", "gen", "Ивановой"), ("Дюма", "m", "gen", "Дюма")]
    df = spark.createDataFrame(rows, "n string, g string, c string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", decline_family(F.col("n"), F.col("g"), F.col("c"))).collect())


def test_glue_lists_and_literals(spark):
    df = spark.createDataFrame([("звонил Пётр и Олег", [(7, 11, "PERSON"), (14, 18, "PERSON")]), ("Пётр", [(0, 4, "PERSON")])], "t string, s array<struct<start_pos:int,end_pos:int,entity_type:string>>")
    r = df.select(synth.glued(F.col("t"), F.col("s"), F.lit(1), 100).alias("g")).collect()
    assert r[0]["g"]["text"] == "звонилПётр иОлег" and [(s["start_pos"], s["end_pos"]) for s in r[0]["g"]["spans"]] == [(6, 10), (12, 16)] and r[1]["g"]["text"] == "Пётр"
    got = spark.createDataFrame([(" PERSON, ,inn,",), ("",), (None,)], "f string").select(listed_types(F.col("f"))).collect()
    assert [r[0] for r in got] == [["PERSON", "inn"], [], []]
    df = spark.createDataFrame([("a\\Eb a\\Eb", "a\\Eb"), ("x", ""), ("x", None)], "t string, v string")
    assert [len(r[0]) for r in df.select(occurrences(F.col("t"), F.col("v"))).collect()] == [2, 0, 0]
