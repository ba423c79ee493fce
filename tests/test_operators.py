import io
import json
import zipfile

from pyspark.sql import functions as F

import __spark_entry__
from veilframe.functions.checks import is_inn, is_luhn, is_snils
from veilframe.operators.evaluation import bootstrap, greedy_matches, type_matches
from veilframe.operators.ranking import spread_rank
from veilframe.operators.references import Reference, orphan_references, orphan_report
from veilframe.operators.spans import SPANS, fully_covered, merge_hyphened, restored
from veilframe.sources.readers import read_conll, read_docx, read_gold, standoff, tags_from_ids


def test_checks(spark):
    df = spark.createDataFrame([("7707083893",), ("500100732259",), ("123-456-789 64",), ("4276123456789012",), ("",), (None,)], "v string")
    r = df.select(is_inn(F.col("v")), is_snils(F.col("v")), is_luhn(F.col("v"))).collect()
    assert [tuple(x) for x in r] == [(True, False, False), (True, False, False), (False, True, False), (False, False, False), (False, False, False), (None, None, None)]


def test_spread_rank_with_a_hot_key_and_nulls(spark):
    rows = [("hot" if i % 3 else None, i % 7 or None, i) for i in range(3000)] + [(f"k{i}", 1, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    got = spread_rank(df.repartition(9), ["k"], ["o", "id"], "rank", size="id").collect()
    for key in {r["k"] for r in got}:
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: (r["o"] is not None, r["o"] or 0, r["id"]))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        total = 0
        for r in mine:
            assert r["before"] == total
            total += r["id"]
    assert spread_rank(df.limit(0), ["k"], ["o", "id"]).count() == 0


def test_orphans(spark):
    child = spark.createDataFrame([(1, 10, "2024-01-05"), (1, 10, "2024-01-05"), (2, 11, "2024-01-05"), (3, 12, "2024-02-05"), (4, None, "2024-01-05"), (5, 11, None), (6, 12, None)], "id int, p int, at string").select("id", "p", F.to_timestamp_ntz("at").alias("created_at"), F.lit("x").alias("key"))
    parent = spark.createDataFrame([(11, "2024-03-01"), (11, "2024-03-01"), (13, None)], "id int, at string").select("id", F.to_timestamp_ntz("at").alias("created_at"))
    refs = (Reference("c", "p", "q"),)
    found = orphan_references({"c": child, "q": parent}, refs)
    assert sorted((r["child_id"], r["reason"]) for r in found.collect()) == [(1, "missing"), (2, "late"), (3, "missing"), (6, "missing")]
    assert {(r["month"], r["n_missing"], r["n_late"]) for r in orphan_report(found).collect()} == {("2024-01", 1, 1), ("2024-02", 1, 0), (None, 1, 0)}
    assert orphan_references({"c": child.limit(0), "q": parent}, refs).count() == 0
    assert orphan_references({"c": child, "q": parent.limit(0)}, refs).count() == 5


def test_span_measures(spark):
    df = spark.createDataFrame([("Анна-Мария Петрова тут", [("P", 0, 18, 1.0)], [("P", 0, 4, 0.5), ("P", 5, 10, 0.9), ("P", 11, 18, 0.7)])], f"text string, g {SPANS}, p {SPANS}")
    g, p = F.col("g"), F.col("p")
    r = df.select(fully_covered(F.col("text"), g[0], p).alias("full"), F.size(merge_hyphened(F.col("text"), p)).alias("merged"), greedy_matches(g, p).alias("greedy"), type_matches(g, p).alias("typed")).first()
    assert (r["full"], r["merged"], r["greedy"], r["typed"]) == (True, 2, 1, 1)
    assert not df.select(fully_covered(F.col("text"), g[0], F.slice(p, 1, 2))).first()[0]


def test_restoring_takes_long_placeholders_first(spark):
    m = F.create_map(F.lit("<A>"), F.lit("x"), F.lit("<A_2>"), F.lit("y"))
    assert tuple(spark.range(1).select(restored(F.lit("<A_2> <A> <A>"), m).alias("r")).first()["r"]) == ("y x x", 3)


def test_bootstrap_of_equal_systems_is_nought(spark):
    c = spark.createDataFrame([(f"t{i}", i, i + 1, i + 2, i, i, 1, 0) for i in range(9)], "k string, tp long, n_pred long, n_gold long, tp_overlap long, full long, n_neg long, neg_hit long")
    assert all(r["lo"] == r["hi"] == 0 and r["p"] == 1 for r in bootstrap(c, "k", 50, other=c).collect())


def test_readers(spark, tmp_path):
    (tmp_path / "a.conll").write_text("Иван\tB-PERSON\nв\tO\n\nМоскве\tB-LOC\nя\tO\n", encoding="utf-8")
    assert [(r["token"], r["tag"]) for r in read_conll(spark, str(tmp_path / "a.conll")).orderBy("sent_id", "pos").collect()] == [("Иван", "B-PERSON"), ("в", "O"), ("Москве", "O"), ("я", "O")]
    (tmp_path / "g.jsonl").write_text(json.dumps({"text": "а", "spans": []}) + "\n\n" + json.dumps({"id": "q", "text": "б", "spans": [{"start": 0, "stop": 1, "type": "PERSON"}]}) + "\n", encoding="utf-8")
    assert [(r["id"], r["template_id"], r["subset"]) for r in read_gold(spark, str(tmp_path / "g.jsonl"), "set").collect()] == [("set-0000", "set-0000", "neg"), ("q", "q", "pii")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Тел </w:t></w:r><w:r><w:t>1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>ячейка</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>верх</w:t></w:r></w:p></w:hdr>")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.docx").write_bytes(b.getvalue())
    (tmp_path / "d" / "b.docx").write_bytes(b"no zip")
    got = {(r["part"], r["text"], r["table_row"]) for r in read_docx(spark, str(tmp_path / "d")).collect()}
    assert got == {("word/document.xml", "Тел 1", None), ("word/document.xml", "ячейка", 0), ("word/header1.xml", "верх", None), (None, None, None)}
    assert spark.range(1).select(tags_from_ids(F.array(F.lit(0), F.lit(1), F.lit(9)), ["O", "B-PER"])).first()[0] == ["O", "B-PER", "O"]
    s = standoff(spark.createDataFrame([("d", "Иван тут")], "doc string, text string"), spark.createDataFrame([("d", 1, 0, 4)], "doc string, span_id int, start_pos int, length int"), spark.createDataFrame([("d", "PERSON", [1])], "doc string, entity_type string, span_ids array<int>"))
    assert tuple(s.first()["spans"][0]) == (0, 4, "PERSON")


def test_entry_names_match():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and {"p4_found", "anonymize_messages"} <= set(q)
