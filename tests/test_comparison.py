import pytest
from pyspark.sql import functions as F

from veilframe.operators import comparison as cp
from veilframe.operators.persons import reject_reason
from veilframe.operators.spans import SPANS
from veilframe.sources.readers import read_conll, read_gold
from veilframe.sources.writers import fingerprint, write_dataset, write_masked


def _s(*spans):
    return [(t, a, b, 1.0) for t, a, b in spans]


def test_type_scores_micro_and_macro(spark):
    rows = [(_s(("P", 0, 3), ("P", 5, 8), ("T", 10, 12)), _s(("P", 1, 2), ("P", 2, 3), ("E", 10, 12))), ([], _s(("E", 0, 1))), ([], []), (_s(("T", 0, 2)), _s(("T", 0, 2)))]
    c = cp.type_counts(spark.createDataFrame(rows, f"g {SPANS}, p {SPANS}"), "g", "p")
    assert {r["entity_type"]: (r["tp"], r["fp"], r["fn"]) for r in c.collect()} == {"P": (1, 1, 1), "T": (1, 0, 1), "E": (0, 2, 0)}
    s = {(r["level"], r["entity_type"]): r for r in cp.type_scores(c).collect()}
    assert s["micro", None]["tp"] == 2 and abs(s["micro", None]["precision"] - 0.4) < 1e-9
    assert abs(s["macro", None]["precision"] - (0.5 + 1 + 0) / 3) < 1e-9 and s["type", "E"]["recall"] == 1 and s["type", "E"]["f"] == 0
    empty = {r["level"]: r for r in cp.type_scores(c.limit(0)).collect()}
    assert empty["micro"]["tp"] == 0 and empty["macro"]["f"] == 0


def test_keys_and_pairs_must_agree(spark):
    a = spark.createDataFrame([(1, []), (2, [])], f"id int, spans {SPANS}")
    b = spark.createDataFrame([(1, []), (3, [])], f"id int, spans {SPANS}")
    assert sorted((r["id"], r["only_in"]) for r in cp.unequal_keys(a, b, "id").collect()) == [(2, "a"), (3, "b")]
    with pytest.raises(ValueError):
        cp.paired_predictions(a, b, "id")
    assert cp.paired_predictions(a, a, "id").count() == 2


def test_parts_rules_and_verdicts(spark):
    df = spark.createDataFrame([("Пётр <X>", "Пётр Ильин"), ("П. <X>", "П. Ильин"), ("<X>", "Ян Ли")], "m string, v string")
    assert [r[0] for r in df.select(cp.part_leaks(F.col("m"), F.col("v"))).collect()] == [True, False, False]
    m = spark.createDataFrame([("f1", 0.9), ("leak", 0.1)], "metric string, value double")
    c = spark.createDataFrame([("a", "f1", ">=", 0.9), ("b", "leak", "<", 0.1), ("c", "none", "<=", 1.0)], "criterion string, metric string, relation string, bound double")
    assert {r["criterion"]: r["passed"] for r in cp.acceptance(m, c).collect()} == {"a": True, "b": False, "c": False}
    v = spark.createDataFrame([("x", "f1", "win"), ("y", "f1", "loss")], "d string, metric string, verdict string")
    assert {r["d"]: r["verdict"] for r in cp.comparable_verdicts(v, v.filter("d = 'x'"), ["d", "metric"]).collect()} == {"x": "na", "y": "loss"}


def test_span_relations(spark):
    df = spark.createDataFrame([("a b\nc d", _s(("P", 0, 3), ("P", 2, 5)), _s(("A", 0, 3)))], f"t string, s {SPANS}, o {SPANS}")
    r = df.select(F.size(cp.contained(F.col("s"), F.col("o"))), F.size(cp.crossing(F.col("t"), F.col("s"), "\n")), cp.three_ways(F.col("s"), F.col("o"), F.col("o"), F.col("s")).alias("w")).first()
    assert (r[0], r[1], tuple(r["w"])) == (1, 1, (0, 2, 2))


def test_name_rules_with_a_lexicon_table(spark):
    lex = spark.createDataFrame([("мельник", 0.0, 0.0, 0.9), ("горшок", 0.0, 0.0, 0.9), ("виктор", 0.9, 0.0, 0.0), ("лицо", 0.0, 0.0, 0.9)], "word string, given double, surn double, common double")
    cases = [("пришёл Мельник", "Мельник", "F3"), ("Исполнитель по заявке Мельник", "Мельник", None), ("от ООО «Мельник»", "Мельник", "F3"), ("это Виктор Горшок тут", "Горшок", None), ("это Горшок тут", "Горшок", "F3"), ("физ лицо", "физ лицо", "F4"), ("12", "12", "F1"), ("вот Юр", "Юр", "F2"), ("ул. Виктор", "Виктор", "F5")]
    rows = [(i, t, [("PERSON", t.index(v), t.index(v) + len(v), 0.9)]) for i, (t, v, _) in enumerate(cases)] + [(99, "нет", []), (100, None, None)]
    got = {r["id"]: r["reason"] for r in reject_reason(spark.createDataFrame(rows, f"id int, text string, s {SPANS}"), "id", "text", "s", lex).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_written_records_come_back(spark, tmp_path):
    rows = [("a", "t", "pii", "Пишет Пётр Ильин.", _s(("PERSON", 6, 16)), "train"), ("b", "t", "neg", "Привет", [], "dev"), ("c", "t", "neg", None, [], "dev"), ("d", "t", "neg", "", [], "dev")]
    write_dataset(spark.createDataFrame(rows, f"id string, template_id string, subset string, text string, spans {SPANS}, split string"), str(tmp_path / "d"))
    back = {r["id"]: r for r in read_gold(spark, str(tmp_path / "d/jsonl/*"), "x").collect()}
    assert set(back) == {"a", "b", "d"} and [tuple(s) for s in back["a"]["spans"]] == _s(("PERSON", 6, 16))
    tags = [(r["token"], r["tag"]) for r in read_conll(spark, str(tmp_path / "d/conll/split=train")).orderBy("sent_id", "pos").collect()]
    assert tags == [("Пишет", "O"), ("Пётр", "B-PERSON"), ("Ильин", "I-PERSON"), (".", "O")]
    ents = spark.createDataFrame([(1, "<X>", [("PHONE", "1"), ("PHONE", "2"), ("INN", "3")])], "id int, anonymized string, entities_found array<struct<entity_type:string,value:string>>")
    write_masked(ents, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first()["summary"] == '{"PHONE":2,"INN":1}'
    t = spark.createDataFrame([(i, "x" * i) for i in range(50)], "i int, s string")
    assert fingerprint(t) == fingerprint(t.repartition(5)) != fingerprint(t.filter("i > 0"))
