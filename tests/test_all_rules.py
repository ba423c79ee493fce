import datetime as dt

import __spark_entry__
from veilframe.plans import all_oracle_sql

LEAKS = {
    "Иванова Мария Петровна": "Звонила Иванова Мария Петровна насчёт возврата.",
    "Ленина": "Доставка: г. Москва, ул. Ленина, д. 5, кв. 12",
    "9161234567": "Перезвоните 9161234567 вечером",
    "123-456-789 64": "Номер 123-456-789 64 в анкете",
    "собака": "Пишите на ivan собака mail точка ru",
}


def _tables(spark, at):
    day = dt.datetime(2024, 1, 1)
    texts = list(LEAKS.values())
    spark.createDataFrame([(i, 1, 0, t, day, day) for i, t in enumerate(texts)], "id int, conversation_id int, message_type int, content string, created_at timestamp_ntz, updated_at timestamp_ntz").write.parquet(f"{at}/messages.parquet")
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, None, 7, '{"note": "Доставка: г. Москва, ул. Ленина, д. 5, кв. 12"}', day)], "id int, identifier string, contact_id int, additional_attributes string, updated_at timestamp_ntz").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(7, "Иванова Мария Петровна", "ivan собака mail точка ru", "9161234567", day)], "id int, name string, email string, phone string, updated_at timestamp_ntz").write.parquet(f"{at}/contacts.parquet")


def test_queries_mask_by_all_rules(spark, tmp_path):
    """Names, addresses and forms without a keyword are masked and counted, not only those of a few rules."""
    at = str(tmp_path)
    _tables(spark, at)
    q = __spark_entry__.queries()
    rows = lambda name: q[name](spark, at).collect()
    masked = " ".join(r["anonymized"] for r in rows("anonymize_documents"))
    assert [v for v in LEAKS if v in masked] == []
    assert len(rows("snk_review")) == len(LEAKS)
    assert sorted(r["deanonymized"] for r in rows("deanon_round_trip")) == sorted(LEAKS.values())
    assert "Ленина" not in rows("json_anon")[0]["anonymized"]
    cells = {r["col"]: r["masked"] for r in rows("docx_row_ctx")}
    assert "Иванова" not in cells[0] and "собака" not in cells[1] and "9161234567" not in cells[2]
    assert rows("ag_conv_total")[0]["total_entities"] == len(LEAKS) + 3
    assert {r["doc_id"] for r in rows("pdf_hits")} == set(range(len(LEAKS)))
    assert sum(r["n"] for r in rows("map_build_all")) == len(LEAKS)
    assert sum(r["n_entities"] for r in rows("stream_webhook_all")) == len(LEAKS)


def test_queries_with_sql_have_a_form_with_all_rules():
    for name in ("map_build", "ph_number", "prj_redact", "ag_clean_mask", "ag_leak", "stream_webhook"):
        assert name in all_oracle_sql() and f"{name}_all" in __spark_entry__.queries()
