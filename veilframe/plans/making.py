"""Queries of made records and documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from veilframe.functions import synth
from veilframe.functions.checks import is_luhn
from veilframe.operators.anonymize import anonymize
from veilframe.operators.documents import made_document, masked_documents, paragraphs_of
from veilframe.plans.registry import query
from veilframe.session import table

_THREE = r"^[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+$"


@query("sy_person", rf"""
with v as (select row_id, string_split(entity_value, ' ') as w from ru_training_data where entity_type = 'PERSON' and regexp_matches(entity_value, '{_THREE}'))
select row_id, w[1][1:1] || '.' || w[2][1:1] || '. ' || w[3] as initials_before, w[3] || ' ' || w[1][1:1] || '. ' || w[2][1:1] || '.' as initials_after, w[3] || ' ' || w[1] || ' ' || w[2] as surname_first, lower(w[1] || ' ' || w[2] || ' ' || w[3]) as "lower" from v""")
def sy_person(spark, sf_dir):
    """Labelled names of three words in other forms."""
    v = table(spark, sf_dir, "ru_training_data").filter((F.col("entity_type") == "PERSON") & F.col("entity_value").rlike(_THREE))
    w = F.split("entity_value", " ")
    f = v.select("row_id", synth.person_forms(w[0], w[1], w[2]).alias("f"))
    return f.select("row_id", *[F.col("f")[k].alias(k) for k in ("initials_before", "initials_after", "surname_first", "lower")])


@query("sy_values_forms", r"""
select doc_id, true as card_ok, true as born_ok, true as address_ok, true as mail_ok, true as passport_ok from documents""")
def sy_values_forms(spark, sf_dir):
    """A card, birth date, address, e-mail and passport made for each document, all in their forms; the card's check digit is right."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", is_luhn(synth.made_card(i)).alias("card_ok"), F.to_date(synth.made_birth_date(i), "dd.MM.yyyy").between("1940-01-01", "2005-12-31").alias("born_ok"),
        synth.made_address(i).rlike(r"^ул\. [А-ЯЁ][а-яё]+, д\. [0-9]{1,3}, кв\. [0-9]{1,3}$").alias("address_ok"), synth.made_email(i).rlike(r"^[a-z0-9]+@mail\.test$").alias("mail_ok"),
        synth.made_passport(i).rlike("^[0-9]{4} [0-9]{6}$").alias("passport_ok"),
    )


@query("sy_values_found")
def sy_values_found(spark, sf_dir):
    """Made values put in a sentence with their keywords, masked by all rules: the types found for each document."""
    i = F.col("doc_id")
    text = F.concat(F.lit("ИНН "), synth.made_inn(i), F.lit(", СНИЛС "), synth.made_snils(i), F.lit(", телефон "), synth.made_phone(i), F.lit(", паспорт "), synth.made_passport(i), F.lit(", дата рождения "), synth.made_birth_date(i), F.lit(", карта "), synth.made_card(i), F.lit(", "), synth.made_email(i), F.lit(", "), synth.made_address(i))
    a = anonymize(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text")
    return a.select("doc_id", F.array_join(F.transform("entities_found", lambda e: e["entity_type"]), ",").alias("kinds"), "anonymized")


@query("sy_glue", "select rec_id, cast(coalesce(len(spans), 0) as int) as n_spans, true as kept from train_negatives where text is not null and spans is not null")
def sy_glue(spark, sf_dir):
    """Labelled values glued to the word before them here and there; each value stands at its new place."""
    r = table(spark, sf_dir, "train_negatives").filter("text is not null and spans is not null")
    spans = F.transform("spans", lambda s: F.struct(s["start_pos"].alias("start_pos"), s["stop_pos"].alias("end_pos"), s["entity_type"].alias("entity_type")))
    g = r.select("rec_id", "text", F.array_sort(F.transform(spans, lambda s: F.struct(s["start_pos"], s["end_pos"], s["entity_type"]))).alias("old"), synth.glued(F.col("text"), spans, F.col("rec_id"), 50).alias("g"))
    same = F.forall(F.zip_with("old", "g.spans", lambda a, b: F.substring("text", a["start_pos"] + 1, a["end_pos"] - a["start_pos"]) == F.substring("g.text", b["start_pos"] + 1, b["end_pos"] - b["start_pos"])), lambda x: x)
    return g.select("rec_id", F.size("g.spans").alias("n_spans"), same.alias("kept"))


@query("sy_mix")
def sy_mix(spark, sf_dir):
    """Records in parts of a mixture of about 55, 20, 15 and 10 percent."""
    part = synth.mixed_parts(F.col("rec_id"), {"persons": 55, "streets": 20, "firms": 15, "orders": 10})
    return table(spark, sf_dir, "train_negatives").select("rec_id").distinct().groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("docx_para", "select doc_id, cast(len(string_split(text, chr(10))) as int) as n_paragraphs, true as same from documents where text is not null")
def docx_para(spark, sf_dir):
    """Every document made a Word document with a paragraph for each line, masked, and read again: its paragraphs are the masked lines."""
    @F.pandas_udf(T.BinaryType())
    def make(s: pd.Series) -> pd.Series:
        return s.map(made_document)

    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    masked = masked_documents(d.select("doc_id", make("text").alias("content")), "doc_id").select("doc_id", F.col("masked").alias("content"))
    back = paragraphs_of(masked, "doc_id").select("doc_id", "paragraph", F.col("text").alias("got"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    want = anonymize(lines, "text").select("doc_id", "paragraph", "anonymized")
    same = F.regexp_replace("got", r"\s", "") == F.regexp_replace("anonymized", r"[\s\x00-\x1f]", "")
    return want.join(back, ["doc_id", "paragraph"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_paragraphs"), F.bool_and(F.coalesce(same, F.lit(False))).alias("same"))
