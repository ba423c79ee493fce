"""Queries of the recognisers and of masking, over the whole chat and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators.anonymize import anonymize, anonymize_json, checked_requests, deanonymize, json_strings, redacted, row_context, word_boxes
from veilframe.operators.chats import one_row_each
from veilframe.operators.recognizers import RECOGNIZERS
from veilframe.operators.spans import highlighted, value_of
from veilframe.plans.registry import query
from veilframe.session import table

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
_SEP = r"[\s().\-–]{0,3}"


def _consumed(pattern: str, left: str = "[^0-9]", right: str = "[^0-9]") -> str:
    """SQL for a pattern between borders; borders are consumed, as the SQL engine's patterns can't look around."""
    return f"select id, unnest(regexp_extract_all(content, '(?i)(?:^|{left})({pattern})(?:$|{right})', 1)) as value from messages"


#: SQL of the rules that a pattern without look-around can express; the other rules have none and are tested on cases.
_SQL = {
    "rx_email": f"select id, unnest(regexp_extract_all(content, '(?i){_EMAIL}')) as value from messages",
    "rx_url": r"""select doc_id as id, unnest(regexp_extract_all(text, '(?i)https?://[^\s<>"]+')) as value from documents""",
    "rx_phone_plus7": _consumed(rf"\+7{_SEP}[0-9]{{3}}{_SEP}[0-9]{{3}}{_SEP}[0-9]{{2}}{_SEP}[0-9]{{2}}"),
    "rx_phone_mobile9": _consumed("[78]9[0-9]{9}", "[^0-9+]"),
    "rx_phone_bare": _consumed("9[0-9]{9}", "[^0-9+]"),
    "rx_snils_grouped": _consumed(r"[0-9]{3}[\s.\-][0-9]{3}[\s.\-][0-9]{3}[\s.\-][0-9]{2}"),
    "rx_passport_word": _consumed(r"[0-9]{2}\s?[0-9]{2}\s?(?:номер|№)\s?[0-9]{3}\s?[0-9]{3}"),
}


def _rule_query(rule):
    @query(rule.name, _SQL.get(rule.name))
    def run(spark, sf_dir):
        if rule.name in ("rx_url", "rx_ip", "rx_iban"):  # what documents have rather than chats
            m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).filter("content is not null")
        else:
            m = table(spark, sf_dir, "messages").select("id", "content").filter("content is not null")
        return m.select("id", F.explode(rule.spans(F.col("content"))).alias("s"), "content").select("id", value_of(F.col("content"), F.col("s")).alias("value"))


for _r in RECOGNIZERS:
    _rule_query(_r)

@query("anonymize_messages")
def anonymize_messages(spark, sf_dir):
    """Messages with all rules applied: id, masked text, number of entities."""
    a = anonymize(table(spark, sf_dir, "messages").select("id", "content"), "content")
    return a.select("id", "anonymized", F.size("entities_found").alias("n_entities"))


@query("anonymize_documents")
def anonymize_documents(spark, sf_dir):
    """Documents with all rules applied."""
    a = anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return a.select("doc_id", "anonymized", F.size("entities_found").alias("n_entities"))


@query("deanon_round_trip", "select id, content as deanonymized from messages")
def deanon_round_trip(spark, sf_dir):
    """Masking and putting back gives every message again (that doesn't itself hold placeholders)."""
    a = anonymize(table(spark, sf_dir, "messages").select("id", "content"), "content")
    return deanonymize(a, "anonymized", "mapping").select("id", "deanonymized")


def _map_build(spark, sf_dir, names=None):
    m = anonymize(table(spark, sf_dir, "messages").select("id", "content"), "content", names=names)
    return m.filter(F.size("mapping") > 0).groupBy("id").agg(F.sum(F.size("mapping")).cast("long").alias("n"))


@query("map_build", f"select id, cast(count(*) as bigint) as n from (select id, unnest(regexp_extract_all(content, '(?i){_EMAIL}')) from messages) group by id")
def map_build(spark, sf_dir):
    """Entries of the mapping of each message, e-mail addresses only: one for each placeholder."""
    return _map_build(spark, sf_dir, names=("rx_email",))


@query("map_build_all")
def map_build_all(spark, sf_dir):
    """Entries of the mapping of each message, all rules."""
    return _map_build(spark, sf_dir)


def _ph_number(spark, sf_dir, names=None):
    a = anonymize(table(spark, sf_dir, "messages").select("id", "content").distinct(), "content", names=names)
    return a.select("id", F.explode("entities_found").alias("e")).select("id", "e.value", "e.placeholder")


@query("ph_number", f"""
with m as (select distinct id, content from messages),
e as (select id, unnest(regexp_extract_all(content, '(?i){_EMAIL}')) as value, generate_subscripts(regexp_extract_all(content, '(?i){_EMAIL}'), 1) as k from m)
select id, value, case when k = 1 then '<EMAIL>' else '<EMAIL_' || k || '>' end as placeholder from e""")  # fmt: skip
def ph_number(spark, sf_dir):
    return _ph_number(spark, sf_dir, names=("rx_email",))


@query("ph_number_all")
def ph_number_all(spark, sf_dir):
    """Values and placeholders of each message, all rules."""
    return _ph_number(spark, sf_dir)


def _prj_redact(spark, sf_dir, names=None):
    r = redacted(anonymize(table(spark, sf_dir, "messages").select("id", "content").distinct(), "content", names=names))
    r = r.select("id", F.size("entities_found").alias("n_entities"), F.forall("entities_found", lambda e: e["value"] == "").alias("all_blank"), F.size("mapping").alias("n_mapping"))
    return r.filter("n_entities > 0")


@query("prj_redact", f"""
select id, cast(len(regexp_extract_all(content, '(?i){_EMAIL}')) as int) as n_entities, true as all_blank, 0 as n_mapping from (select distinct id, content from messages) where len(regexp_extract_all(content, '(?i){_EMAIL}')) > 0""")
def prj_redact(spark, sf_dir):
    return _prj_redact(spark, sf_dir, names=("rx_email",))


@query("prj_redact_all")
def prj_redact_all(spark, sf_dir):
    """Blanked entities of each message, all rules."""
    return _prj_redact(spark, sf_dir)


@query("flt_disable", f"select id, regexp_replace(content, '(?i){_EMAIL}', '', 'g') = content as unchanged from messages where content is not null")
def flt_disable(spark, sf_dir):
    """With every other type switched off only e-mail addresses change a text."""
    off = F.array(*[F.lit(x) for x in ("phone_number ", "PII", "unknown", "CREDIT_CARD", "INN", "SNILS", "PASSPORT", "DATE_OF_BIRTH", "ADDRESS", "PERSON")])
    a = anonymize(table(spark, sf_dir, "messages").select("id", "content").filter("content is not null"), "content", disable=off, names=("rx_email", "rx_phone_plus7", "rx_url"))
    return a.select("id", (F.col("anonymized") == F.col("content")).alias("unchanged"))


@query("src_text", "select id, case when content is null or length(content) = 0 then 'empty' when length(content) > 50000 then 'too_long' end as error from messages")
def src_text(spark, sf_dir):
    return checked_requests(table(spark, sf_dir, "messages").select("id", "content"), "content").select("id", "error")


@query("flt_empty", r"select id, content is null or not regexp_matches(content, '[^\s\p{Z}]') as blank from messages")
def flt_empty(spark, sf_dir):
    return table(spark, sf_dir, "messages").select("id", (F.col("content").isNull() | ~F.col("content").rlike(r"[^\s\p{Z}]")).alias("blank"))


@query("snk_review")
def snk_review(spark, sf_dir):
    """Messages with their entities marked for review."""
    a = anonymize(table(spark, sf_dir, "messages").select("id", "content"), "content")
    return a.filter(F.size("entities_found") > 0).select("id", highlighted(F.col("content"), F.col("entities_found")).alias("marked"))


@query("json_strings", """
select c.id, '$.' || j.key as path, j.value ->> '$' as value from (select distinct id, custom_attributes as a from contacts where custom_attributes is not null) c, json_each(c.a) j where j.type = 'VARCHAR'""")
def json_strings_query(spark, sf_dir):
    c = table(spark, sf_dir, "contacts").select("id", "custom_attributes").filter("custom_attributes is not null").distinct()
    return json_strings(c, "id", "custom_attributes").select("id", "path", "value")


@query("json_anon")
def json_anon(spark, sf_dir):
    c = one_row_each(table(spark, sf_dir, "conversations").select("id", "additional_attributes", "updated_at"))
    return anonymize_json(c, "id", "additional_attributes")


@query("docx_row_ctx")
def docx_row_ctx(spark, sf_dir):
    """Contacts as table rows: each field masked in the context of the row."""
    c = one_row_each(table(spark, sf_dir, "contacts").select("id", "name", "email", "phone", "updated_at"))
    cells = c.select("id", F.posexplode(F.array("name", "email", "phone")).alias("col", "text"))
    return row_context(cells, "id", "col", "text").select("id", "col", "masked")


@query("pdf_boxes", r"""
with w as (select doc_id, unnest(string_split_regex(text, '\s+')) as word, generate_subscripts(string_split_regex(text, '\s+'), 1) as n from documents where text is not null)
select doc_id, cast(n as bigint) as n, cast(coalesce(sum(length(word) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as bigint) as start_pos from w""")
def pdf_boxes(spark, sf_dir):
    words = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"\s+", -1)).alias("n", "text"))
    b = word_boxes(words, "doc_id", "n", "text", names=("rx_email", "rx_url"))
    return b.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.col("start_pos").cast("long").alias("start_pos"))


@query("pdf_hits")
def pdf_hits(spark, sf_dir):
    words = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"\s+", -1)).alias("n", "text"))
    return word_boxes(words, "doc_id", "n", "text").filter("hit").select("doc_id", "n", "text")


def _ag_clean_mask(spark, sf_dir, names=None):
    a = anonymize(table(spark, sf_dir, "documents").select("source", "text").filter("text is not null"), "text", names=names)
    return a.groupBy("source").agg(F.avg((F.col("anonymized") != F.col("text")).cast("double")).alias("share"))


@query("ag_clean_mask", f"select source, avg(case when regexp_matches(text, '(?i){_EMAIL}') then 1.0 else 0.0 end) as share from documents where text is not null group by source")
def ag_clean_mask(spark, sf_dir):
    """Share of documents of each source that masking of e-mail addresses changes."""
    return _ag_clean_mask(spark, sf_dir, names=("rx_email",))


@query("ag_clean_mask_all")
def ag_clean_mask_all(spark, sf_dir):
    """Share of documents of each source that masking by all rules changes."""
    return _ag_clean_mask(spark, sf_dir)


def _ag_leak(spark, sf_dir, names=None):
    from veilframe.operators.spans import leaked

    d = table(spark, sf_dir, "ru_training_data").filter("text is not null and entity_value is not null")
    a = anonymize(d.select("text", "entity_type", "entity_value"), "text", names=names)
    return a.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(leaked(F.col("anonymized"), F.col("entity_value"))).alias("leaked"))


@query("ag_leak", f"""
select entity_type, cast(count(*) as bigint) as n, cast(count(*) filter (where trim(entity_value) <> '' and contains(regexp_replace(text, '(?i){_EMAIL}', '<EMAIL>', 'g'), trim(entity_value))) as bigint) as leaked
from ru_training_data where text is not null and entity_value is not null group by entity_type""")
def ag_leak(spark, sf_dir):
    """Values of each type that still stand in the text after e-mail addresses are masked."""
    return _ag_leak(spark, sf_dir, names=("rx_email",))


@query("ag_leak_all")
def ag_leak_all(spark, sf_dir):
    """Values of each type that still stand in the text after masking by all rules."""
    return _ag_leak(spark, sf_dir)
