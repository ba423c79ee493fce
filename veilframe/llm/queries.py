"""Queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm.conversations import estimate_weights, link_accuracy, link_trees, planted_channels, rebuild_conversations, reply_links, turns
from veilframe.llm.entities import find_personal_data, fit, labelled_examples
from veilframe.llm.languages import document_languages, found_languages
from veilframe.llm.lookalikes import lookalike_pairs
from veilframe.llm.mixing import mix_report, mix_sources
from veilframe.llm.oracle import P1_FOUND_SQL, P1_REPORT_SQL, P3_FOUND_SQL, P5_FOUND_SQL
from veilframe.llm.overlap import cross_split_overlaps, overlap_counts, overlap_report
from veilframe.llm.packing import pack_documents, packing_report, sized_documents
from veilframe.llm.restatements import restatement_groups, restatement_pairs
from veilframe.llm.tokens import token_count
from veilframe.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dev_negatives").select("rec_id", "text").unionByName(table(spark, sf_dir, "test_negatives").select("rec_id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_split_overlaps(table(spark, sf_dir, "train_negatives"), _evaluation(spark, sf_dir))
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = {s: table(spark, sf_dir, f"{s}_negatives") for s in ("dev", "test")}
    return overlap_report(overlap_counts(table(spark, sf_dir, "train_negatives"), _evaluation(spark, sf_dir)), splits)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ru_training_data").select("rec_id", "text").unionByName(table(spark, sf_dir, "dev_negatives").select("rec_id", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restatement_pairs(_records(spark, sf_dir)).select("id_a", "id_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restatement_groups(_records(spark, sf_dir))


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_conversations(spark, sf_dir).select("conversation_id", "turn_no", "message_id")


def p2_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread (tree of reply links) of the kept conversations, with its size and whether an agent answered in it."""
    turns_ = written(turns(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations")), "turns")
    weights = estimate_weights(planted_channels(turns_))
    t = link_trees(reply_links(turns_, weights=weights))
    return t.groupBy("conversation_id", "thread_no").agg(
        F.count(F.lit(1)).alias("n_turns"), F.max("turn_no").alias("last_turn_no"), F.bool_or(F.col("speaker") == "agent").alias("has_agent"),
    )


def p2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parents are right in channels of two interleaved conversations each, with weights estimated on other channels."""
    turns_ = written(turns(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations")), "turns")
    weights = estimate_weights(planted_channels(turns_, 1))
    held = written(planted_channels(turns_, 2), "held")
    return link_accuracy(held, reply_links(held.drop("true_parent"), weights=weights))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "messages"), "id", "content")


def _tagger(spark: SparkSession, sf_dir: str):
    return fit(labelled_examples(table(spark, sf_dir, "ru_training_data"), table(spark, sf_dir, "train_negatives")))


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field of messages and contacts in which something was found, with placeholders in its place, and the spans."""
    tagger = _tagger(spark, sf_dir)
    m = find_personal_data(table(spark, sf_dir, "messages"), "id", ["content"], tagger).withColumn("src_table", F.lit("messages"))
    c = find_personal_data(table(spark, sf_dir, "contacts"), "id", ["name", "email", "phone"], tagger).withColumn("src_table", F.lit("contacts"))
    return m.unionByName(c).select("src_table", F.col("field").alias("src_field"), "row_id", "masked", "spans")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity_type"]))).alias("entity_type")
    return p6_masked(spark, sf_dir).select("src_table", "src_field", "row_id", kinds).distinct()


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    return mix_sources(docs, table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(written(p8_mix(spark, sf_dir), "mix"), table(spark, sf_dir, "mix_targets"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and status of every document, with its segments."""
    return document_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_languages(p9_documents(spark, sf_dir))


P2_FOUND_SQL = r"""
with m as (
  select *, row_number() over (partition by id order by updated_at desc nulls last) as copy,
    regexp_replace(lower(coalesce(sender_type, '')), '[\s_\-]+', '', 'g') as kind from messages
  where id is not null and conversation_id is not null and not coalesce(private, false) and (message_type is null or message_type in (0, 1))
    and length(regexp_replace(content, '[\s\p{Z}\p{Cc}\p{Cf}\x{34f}\x{fe00}-\x{fe0f}]', '', 'g')) > 0),
t as (
  select id, conversation_id, created_at, case
    when kind = '' then case message_type when 0 then 'customer' when 1 then 'agent' end
    when kind = 'contact' and coalesce(message_type, 0) = 0 then 'customer'
    when kind in ('user', 'agentbot', 'bot') and coalesce(message_type, 1) = 1 then 'agent' end as speaker
  from m where copy = 1),
n as (select *, row_number() over (partition by conversation_id order by created_at, id) as turn_no from t),
k as (
  select conversation_id from n group by conversation_id
  having count(*) filter (where created_at is null or speaker is null) = 0
    and max(turn_no) filter (where speaker = 'agent') > min(turn_no) filter (where speaker = 'customer'))
select cast(conversation_id as bigint) as conversation_id, turn_no, cast(id as bigint) as message_id
from n where conversation_id in (select conversation_id from k) and conversation_id in (select id from conversations)
"""

QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_groups": p3_groups, "p2_found": p2_found, "p2_threads": p2_threads, "p2_accuracy": p2_accuracy, "p5_found": p5_found, "p6_found": p6_found, "p6_masked": p6_masked, "p7_packed": p7_packed, "p7_report": p7_report, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_documents": p9_documents}
ORACLE: dict[str, str] = {"p1_found": P1_FOUND_SQL, "p1_report": P1_REPORT_SQL, "p2_found": P2_FOUND_SQL, "p3_found": P3_FOUND_SQL, "p5_found": P5_FOUND_SQL}
