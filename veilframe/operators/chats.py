"""Chat tables to anonymised conversations: contact, identifier and messages in one pass, with totals of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.operators.anonymize import anonymize


def one_row_each(df: DataFrame, key: str = "id", latest: str = "updated_at") -> DataFrame:
    """One row of each key, the latest; rows delivered twice count once. Null keys are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(latest, *[c for c in ("created_at",) if c in df.columns])).alias("r")).select(key, "r.*")


def conversation_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their messages (id, created_at, content) in order of created_at, null first, then id; none for those without.

    One row holds a conversation, as a request for it asks; for counts take message_counts, for texts long_texts, which gather nothing.
    """
    m = one_row_each(messages).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct(F.col("created_at").isNotNull().alias("timed"), "created_at", "id", "content"))).alias("messages"))
    return one_row_each(conversations).join(m.withColumnRenamed("conversation_id", "__c"), F.col("id") == F.col("__c"), "left").drop("__c")


def message_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, n_messages) of every conversation, 0 without messages; contents are neither read nor gathered."""
    n = one_row_each(messages).groupBy("conversation_id").agg(F.count(F.lit(1)).cast("int").alias("n_messages")).withColumnRenamed("conversation_id", "id")
    return one_row_each(conversations).select("id").join(n, "id", "left").fillna(0, ["n_messages"])


def conversation_contacts(conversations: DataFrame, contacts: DataFrame) -> DataFrame:
    """(id, contact_id, name, email, phone, known) of conversations; known: whether there is such a contact, whose fields may be null."""
    c = one_row_each(contacts).select(F.col("id").alias("__c"), "name", "email", "phone")
    j = one_row_each(conversations).select("id", "contact_id").join(c, F.col("contact_id") == F.col("__c"), "left")
    return j.withColumn("known", F.col("__c").isNotNull()).drop("__c")


def batch(conversations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of a list of ids, and (total, processed): ids as listed, repeats and all, and conversations found."""
    found = one_row_each(conversations).join(ids.select("id").distinct(), "id", "left_semi")
    totals = ids.agg(F.count(F.lit(1)).alias("total")).crossJoin(found.agg(F.count(F.lit(1)).alias("processed")))
    return found, totals


def long_texts(conversations: DataFrame, contacts: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, part, ordinal, text) of every text of conversations: identifier, contact name, e-mail, phone, message contents."""
    c = one_row_each(conversations).select(F.col("id").alias("conversation_id"), "identifier", "contact_id")
    p = one_row_each(contacts).select(F.col("id").alias("contact_id"), "name", "email", "phone")
    head = c.join(p, "contact_id", "left").select("conversation_id", F.explode(F.create_map(F.lit("identifier"), "identifier", F.lit("contact.name"), "name", F.lit("contact.email"), "email", F.lit("contact.phone"), "phone")).alias("part", "text"))
    m = one_row_each(messages).join(c.select("conversation_id"), "conversation_id", "left_semi").select("conversation_id", F.lit("message").alias("part"), F.col("id").cast("long").alias("ordinal"), F.col("content").alias("text"))
    return head.select("conversation_id", "part", F.lit(0).cast("long").alias("ordinal"), "text").unionByName(m).filter("text is not null")


def anonymized_conversations(conversations: DataFrame, contacts: DataFrame, messages: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """long_texts with anonymized text and the number of entities: one pass over all texts, no loop over conversations."""
    a = anonymize(long_texts(conversations, contacts, messages), "text", names=names, return_mapping=False)
    return a.select("conversation_id", "part", "ordinal", "anonymized", F.size("entities_found").alias("n_entities"))


def entity_totals(anonymized: DataFrame) -> DataFrame:
    return anonymized.groupBy("conversation_id").agg(F.sum("n_entities").cast("long").alias("total_entities"), F.count(F.lit(1)).alias("n_texts"))
