"""Message events as a stream: parsed, masked and written without state. Numbers of placeholders restart in each text, so no state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.anonymize import anonymize
from veilframe.sources.readers import WEBHOOK


def parsed_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Events of a text column; what isn't JSON has null fields, and everything not in the schema stays in raw."""
    return raw.select(F.col(column).alias("raw"), F.from_json(column, WEBHOOK).alias("e")).select("raw", "e.*")


def masked_events(events: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Of message_created events the masked content and number of entities; other events are passed over."""
    made = events.filter("event = 'message_created'").withColumn("conversation_id", F.col("conversation.id"))
    a = anonymize(made, "content", names=names, return_mapping=False)
    return a.select("id", "conversation_id", "message_type", "anonymized", F.size("entities_found").alias("n_entities"))


def run_webhook(spark: SparkSession, source: str, sink: str, checkpoint: str, names: tuple[str, ...] | None = None) -> StreamingQuery:
    """Mask all events in a folder of JSON lines and write them as Parquet; takes what is there and ends (start it again for more)."""
    raw = spark.readStream.format("text").load(source)
    return masked_events(parsed_events(raw), names).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed(body: bytes, signature: str, key: bytes) -> bool:
    """Whether an event's body has the given HMAC-SHA256 signature, in hexadecimal."""
    import hashlib
    import hmac

    return hmac.compare_digest(hmac.new(key, body, hashlib.sha256).hexdigest(), signature)
