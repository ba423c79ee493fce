"""Readers of annotated texts, documents, chat tables and events; every schema is explicit."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GOLD = "id string, template_id string, subset string, text string, spans array<struct<start:int,stop:int,type:string,meta:map<string,string>>>"
PREDICTIONS = "id string, spans array<array<int>>, ms double, anonymized string"
WEBHOOK = "event string, id long, content string, message_type string, created_at string, private boolean, conversation struct<id:long>, sender struct<id:long,name:string,type:string>"


def read_gold(spark: SparkSession, path: str, name: str) -> DataFrame:
    """JSON lines with defaults: id from the name and the line's place, template_id from id, subset pii or neg from the spans; blank lines are skipped."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    r = lines.select("n", F.from_json("value", GOLD).alias("r")).select("n", "r.*")
    from veilframe.operators.ranking import spread_rank

    r = spread_rank(r.withColumn("one", F.lit(1)), ["one"], ["n"], "k").drop("one", "n")
    ident = F.coalesce("id", F.format_string(f"{name}-%04d", F.col("k") - 1))
    spans = F.transform(F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,type:string,meta:map<string,string>>>")), lambda s: F.struct(s["type"].alias("entity_type"), s["start"].alias("start_pos"), s["stop"].alias("end_pos"), F.lit(1.0).alias("score")))
    subset = F.coalesce("subset", F.when(F.exists(spans, lambda s: ~s["entity_type"].startswith("OTHER_")), "pii").otherwise("neg"))
    return r.select(ident.alias("id"), F.coalesce("template_id", ident).alias("template_id"), subset.alias("subset"), "text", spans.alias("spans"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions by id; of several lines with one id the last counts."""
    r = spark.read.schema(PREDICTIONS).json(path).withColumn("seq", F.monotonically_increasing_id())
    spans = F.transform("spans", lambda s: F.struct(F.lit("PERSON").alias("entity_type"), s[0].alias("start_pos"), s[1].alias("end_pos"), F.lit(1.0).alias("score")))
    return r.groupBy("id").agg(F.max_by(F.struct(spans.alias("spans"), "ms", "anonymized"), "seq").alias("x")).select("id", "x.*")


def read_conll(spark: SparkSession, path: str, keep: str = "PERSON") -> DataFrame:
    """(sent_id, pos, token, tag) of sentences parted by blank lines, token and tag by a tab; tags of other types become O."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("sent_id", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    rows = blocks.select("sent_id", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    part = F.split("line", "\t")
    tag = F.coalesce(F.get(part, F.lit(1)), F.lit("O"))
    return rows.select("sent_id", "pos", F.get(part, F.lit(0)).alias("token"), F.when(tag.endswith(f"-{keep}"), tag).otherwise("O").alias("tag"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(path)


def standoff(texts: DataFrame, spans: DataFrame, objects: DataFrame) -> DataFrame:
    """Texts (doc, text) with spans (doc, span_id, start_pos, length) named by objects (doc, entity_type, span_ids)."""
    named = objects.select("doc", "entity_type", F.explode("span_ids").alias("span_id")).join(spans, ["doc", "span_id"])
    per = named.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start_pos", (F.col("start_pos") + F.col("length")).alias("end_pos"), "entity_type"))).alias("spans"))
    return texts.join(per, "doc", "left")


def bio_from_json(df: DataFrame, tokens: str, tags: str) -> DataFrame:
    """Token and tag lists given as JSON strings, as arrays."""
    return df.withColumn(tokens, F.from_json(tokens, "array<string>")).withColumn(tags, F.from_json(tags, "array<string>"))


def tags_from_ids(ids: Column, labels: list[str]) -> Column:
    """Integer tags to labels; out of range: O."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.transform(ids, lambda i: F.coalesce(F.get(names, i), F.lit("O")))


def occurrences(text: Column, value: Column) -> Column:
    """(start_pos, end_pos) of every occurrence of a literal value, from the left, without overlap."""
    literal = F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))  # a value may hold the mark that ends a quotation
    parts = F.split(text, F.concat(F.lit("\\Q"), literal, F.lit("\\E")), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_pos:int,end_pos:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x)
        return F.struct((s + F.length(value)).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(s.cast("int").alias("start_pos"), (s + F.length(value)).cast("int").alias("end_pos")))).alias("out"))

    return F.when((value == "") | value.isNull(), F.array().cast("array<struct<start_pos:int,end_pos:int>>")).otherwise(F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), zero, step, lambda a: a["out"]))


def handler_of(path: Column, mime: Column) -> Column:
    """'docx', 'pdf' or 'unsupported' by file ending or MIME type."""
    p = F.lower(path)
    docx = p.endswith(".docx") | (mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    pdf = p.endswith(".pdf") | (mime == "application/pdf")
    return F.when(F.coalesce(docx, F.lit(False)), "docx").when(F.coalesce(pdf, F.lit(False)), "pdf").otherwise("unsupported")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARTS = re.compile(r"word/(document|header\d*|footer\d*)\.xml$")


def docx_paragraphs(content: bytes) -> Iterator[tuple[str, int, int | None, str]]:
    """(part, paragraph number, table row number or None, text) of body, tables at any depth, headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if _PARTS.match(n)):
            root = ElementTree.fromstring(z.read(name))
            row_of = {id(p): k for k, tr in enumerate(root.iter(f"{_W}tr")) for p in tr.iter(f"{_W}p")}
            for k, p in enumerate(root.iter(f"{_W}p")):
                text = "".join((t.text or "") if t.tag == f"{_W}t" else "\t" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab"))
                yield name, k, row_of.get(id(p)), text


def docx_flags(content: bytes) -> tuple[bool, bool]:
    """Whether there are tracked insertions, and comments."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = z.read("word/document.xml")
        return b"<w:ins " in body, any(n.startswith("word/comments") for n in z.namelist())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, paragraph, table_row, text, tracked_insertions, comments) of .docx files; files that aren't such give one row with a null part."""
    schema = "path string, part string, paragraph int, table_row int, text string, tracked_insertions boolean, comments boolean"

    def run(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    flags = docx_flags(c)
                    rows += [(p, part, k, r, t, *flags) for part, k, r, t in docx_paragraphs(c)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((p, None, None, None, None, None, None))
            out = pd.DataFrame(rows, columns=["path", "part", "paragraph", "table_row", "text", "tracked_insertions", "comments"])
            out["table_row"] = out["table_row"].astype("Int32")
            out["paragraph"] = out["paragraph"].astype("Int32")
            yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_chat_tables(spark: SparkSession, url: str, partitions: int = 16, **options: str) -> dict[str, DataFrame]:
    """contacts, conversations and messages over JDBC, partitioned by id; filters and columns are pushed down. An empty url is an error at once."""
    if not url:
        raise ValueError("no database url")
    out = {}
    for t in ("contacts", "conversations", "messages"):
        base = spark.read.format("jdbc").option("url", url).options(**options)
        lo, hi = base.option("query", f"select min(id), max(id) from {t}").load().first()
        out[t] = base.options(dbtable=t, partitionColumn="id", lowerBound=str(lo or 0), upperBound=str((hi or 0) + 1), numPartitions=str(partitions), fetchsize="10000").load()
    return out
