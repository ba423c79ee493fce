"""Word documents in a table: found, masked paragraph by paragraph and row by row, and written back as documents."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from veilframe.operators.anonymize import anonymize, row_context
from veilframe.session import written
from veilframe.sources.readers import _PARTS, _W, docx_flags, docx_paragraphs

#: Bytes of a document at most; larger ones are refused.
MOST_BYTES = 20_000_000
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def limit_error(df: DataFrame, content: str = "content", most: int = MOST_BYTES, pages: str | None = None, most_pages: int = 200) -> DataFrame:
    """Adds error: 'empty' (no bytes), 'too_large', 'too_many_pages' (by a column of page counts, if given) or null."""
    n = F.length(content)
    e = F.when(F.col(content).isNull() | (n == 0), "empty").when(n > most, "too_large")
    return df.withColumn("error", e if pages is None else e.when(F.col(pages) > most_pages, "too_many_pages"))


def paragraphs_of(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, part, paragraph, table_row, text, tracked_insertions, comments) of documents in a table; contents that are no document give one row with a null part."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, part string, paragraph int, table_row int, text string, tracked_insertions boolean, comments boolean"

    def run(batches):
        for pdf in batches:
            rows = []
            for k, c in zip(pdf[key], pdf[content]):
                try:
                    flags = docx_flags(c)
                    rows += [(k, part, n, r, t, *flags) for part, n, r, t in docx_paragraphs(c)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                    rows.append((k, None, None, None, None, None, None))
            out = pd.DataFrame(rows, columns=[key, "part", "paragraph", "table_row", "text", "tracked_insertions", "comments"])
            out["paragraph"], out["table_row"] = out["paragraph"].astype("Int32"), out["table_row"].astype("Int32")
            yield out

    return df.select(key, content).mapInPandas(run, schema)


def rewritten(content: bytes, texts: dict[tuple[str, int], str]) -> bytes:
    """A document with the paragraphs named by (part, number) given new texts: the first run gets the text, the others are emptied. Deleted text kept for review and the
    authors, titles and other core properties are removed; all other parts are copied as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            raw = z.read(item.filename)
            if _PARTS.match(item.filename) or item.filename == "docProps/core.xml":
                for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(raw), events=["start-ns"]):
                    if not prefix.startswith("ns"):
                        ElementTree.register_namespace(prefix, uri)
                root = ElementTree.fromstring(raw)
                if item.filename == "docProps/core.xml":
                    for x in root:
                        x.text = ""
                else:
                    for k, p in enumerate(root.iter(f"{_W}p")):
                        new = texts.get((item.filename, k))
                        if new is not None:
                            _set_text(p, new)
                    for parent in list(root.iter()):
                        for x in [x for x in parent if x.tag == f"{_W}del"]:
                            parent.remove(x)
                raw = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            to.writestr(item.filename, raw)
    return out.getvalue()


def _set_text(p: ElementTree.Element, text: str) -> None:
    first = True
    for run in p.iter(f"{_W}r"):
        for t in [t for t in run if t.tag == f"{_W}tab"]:
            run.remove(t)
        for t in run.iter(f"{_W}t"):
            t.text = text if first else ""
            t.set(_SPACE, "preserve")
            first = False


def masked_documents(df: DataFrame, key: str = "path", content: str = "content", names: tuple[str, ...] | None = None) -> DataFrame:
    """(key, masked, n_entities, tracked_insertions, comments, error) of Word documents: the document with personal data replaced.

    A paragraph is looked at as a whole, whatever runs it is split in; cells of a table row in the context of their row, nested tables too. error: 'empty',
    'too_large' or 'broken'; such documents give null. Keys must be unique; null keys are left out. Only taking apart and putting together is Python.
    """
    checked = written(limit_error(df.filter(F.col(key).isNotNull()).select(key, content), content), "documents")
    parts = written(paragraphs_of(checked.filter("error is null"), key, content), "paragraphs")
    some = parts.filter("part is not null")
    plain = anonymize(some.filter("table_row is null"), "text", names=names).select(key, "part", "paragraph", F.col("anonymized").alias("masked"), F.size("entities_found").alias("n"))
    cells = some.filter("table_row is not null").withColumn("__r", F.concat_ws("|", F.col(key).cast("string"), "part", "table_row"))
    rows = row_context(cells, "__r", "paragraph", "text", names).select(key, "part", "paragraph", "masked", (F.col("masked") != F.col("text")).cast("int").alias("n"))
    every = plain.unionByName(rows)
    per = every.groupBy(key).agg(F.collect_list(F.struct("part", "paragraph", "masked")).alias("texts"), F.sum("n").cast("int").alias("n_entities"))
    flags = parts.groupBy(key).agg(F.bool_or(F.col("part").isNull()).alias("broken"), F.max("tracked_insertions").alias("tracked_insertions"), F.max("comments").alias("comments"))

    @F.pandas_udf(T.BinaryType())
    def build(source: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else rewritten(s, {(x["part"], x["paragraph"]): x["masked"] for x in t}) for s, t in zip(source, texts)], dtype=object)

    j = checked.join(flags, key, "left").join(per, key, "left")
    error = F.coalesce("error", F.when(F.col("broken"), "broken"))
    return j.select(key, build(content, "texts").alias("masked"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "tracked_insertions", "comments", error.alias("error"))


def made_document(text: str) -> bytes:
    """A plain document with one paragraph for each line of a text."""
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    lines = []
    for line in text.split("\n"):
        t = escape("".join(c for c in line if c in "\t\r" or c >= " "))
        lines.append(f'<w:p><w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>' if t else "<w:p/>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", head + "".join(lines) + "</w:body></w:document>")
    return out.getvalue()
