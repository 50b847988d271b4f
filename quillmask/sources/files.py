"""Documents from files, and results to files.

Files are read by Spark's binaryFile source, so any store that Spark reads will do; bytes are parsed in Arrow batches of a few files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ExtractionError(ValueError):
    """What keeps a file from being read, in words for its sender."""


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word document's body that aren't blank, with a blank line between them."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        paragraphs = []
        for p in body.findall(f"{_W}p"):
            marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
            paragraphs.append("".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter()))
    except Exception as e:
        raise ExtractionError(f"Could not read the Word document; it may be damaged or not a .docx file ({type(e).__name__}).") from e
    text = "\n\n".join(p for p in paragraphs if p.strip()).strip()
    if not text:
        raise ExtractionError("The Word document holds no text.")
    return text


def pdf_text(content: bytes) -> str:
    """The pages' texts with a blank line between them, by pdfplumber where that is installed."""
    try:
        import pdfplumber
    except ImportError as e:
        raise ExtractionError("PDF files can't be read here: pdfplumber is not installed.") from e
    try:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            if not pdf.pages:
                raise ExtractionError("The PDF has no pages.")
            text = "\n\n".join(t.strip() for t in (page.extract_text() for page in pdf.pages) if t).strip()
    except ExtractionError:
        raise
    except Exception as e:
        raise ExtractionError(f"Could not read the PDF; it may be damaged or protected ({type(e).__name__}).") from e
    if not text:
        raise ExtractionError("The PDF holds no text layer.")
    return text


def extract(name: str, content: bytes) -> tuple[str, str]:
    """(text, kind) of a file by its extension."""
    for end, kind, read in ((".pdf", "pdf", pdf_text), (".docx", "docx", docx_text)):
        if name.lower().endswith(end):
            return read(content), kind
    raise ExtractionError(f"Unsupported file '{name}': only .pdf and .docx files are read.")


def _extract(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in it:
        out = []
        for path, content in zip(rows["path"], rows["content"]):
            name, text, kind, error = path.rsplit("/", 1)[-1], None, None, None
            try:
                if not content:
                    raise ExtractionError("The file is empty.")
                text, kind = extract(name, bytes(content))
            except ExtractionError as e:
                error = str(e)
            out.append((path, name, text, kind, error))
        yield pd.DataFrame(out, columns=["path", "name", "text", "kind", "error"])


def ingest(files: DataFrame) -> DataFrame:
    """files(path, content), as binaryFile has them -> path, title, text, kind, status, error, char_count; a row a file, with an error or a text."""
    rows = files.select("path", "content").mapInPandas(_extract, "path string, name string, text string, kind string, error string")
    title = F.concat(F.lit("Uploaded: "), F.regexp_replace("name", r"\.[^.]*$", ""))
    state = F.when(F.col("error").isNull(), "pending_review")
    return rows.select("path", title.alias("title"), "text", "kind", state.alias("status"), "error", F.length("text").alias("char_count"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return ingest(spark.read.format("binaryFile").load(path))


def write_texts(outputs: DataFrame, path: str) -> None:
    """outputs(doc_id, content): each document's text in a folder of its own, sanitized_document=<doc_id>."""
    outputs.select(F.col("content").alias("value"), F.col("doc_id").alias("sanitized_document")).write.partitionBy("sanitized_document").option("lineSep", "\n").text(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One column, json, with each row as an object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(rows: DataFrame, schema: StructType) -> DataFrame:
    """The rows that to_json_rows() wrote; what isn't an object of the schema gives nulls."""
    return rows.select(F.from_json("json", schema).alias("x")).select("x.*")


def with_counts(docs: DataFrame, detector: DataFrame, risk: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, char_count, detector_count, risk_count: what an upload answers once its spans are stored."""
    count = lambda spans, name: spans.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = docs.select("doc_id", F.length("text").alias("char_count")).join(count(detector, "detector_count"), "doc_id", "left").join(count(risk, "risk_count"), "doc_id", "left")
    return rows.select("doc_id", "char_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("detector_count", "risk_count")])
