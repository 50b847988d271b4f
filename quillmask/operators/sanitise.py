"""Sanitisation: approved spans become bars, brackets or consistent pseudonyms.

Spans are gathered by document (they are few), numbered there, and spliced into the text in one join; texts aren't shuffled more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions import vocab
from quillmask.functions.spans import splice
from quillmask.functions.text import strip
from quillmask.operators.review import latest_decisions


def approved(detector: DataFrame, risk: DataFrame, decisions: DataFrame) -> DataFrame:
    """Detector spans decided 'approve' and risk flags decided 'redact', latest decision each -> doc_id, span_type, span_id, start, end, text, category; a null category is 'unknown'."""
    fields = ("doc_id", "span_id", "start", "end", "text", F.coalesce("category", F.lit("unknown")).alias("category"))
    rows = detector.select(*fields, F.lit("detector").alias("span_type")).unionByName(risk.select(*fields, F.lit("risk_flag").alias("span_type")))
    yes = latest_decisions(decisions).where("(span_type = 'detector' AND decision = 'approve') OR (span_type = 'risk_flag' AND decision = 'redact')")
    return rows.join(yes.select("doc_id", "span_type", "span_id"), ["doc_id", "span_type", "span_id"], "left_semi").select("doc_id", "span_type", "span_id", "start", "end", "text", "category")


def _from_right(spans: DataFrame, *fields: str) -> DataFrame:
    """doc_id, edits: a document's spans from right to left, detector spans first on ties."""
    order = F.struct((-F.col("start")).alias("__a"), F.col("span_type").alias("__b"), F.col("span_id").alias("__c"), *fields)
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("edits"))


def replacement(text: Column, style: str) -> Column:
    if style not in vocab.STYLES:
        raise ValueError(f"style must be one of {vocab.STYLES}")
    return F.repeat(F.lit("█"), F.length(text)) if style == "bars" else F.lit("[REDACTED]")


def redact(docs: DataFrame, spans: DataFrame, style: str = "bars", text: str = "text") -> DataFrame:
    """docs(doc_id, text), spans as of approved() -> doc_id, content, redactions, redaction_count.

    Bars are as long as the span's text, not as its range. redactions lists original, category, start, end and replacement from right to
    left. Documents without approved spans stay as they are, with none.
    """
    own = spans.withColumn("replacement", replacement(F.col("text"), style)).withColumnRenamed("text", "original")
    rows = docs.select("doc_id", F.col(text).alias("text")).join(_from_right(own, "original", "category", "start", "end", "replacement"), "doc_id", "left")
    listed = F.transform(F.col("edits"), lambda x: F.struct(x["original"].alias("original"), x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement")))
    none = F.array().cast("array<struct<original: string, category: string, start: int, end: int, replacement: string>>")
    rows = rows.withColumn("redactions", F.coalesce(listed, none))
    return rows.select("doc_id", splice(F.col("text"), F.col("redactions")).alias("content"), "redactions", F.size("redactions").alias("redaction_count"))


def prefix(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.PSEUDONYM_PREFIXES.items() for x in kv])
    return F.coalesce(F.element_at(table, category), F.lit("ENTITY"))


def normal(text: Column) -> Column:
    return strip(F.lower(text))


def counters(mappings: DataFrame) -> DataFrame:
    """mappings(doc_id, pseudonym, ...) -> doc_id, prefix, used: the largest number given out; labels that don't end in a number are ignored."""
    n = F.expr("try_cast(substring_index(pseudonym, '_', -1) AS int)")
    head = F.regexp_replace("pseudonym", "_[^_]*$", "")
    return mappings.where(F.contains("pseudonym", F.lit("_"))).select("doc_id", head.alias("prefix"), n.alias("n")).where("n IS NOT NULL").groupBy("doc_id", "prefix").agg(F.max("n").alias("used"))


def pseudonyms(spans: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """spans as of approved() -> the mappings they need beside the existing ones: doc_id, original_text, normalized_text, category, pseudonym.

    A label is a category's prefix and a number; categories that share a prefix share its numbers. Numbers follow the order from the
    document's end, after those already given out. original_text is the spelling met first in that order.
    """
    seen = F.struct((-F.col("start")).alias("a"), F.col("span_type").alias("b"), F.col("span_id").alias("c"))
    rows = spans.select("doc_id", "category", normal(F.col("text")).alias("normalized_text"), F.col("text").alias("original_text"), seen.alias("seen"))
    first = rows.groupBy("doc_id", "category", "normalized_text").agg(F.min("seen").alias("seen"), F.min_by("original_text", "seen").alias("original_text"))
    first = first.withColumn("prefix", prefix(F.col("category")))
    used: Column = F.lit(0)
    if existing is not None:
        first = first.join(existing.select("doc_id", "category", "normalized_text"), ["doc_id", "category", "normalized_text"], "left_anti")
        first, used = first.join(counters(existing), ["doc_id", "prefix"], "left"), F.coalesce("used", F.lit(0))
    number = F.row_number().over(Window.partitionBy("doc_id", "prefix").orderBy("seen")) + used
    return first.select("doc_id", "original_text", "normalized_text", "category", F.concat_ws("_", "prefix", number.cast("string")).alias("pseudonym"))


def pseudonymise(docs: DataFrame, spans: DataFrame, existing: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs, spans as of approved() -> doc_id, content, mapping (original text -> pseudonym), mapping_count, of new and existing mappings."""
    made = pseudonyms(spans, existing)
    mappings = made if existing is None else existing.select(*made.columns).unionByName(made)
    label = mappings.select("doc_id", "category", "normalized_text", F.col("pseudonym").alias("replacement"))
    own = spans.withColumn("normalized_text", normal(F.col("text"))).join(label, ["doc_id", "category", "normalized_text"])
    edits = _from_right(own, "start", "end", "replacement").withColumn("edits", F.transform("edits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"))))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(edits, "doc_id", "left").join(mapping_dict(mappings), "doc_id", "left")
    none = F.array().cast("array<struct<start: int, end: int, replacement: string>>")
    return rows.select(
        "doc_id", splice(F.col("text"), F.coalesce("edits", none)).alias("content"), F.coalesce("mapping", F.create_map().cast("map<string, string>")).alias("mapping"), F.coalesce("mapping_count", F.lit(0)).cast("bigint").alias("mapping_count")
    )


def mapping_dict(mappings: DataFrame) -> DataFrame:
    """mappings -> doc_id, mapping, mapping_count. Of equal originals the later label counts (by category, then normal text)."""
    last = mappings.groupBy("doc_id", "original_text").agg(F.max_by("pseudonym", F.struct("category", "normalized_text")).alias("pseudonym"), F.count("*").alias("n"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("original_text", "pseudonym")))).alias("mapping"), F.sum("n").alias("mapping_count"))


def sanitise(docs: DataFrame, spans: DataFrame, mode: str, style: str = "bars", existing: DataFrame | None = None) -> DataFrame:
    """doc_id, mode, redaction_style (redact only), content, mapping (pseudonymize only), count."""
    if mode not in vocab.MODES:
        raise ValueError(f"mode must be one of {vocab.MODES}")
    if mode == "redact":
        out = redact(docs, spans, style)
        return out.select("doc_id", F.lit(mode).alias("mode"), F.lit(style).alias("redaction_style"), "content", F.lit(None).cast("map<string, string>").alias("mapping"), F.col("redaction_count").cast("bigint").alias("count"))
    out = pseudonymise(docs, spans, existing)
    return out.select("doc_id", F.lit(mode).alias("mode"), F.lit(None).cast("string").alias("redaction_style"), "content", "mapping", F.col("mapping_count").alias("count"))


def output_rows(sanitised: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows of sanitise() as the table of outputs stores them, with the time, now unless given, at which they were made."""
    return sanitised.select("doc_id", "mode", "redaction_style", "content", "mapping", (F.current_timestamp() if at is None else at).alias("created_at"))
