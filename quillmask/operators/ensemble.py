"""The whole detection: normalise, detect, drop false positives, reconcile, route."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.text import normalise
from quillmask.operators import detect
from quillmask.operators.reconcile import conflict, reconcile


def detections(docs: DataFrame, normalised: bool = True, recognisers: Iterable[str] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of all detectors' spans without false positives, in the order expressions, recognisers, context, rules.

    recognisers are array columns that detect.ner() made on the text as it is to be searched; pass normalised=False with them.
    """
    recognisers = list(recognisers)
    rows = docs.select(key, (normalise(F.col(text)) if normalised else F.col(text)).alias("text"), *recognisers)
    found = detect.detect(rows)
    spans = detect.explode_spans(found.drop("text"), ["regex", *recognisers, "context", "rules"], (key,))
    return spans.where(~detect.false_positive(F.col("text"), F.col("kind")))


def ensemble(docs: DataFrame, normalised: bool = True, recognisers: Iterable[str] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs(key, text, ...) -> reconciled spans, with the queue they go to. Offsets are those of the text as searched."""
    return reconcile(detections(docs, normalised, recognisers, text, key), (key,))


def stored(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reconciled spans as rows of the two review tables: (detector spans, risk flags). Ids number a document's spans by place."""
    number = F.row_number().over(Window.partitionBy("doc_id", "queue").orderBy("start", "end"))
    rows = spans.dropDuplicates(["doc_id", "start", "end"]).withColumn("span_id", number).withColumn("conflict_types", conflict(F.col("types")))
    common = ("doc_id", "span_id", "start", "end", "text", F.col("primary_type").alias("category"), "confidence_score", F.lit(False).alias("is_manual"), "sources", "agreement_count", "conflict_types")
    detector = rows.where("queue = 'detector'").select(*common)
    risk = rows.where("queue = 'risk_flag'").select(*common, F.concat_ws(",", "sources").alias("pattern_source"))
    return detector, risk
