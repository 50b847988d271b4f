"""Reconciliation: overlapping detections become one span with sources, types and a confidence, routed to a review queue.

One shuffle of narrow rows by document; texts don't move. Islands of overlapping detections come from a running maximum of ends.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions import vocab


def alias(kind: Column) -> Column:
    out = kind
    for raw, name in vocab.TYPE_ALIASES.items():
        out = F.when(kind == raw, name).otherwise(out)
    return out


def islands(spans: DataFrame, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """spans(keys, ord, start, end, ...) with `island`: detections that overlap, directly or through others, share one. Touching ones don't overlap."""
    by = Window.partitionBy(*keys).orderBy("start", "ord")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__new", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("island", F.sum("__new").over(by)).drop("__new")


def confidence(sources: Column, types: Column, average: Column) -> Column:
    """0 to 100 from the number of sources, recognisers and context among them, types that differ, and a recogniser's own scores."""
    n, kinds = F.size(sources), F.size(types)
    score = F.when(n >= 5, 98).when(n >= 4, 95).when(n == 3, 85).when(n == 2, 70).otherwise(50)
    score = score + F.when(F.arrays_overlap(sources, F.array(F.lit("presidio"), F.lit("spacy"))), 5).otherwise(0) + F.when(F.array_contains(sources, "context"), 5).otherwise(0)
    score = score - F.when(kinds > 1, 10).otherwise(0) - F.when(kinds > 2, 5).otherwise(0)
    blended = (score * F.lit(0.7) + average * F.lit(100.0) * F.lit(0.3)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(blended, score))).cast("int")


def primary_type(types: Column) -> Column:
    """The first of the priority list among the types, else the least in alphabetical order; 'unknown' if there is none."""
    ranked = F.array(*[F.lit(t) for t in vocab.TYPE_PRIORITY])
    return F.coalesce(F.get(F.array_intersect(ranked, types), F.lit(0)), F.array_min(types), F.lit("unknown"))


def queue(primary: Column, score: Column) -> Column:
    return F.when(primary.isin(*vocab.HIGH_CONFIDENCE) | (score >= 80), "detector").otherwise("risk_flag")


def reconcile(spans: DataFrame, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """spans(keys, ord, start, end, text, kind, source, score) -> keys, start, end, text, primary_type, types, sources, agreement_count, confidence_score, queue.

    Sources named after expressions count as 'regex'. text is the longest of the texts, the first in order of (start, ord) on ties.
    Arrays are sorted. Spans with null offsets are ignored.
    """
    keys = list(keys)
    rows = islands(spans.where("start IS NOT NULL AND end IS NOT NULL"), keys)
    rows = rows.withColumn("source", F.when(F.contains("source", F.lit("regex")), "regex").otherwise(F.col("source"))).withColumn("kind", alias(F.col("kind")))
    own = F.when(F.col("score") != 0, F.col("score"))
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("start"), -F.col("ord")))
    out = rows.groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), longest.alias("text"), F.array_sort(F.collect_set("kind")).alias("types"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.avg(own).alias("average"),
    )
    out = out.withColumn("agreement_count", F.size("sources")).withColumn("confidence_score", confidence(F.col("sources"), F.col("types"), F.col("average")))
    out = out.withColumn("primary_type", primary_type(F.col("types")))
    return out.select(*keys, "start", "end", "text", "primary_type", "types", "sources", "agreement_count", "confidence_score", queue(F.col("primary_type"), F.col("confidence_score")).alias("queue"))


def conflict(types: Column) -> Column:
    return F.when(F.size(types) > 1, types)


def overlay(spans: DataFrame, reconciled: DataFrame) -> DataFrame:
    """spans(doc_id, span_type, span_id, start, end, confidence_score, ...) with the sources, agreement and conflict of the first reconciled span they overlap.

    Without one: ['regex'], 1 and null. A confidence that is there stays.
    """
    r = reconciled.select(F.col("doc_id").alias("__doc"), F.col("start").alias("__s"), F.col("end").alias("__e"), "sources", "agreement_count", "types", F.col("confidence_score").alias("__score"))
    hit = spans.select("doc_id", "span_type", "span_id", "start", "end").join(r, (F.col("doc_id") == F.col("__doc")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s")))
    first = hit.groupBy("doc_id", "span_type", "span_id").agg(F.min_by(F.struct("sources", "agreement_count", "types", "__score"), F.struct("__s", "__e")).alias("__r"))
    out = spans.drop("sources", "agreement_count", "conflict_types").join(first, ["doc_id", "span_type", "span_id"], "left")
    rest = [c for c in spans.columns if c not in ("sources", "agreement_count", "conflict_types", "confidence_score")]
    return out.select(
        *rest, F.coalesce("confidence_score", F.col("__r.__score")).alias("confidence_score"), F.coalesce(F.col("__r.sources"), F.array(F.lit("regex"))).alias("sources"),
        F.coalesce(F.col("__r.agreement_count"), F.lit(1)).alias("agreement_count"), conflict(F.col("__r.types")).alias("conflict_types"),
    )


def outside(spans: DataFrame, redacted: DataFrame) -> DataFrame:
    """spans(doc_id, start, end, ...) that overlap none of redacted(doc_id, start, end)."""
    r = redacted.select(F.col("doc_id").alias("__doc"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    return spans.join(r, (F.col("doc_id") == F.col("__doc")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s")), "left_anti")
