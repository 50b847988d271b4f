"""The review workflow on an event log: decisions, manual spans, completion, scoring and the viewer's segments.

State is never updated in place. A decision event has doc_id, span_type, span_id, decision and seq; the last one of a span counts, and a
null decision withdraws it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions import vocab
from quillmask.functions.text import urgency

KEY = ["doc_id", "span_type", "span_id"]


def valid_decision(span_type: Column, decision: Column) -> Column:
    out = F.lit(False)
    for kind, allowed in vocab.DECISIONS.items():
        out = out | ((span_type == kind) & (decision.isin(*allowed) | decision.isNull()))
    return out


def latest_decisions(events: DataFrame) -> DataFrame:
    """One row a span: its last decision by seq, unless that withdraws it. Events with a wrong type or decision are ignored."""
    rows = events.where(valid_decision(F.col("span_type"), F.col("decision")))
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("decision"), "seq").alias("e"), F.max("seq").alias("seq"))
    return last.select(*KEY, F.col("e.decision").alias("decision"), "seq").where("decision IS NOT NULL")


def existing_only(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events on spans that there are."""
    return events.join(spans.select(*KEY), KEY, "left_semi")


def typed(detector: DataFrame, risk: DataFrame) -> DataFrame:
    """Both tables' spans with their span_type."""
    return detector.withColumn("span_type", F.lit("detector")).unionByName(risk.withColumn("span_type", F.lit("risk_flag")), allowMissingColumns=True)


def review_items(spans: DataFrame, events: DataFrame) -> DataFrame:
    """spans with a span_type -> with their latest decision, or null, and urgency."""
    return spans.join(latest_decisions(events).select(*KEY, "decision"), KEY, "left").withColumn("urgency", urgency(F.col("span_type"), F.col("category")))


def _order() -> list[Column]:
    return [F.when(F.col("span_type") == "detector", 2).when(F.col("urgency") == "critical", 0).otherwise(1), F.col("start"), F.col("span_id")]


def display_order(items: DataFrame) -> DataFrame:
    """Critical flags, then elevated flags, then detector spans; by place."""
    return items.orderBy("doc_id", *_order())


def places(items: DataFrame) -> DataFrame:
    """items with `place`, an item's number in its document's display order."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*_order())))


def linked(items: DataFrame) -> DataFrame:
    """items(doc_id, text, decision, ...) with `spread`: an undecided span takes the decision of the first decided span of its type with the same text in its document."""
    rows = Window.partitionBy("doc_id", "span_type", "text").orderBy("span_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return items.withColumn("spread", F.coalesce("decision", F.first("decision", ignorenulls=True).over(rows)))


def manual_spans(candidates: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """candidates(doc_id, start, end, category, span_type) that lie within their document and overlap no span of either table, as new spans."""
    inside = candidates.join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id").where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("__t")))
    taken = spans.select(F.col("doc_id").alias("__doc"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    free = inside.join(taken, (F.col("doc_id") == F.col("__doc")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s")), "left_anti")
    kind = F.when(F.col("span_type") == "risk_flag", "risk_flag").otherwise("detector")
    return free.select(
        "doc_id", "start", "end", F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "category", kind.alias("span_type"),
        F.lit(100).alias("confidence_score"), F.lit(True).alias("is_manual"), F.array(F.lit("manual")).alias("sources"), F.lit(1).alias("agreement_count"),
    )


def override_category(spans: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides(doc_id, span_type, span_id, category, seq): the last one of a span replaces its category."""
    last = overrides.groupBy(*KEY).agg(F.max_by("category", "seq").alias("__c"))
    return spans.join(last, KEY, "left").withColumn("category", F.coalesce("__c", "category")).drop("__c")


def without(spans: DataFrame, removed: DataFrame) -> DataFrame:
    """spans but for those removed."""
    return spans.join(removed.select(*KEY), KEY, "left_anti")


def completion(spans: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, detector_count, risk_count, decision_count, complete. Decisions count even if their span is gone."""
    items = spans.groupBy("doc_id").agg(F.count_if(F.col("span_type") == "detector").alias("detector_count"), F.count_if(F.col("span_type") == "risk_flag").alias("risk_count"))
    made = latest_decisions(events).groupBy("doc_id").agg(F.count("*").alias("decision_count"))
    rows = items.join(made, "doc_id", "full")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.select("doc_id", count("detector_count"), count("risk_count"), count("decision_count"))
    return rows.withColumn("complete", F.col("decision_count") >= F.col("detector_count") + F.col("risk_count"))


def status(docs: DataFrame, events: DataFrame, completed: DataFrame) -> DataFrame:
    """doc_id, status: completed if listed, else in_progress once a decision was ever made, withdrawn or not."""
    ever = events.where("decision IS NOT NULL").select("doc_id").distinct().withColumn("__e", F.lit(True))
    done = completed.select("doc_id").distinct().withColumn("__d", F.lit(True))
    state = F.when(F.col("__d"), "completed").when(F.col("__e"), "in_progress").otherwise("pending_review")
    return docs.select("doc_id").join(ever, "doc_id", "left").join(done, "doc_id", "left").select("doc_id", state.alias("status"))


def summary(spans: DataFrame, events: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, exposures_caught, exposures_missed, unnecessary_redactions_fixed, correct_redactions_kept, total_reviewed.

    A span is personal data if the truth has its exact range. Decisions on missing spans count as reviewed only.
    """
    decided = latest_decisions(events)
    exact = truth.select("doc_id", "start", "end").distinct().withColumn("__true", F.lit(True))
    rows = decided.join(spans.select(*KEY, "start", "end"), KEY).join(exact, ["doc_id", "start", "end"], "left").withColumn("real", F.coalesce("__true", F.lit(False)))
    is_ = lambda d, real: F.count_if((F.col("decision") == d) & (F.col("real") == real))
    counts = rows.groupBy("doc_id").agg(is_("redact", True).alias("exposures_caught"), is_("dismiss", True).alias("exposures_missed"), is_("reject", False).alias("unnecessary_redactions_fixed"), is_("approve", True).alias("correct_redactions_kept"))
    total = decided.groupBy("doc_id").agg(F.count("*").alias("total_reviewed"))
    names = ("exposures_caught", "exposures_missed", "unnecessary_redactions_fixed", "correct_redactions_kept")
    return total.join(counts, "doc_id", "left").select("doc_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "total_reviewed")


def completed_summary(spans: DataFrame, events: DataFrame, truth: DataFrame, states: DataFrame) -> DataFrame:
    """summary() of the documents whose status is completed."""
    return summary(spans, events, truth).join(states.where("status = 'completed'").select("doc_id"), "doc_id", "left_semi")


def progress(items: DataFrame) -> DataFrame:
    """doc_id, decided, total, percent, pending_flags, all_decided."""
    done = F.col("decision").isNotNull()
    rows = items.groupBy("doc_id").agg(F.count_if(done).alias("decided"), F.count("*").alias("total"), F.count_if(~done & (F.col("span_type") == "risk_flag")).alias("pending_flags"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.col("decided") / F.col("total") * 100).otherwise(0.0)).withColumn("all_decided", F.col("decided") == F.col("total"))


def cards(items: DataFrame) -> DataFrame:
    """doc_id, span_type, text, first span_id by place, copies: equal texts as one card."""
    return items.groupBy("doc_id", "span_type", "text").agg(F.min_by("span_id", F.struct("start", "span_id")).alias("span_id"), F.min("start").alias("start"), F.count("*").alias("copies"))


def outcome(span_type: Column, decision: Column) -> Column:
    """'redacted', 'released' or, undecided, null."""
    return F.when(((span_type == "detector") & (decision == "approve")) | ((span_type == "risk_flag") & (decision == "redact")), "redacted").when(
        ((span_type == "detector") & (decision == "reject")) | ((span_type == "risk_flag") & (decision == "dismiss")), "released"
    )


def segments(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The document cut for display: doc_id, start, end, text, span_type, span_id; plain pieces have no span. A gap runs from the end of the span before, whatever earlier ones cover."""
    by = Window.partitionBy("doc_id").orderBy("start", "span_type", "span_id")
    rows = spans.select("doc_id", "start", "end", "span_type", "span_id").withColumn("past", F.lag("end", 1, 0).over(by))
    gaps = rows.where("start > past").select("doc_id", F.col("past").alias("start"), F.col("start").alias("end"), F.lit(None).cast("string").alias("span_type"), F.lit(None).cast("int").alias("span_id"))
    last = rows.groupBy("doc_id").agg(F.max_by("end", F.struct("start", "span_type", "span_id")).alias("past"))
    tails = docs.select("doc_id", F.length("text").alias("end")).join(last, "doc_id", "left").select("doc_id", F.coalesce("past", F.lit(0)).alias("start"), "end", F.lit(None).cast("string").alias("span_type"), F.lit(None).cast("int").alias("span_id")).where("start < end")
    pieces = rows.select("doc_id", "start", "end", "span_type", "span_id").union(gaps).union(tails)
    # texts are cut where they lie: a document's pieces go to it, not it to each piece
    listed = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "span_type", "span_id")).alias("p"))
    out = docs.select("doc_id", F.col("text").alias("__t")).join(listed, "doc_id")
    cut = F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(F.col("__t"), x["start"] + 1, x["end"] - x["start"]).alias("text"), x["span_type"].alias("span_type"), x["span_id"].alias("span_id")))
    return out.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")


def undo(history: DataFrame) -> DataFrame:
    """history(doc_id, seq, group_id, ...) without each document's last entry, or, if that has a group, without the whole group."""
    last = history.groupBy("doc_id").agg(F.max("seq").alias("__s"), F.max_by("group_id", "seq").alias("__g"))
    gone = (F.col("seq") == F.col("__s")) | F.coalesce(F.col("group_id") == F.col("__g"), F.lit(False))
    return history.join(last, "doc_id").where(~gone).select(history.columns)


def reset(history: DataFrame, items: DataFrame) -> DataFrame:
    """history without entries on spans whose text is that of a decided span of the same document and type."""
    texts = items.where("decision IS NOT NULL").select("doc_id", "span_type", "text").distinct()
    affected = items.join(texts, ["doc_id", "span_type", "text"], "left_semi").select(*KEY)
    return history.join(affected, KEY, "left_anti")


def dismissals(items: DataFrame, chosen: DataFrame, also_linked: bool) -> DataFrame:
    """Events(KEY, decision) that dismiss the chosen spans, with `also_linked` all undecided ones of the same text and type in their document as well.

    A dismissal has two steps: the first shows what is linked, by linked_to(); the second is this.
    """
    own = items.join(chosen.select(*KEY), KEY, "left_semi")
    if also_linked:
        own = own.select(*KEY).union(linked_to(items, chosen).where("decision IS NULL").select(*KEY)).distinct()
    return own.select(*KEY, F.when(F.col("span_type") == "risk_flag", "dismiss").otherwise("reject").alias("decision"))


def linked_to(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The other items with the text, document and type of a chosen one."""
    texts = items.join(chosen.select(*KEY), KEY, "left_semi").select("doc_id", "span_type", "text").distinct()
    return items.join(texts, ["doc_id", "span_type", "text"], "left_semi").join(chosen.select(*KEY), KEY, "left_anti")


def reset_all(history: DataFrame, docs: DataFrame) -> DataFrame:
    """history without any entry of these documents."""
    return history.join(docs.select("doc_id"), "doc_id", "left_anti")


def log_tail(log: DataFrame, n: int = 3) -> DataFrame:
    """The last n entries of each document's log."""
    return log.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))).where(F.col("__r") <= n).drop("__r")
