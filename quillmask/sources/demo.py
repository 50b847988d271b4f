"""The demonstration letter with its ground truth and a flawed first detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmask.functions.spans import nth_occurrence
from quillmask.operators.detect import detect, explode_spans
from quillmask.operators.ensemble import ensemble
from quillmask.operators.reconcile import outside, overlay

# The letter, and (text, category, occurrence) of what it holds.
LETTER = """THOMPSON & REYNOLDS LAW OFFICES
1847 Market Street, Suite 400
San Francisco, CA 94103

Re: Demand for Payment - Case Reference 847-555-2901

Dear Mr. Marcus Whitfield,

This letter serves as formal notice that our client, Apex Financial Services,
is demanding immediate payment of the outstanding balance owed under Account
Number 4532-8891-2234-5567.

Our records indicate that despite multiple attempts to contact you at
415-867-5309 and via email at marcus.whitfield@techcorp.io, you have failed
to remit payment of $12,450.00 owed since January 15, 2024.

We have verified your identity using the Social Security Number on file
ending in 987-65-4321, and confirmed your current address at 2847 Oak Valley
Drive, San Francisco, CA 94110.

If payment is not received within thirty days of this notice, we will have no
choice but to pursue legal remedies, including but not limited to filing suit
against Marcus Whitfield in San Francisco Superior Court. Such action will
result in additional legal fees and court costs being added to your balance.

Please contact our office immediately at Thompson & Reynolds to arrange
payment. You may reach our collections department at 415-555-0142 or via
email at collections@thompsonreynolds.com.

Sincerely,

Elena Rodriguez
Senior Collections Attorney
Thompson & Reynolds Law Offices
elena.rodriguez@thompsonreynolds.com"""
TRUTH = (
    ("Marcus Whitfield", "name", 1), ("Marcus Whitfield", "name", 2), ("Elena Rodriguez", "name", 1), ("415-867-5309", "phone", 1), ("415-555-0142", "phone", 1),
    ("marcus.whitfield@techcorp.io", "email", 1), ("collections@thompsonreynolds.com", "email", 1), ("elena.rodriguez@thompsonreynolds.com", "email", 1), ("987-65-4321", "ssn", 1),
)
CAUGHT = (
    ("Marcus Whitfield", "name", 1), ("Marcus Whitfield", "name", 2), ("415-555-0142", "phone", 1), ("marcus.whitfield@techcorp.io", "email", 1),
    ("collections@thompsonreynolds.com", "email", 1), ("987-65-4321", "ssn", 1), ("Apex Financial Services", "organization", 1),
    ("San Francisco Superior Court", "organization", 1), ("January 15, 2024", "date", 1), ("$12,450.00", "money", 1),
)


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "Demand for Payment - Thompson & Reynolds", LETTER, "pending_review")], "doc_id long, title string, text string, status string")


def _placed(spark: SparkSession, items: tuple) -> DataFrame:
    docs = documents(spark)
    places = [F.struct(F.lit(i + 1).alias("span_id"), nth_occurrence(F.col("text"), t, n).cast("int").alias("start"), F.lit(t).alias("span_text"), F.lit(c).alias("category")) for i, (t, c, n) in enumerate(items)]
    rows = docs.select("doc_id", F.explode(F.array(*places)).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "span_id", "start", (F.col("start") + F.length("span_text")).alias("end"), F.col("span_text").alias("text"), "category")


def ground_truth(spark: SparkSession) -> DataFrame:
    return _placed(spark, TRUTH).drop("span_id")


def spans(spark: SparkSession) -> DataFrame:
    """The first detection and the second pass over what it left visible, with the ensemble's metadata; one table with span_type."""
    first = _placed(spark, CAUGHT).withColumn("span_type", F.lit("detector")).withColumn("pattern_source", F.lit(None).cast("string"))
    found = explode_spans(detect(documents(spark), ["second_pass"]), ["second_pass"])
    flags = outside(found, first)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    flags = flags.select("doc_id", number.alias("span_id"), "start", "end", "text", F.col("kind").alias("category"), F.lit("risk_flag").alias("span_type"), F.col("source").alias("pattern_source"))
    both = first.unionByName(flags).withColumn("confidence_score", F.lit(None).cast("int"))
    return overlay(both, ensemble(documents(spark)))
