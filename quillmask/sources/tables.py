"""Tables of the engine as Parquet: scans, look-ups, appends and schemas that grew.

Rows are only ever appended; what replaces or removes is an event that a later read folds in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table; with a schema, columns that older files lack are null."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(StructType([f.__class__(f.name, f.dataType, True) for f in schema])).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def recreate(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def of_document(df: DataFrame, doc_id: int) -> DataFrame:
    """A document's rows; the filter reaches the scan."""
    return df.where(F.col("doc_id") == doc_id)


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def list_documents(docs: DataFrame) -> DataFrame:
    """Documents by id; the demonstration document has id 1."""
    return docs.withColumn("is_demo", F.col("doc_id") == 1).orderBy("doc_id")


def new_rows(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys aren't there yet, to be appended."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def overlapping(spans: DataFrame, doc_id: int, start: int, end: int) -> DataFrame:
    """A document's spans that overlap a range; the filter reaches the scan."""
    return spans.where((F.col("doc_id") == doc_id) & (F.col("start") < end) & (F.col("end") > start))


def cleared(mappings: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings without those of the documents, number of rows that go by document)."""
    gone = doc_ids.select("doc_id").distinct()
    return mappings.join(gone, "doc_id", "left_anti"), mappings.join(gone, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("deleted_count"))


def statistics(**named: DataFrame) -> DataFrame:
    """table, rows of each of the tables given."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in named.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def outputs_of(outputs: DataFrame) -> DataFrame:
    """Stored outputs, newest first."""
    return outputs.orderBy(F.desc("created_at"), F.desc("doc_id"))
