"""Connected components of a table of links, by minimum labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import discard, materialise

def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id that each linked id reaches. Ids without links have no row.

    Each round takes the least label among an id and its neighbours, then the label of that label, so that a star needs two rounds
    and a chain about the logarithm of its length. No links: no rows. Nulls in links are ignored; repeated links change nothing.
    """
    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialise(clean.select(F.col("a").alias("u"), F.col("b").alias("v")).union(clean.select("b", "a")).distinct(), "cc-links")
    labels = both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component"))
    labels = written = materialise(labels, "cc-0")
    for i in range(1, rounds + 1):
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("further"))
        after = step.join(jump, "next", "left").select("id", F.coalesce("further", "next").alias("component"), (F.coalesce("further", "next") != F.col("old")).alias("moved"))
        past, written = written, materialise(after, f"cc-{i}")
        labels = written.drop("moved")
        discard(past)
        if not written.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    discard(both)
    return labels.select("id", "component")
