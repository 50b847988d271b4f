"""Mixing sources to target weights by subset-sum budget fitting.

Texts are scanned once for their sizes; everything after that is on narrow rows. Each source's target is whole rounds through all its
documents plus a remainder. The remainder is fitted on the histogram of exact sizes: an even share of every size, then longest first
down to a small budget, then a bounded knapsack over bits for what is left. Of a size the documents with the smallest seeded hashes are
taken: ranges of hashes are counted, and only the range in which the last one lies is looked into, so that a hot source or a hot size is
never ranked in one task. A row of the histogram then says of every document whether it is taken, and texts don't move.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import WORD, at_workers, materialise, small, written

#: Words that the knapsack fits exactly; ranges of hashes, as a power of two, at least; rows of a range at most, on average.
KNAPSACK_WORDS, RANGE_BITS, RANGE_ROWS = 16_384, 8, 1_000_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(source: Column) -> Column:
    """A source as a key that is never null, in code-point order with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(totals: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """totals(key, source_size), one row a source -> with target: weighted shares of all words, none above most * source_size.

    A source is capped if its cap is below the share that it would get with all sources of smaller cap a weight capped.
    """
    place = F.row_number().over(Window.orderBy("key"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("weight", F.element_at(cycle, F.pmod(place - 1, F.lit(len(weights))) + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, onward, all_rows = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("rate", left / F.sum("weight").over(onward)).withColumn("free", F.col("cap") / F.col("weight") >= F.col("rate"))
    rate = F.first(F.when(F.col("free"), F.col("rate")), ignorenulls=True).over(all_rows)
    return rows.select("key", "source_size", F.when(F.col("free"), F.col("weight") * rate).otherwise(F.col("cap")).alias("target"))


def fit(sizes: list[int], counts: list[int], budget: int, knapsack: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each size to take so that their words come as near to the budget from below as found."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    take = [budget * c // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, take))
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i] and left > knapsack:
            n = min(counts[i] - take[i], (left - knapsack) // sizes[i])
            take[i] += n
            left -= n * sizes[i]
    reach, past, items = 1, [], []
    mask = (1 << (left + 1)) - 1
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        spare, lot = counts[i] - take[i], 1
        while sizes[i] and spare > 0 and sizes[i] <= left and not reach >> left & 1:
            lot = min(lot, spare)
            past.append(reach)
            items.append((i, lot))
            reach |= reach << (lot * sizes[i]) & mask
            spare -= lot
            lot *= 2
    at = reach.bit_length() - 1
    for before, (i, lot) in zip(reversed(past), reversed(items)):
        if not before >> at & 1:
            take[i] += lot
            at -= lot * sizes[i]
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram -> rounds through all its documents and how many of each size to take besides."""
    rows = rows.sort_values("size")
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    rounds = min(int(target // total), 3) if total else 0
    take = fit([int(x) for x in rows["size"]], [int(x) for x in rows["n"]], round(target) - rounds * total)
    return pd.DataFrame({"key": rows["key"], "size": rows["size"], "rounds": rounds, "take": take})


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with __key, __size and __draw, a non-negative hash of the seed and all that tells a row apart here."""
    text = F.col("text").cast("string")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), text).bitwiseAND(F.lit((1 << 63) - 1))
    return docs.withColumns({"__key": key_of(F.col("source")), "__size": size_of(text), "__draw": draw})


def _cuts(rows: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """rows(key, size, draw), written -> for each key and size: source_size, target, rounds, cut, some, among.

    A document is taken `rounds` times, and once more if its draw is below `cut`; of the `among` rows whose draw is `cut`, `some` are.
    """
    count = getattr(rows, "known_rows", None)
    count = rows.count() if count is None else count
    bits = max(RANGE_BITS, (count // RANGE_ROWS).bit_length())
    rows = rows.withColumn("part", F.shiftright("draw", 63 - bits))
    parts = materialise(rows.groupBy("key", "size", "part").agg(F.count("*").alias("n")), "mix-parts")
    lengths = parts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    aims = materialise(targets(lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "mix-targets")
    # Spark's own writer: materialise() would run a second Python worker in each of these tasks
    fitted = written(lengths.join(aims, "key").groupBy("key").applyInPandas(_fit_source, "key string, size bigint, rounds int, take bigint"), "mix-fitted")
    upto = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(fitted, ["key", "size"]).where("take > before AND take <= before + n")
    last = materialise(last.select("key", "size", "part", (F.col("take") - F.col("before")).alias("quota")), "mix-ranges")
    drawn = rows.join(last, ["key", "size", "part"]).groupBy("key", "size", "quota", "draw").agg(F.count("*").alias("among"))
    upto = Window.partitionBy("key", "size").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("some", F.col("quota") - F.coalesce(F.sum("among").over(upto), F.lit(0))).where("some > 0 AND some <= among")
    cuts = fitted.join(drawn.select("key", "size", F.col("draw").alias("cut"), "some", "among"), ["key", "size"], "left").join(aims, "key")
    # without a cut no draw is below it
    return materialise(cuts.select("key", "size", "source_size", "target", "rounds", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("some", F.lit(0)).alias("some"), F.coalesce("among", F.lit(0)).alias("among")), "mix-cuts")


def _tied() -> Column:
    """Whether a row is one of several equal ones of which some are taken."""
    return (F.col("draw") == F.col("cut")) & (F.col("some") < F.col("among"))


def _copies() -> Column:
    return (F.col("rounds") + (F.col("draw") <= F.col("cut")).cast("int")).cast("int")


def _bytes() -> Column:
    return F.octet_length("key") + 56


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, size, source_size, target, copies, taken; one row for each row of docs.

    size is the number of words; null, empty and blank texts have 0 and take nothing. Sources by code point, a null source last as a
    source of its own, get the weights in turn. copies is how often the mix holds the document, taken its words. The choice depends on
    the seed, doc_id and text alone, so that rows that repeat a doc_id, or have none, go by their text; equal rows are interchangeable.
    Reruns agree. An empty table gives an empty result; other columns of docs are ignored.
    """
    if most > 3:
        raise ValueError("a document is taken three times at most")
    at_workers(docs.sparkSession)
    rows = _sized(docs.select("doc_id", "text", "source"), seed).select("doc_id", F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__draw").alias("draw"))
    rows = materialise(rows, "mix-sizes")
    cuts = _cuts(rows, weights, most)
    chosen = rows.join(small(cuts, size=_bytes()), ["key", "size"])
    out = chosen.withColumn("copies", _copies())
    if cuts.where("some < among").limit(1).count():
        place = F.row_number().over(Window.partitionBy("key", "size").orderBy("draw"))
        ties = chosen.where(_tied()).withColumn("copies", (F.col("rounds") + (place <= F.col("some")).cast("int")).cast("int"))
        out = out.where(~_tied()).unionByName(ties)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as mix() takes it. Names that begin with two underscores are reserved."""
    at_workers(docs.sparkSession)
    own = _sized(docs, seed)
    rows = materialise(own.select(F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__draw").alias("draw")), "mix-sizes")
    cuts = _cuts(rows, weights, most)
    table = cuts.select(F.struct("rounds", "cut", "some", "among").alias("__cut"), F.col("key").alias("__k"), F.col("size").alias("__s"), "key")
    c, draw = F.col("__cut"), F.col("__draw")
    joined = own.join(small(table, size=_bytes()).drop("key"), (F.col("__key") == F.col("__k")) & (F.col("__size") == F.col("__s")))
    tied = (draw == c["cut"]) & (c["some"] < c["among"])
    out = joined.withColumn("__n", c["rounds"] + (draw <= c["cut"]).cast("int"))
    if cuts.where("some < among").limit(1).count():  # equal rows share their copies
        ties = joined.where(tied).dropDuplicates(["__key", "__size", "__draw"]).withColumn("__n", (c["rounds"] * c["among"] + c["some"]).cast("int"))
        out = out.where(~tied).unionByName(ties)
    out = out.where("__n > 0 AND __size > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(docs.columns)
