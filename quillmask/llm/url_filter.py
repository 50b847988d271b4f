"""URL filters as a temporal list join, in DataFrame expressions.

Dated list events (an entry is added or removed) become validity intervals, packed by entry. A capture asks for every host suffix of
its URL and, as deep as the list goes, for every path prefix under its host; it is blocked if one of these entries is valid at its
fetch time. Captures are evaluated once for each distinct (URL, time); the list has one row an entry, so the join multiplies nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import materialise, small

#: List entries up to which the list is broadcast, if it has few bytes; beyond, it is joined by shuffle. A join only, with its own shuffle
#: behind it: where a third of all captures ask for one suffix, adaptive execution splits that partition.
LIST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """events(entry, action, at) -> entry, valid: array of (since, until), half open, until null if it still holds.

    An entry is a host, which covers its subdomains, or host/path, which covers the paths below. It holds from an 'add' to the next
    'remove'; at the same time a removal comes last. Further adds while it holds, removals while it doesn't, repeated events and rows with a
    null or another action change nothing.
    """
    listed = events.where("entry IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select(F.regexp_replace(F.lower("entry"), "/+$", "").alias("entry"), "action", "at").distinct()
    by = Window.partitionBy("entry").orderBy("at", "action")
    # only events that change something part one interval from the next
    turns = listed.withColumn("before", F.lag("action").over(by)).where("before IS NULL OR before <> action")
    spans = turns.withColumn("until", F.lead("at").over(by)).where("action = 'add'").where("until IS NULL OR until > at")
    return spans.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("since"), "until"))).alias("valid"))


def questions(url: Column, depth: int) -> Column:
    """Every list entry that would cover a URL: host suffixes, and path prefixes of up to `depth` segments under the host."""
    host, path = host_of(url), F.regexp_replace(path_of(url), "/+$", "")
    labels, segments = F.split(host, r"\."), F.split(F.regexp_replace(path, "^/+", ""), "/+")
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    deep = F.least(F.lit(depth), F.when(path == "", F.lit(0)).otherwise(F.size(segments)))
    prefixes = F.when(deep >= 1, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.lower(F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def screen(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures(url, fetched, ...) -> all their rows and columns, and blocked, n_entries, entry, since.

    n_entries counts the entries valid at `fetched`; entry is the longest of them (ties by code point) and since the time from which
    it has held. A null url or time, and a URL without a host, is never blocked. An empty list blocks nothing. Columns of captures with
    the four names are replaced.
    """
    made = ("blocked", "n_entries", "entry", "since")
    captures = captures.drop(*made)
    listed = materialise(intervals(events), "url-list")
    depth = listed.agg(F.max(F.size(F.split("entry", "/")) - 1)).head()[0] or 0
    asked = captures.where("url IS NOT NULL AND fetched IS NOT NULL").select(F.col("url").alias("__url"), F.col("fetched").alias("__at")).distinct()
    keys = asked.select("__url", "__at", F.explode(questions(F.col("__url"), depth)).alias("entry"))
    hits = keys.join(small(listed, LIST_ROWS, F.octet_length("entry") + 32 * F.size("valid")), "entry")
    now = F.filter("valid", lambda v: (v["since"] <= F.col("__at")) & (v["until"].isNull() | (F.col("__at") < v["until"])))
    hits = hits.withColumn("since", F.get(now, 0)["since"]).where("since IS NOT NULL")
    best = F.max(F.struct(F.length("entry").alias("size"), "entry", "since"))
    verdicts = materialise(hits.groupBy("__url", "__at").agg(F.count("*").alias("n_entries"), best.alias("best")), "url-hits")
    verdicts = verdicts.select("__url", "__at", "n_entries", F.col("best.entry").alias("entry"), F.col("best.since").alias("since"))
    out = captures.join(verdicts, (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__at")), "left")
    n = F.coalesce("n_entries", F.lit(0)).cast("bigint")
    return out.select(*captures.columns, (n > 0).alias("blocked"), n.alias("n_entries"), "entry", "since")


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages as captures: page_id, url and a fetch date that follows from page_id, as the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and first path segments that occur: a quarter of the hosts and an eighth of the sections, by their
    MD5, are listed during 2024; half of these are removed 90 days later, and a quarter listed again after 60 days more. Every third is
    listed once more after 20 days, while it holds, which changes nothing."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    section = F.concat(host, F.lit("/"), F.lower(F.split(F.regexp_replace(path, "^/+", ""), "/+")[0]))
    entries = pages.where("url IS NOT NULL").select(F.explode(F.array(F.struct(host.alias("entry"), F.lit(4).alias("one_in")), F.struct(section.alias("entry"), F.lit(8).alias("one_in")))).alias("e")).select("e.*").distinct()
    entries = entries.where("entry <> '' AND NOT endswith(entry, '/')").withColumn("m", F.conv(F.substring(F.md5("entry"), 1, 7), 16, 10).cast("bigint")).where("m % one_in = 0")
    day = lambda more: F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("m") / 8).cast("bigint") % 300 + more).cast("int"))
    event = lambda action, more: F.struct(F.lit(action).alias("action"), day(more).alias("at"))
    again = (F.col("m") / 4096).cast("bigint")
    events = F.when(again % 2 == 1, F.array(event("add", 0))).when(again % 4 == 0, F.array(event("add", 0), event("remove", 90), event("add", 150))).otherwise(F.array(event("add", 0), event("remove", 90)))
    more = F.when(F.col("m") % 3 == 0, F.array(event("add", 20))).otherwise(F.array(event("add", 0)))
    return entries.select("entry", F.explode(F.concat(events, more)).alias("e")).select("entry", "e.*")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, (DATE '2024-01-01' + (((page_id % 366) + 366) % 366)::INT)::DATE AS fetched,
    regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
    regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+', ''), '/+$', ''), '/+') AS parts
  FROM pages),
c AS (
  SELECT DISTINCT entry, one_in, ('0x' || substr(md5(entry), 1, 7))::BIGINT AS m FROM (
    SELECT host AS entry, 4 AS one_in FROM p UNION ALL SELECT host || '/' || lower(parts[1]), 8 FROM p)
  WHERE entry <> '' AND NOT ends_with(entry, '/')),
l AS (SELECT entry, (DATE '2024-01-01' + ((m // 8) % 300)::INT)::DATE AS d, m // 4096 AS again FROM c WHERE m % one_in = 0),
i AS (
  SELECT entry, d AS since, CASE WHEN again % 2 = 1 THEN NULL ELSE (d + 90)::DATE END AS until FROM l
  UNION ALL SELECT entry, (d + 150)::DATE, NULL FROM l WHERE again % 4 = 0),
h AS (
  SELECT p.page_id, p.url, i.entry, i.since FROM p JOIN i ON (i.entry = p.host OR ends_with(p.host, '.' || i.entry) OR i.entry = p.host || '/' || lower(parts[1]))
  WHERE i.since <= p.fetched AND (i.until IS NULL OR p.fetched < i.until)),
b AS (SELECT page_id, count(*) AS n, max(struct_pack(s := length(entry), entry := entry, since := since)) AS best FROM h GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched, b.n IS NOT NULL AS blocked, coalesce(b.n, 0)::BIGINT AS n_entries, b.best.entry AS entry, b.best.since AS since
FROM p LEFT JOIN b USING (page_id)
"""
