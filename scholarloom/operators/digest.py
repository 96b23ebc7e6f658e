"""Digests of any range of dates in one job: rows that hold from one moment to another, and the first of them on every date.

A date sees the rows that hold at its end. Spreading every row over all dates it holds on would multiply long-lived rows by the length of the range, so a
row is put on the few nodes of a binary tree over the dates that make up its interval, at most two a level. The first rows of
every node are kept, and a date takes the first of those on its path to the root: the same rows, from logarithmic copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.operators.ordered import next_in_order, top_per_key
from scholarloom.sources.batches import BatchTables

LEVELS = 20  # of the tree: ranges of up to a million dates
ITEM = "struct<id: string, detail: string>"
REPORTS = "report_date date, input_fingerprint string, report_json string"


def part(rows: DataFrame, name: str, ident: Column, order: list[Column], since: Column, *, until: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Rows of one part of the digest: (part, order, id, detail, since, until). ``order``: numbers, smaller first, nulls last; ties by id."""
    key = F.array(*[F.coalesce(o.cast("double"), F.lit(float("inf"))) for o in order])
    return rows.select(F.lit(name).alias("part"), key.alias("order"), ident.cast("string").alias("id"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"),
                       since.cast("timestamp").alias("since"), (F.lit(None) if until is None else until).cast("timestamp").alias("until"))


def current_rows(rows: DataFrame, keys: list[str], moment: str) -> DataFrame:
    """``rows`` with ``until``: the next moment of the same keys. Rows of one key and moment must be one."""
    stamped = rows.withColumn("_at", F.unix_micros(moment))
    return next_in_order(stamped, keys, "_at", "_until", chunk=86_400_000_000).withColumn("until", F.timestamp_micros("_until")).drop("_at", "_until")


def _nodes(begin: Column, end: Column) -> Column:
    """(level, node) of the dates from ``begin`` up to before ``end``."""
    def at(level: int) -> Column:
        size = 1 << level
        a, b = F.ceil(begin / size).cast("bigint"), F.floor(end / size).cast("bigint")
        own = lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))
        return F.when(a < b, F.array(F.when(a % 2 == 1, own(a)), F.when(b % 2 == 1, own(b - 1))))

    return F.filter(F.flatten(F.filter(F.array(*[at(k) for k in range(LEVELS)]), lambda x: x.isNotNull())), lambda x: x.isNotNull())


def on_dates(parts: DataFrame, first: str, last: str, limits: dict[str, int]) -> DataFrame:
    """(report_date, part, position, id, detail): the first rows of every part that hold at the end of each date from ``first`` to ``last``."""
    spark = parts.sparkSession
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    start = F.lit(first).cast("date")
    days = F.datediff(F.lit(last).cast("date"), start) + 1
    begin = F.greatest(F.lit(0), F.datediff(F.col("since").cast("date"), start)).cast("bigint")
    end = F.least(days, F.coalesce(F.datediff(F.col("until").cast("date"), start), days)).cast("bigint")
    most = max(limits.values())
    placed = parts.filter(F.col("part").isin(list(limits))).select("part", "order", "id", "detail", F.explode(_nodes(begin, end)).alias("n")).select("part", "order", "id", "detail", "n.level", "n.node")
    kept = top_per_key(placed, ["part", "level", "node"], [F.col("order"), F.col("id")], most).filter(F.col("rank") <= table[F.col("part")]).drop("rank")
    dates = spark.range(1).select(F.explode(F.sequence(start, F.lit(last).cast("date"))).alias("report_date")).withColumn("_day", F.datediff("report_date", start).cast("bigint"))
    paths = dates.select("report_date", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("_day") / (1 << k)).cast("bigint").alias("node")) for k in range(LEVELS)])).alias("n")).select("report_date", "n.*")
    seen = top_per_key(kept.join(paths, ["level", "node"]), ["report_date", "part"], [F.col("order"), F.col("id")], most, "position").filter(F.col("position") <= table[F.col("part")])
    return seen.select("report_date", "part", "position", "id", "detail")


def linked_sources(seen: DataFrame, links: DataFrame) -> DataFrame:
    """``seen`` events (report_date, id) with the number of sources of their links at the end of each date. ``links``: event_id, source_key, since, until."""
    spans = links.select("event_id", "source_key", "since", "until").distinct()
    close = F.col("report_date") + F.expr("interval 1 day")
    found = seen.select("report_date", "id").distinct().join(spans, F.col("id") == F.col("event_id")).filter((F.col("since") < close) & (F.col("until").isNull() | (F.col("until") >= close)))
    counts = found.select("report_date", "id", "source_key").distinct().groupBy("report_date", "id").agg(F.count("*").alias("sources"))
    return seen.join(counts, ["report_date", "id"], "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


def totals_by_date(moments: DataFrame, first: str, last: str) -> DataFrame:
    """(report_date, name, total): how many rows (name, moment, change) add up to by the end of each date. Rows are counted per day and name first."""
    spark = moments.sparkSession
    start = F.lit(first).cast("date")
    daily = moments.groupBy("name", F.greatest(F.lit(0), F.datediff(F.col("moment").cast("date"), start)).cast("bigint").alias("day")).agg(F.sum("change").alias("change"))
    dates = spark.range(1).select(F.explode(F.sequence(start, F.lit(last).cast("date"))).alias("report_date")).withColumn("_day", F.datediff("report_date", start).cast("bigint"))
    return daily.join(F.broadcast(dates), F.col("day") <= F.col("_day")).groupBy("report_date", "name").agg(F.sum("change").alias("total"))


def reports(seen: DataFrame, totals: DataFrame) -> DataFrame:
    """(report_date, input_fingerprint, report_json): one report per date; every part is an ordered list of at most its limit."""
    lists = seen.groupBy("report_date", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "detail"))), lambda x: F.struct(x["id"].alias("id"), x["detail"].alias("detail"))).alias("items"))
    parts = lists.groupBy("report_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "items")))).alias("parts"))
    counts = totals.groupBy("report_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "total")))).alias("totals"))
    both = parts.join(counts, "report_date", "full").withColumn("report_json", F.to_json(F.struct("report_date", "parts", "totals")))
    return both.select("report_date", F.sha2("report_json", 256).alias("input_fingerprint"), "report_json")


def report_tables(spark, path: str) -> BatchTables:
    """Stored reports: a batch of dates appears whole, a later batch replaces the reports of its dates."""
    return BatchTables(spark, path, {"reports": REPORTS})


def stored_reports(tables: BatchTables) -> DataFrame:
    """The newest report of every date."""
    rows = tables.read("reports")
    return rows.groupBy("report_date").agg(F.max_by(F.struct("input_fingerprint", "report_json"), "batch").alias("r")).select("report_date", "r.*")


def report_items(stored: DataFrame) -> DataFrame:
    """Stored reports taken apart again: (report_date, part, position, id, detail)."""
    parts = F.from_json("report_json", f"parts map<string, array<{ITEM}>>")["parts"]
    return stored.select("report_date", F.explode(parts).alias("part", "items")).select("report_date", "part", F.posexplode("items").alias("position", "item")).select(
        "report_date", "part", "position", "item.id", "item.detail")


def report_totals(stored: DataFrame) -> DataFrame:
    return stored.select("report_date", F.explode(F.from_json("report_json", "totals map<string, bigint>")["totals"]).alias("name", "total"))
