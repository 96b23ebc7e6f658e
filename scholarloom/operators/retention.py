"""Retention plan over a file inventory. The plan is data; nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.operators.ordered import global_position, sum_before

CUTOFF_FIELD = {"temporary": "modified_at", "quarantine": "modified_at", "raw": "observed_at"}


def retention_plan(inventory: DataFrame, cutoffs: dict[str, Column], budget_bytes: int) -> DataFrame:
    """Files to remove with the rule that chose them.

    ``inventory``: path, area (temporary, quarantine, raw, other), size, modified_at, observed_at,
    record_id. First files older than the cutoff of their area, then the oldest raw files until the
    projected size is within budget; the file that crosses the line is included.
    """
    old = F.lit(False)
    for area, cutoff in cutoffs.items():
        old = old | ((F.col("area") == area) & (F.col(CUTOFF_FIELD[area]) < cutoff))
    marked = inventory.withColumn("_old", F.coalesce(old, F.lit(False)))
    excess = marked.agg((F.sum("size") - F.coalesce(F.sum(F.when(F.col("_old"), F.col("size"))), F.lit(0)) - budget_bytes).alias("excess"))
    raw = marked.filter("area = 'raw' AND NOT _old")
    placed = global_position(raw.select("path", "size", "observed_at", "record_id"), ["observed_at", "record_id"])
    running = sum_before(placed, [], "pos", F.col("size"), "prior")
    by_budget = running.join(F.broadcast(excess)).filter("prior < excess")
    return marked.filter("_old").select("path", "size", F.lit("age").alias("rule")).unionByName(
        by_budget.select("path", "size", F.lit("budget").alias("rule")))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("rule").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
