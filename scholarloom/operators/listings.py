"""Run listings and daily budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.operators.ordered import latest_by


def preferred_run(runs: DataFrame) -> DataFrame:
    """Per work and analysis type: newest success with an output, else the newest run."""
    good = (F.col("status") == "succeeded") & F.col("output_json").isNotNull()
    return latest_by(runs, ["work_id", "analysis_type"], [good, F.col("created_at"), F.col("run_id")])


def daily_budget(runs: DataFrame, day_start: Column, limits: dict[str, int]) -> DataFrame:
    """Successes since the start of the day and what is left, per analysis type."""
    counted = runs.filter((F.col("status") == "succeeded") & (F.col("created_at") >= day_start)).groupBy("analysis_type").agg(
        F.count("*").alias("n"))
    spark = runs.sparkSession
    frame = spark.createDataFrame(list(limits.items()), "analysis_type string, daily_limit bigint")
    return F.broadcast(frame).join(counted, "analysis_type", "left").select(
        "analysis_type", F.coalesce("n", F.lit(0)).alias("generated"),
        F.greatest(F.lit(0), F.col("daily_limit") - F.coalesce("n", F.lit(0))).alias("remaining"))


def first_writer(authors: DataFrame) -> DataFrame:
    """One author per (work, slot): stored ones first, then the first to arrive."""
    rest = [c for c in authors.columns if c not in ("work_id", "author_order")]
    kept = F.min_by(F.struct(*rest), F.struct(~F.col("stored"), F.col("arrival")))
    return authors.groupBy("work_id", "author_order").agg(kept.alias("_a")).select("work_id", "author_order", "_a.*")
