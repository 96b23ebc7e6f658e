"""Rules that stored tables must keep, as rows of what breaks them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(t: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, key): one row with a NULL key for each rule that could be checked, and one row per broken key.

    One current version per work, one work per external id, one result per work, profile and kind of score.
    Only rules whose table is in ``t`` are checked. Keys are counted with partial aggregation, so a hot key costs one row per task.
    """
    rules = {}
    if "versions" in t:
        current = t["versions"].groupBy("work_id").agg(F.count_if("is_current").alias("n"))
        rules["current_versions"] = current.filter("n <> 1").select(F.col("work_id").alias("key"))
    if "external_ids" in t:
        owners = t["external_ids"].groupBy("id_type", "value").agg(F.min("work_id").alias("a"), F.max("work_id").alias("b"))
        rules["external_ids"] = owners.filter("a <> b").select(F.concat_ws(":", "id_type", "value").alias("key"))
    if "results" in t:
        slots = t["results"].groupBy("work_id", "profile", "score_kind").agg(F.count("*").alias("n"))
        rules["results"] = slots.filter("n > 1").select(F.concat_ws(":", "work_id", "profile", "score_kind").alias("key"))
    if not rules:
        raise ValueError("no table to check")
    found = None
    for rule, keys in rules.items():
        checked = keys.sparkSession.range(1).select(F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("key"))
        rows = checked.unionByName(keys.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key")))
        found = rows if found is None else found.unionByName(rows)
    return found
