"""Topic assignment and topic overviews. The taxonomy is a handful of rows and is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.text import casefold
from scholarloom.operators.ordered import top_per_key

TOPIC_SCHEMA = "topic_key string, display_name string, parent_key string, user_weight double, active boolean"


def taxonomy(spark: SparkSession, topics: list[tuple] = settings.TOPICS) -> DataFrame:
    """Topic table; unknown parents and cycles are refused."""
    parents = {key: parent for key, _, parent, _ in topics}
    for start in parents:
        seen, at = set(), start
        while at is not None:
            if at in seen or at not in parents:
                raise ValueError(f"topic {start} has a cyclic or unknown parent")
            seen.add(at)
            at = parents[at]
    return spark.createDataFrame([(*t, True) for t in topics], TOPIC_SCHEMA)


def category_map(spark: SparkSession, mapping: list[tuple] = settings.CATEGORY_TOPICS) -> DataFrame:
    rows = [(s.casefold(), c.casefold(), k) for s, c, keys in mapping for k in keys]
    return spark.createDataFrame(rows, "source_key string, category string, topic_key string")


def assign_topics(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """(work_id, topic_key) from ``records`` (work_id, source_key, categories).

    ``unknown`` stays only where nothing else matched. A work may come with several records; its
    topics are the union, so a record without a match adds ``unknown`` on its own account.
    """
    exploded = records.select(
        "work_id", "record_id", casefold(F.trim("source_key")).alias("source_key"),
        F.explode_outer(F.transform("categories", lambda c: casefold(F.trim(c)))).alias("category"))
    mapped = exploded.join(F.broadcast(mapping), ["source_key", "category"], "left")
    known = mapped.filter("topic_key IS NOT NULL AND topic_key <> 'unknown'").select("work_id", "record_id", "topic_key")
    unmatched = records.select("work_id", "record_id").join(known.select("record_id"), "record_id", "left_anti")
    return known.select("work_id", "topic_key").unionByName(
        unmatched.select("work_id", F.lit("unknown").alias("topic_key"))).distinct()


def topic_counts(topics: DataFrame, work_topics: DataFrame, works: DataFrame, versions: DataFrame, day: Column) -> DataFrame:
    """Works per active topic, and those observed on ``day``; topics without works stay, with zero."""
    seen = works.select("work_id", F.col("current_version_id").alias("version_id")).join(
        versions.select("version_id", "observed_at"), "version_id")
    pairs = work_topics.select("topic_key", "work_id").distinct().join(seen.select("work_id", "observed_at"), "work_id", "left")
    counted = pairs.groupBy("topic_key").agg(
        F.count("*").alias("paper_count"), F.count_if(F.to_date("observed_at") == day).alias("daily_change"))
    return topics.filter("active").select("topic_key", "display_name").join(counted, "topic_key", "left").select(
        "topic_key", "display_name", F.coalesce("paper_count", F.lit(0)).alias("paper_count"),
        F.coalesce("daily_change", F.lit(0)).alias("daily_change"))


def top_works_per_topic(work_topics: DataFrame, works: DataFrame, versions: DataFrame, results: DataFrame, count: int = 5) -> DataFrame:
    """Best works of each topic by technical score (missing counts as 0), id breaks ties."""
    scores = results.filter("score_kind = 'technical'").select("work_id", "total_score")
    titled = works.select("work_id", F.col("current_version_id").alias("version_id")).join(
        versions.select("version_id", "title"), "version_id")
    rows = work_topics.select("topic_key", "work_id").distinct().join(titled, "work_id").join(scores, "work_id", "left")
    rows = rows.select("topic_key", "work_id", "title", F.coalesce("total_score", F.lit(0.0)).alias("score"))
    return top_per_key(rows, ["topic_key"], [F.col("score").desc(), F.col("work_id").asc()], count)

