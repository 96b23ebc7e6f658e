"""Registry of the queries, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom.plans.corpus import Corpus, sql_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_STORED: dict[tuple, Corpus] = {}


def corpus_of(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus over the tables of a folder. Its stored views are written once a session, and anew when the listed files of the tables they start from change."""
    files = tuple(sorted(f for name in ("documents", "events") for f in spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles()))
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _STORED:
        for old in [k for k in _STORED if k[:2] == key[:2] or k[0] != key[0]]:
            del _STORED[old]
        _STORED[key] = Corpus(spark, sf_dir)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _STORED[key]


def query(name: str, sql: str | None = None):
    """Register ``function(corpus) -> DataFrame`` under ``name``."""
    def register(function: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: function(corpus_of(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql_with(sql)
        return function

    return register


def shown(moment: Column | str) -> Column:
    """Timestamp as text, so that results compare equal whatever the session zone."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def listed(items: Column | str) -> Column:
    """Array of strings as one text."""
    return F.array_join(items, "|")
