"""Quality metrics over labelled results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.text import casefold, collapse_space


def _top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows with their rank; the window only sees those k rows."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def precision_at(rows: DataFrame, k: int = 10) -> DataFrame:
    """Share of relevant rows (id, score, relevance) among the first k; always divided by k."""
    top = rows.orderBy(F.col("score").desc(), "id").limit(k)
    return top.agg((F.count_if(F.col("relevance") > 0) / k).alias("precision"))


def _gain(top: DataFrame, name: str) -> DataFrame:
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1)
    return top.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias(name))


def ndcg_at(rows: DataFrame, k: int = 10) -> DataFrame:
    """Gain of the score order over the gain of the best order; 1 when there is nothing to gain."""
    actual = _gain(_top(rows, [F.col("score").desc(), F.col("id")], k), "dcg")
    ideal = _gain(_top(rows, [F.col("relevance").desc(), F.col("id")], k), "idcg")
    return actual.join(ideal).select(F.when(F.col("idcg") == 0, 1.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def completeness(examples: DataFrame) -> DataFrame:
    """Share of examples (fields map<string,boolean>) with every field present."""
    whole = F.forall(F.map_values("fields"), lambda v: v)
    return examples.agg(F.avg(whole.cast("double")).alias("completeness"))


def repetition(texts: DataFrame) -> DataFrame:
    """1 - distinct / total over normalised texts; counted by text first, so a hot text is one row."""
    counted = texts.groupBy(F.sha2(collapse_space(casefold(F.col("text"))), 256).alias("h")).agg(F.count("*").alias("n"))
    return counted.agg((1 - F.count("*") / F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0)))).alias("repetition_rate"))


def claim_rates(claims: DataFrame) -> DataFrame:
    """Citation coverage of factual claims and rejection rate of unsupported ones (one row)."""
    cited = F.count_if(F.col("factual") & F.col("cited")) / F.greatest(F.lit(1), F.count_if("factual"))
    refused = F.count_if(~F.col("supported") & F.col("rejected")) / F.greatest(F.lit(1), F.count_if(~F.col("supported")))
    return claims.agg(cited.alias("citation_coverage"), refused.alias("unsupported_rejection"))


def quality_gate(scores: DataFrame, thresholds: dict[str, float] = settings.QUALITY_THRESHOLDS) -> DataFrame:
    """Adds ``passed``: every score at least its threshold, repetition at most."""
    passed = F.lit(True)
    for name, limit in thresholds.items():
        passed = passed & (F.col(name) <= limit if name == "repetition_rate" else F.col(name) >= limit)
    return scores.withColumn("passed", passed)
