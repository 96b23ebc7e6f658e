"""Feature frame, technical, commercial and priority scores, and rankings drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.scoring import clamp, half_life_freshness, rounded, tier_quality
from scholarloom.functions.text import first_sentence
from scholarloom.operators.catalog import Tables, base_papers, linked_artifacts
from scholarloom.operators.ordered import latest_by


def analyzed_works(t: Tables) -> DataFrame:
    return t["runs"].filter("status = 'succeeded'").select("work_id").distinct()


def linked_signals(t: Tables, *, active_only: bool = False) -> DataFrame:
    """(work_id, linked_authority, linked_novelty, linked_corroboration); corrected links count by default."""
    artifacts = linked_artifacts(t, active_only=active_only).groupBy("work_id").agg(
        F.max("authority").alias("linked_authority"), F.max("novelty").alias("linked_novelty"))
    events = t["events"].filter("primary_work_id IS NOT NULL").groupBy(F.col("primary_work_id").alias("work_id")).agg(
        F.max("corroboration").alias("linked_corroboration"))
    return events.join(artifacts, "work_id", "left")


SIGNALS = {"relevance": "double", "_doc": "boolean", "_code": "boolean", "_run": "boolean", "linked_authority": "double", "linked_novelty": "double", "linked_corroboration": "double"}


def _signals(t: Tables, weights: DataFrame, *, active_only: bool) -> DataFrame:
    """One row per work that any other table says something about, with ``SIGNALS``.

    All sides become rows of one shape and are combined by one aggregation, so a task holds one table of works instead of a sorted copy of each side.
    """
    done = t["documents"].filter(F.col("parse_status").isin(settings.PARSED_STATES)).select("version_id")
    yes = F.lit(True)
    sides = [
        (t["work_topics"].join(weights, "topic_key"), {"relevance": F.col("user_weight")}),
        (t["versions"].join(done, "version_id", "left_semi"), {"_doc": yes}),
        (t["external_ids"].filter("id_type = 'github'"), {"_code": yes}),
        (t["runs"].filter("status = 'succeeded'"), {"_run": yes}),
        (linked_artifacts(t, active_only=active_only), {"linked_authority": F.col("authority"), "linked_novelty": F.col("novelty")}),
        (t["events"].filter("primary_work_id IS NOT NULL").withColumnRenamed("primary_work_id", "work_id"), {"linked_corroboration": F.col("corroboration")}),
    ]
    rows = reduce(DataFrame.unionByName, [
        side.select("work_id", *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SIGNALS.items()]) for side, given in sides])
    return rows.groupBy("work_id").agg(*[F.max(name).alias(name) for name in SIGNALS])


def feature_frame(t: Tables, as_of: Column, *, limit: int | None = None, active_only: bool = False) -> DataFrame:
    """One row per open paper with all features; ``limit`` keeps the newest ones."""
    papers = base_papers(t)
    if limit is not None:
        papers = papers.orderBy(F.coalesce("first_published_at", "created_at").desc_nulls_last(), "work_id").limit(limit)
    weights = F.broadcast(t["topics"].filter("active").select("topic_key", "user_weight"))
    frame = papers.select("work_id", "title", "abstract", "publication_status", "trust_tier", "first_published_at").join(
        _signals(t, weights, active_only=active_only), "work_id", "left")
    has_document, has_code = F.col("_doc").isNotNull(), F.col("_code").isNotNull()
    authority, novelty, corroborated = (
        F.coalesce(c, F.lit(0.0)) for c in ("linked_authority", "linked_novelty", "linked_corroboration"))
    frame = frame.withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    features = {
        "R": F.col("relevance"),
        "N": F.least(F.lit(1.0), 0.5 + 0.2 * novelty + 0.1 * corroborated),
        "E": F.when(has_document, 0.65).otherwise(0.25),
        "P": F.when(has_document & has_code, 0.9).when(has_document, 0.55).otherwise(0.25),
        "I": F.lit(0.5),
        "M": F.lit(0.5),
        "Q": F.greatest(tier_quality(F.col("trust_tier"), F.col("publication_status")), authority),
        "F": half_life_freshness(as_of, F.col("first_published_at")),
    }
    commercial = {key: F.lit(0.5) for key in settings.COMMERCIAL_WEIGHTS}
    commercial["B"] = F.when(has_document, 0.6).otherwise(0.45)
    commercial["X"] = F.col("relevance") * 0.5
    return frame.select(
        "work_id", "title", "abstract", "relevance", has_document.alias("has_document"), has_code.alias("has_code"),
        F.col("_run").isNotNull().alias("analyzed"),
        (F.col("relevance") >= settings.CRITICAL_RELEVANCE).cast("int").alias("critical_topic"),
        F.struct(*[v.alias(k) for k, v in features.items()]).alias("technical"),
        F.struct(*[v.alias(k) for k, v in commercial.items()]).alias("commercial"))


def _components(group: str, weights: dict[str, float]) -> dict[str, Column]:
    return {k: rounded(F.col(f"{group}.{k}") * w * 100, 4) for k, w in weights.items()}


def score(
    features: DataFrame, *, penalty: Column | None = None, human_cost: Column | None = None,
    technical_weights: dict[str, float] = settings.TECHNICAL_WEIGHTS,
    commercial_weights: dict[str, float] = settings.COMMERCIAL_WEIGHTS,
) -> DataFrame:
    """Components and the three totals. ``penalty`` and the budget term ``human_cost`` are off by default."""
    technical, commercial = _components("technical", technical_weights), _components("commercial", commercial_weights)
    taken = F.lit(0.0) if penalty is None else penalty
    cost = F.lit(0.0) if human_cost is None else 10 * human_cost
    scored = features.withColumn("technical_components", F.struct(*[v.alias(k) for k, v in technical.items()])).withColumn(
        "commercial_components", F.struct(*[v.alias(k) for k, v in commercial.items()]))

    def total(group: str, keys: dict) -> Column:
        names = list(keys)
        return sum((F.col(f"{group}.{k}") for k in names[1:]), F.col(f"{group}.{names[0]}"))

    scored = scored.withColumn("technical_raw", clamp(total("technical_components", technical) - taken)).withColumn(
        "commercial_raw", clamp(total("commercial_components", commercial)))
    priority = clamp(
        0.55 * F.col("technical_raw") + 0.30 * F.col("commercial_raw") + 15 * F.col("critical_topic")
        - 20 * F.col("analyzed").cast("int") - cost)
    return (
        scored.withColumn("technical_score", rounded(F.col("technical_raw"), 4))
        .withColumn("commercial_score", rounded(F.col("commercial_raw"), 4))
        .withColumn("priority_score", rounded(priority, 4))
        .drop("technical_raw", "commercial_raw"))


def result_rows(scored: DataFrame, profile: str) -> DataFrame:
    """Long-form results, three kinds per work, with their components as key-ordered JSON."""
    priority = F.struct(
        (20 * F.col("analyzed").cast("int")).alias("already_analyzed_penalty"), F.col("commercial_score").alias("commercial"),
        (15 * F.col("critical_topic")).alias("critical_topic_bonus"), F.col("technical_score").alias("technical"))

    def in_order(group: str, weights: dict[str, float]) -> Column:
        return F.to_json(F.struct(*[F.col(f"{group}.{k}").alias(k) for k in sorted(weights)]))

    kinds = F.array(
        F.struct(F.lit("technical").alias("score_kind"), F.col("technical_score").alias("total_score"),
                 in_order("technical_components", settings.TECHNICAL_WEIGHTS).alias("components_json")),
        F.struct(F.lit("commercial").alias("score_kind"), F.col("commercial_score").alias("total_score"),
                 in_order("commercial_components", settings.COMMERCIAL_WEIGHTS).alias("components_json")),
        F.struct(F.lit("deep_dive_priority").alias("score_kind"), F.col("priority_score").alias("total_score"),
                 F.to_json(priority).alias("components_json")))
    snapshot = F.to_json(F.struct("technical", "commercial", "critical_topic"))
    return scored.select("work_id", F.lit(profile).alias("profile"), F.explode(kinds).alias("k"), snapshot.alias("feature_snapshot_json")).select(
        "work_id", "profile", "k.*", "feature_snapshot_json")


def insert_results(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Results that are not stored yet; stored ones of a profile never change."""
    return new.join(existing.select("work_id", "profile", "score_kind"), ["work_id", "profile", "score_kind"], "left_anti")


def insert_summary(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Ranked works, created and reused results."""
    stored = existing.select("work_id", "profile", "score_kind", F.lit(True).alias("_old"))
    joined = new.join(stored, ["work_id", "profile", "score_kind"], "left")
    return joined.agg(
        (F.count("*") / 3).cast("bigint").alias("works_ranked"), F.count_if(F.col("_old").isNull()).alias("results_created"),
        F.count_if(F.col("_old").isNotNull()).alias("results_reused"))


def ranked(t: Tables, kind: str, limit: int | None = 10) -> DataFrame:
    """Best works of a score kind with status and the first sentence of the abstract as reason."""
    scores = t["results"].filter(F.col("score_kind") == kind).select("work_id", "total_score")
    top = scores.orderBy(F.col("total_score").desc(), "work_id")
    top = top if limit is None else top.limit(limit)
    current = t["works"].select("work_id", F.col("current_version_id").alias("version_id")).join(
        t["versions"].select("version_id", "title", "abstract"), "version_id")
    return (
        top.join(current, "work_id").join(analyzed_works(t).withColumn("_run", F.lit(True)), "work_id", "left")
        .select("work_id", "title", "total_score", first_sentence(F.col("abstract"), settings.TEXTS["no_abstract"]).alias("reason"),
                F.when(F.col("_run").isNotNull(), "analyzed").otherwise("unreviewed").alias("status")))


def tiered_selection(t: Tables, day_start: Column, limit: int = 3) -> DataFrame:
    """Works for a deep report: today's successes, then failed jobs, then the best with evidence.

    Every tier is cut to ``limit`` before the union: a tier can never give more.
    """
    scores = t["results"].filter("score_kind = 'deep_dive_priority'").select("work_id", "total_score")
    deep = t["runs"].filter("analysis_type = 'deep_dive'")
    done = deep.filter((F.col("status") == "succeeded") & (F.col("created_at") >= day_start))
    retry = t["jobs"].filter(F.col("status").isin("failed", "rejected")).join(scores, "work_id")
    parsed = t["documents"].filter(F.col("parse_status").isin(settings.PARSED_STATES)).join(
        t["spans"].select("document_id"), "document_id", "left_semi").select(F.col("version_id").alias("current_version_id"))
    backed = t["works"].join(parsed, "current_version_id", "left_semi").select("work_id")
    best = scores.join(backed, "work_id", "left_semi")

    def tier(rows: DataFrame, number: int, *order: Column) -> DataFrame:
        # The window ranks the few rows the limit leaves.
        top = rows.orderBy(*order).limit(limit)
        return top.select("work_id", F.lit(number).alias("tier"), F.row_number().over(Window.orderBy(*order)).alias("place"))

    tiers = tier(done, 1, F.col("completed_at").desc(), F.col("run_id").desc()).unionByName(
        tier(retry, 2, F.col("total_score").desc(), F.col("updated_at"), F.col("job_id"))).unionByName(
        tier(best, 3, F.col("total_score").desc(), F.col("work_id")))
    first = tiers.groupBy("work_id").agg(F.min(F.struct("tier", "place")).alias("s"))
    return first.orderBy("s").limit(limit).select("work_id", F.col("s.tier").alias("tier"))


def newest_briefs(t: Tables) -> DataFrame:
    """Every paper with its newest successful brief; papers without one are kept."""
    briefs = t["runs"].filter("analysis_type = 'fast_brief' AND status = 'succeeded'")
    newest = latest_by(briefs.select("work_id", "completed_at", "run_id", "output_json"), ["work_id"], [F.col("completed_at"), F.col("run_id")])
    return t["works"].filter("work_type = 'paper'").select("work_id").join(newest, "work_id", "left")


BRIEF = (
    "work_id string, change string, problem string, contribution string, technical_relevance string, "
    "commercial_relevance string, evidence_state string, code_state string, recommended_action string, "
    "limitations array<string>, claims array<struct<text:string,type:string,evidence_ids:array<string>>>, schema_version string"
)


def model_signals(briefs: DataFrame, usable: Column) -> DataFrame:
    """Bounded signals from validated briefs (work_id, run_id, brief); shown beside scores, never added.

    ``usable`` says that the brief passed validation; the others get the neutral fallback.
    """
    b = F.col("brief")
    cited = F.size(F.filter(b["claims"], lambda c: F.size(c["evidence_ids"]) > 0))
    confidence = F.least(F.lit(1.0), cited / F.greatest(F.lit(1), F.size(b["claims"])))

    def proxy(base: float, text: Column, scale: int) -> Column:
        return F.least(F.lit(1.0), base + F.length(text) / scale)

    signals = {
        "novelty": proxy(0.4, b["contribution"], 1600), "method_depth": proxy(0.35, b["technical_relevance"], 1600),
        "impact": proxy(0.35, b["change"], 640), "opportunity": proxy(0.35, b["commercial_relevance"], 1600),
    }
    ok = F.coalesce(usable, F.lit(False))
    frame = briefs.select("work_id", "run_id", *[F.when(ok, v).otherwise(0.5).alias(k) for k, v in signals.items()],
                          F.when(ok, confidence).otherwise(0.0).alias("confidence"), (~ok).alias("fallback"),
                          F.when(ok, F.array_distinct(F.flatten(F.transform(b["claims"], lambda c: c["evidence_ids"]))))
                          .otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    mean = (F.col("novelty") + F.col("method_depth") + F.col("impact") + F.col("opportunity")) / 4
    raw = (mean - 0.5) * 5 * F.col("confidence")
    return frame.withColumn("refinement", clamp(raw, -2.5, 2.5))
