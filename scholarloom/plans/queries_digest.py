"""Digests of a range of dates: stored in two overlapping batches, read back, taken apart."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.operators import digest
from scholarloom.plans.corpus import at, sql_at
from scholarloom.plans.registry import query
from scholarloom.session import durable, shared_dir

LIMITS = {"technical": 10, "commercial": 10, "what_happened": 8, "launches": 8, "community": 8, "updates": 10, "deep_reports": 2, "what_to_build": 3, "hypotheses": 3}
FIRST, MIDDLE, LATE, LAST = "2023-12-30", "2024-01-20", "2024-01-15", "2024-02-12"


def score_history(t) -> DataFrame:
    """Two results per work and kind of score, of different days; the later one takes the place of the first."""
    doc = F.col("first_doc")
    both = F.array(F.struct(at(doc % 20).alias("scored_at"), F.col("total_score").alias("score")), F.struct(at(20 + doc % 10).alias("scored_at"), (100 - F.col("total_score")).alias("score")))
    rows = t["results"].join(t["works"].select("work_id", "first_doc"), "work_id").select("work_id", "score_kind", F.explode(both).alias("r")).select("work_id", "score_kind", "r.*")
    return digest.current_rows(rows, ["work_id", "score_kind"], "scored_at")


def first_evidence(t) -> DataFrame:
    """(work_id, read_at): when the first parsed document of a work was there."""
    parsed = t["documents"].filter(F.col("parse_status").isin("parsed", "partial")).select("version_id", "acquired_at")
    return parsed.join(t["versions"].select("version_id", "work_id"), "version_id").groupBy("work_id").agg(F.min("acquired_at").alias("read_at"))


def digest_parts(t) -> DataFrame:
    """All parts of the digest as rows that hold from one moment to another."""
    scores, id_ = score_history(t), F.col
    newest = lambda moment: [-F.unix_micros(moment)]
    backed = scores.join(first_evidence(t), "work_id").withColumn("since", F.greatest("scored_at", "read_at")).filter("until IS NULL OR since < until")
    artifacts = t["artifacts"].withColumn("moment", F.coalesce("updated_at", "published_at")).filter("moment IS NOT NULL")
    observed = t["versions"].groupBy("work_id", "observed_at").agg(F.max("version_id").alias("version_id"))
    before = observed.groupBy("work_id").agg(F.min("observed_at").alias("first_at"))
    updates = digest.current_rows(observed, ["work_id"], "observed_at").join(before, "work_id").filter("observed_at > first_at")
    deep = t.raw("documents").select(F.col("doc_id").alias("run_id"), at(F.col("doc_id") % 40).alias("completed_at"))
    parts = None
    for name, rows, ident, order, since, until in (
        ("technical", scores.filter("score_kind = 'technical'"), id_("work_id"), [-F.col("score")], F.col("scored_at"), F.col("until")),
        ("commercial", scores.filter("score_kind = 'commercial'"), id_("work_id"), [-F.col("score")], F.col("scored_at"), F.col("until")),
        ("what_to_build", backed.filter("score_kind = 'technical'"), id_("work_id"), [-F.col("score")], F.col("since"), F.col("until")),
        ("hypotheses", backed.filter("score_kind = 'commercial'"), id_("work_id"), [-F.col("score")], F.col("since"), F.col("until")),
        ("what_happened", t["events"].filter("occurred_at IS NOT NULL"), id_("event_id"), newest("occurred_at"), F.col("occurred_at"), None),
        ("launches", artifacts.filter(F.col("artifact_type").isin(settings.LAUNCH_TYPES)), id_("artifact_id"), newest("moment"), F.col("moment"), None),
        ("community", artifacts.filter((F.col("content_class") == "community_reaction") | (F.col("authority") < 0.5)), id_("artifact_id"), newest("moment"), F.col("moment"), None),
        ("updates", updates, id_("version_id"), newest("observed_at"), F.col("observed_at"), F.col("until")),
        ("deep_reports", deep, id_("run_id"), [*newest("completed_at"), -F.col("run_id")], F.col("completed_at"), None),
    ):
        own = digest.part(rows, name, ident, order, since, until=until)
        parts = own if parts is None else parts.unionByName(own)
    return parts


def digest_totals(t, first: str, last: str) -> DataFrame:
    papers = t["works"].filter("work_type = 'paper'").select("work_id", "created_at")
    read = papers.join(first_evidence(t), "work_id").select(F.lit("papers_unread").alias("name"), F.greatest("created_at", "read_at").alias("moment"), F.lit(-1).cast("bigint").alias("change"))
    rows = papers.select(F.lit("papers_unread").alias("name"), F.col("created_at").alias("moment"), F.lit(1).cast("bigint").alias("change")).unionByName(read)
    deep = t.raw("documents").select(F.lit("deep_reports").alias("name"), at(F.col("doc_id") % 40).alias("moment"), F.lit(1).cast("bigint").alias("change"))
    return digest.totals_by_date(rows.unionByName(deep), first, last)


def _stored(t) -> DataFrame:
    """Reports of two overlapping ranges, each written in one batch; read back, each date has the later one."""
    tables = digest.report_tables(t.spark, f"{shared_dir(t.spark)}/reports-{os.urandom(8).hex()}")
    parts = digest_parts(t)
    for number, (first, last) in enumerate(((FIRST, MIDDLE), (LATE, LAST))):
        seen = durable(digest.on_dates(parts, first, last, LIMITS))
        # A date has at most eight events, so the links of the others need not be dealt out.
        shown = seen.filter("part = 'what_happened'").select(F.col("id").alias("event_id")).distinct()
        links = t["linked_rows"].join(F.broadcast(shown), "event_id", "left_semi").groupBy("event_id", "source_key").agg(
            F.min("observed_at").alias("since")).withColumn("until", F.lit(None).cast("timestamp"))
        happened = digest.linked_sources(seen.filter("part = 'what_happened'"), links).withColumn("detail", F.col("sources").cast("string")).drop("sources")
        seen = seen.filter("part <> 'what_happened'").unionByName(happened.select(*seen.columns))
        tables.write(number, {"reports": digest.reports(seen, digest_totals(t, first, last))})
    return digest.stored_reports(tables)


def _sql_part(name: str, rows: str, ident: str, order: str, since: str, until: str = "NULL", detail: str = "''") -> str:
    return f"""SELECT CAST(d AS DATE) AS report_date, '{name}' AS part, row_number() OVER (PARTITION BY d ORDER BY {order}, CAST({ident} AS VARCHAR)) AS place, CAST({ident} AS VARCHAR) AS id, {detail} AS detail
        FROM dates JOIN ({rows}) r ON {since} < d + INTERVAL 1 DAY AND ({until} IS NULL OR {until} >= d + INTERVAL 1 DAY) QUALIFY place <= {LIMITS[name]}"""


_SCORES = f"""SELECT r.work_id, k.n AS turn, CASE k.n WHEN 0 THEN {sql_at('first_doc % 20')} ELSE {sql_at('20 + first_doc % 10')} END AS since, CASE k.n WHEN 0 THEN {sql_at('20 + first_doc % 10')} END AS until,
    CASE k.n WHEN 0 THEN total_score ELSE 100 - total_score END AS score FROM results r JOIN works USING (work_id), (VALUES (0), (1)) k(n) WHERE score_kind = """
_READ = "(SELECT work_id, min(acquired_at) AS read_at FROM pdfs JOIN versions USING (version_id) WHERE parse_status IN ('parsed', 'partial') GROUP BY 1)"
_BACKED = "SELECT work_id, score, greatest(since, read_at) AS since, until FROM (SCORES) JOIN " + _READ + " USING (work_id) WHERE until IS NULL OR greatest(since, read_at) < until"
_DATES = f"dates AS (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY)) AS d)"
_MOMENT = "SELECT artifact_id, coalesce(updated_at, published_at) AS moment FROM artifacts WHERE coalesce(updated_at, published_at) IS NOT NULL AND "
_ROWS = " UNION ALL ".join([
    _sql_part("technical", _SCORES + "'technical'", "work_id", "score DESC", "since", "until"),
    _sql_part("commercial", _SCORES + "'commercial'", "work_id", "score DESC", "since", "until"),
    _sql_part("what_to_build", _BACKED.replace("SCORES", _SCORES + "'technical'"), "work_id", "score DESC", "since", "until"),
    _sql_part("hypotheses", _BACKED.replace("SCORES", _SCORES + "'commercial'"), "work_id", "score DESC", "since", "until"),
    _sql_part("what_happened", "SELECT event_id, occurred_at FROM linked_events WHERE occurred_at IS NOT NULL", "event_id", "occurred_at DESC", "occurred_at", detail="""CAST((SELECT count(*) FROM (
        SELECT source_key, min(observed_at) AS seen FROM linked_rows l WHERE sha256(l.canonical_key) = r.event_id GROUP BY 1) WHERE seen < d + INTERVAL 1 DAY) AS VARCHAR)"""),
    _sql_part("launches", _MOMENT + "artifact_type IN ('repository', 'release', 'model', 'dataset', 'space')", "artifact_id", "moment DESC", "moment"),
    _sql_part("community", _MOMENT + "(content_class = 'community_reaction' OR authority < 0.5)", "artifact_id", "moment DESC", "moment"),
    _sql_part("updates", """SELECT * FROM (SELECT version_id, observed_at, lead(observed_at) OVER (PARTITION BY work_id ORDER BY observed_at) AS until, row_number() OVER (PARTITION BY work_id ORDER BY observed_at) AS turn
        FROM (SELECT work_id, observed_at, max(version_id) AS version_id FROM versions GROUP BY 1, 2)) WHERE turn > 1""", "version_id", "observed_at DESC", "observed_at", "until"),
    _sql_part("deep_reports", f"SELECT doc_id AS run_id, {sql_at('doc_id % 40')} AS completed_at FROM documents", "run_id", "completed_at DESC, run_id DESC", "completed_at"),
])


@query("g9_report_range", f"SELECT strftime(report_date, '%Y-%m-%d') AS report_date, part, place - 1 AS position, id, detail FROM (WITH {_DATES} {_ROWS})")
def g9_range(t):
    return digest.report_items(_stored(t)).select(F.col("report_date").cast("string").alias("report_date"), "part", "position", "id", "detail")


@query("g9_report_range_totals", f"""SELECT strftime(d, '%Y-%m-%d') AS report_date, name, CAST(sum(change) AS BIGINT) AS total FROM (WITH {_DATES} SELECT d, name, change FROM dates JOIN (
        SELECT 'papers_unread' AS name, created_at AS moment, 1 AS change FROM works WHERE work_type = 'paper'
        UNION ALL SELECT 'papers_unread', greatest(created_at, read_at), -1 FROM works JOIN {_READ} USING (work_id) WHERE work_type = 'paper'
        UNION ALL SELECT 'deep_reports', {sql_at('doc_id % 40')}, 1 FROM documents) ON moment < d + INTERVAL 1 DAY) GROUP BY 1, 2""")
def g9_range_totals(t):
    return digest.report_totals(_stored(t)).select(F.col("report_date").cast("string").alias("report_date"), "name", "total")
