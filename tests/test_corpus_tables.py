"""Shapes that the small tables do not have: tables that are folders, copies that differ beside their text, values that end on a half."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from scholarloom.functions.scoring import rounded
from scholarloom.operators import catalog, linking, ranking, reports
from scholarloom.plans import queries_catalog, queries_documents, queries_index  # noqa: F401
from scholarloom.plans.corpus import Corpus, as_of
from scholarloom.plans.registry import ORACLES, QUERIES

DOCUMENTS = "doc_id bigint, text string, lang string, source string"


@pytest.mark.parametrize("folder", [True, False])
def test_documents_in_a_folder_or_a_file_are_ingested(spark, tmp_path, folder):
    rows = spark.createDataFrame([(n, f"text {n % 4}", "en", "src1") for n in range(8)], DOCUMENTS)
    if folder:
        rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    assert queries_documents.t1(Corpus(spark, str(tmp_path))).count() == 8


def test_copies_in_other_languages_take_the_language_of_the_first(spark, tmp_path):
    rows = [(9, "same", "fr", "src1"), (4, "same", "de", "src1"), (2, "same", None, "src1"), (7, "same", "en", "src1")]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.lang for r in Corpus(spark, str(tmp_path))._grouped.collect()] == ["de"]


def test_doubles_are_rounded_like_in_sql(spark):
    values = [32.4505, 32.0025, 16.3405, 0.0005, 1.0005, 2.675, -32.4505, 0.5, 100.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 3)).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 3)", [v]).fetchone()[0] for v in values]
    plain = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 3)).collect()]
    assert got != plain


RECORDS = ("record_id bigint, source_key string, identities array<struct<id_type:string,raw_value:string,normalized_value:string>>, repository_urls array<string>")


def test_records_attach_by_what_they_name(spark):
    """Repeated, empty and missing lists; the first listed identity that is known wins over repositories, notes have no repositories, and records do not move."""
    own = lambda *values: [(kind, v, v) for kind, v in values]
    rows = [
        (1, "github", own(("arxiv", "b"), ("arxiv", "a")), ["https://github.com/x/y"]), (2, "github", own(("arxiv", "none")), ["https://github.com/X/Y.git", None]),
        (3, "openreview", own(("arxiv", "none")), ["https://github.com/x/y"]), (4, "github", None, None), (5, "reddit", [], ["https://github.com/x/y"]),
        (6, "openreview", own(("isbn", "a"), ("arxiv", "a")), []), (7, "reddit", own(("isbn", "a")), ["https://github.com/no/no"])]
    records = spark.createDataFrame(rows, RECORDS).unionByName(spark.createDataFrame([(r[0] + 10, *r[1:]) for r in rows], RECORDS))
    ids = spark.createDataFrame([("arxiv", "a", "wa"), ("arxiv", "b", "wb"), ("isbn", "a", "wi")], "id_type string, value string, work_id string")
    versions = spark.createDataFrame([("w2", True, ["https://github.com/x/y"]), ("w1", True, ["https://github.com/x/y"]), ("w0", False, ["https://github.com/x/y"])],
                                     "work_id string, is_current boolean, repository_urls array<string>")
    attached = linking.attach_records(records, ids, versions)
    want = {1: "wb", 2: "w1", 3: None, 4: None, 5: "w1", 6: "wa", 7: None}
    assert {r.record_id: r.work_id for r in attached.collect()} == {n + shift: work for n, work in want.items() for shift in (0, 10)}
    assert attached.columns == [*records.columns, "work_id"]
    plan = attached._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert "regexp_replace" not in plan  # match forms are those of the distinct combinations


def test_linked_rows_are_stored_without_their_ids(spark):
    stored = Corpus(spark, "/root/testdata/sf0.001").linked_rows
    written = set(spark.read.parquet(*stored.inputFiles()).columns)
    assert "canonical_key" in written and not written & {"event_id", "artifact_id"} and {"event_id", "artifact_id"} <= set(stored.columns)


def test_a_page_reads_the_texts_of_its_rows_only(spark, monkeypatch):
    written = []
    monkeypatch.setattr(catalog, "durable", lambda frame: written.append(frame) or frame)
    shown, boundary = catalog.seek_page(Corpus(spark, "/root/testdata/sf0.001"), catalog.CatalogQuery(sort="newest", limit=5))
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    above = [part for part in plan.split("Relation [")[:-1] if "substring_index(text" in part]
    assert above and [part for part in above if " IN (" not in part[part.rindex("substring_index(text"):]] == []
    assert shown.count() == 5 and set(boundary) == {"publication_date", "work_id"}


@pytest.mark.parametrize("name", ["p2_search_documents", "p2b_index_refresh", "p2b_stored_texts", "p3_inverted_index", "p4_topic_filter"])
def test_searches_of_copies_in_other_languages_equal_the_sql_in_one_thread(spark, tmp_path, name):
    """The SQL takes any language; read in one thread and in the order of the documents it takes the first, as the views do."""
    langs = ["de", "es", "fr", "en"]
    rows = [(n, f"Title {n % 30}\nthe body {n % 30}", None if n in (3, 7) else langs[(n // 30 + n) % 4], f"src{n % 5}") for n in range(120)]
    pandas = spark.createDataFrame(rows, DOCUMENTS).toPandas().sort_values("doc_id")
    pandas.to_parquet(tmp_path / "documents.parquet")
    (tmp_path / "events.parquet").write_bytes(Path("/root/testdata/sf0.001/events.parquet").read_bytes())
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None


def test_features_of_a_work_meet_in_one_aggregation(spark):
    """A join for each side would make a task hold a sorted copy of every one of them."""
    frame = ranking.feature_frame(Corpus(spark, "/root/testdata/sf0.001"), as_of())
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1, plan
    assert frame.count() == frame.select("work_id").distinct().count() > 0


@pytest.mark.parametrize("few", [reports.FEW_DOCUMENTS, 0])
def test_only_texts_of_the_chosen_works_are_cut_into_spans(spark, monkeypatch, few):
    monkeypatch.setattr(reports, "FEW_DOCUMENTS", few)
    t = Corpus(spark, "/root/testdata/sf0.001")
    found = queries_documents.g8(t)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("10) INSET" in plan[plan.index("split(text"):]) == (few > 0), plan
    assert "hashpartitioning(document_id" not in found._jdf.queryExecution().executedPlan().toString()
    con = connect("/root/testdata/sf0.001")
    assert compare(found, con, ORACLES["g8_commercial_hypotheses"]) is None
