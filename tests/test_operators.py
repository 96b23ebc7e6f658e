"""Chunked order helpers, linking, evidence, gates, reports and ingestion on small literal frames."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from scholarloom.operators import evidence, gates, linking, reports, search, topics
from scholarloom.operators.catalog import CatalogQuery, match_reason
from scholarloom.operators.ordered import carry_forward, global_position, latest_by, next_in_order, sum_before, top_per_key
from scholarloom.operators.retention import plan_totals, retention_plan
from scholarloom.operators.search import query_tokens
from scholarloom.streaming.ingest import batch_rows, ingest_files, landed_tables, possible_hits

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ordered_rows():
    rng = random.Random(3)
    return [(rng.choice("ab"), pos, rng.randint(-2, 5), rng.choice([None, None, f"h{pos}"])) for pos in rng.sample(range(100), 60)]


def test_chunks_do_not_change_running_values(spark, ordered_rows):
    frame = spark.createDataFrame(ordered_rows, "k string, pos long, v int, h string")
    rows = sorted(ordered_rows, key=lambda r: (r[0], r[1]))
    sums, following, carried = {}, {}, {}
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        total, last = 0, None
        for i, (_, pos, v, h) in enumerate(mine):
            last = h or last
            sums[key, pos], following[key, pos], carried[key, pos] = total, mine[i + 1][1] if i + 1 < len(mine) else None, last
            total += v
    for chunk in (1, 7, 1000):
        got = sum_before(frame, ["k"], "pos", F.col("v"), "s", chunk=chunk).collect()
        assert {(r["k"], r["pos"]): r["s"] for r in got} == sums
        got = next_in_order(frame, ["k"], "pos", "n", chunk=chunk).collect()
        assert {(r["k"], r["pos"]): r["n"] for r in got} == following
        got = carry_forward(frame, ["k"], F.floor(F.col("pos") / chunk), ["pos"], F.col("h"), "c").collect()
        assert {(r["k"], r["pos"]): r["c"] for r in got} == carried


def test_positions_are_dense_and_independent_of_partitions(spark, ordered_rows):
    frame = spark.createDataFrame(ordered_rows, "k string, pos long, v int, h string")
    want = {r[:2]: i for i, r in enumerate(sorted(ordered_rows, key=lambda r: (r[0], r[1])))}
    for parts in (1, 5):
        got = global_position(frame.repartition(parts), ["k", "pos"], "at").collect()
        assert {(r["k"], r["pos"]): r["at"] for r in got} == want


def test_latest_and_top(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in latest_by(frame, ["k"], [F.col("o")]).collect()) == [("a", 3, "y"), ("b", 2, "z")]
    assert {r["v"] for r in top_per_key(frame, ["k"], [F.col("o").desc()], 1).collect()} == {"y", "z"}


def linked(spark, rows):
    schema = ("record_id long, arrival long, source_key string, upstream_id string, work_type string, kind string, title string, summary string, "
              "canonical_url string, observed_at timestamp, published_at timestamp, updated_at timestamp, work_id string, "
              "identities array<struct<id_type:string,raw_value:string,normalized_value:string>>, repository_urls array<string>")
    full = [(i, i, r["source"], r["up"], r.get("type", "repository"), "models", f"t{i}", None, "https://e.org/" + r["up"], DAY + dt.timedelta(hours=i),
             None, None, r.get("work"), r.get("ids", []), r.get("urls", [])) for i, r in enumerate(rows)]
    return linking.with_source_facts(spark.createDataFrame(full, schema), linking.source_facts(spark))


def test_three_sources_one_event_and_unlink(spark):
    paper = [("arxiv", "2401.00001", "2401.00001")]
    rows = linked(spark, [
        {"source": "openreview", "up": "n1", "work": "w", "ids": paper}, {"source": "github", "up": "r1", "work": "w", "urls": ["https://github.com/a/b"]},
        {"source": "huggingface", "up": "m1", "work": "w", "ids": paper}, {"source": "github", "up": "r1", "work": "w", "urls": ["https://github.com/a/b"]},
        {"source": "reddit", "up": "p1"}])
    artifacts = linking.upsert_artifacts(rows, F.lit(DAY))
    assert {r["upstream_id"]: r["novelty"] for r in artifacts.collect()} == {"n1": 1.0, "r1": 0.0, "m1": 1.0, "p1": 1.0}
    again = linking.upsert_artifacts(rows.filter("upstream_id = 'm1'"), F.lit(DAY), existing=artifacts)
    assert {r["upstream_id"]: (r["novelty"], r["sightings"]) for r in again.collect()} == {"m1": (0.0, 2), "n1": (1.0, 1), "r1": (0.0, 2), "p1": (1.0, 1)}
    links = linking.link_rows(rows)
    events, stored = linking.upsert_events(links), linking.upsert_links(links)
    got = {r["canonical_key"]: r for r in linking.event_measures(events, stored, artifacts).collect()}
    event = got["work:w"]
    assert (event["source_count"], event["corroboration"], event["classification"]) == (3, 1.0, "corroborated_event")
    assert got["artifact:reddit:p1"]["corroboration_status"] == "single_source"
    assert abs(event["association_confidence"] - (1 + 0.95 + 1) / 3) < 1e-9
    reason = {r["event_id"]: r["linkage_reason"] for r in linking.linkage_reasons(events, stored, artifacts).collect()}
    assert reason[event["event_id"]] == "arxiv:2401.00001; primary research; https://github.com/a/b"
    wrong = stored.filter("basis = 'explicit_url'").select("event_id", "artifact_id", F.lit(DAY + dt.timedelta(days=1)).alias("corrected_at"), F.lit("no").alias("reason"))
    after = {r["canonical_key"]: r for r in linking.event_measures(events, linking.upsert_links(links, wrong), artifacts).collect()}
    assert (after["work:w"]["source_count"], after["work:w"]["corroboration"]) == (2, 0.5)
    early = wrong.withColumn("corrected_at", F.lit(DAY))
    assert linking.upsert_links(links, early).filter("NOT active").isEmpty()

    later = linking.link_rows(linked(spark, [{"source": "github", "up": "r1", "work": "w", "urls": ["https://github.com/a/b"]}])).withColumn("title", F.lit("renamed"))
    known = events.withColumn("occurred_at", F.lit(DAY))
    merged = {r["canonical_key"]: (r["title"], r["occurred_at"]) for r in linking.upsert_events(later, existing=known).collect()}
    assert merged == {"work:w": ("renamed", DAY), "artifact:reddit:p1": ("t4", DAY)}
    switched = linking.upsert_links(links, wrong)
    assert switched.filter("NOT active").count() == 1
    back = linking.upsert_links(later, existing=switched)
    assert back.count() == 4 and back.filter("NOT active OR corrected_at IS NOT NULL").isEmpty()
    still = linking.upsert_links(later.limit(0), existing=switched)
    assert [r["correction_reason"] for r in still.filter("NOT active").collect()] == ["no"]
    assert linking.upsert_links(later.limit(0), wrong, existing=stored).filter("NOT active").count() == 1


def test_nested_fields_and_kinds_of_outputs(spark):
    good = {
        "schema_version": "1.0", "work_id": "w", "change": "c", "problem": "a problem", "contribution": "a contribution", "evidence_state": "weak", "limitations": ["l"],
        "code_state": "unknown", "technical_relevance": "technical", "commercial_relevance": "commercial", "recommended_action": "track",
        "claims": [{"text": "t", "type": "fact", "evidence_ids": ["e"]}, {"text": "u", "type": "fact", "evidence_ids": []}]}
    claim = good["claims"][0]
    cases = {
        "good": (good, []), "field": ({**good, "claims": [claim, {**claim, "weight": 1}]}, ["nested unknown field"]), "number": ({**good, "work_id": 5}, ["field kind"]),
        "list": ({**good, "limitations": [1, "l"]}, ["field kind"]), "null": ({**good, "claims": [{**claim, "evidence_ids": ["e", None]}]}, ["claim evidence"]),
        "object": ({**good, "claims": ["t"]}, ["field kind"]), "top": ({**good, "more": {}}, ["unknown field"])}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()], "run_id string, output_json string")
    got = {r["run_id"]: r["reasons"] for r in gates.read_briefs(rows).collect()}
    assert all(set(want) <= set(got[k]) and bool(want) == bool(got[k]) for k, (_, want) in cases.items()), got
    broken = spark.createDataFrame([("x", "[1"), ("y", None), ("z", "")], "run_id string, output_json string")
    assert all(r["reasons"] for r in gates.read_briefs(broken).collect())


def test_segments(spark):
    pages = spark.createDataFrame([("d", 1, ["1 Intro", "a  b", " "], 0), ("d", 2, ["c"], 1), ("d", 3, [], 2), ("d", 4, [], 0)], "document_id string, page int, blocks array<string>, image_count int")
    got = [(r["page"], r["char_start"], r["char_end"], r["text"], r["section_path"]) for r in evidence.segment(pages).orderBy("page", "block").collect()]
    assert got == [(1, 0, 7, "1 Intro", "1 Intro"), (1, 8, 11, "a b", "1 Intro"), (2, 0, 1, "c", "1 Intro")]
    cut = evidence.segment(pages, max_page_chars=9).filter("page = 1").orderBy("block").collect()
    assert [r["text"] for r in cut] == ["1 Intro", "a"]
    triage = evidence.page_triage(pages)
    assert [r["extraction_class"] for r in triage.orderBy("page").collect()] == ["suspicious", "suspicious", "ocr_required", "empty"]
    counts = spark.createDataFrame([("d", 4)], "document_id string, page_count long")
    row = evidence.document_outcome(triage, counts).collect()[0]
    assert (row["empty_pages"], row["parse_status"]) == (2, "partial")


def test_retention_includes_the_file_that_crosses(spark):
    rows = [(f"f{i}", "raw", 10, DAY, DAY + dt.timedelta(days=i), i) for i in range(5)] + [("t", "temporary", 10, DAY, None, 9)]
    files = spark.createDataFrame(rows, "path string, area string, size long, modified_at timestamp, observed_at timestamp, record_id long")
    plan = retention_plan(files, {"temporary": F.lit(DAY + dt.timedelta(days=1)), "raw": F.lit(DAY)}, 25)
    assert {r["path"]: r["rule"] for r in plan.collect()} == {"t": "age", "f0": "budget", "f1": "budget", "f2": "budget"}
    assert {r["rule"]: r["bytes"] for r in plan_totals(plan).collect()} == {"age": 10, "budget": 30}


def test_topics_drop_unknown_only_when_something_matches(spark):
    rows = spark.createDataFrame([("w1", "r1", "arxiv", [" CS.ai ", "zz"]), ("w2", "r2", "arxiv", ["zz"]), ("w3", "r3", "rss", []), ("w4", "r4", "arxiv", None)], "work_id string, record_id string, source_key string, categories array<string>")
    got = {(r["work_id"], r["topic_key"]) for r in topics.assign_topics(rows, topics.category_map(spark)).collect()}
    assert got == {("w1", "agentic-systems"), ("w1", "ai-quality-security"), ("w2", "unknown"), ("w3", "unknown"), ("w4", "unknown")}
    with pytest.raises(ValueError):
        topics.taxonomy(spark, [("a", "A", "b", 0.1), ("b", "B", "a", 0.1)])


def test_first_failing_claim_decides(spark):
    schema = "run_id long, claim_no int, claim_type string, importance string, verification_status string, local_id string, evidence_ids array<string>"
    claims = spark.createDataFrame([
        (1, 1, "fact", "major", "supported", "c1", ["e1", "e1"]), (2, 1, "fact", "major", "supported", "c1", []), (2, 2, "fact", "major", "supported", "c2", ["zz"]),
        (3, 1, "hypothesis", "minor", "unsupported", "c1", []), (4, 1, "fact", "minor", "unsupported", "c1", ["e1"])], schema)
    runs = spark.createDataFrame([(i, True, True) for i in (1, 2, 3, 4, 5)], "run_id long, identity_matches boolean, metadata_matches boolean")
    allowed = spark.createDataFrame([(i, "e1") for i in (1, 2, 3, 4)], "run_id long, span_id string")
    got = {r["run_id"]: (r["reason"], r["citation_coverage"], r["citations_verified"]) for r in gates.verify_citations(runs, claims, allowed, deep=True).collect()}
    assert got == {1: (None, 1.0, 1), 2: ("UNCITED_CLAIM", 0.5, 1), 3: (None, 1.0, 0), 4: ("UNREFUSED_CLAIM", 1.0, 1), 5: (None, 1.0, 0)}


def test_daily_report_is_one_row_and_replaces_its_date(spark, tmp_path):
    part = spark.createDataFrame([(2, "b"), (1, "a")], "place int, text string")
    path = str(tmp_path / "reports")
    for day, rows in (("2024-01-01", part), ("2024-01-02", part), ("2024-01-01", part.limit(1))):
        reports.write_daily_report(reports.daily_report(day, {"parts": rows}), path)
    stored = {str(r["report_date"]): r["report_json"] for r in spark.read.parquet(path).collect()}
    assert set(stored) == {"2024-01-01", "2024-01-02"}
    assert stored["2024-01-02"].endswith('"parts":[{"place":1,"text":"a"},{"place":2,"text":"b"}]}')


def test_query_checks():
    assert query_tokens("Été d'AI_x été") == ["ete", "d", "ai", "x"]
    with pytest.raises(ValueError):
        query_tokens("--")
    for bad in ({"limit": 51}, {"offset": 100_001}, {"sort": "x"}):
        with pytest.raises(ValueError):
            CatalogQuery(**bad)
    assert match_reason(CatalogQuery(q="a", linked_only=True)) == "keyword match, linked event filter"
    assert match_reason(CatalogQuery()) is None


def test_ingest_is_idempotent_and_accepts_late_files(spark, tmp_path):
    schema = "source_key string, upstream_id string, upstream_version string, canonical_url string, observed_at timestamp, media_type string, payload binary"

    def drop(name, *ids):
        rows = [("feed", i, None, "u", DAY, "text/plain", bytearray(i.encode())) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        ingest_files(source, str(tmp_path / "table"), str(tmp_path / "cursor")).awaitTermination()
        return sorted(r["upstream_id"] for r in landed_tables(spark, str(tmp_path / "table")).read("landed").collect())

    drop("one", "a", "b", "a")
    assert run() == ["a", "b"] and run() == ["a", "b"]
    drop("two", "b", "c")
    assert run() == ["a", "b", "c"]


PAYLOADS = "source_key string, upstream_id string, upstream_version string, canonical_url string, observed_at timestamp, media_type string, payload binary"


def test_a_batch_appears_whole_or_not_at_all(spark, tmp_path):
    tables = landed_tables(spark, str(tmp_path / "t"))
    batch = lambda *ids: spark.createDataFrame([("feed" if i != "x" else "X Y", i, None, "u", DAY, "text/plain", bytearray(i.encode())) for i in ids], PAYLOADS)
    state = lambda: {n: tables.read(n).count() for n in tables.schemas}
    assert state() == {"landed": 0, "keys": 0, "refused": 0, "counts": 0}
    folders = tables.write_rows(0, batch_rows(batch("a", "b", "x"), 0, tables))
    assert state() == {"landed": 0, "keys": 0, "refused": 0, "counts": 0} and not tables.ended(0)
    tables.write(0, batch_rows(batch("a", "b", "x"), 0, tables))
    tables.write(1, batch_rows(batch("a", "b", "b"), 1, tables))
    tables.write(2, batch_rows(batch("b", "c", "c"), 2, tables))
    assert state() == {"landed": 3, "keys": 3, "refused": 1, "counts": 4}
    counts = sorted(tuple(r[n] for n in ("batch", "source_key", "seen", "created", "duplicates", "refused")) for r in tables.read("counts").collect())
    assert counts == [(0, "X Y", 1, 0, 0, 1), (0, "feed", 2, 2, 0, 0), (1, "feed", 3, 0, 3, 0), (2, "feed", 3, 1, 2, 0)]
    tables.seal(0, folders)  # a second attempt of a batch takes the place of the first
    assert state()["landed"] == 3
    tables.compact(9)
    assert state() == {"landed": 3, "keys": 3, "refused": 1, "counts": 4} and {r.batch for r in tables.read("landed").collect()} == {9}
    tables.write(10, batch_rows(batch("a", "d"), 10, tables))
    assert {r.upstream_id for r in tables.read("landed").collect()} == {"a", "b", "c", "d"}


def test_the_key_sketch_loses_no_key(spark):
    keys = spark.range(3_000).select(F.lit("s").alias("source_key"), F.col("id").cast("string").alias("upstream_id"), F.sha2(F.col("id").cast("string"), 256).alias("payload_sha256"))
    own = keys.filter("upstream_id % 10 = 0")
    hits = possible_hits(keys, own)
    assert own.join(hits, own.columns, "left_anti").isEmpty() and hits.count() < 400
    assert possible_hits(keys, own.limit(0)).isEmpty()


def test_a_batch_of_repeats_moves_no_payload(spark, tmp_path):
    tables = landed_tables(spark, str(tmp_path / "t"))
    batch = spark.range(50).select(F.lit("feed").alias("source_key"), F.col("id").cast("string").alias("upstream_id"), F.lit(None).cast("string").alias("upstream_version"),
                                   F.lit("u").alias("canonical_url"), F.lit(DAY).cast("timestamp").alias("observed_at"), F.lit("text/plain").alias("media_type"), F.col("id").cast("string").cast("binary").alias("payload"))
    tables.write(0, batch_rows(batch, 0, tables))
    plan = batch_rows(batch, 1, tables)["landed"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    tables.write(1, batch_rows(batch, 1, tables))
    assert tables.read("landed").count() == 50


@pytest.mark.parametrize("text", ["άλφα", "йод", "한국어", "ガイド", "café", "cafe"])
def test_search_finds_every_script(spark, text):
    documents = spark.createDataFrame([("w", "ΆΛΦΑ βήτα Йод 한국어 ガイド Café")], "work_id string, title string")
    terms = search.search_terms(documents, "work_id", ["title"])
    assert [r["entity_id"] for r in search.matching_ids(terms, text).collect()] == ["w"]


def test_late_pages_and_long_texts_stay(spark):
    pages = spark.createDataFrame([("d", 600, ["x" * 150_000], 0)], "document_id string, page int, blocks array<string>, image_count int")
    spans = evidence.segment(pages)
    assert [r["char_end"] for r in spans.collect()] == [150_000]
    many = spark.range(1_000).select(F.lit("v").alias("version_id"), F.sha2(F.col("id").cast("string"), 256).alias("span_id"), F.col("id").cast("int").alias("page"), F.lit(0).alias("char_start"), F.lit("text").alias("text"), F.lit("h").alias("text_sha256"))
    places = [r["place"] for r in evidence.pack_evidence(many).orderBy("place").collect()]
    assert places == list(range(1, 1_000, 35))[:28] and places[-1] > 900


def test_link_state_is_the_same_for_every_order_of_runs(spark):
    """A correction of day 0, a record of day 2 that brings the link back, and a run with the same correction and no record: the link stays on."""
    import itertools

    from scholarloom.operators import linking

    schema = "event_id string, artifact_id string, observed_at timestamp, arrival bigint, relationship string, basis string, confidence double, matching_evidence array<string>"
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    record = lambda n, basis: spark.createDataFrame([("e", "a", day(n), n, "r", basis, 1.0, ["x"])], schema)
    correction = lambda n, why: spark.createDataFrame([("e", "a", day(n), why), ("other", "a", day(n), why)], "event_id string, artifact_id string, corrected_at timestamp, reason string")
    first = linking.upsert_links(record(0, "one"), correction(0, "wrong"))
    second = linking.upsert_links(record(2, "two"), correction(0, "wrong"), existing=first)
    third = linking.upsert_links(record(2, "two").limit(0), correction(0, "wrong"), existing=second)
    assert [r.active for frame in (first, second, third) for r in frame.collect()] == [False, True, True]
    runs = [(record(0, "one"), correction(1, "early")), (record(2, "two"), None), (None, correction(5, "later")), (None, correction(4, "late")), (record(3, "three"), correction(1, "early"))]
    for order in list(itertools.permutations(range(5)))[::17]:
        log = None
        for k in order:
            own = linking.link_log(*runs[k])
            log = own if log is None else log.unionByName(own)
        assert [(r.basis, r.active, r.corrected_at, r.correction_reason) for r in linking.fold_links(log).collect()] == [("three", False, day(4), "late")]


def test_links_and_events_are_dealt_by_short_keys(spark):
    """The ids are hashes of what rows are grouped by; they do not travel with the rows."""
    rows = linking.link_rows(linked(spark, [
        {"source": "github", "up": "r1", "work": "w", "urls": ["https://github.com/a/b"]}, {"source": "github", "up": "r1", "work": "w", "urls": ["https://github.com/a/c"]},
        {"source": "github", "up": "r1"}, {"source": "reddit", "up": "r1"}]))
    for frame in (linking.upsert_links(rows), linking.upsert_events(rows)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(canonical_key" in plan and "hashpartitioning(event_id" not in plan
    links = {(r.event_id, r.artifact_id): r.matching_evidence for r in linking.upsert_links(rows).collect()}
    want = {(r.event_id, r.artifact_id): r.e for r in rows.groupBy("event_id", "artifact_id").agg(F.max_by("matching_evidence", "arrival").alias("e")).collect()}
    assert links == want and len(links) == 3
    events = {(r.event_id, r.canonical_key, r.title) for r in linking.upsert_events(rows).collect()}
    assert events == {tuple(r) for r in rows.groupBy("event_id", "canonical_key").agg(F.max_by("title", "arrival")).collect()}
