"""The stored term index against a plain dictionary, what its batches write and open, and pages by boundary."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholarloom.operators.catalog import ORDER_KEYS, _order, beyond
from scholarloom.functions.text import casefold, search_tokens
from scholarloom.operators.term_index import TermIndex

SCHEMA = "entity_id string, title string, body string"


def index_at(spark, tmp_path):
    return TermIndex(spark, str(tmp_path / "index"), ["title", "body"])


def ids(frame):
    return sorted(r.entity_id for r in frame.collect())


def test_batches_equal_a_dictionary(spark, tmp_path):
    draw, index, state = random.Random(4), index_at(spark, tmp_path), {}
    words = ["alpha", "Alpin", "beta", "bet", "é", "zoë", "東京", "x1", "𝒳y", ""]
    text = lambda: " ".join(draw.choices(words, k=draw.randint(0, 4)))

    def agrees():
        assert {(r.entity_id, r.title, r.body) for r in index.texts().collect()} == {(k, *v) for k, v in state.items()}
        for wanted, prefixes in (("al", ["al"]), ("BET x", ["bet", "x"]), ("e", ["e"]), ("東", ["東"]), ("zoe alp", ["zoe", "alp"]), ("none", ["none"])):
            fold = lambda v: " ".join(v).casefold().replace("é", "e").replace("ë", "e").split()
            want = sorted(k for k, v in state.items() if all(any(w.startswith(p) for w in fold(v)) for p in prefixes))
            assert ids(index.matching(wanted)) == want, wanted

    agrees()
    for batch in range(4):
        rebuilt = {str(k): (text(), text()) for k in draw.sample(range(12), 6)}
        gone = {str(k) for k in draw.sample(range(12), 2)} - set(rebuilt)
        frame = spark.createDataFrame([(k, *v) for k, v in rebuilt.items()] + [(None, "alpha", "bet")], SCHEMA)
        index.refresh(batch, frame, spark.createDataFrame([(k,) for k in [*gone, *rebuilt]], "entity_id string"))
        state = {k: v for k, v in state.items() if k not in gone} | rebuilt
        if batch == 3:
            agrees()
    index.compact(9)
    agrees()
    assert index.tables.read("tombstones").count() == 0
    assert index.postings().count() == index.tables.read("postings").count()


def test_a_batch_writes_and_opens_little(spark, tmp_path):
    index = index_at(spark, tmp_path)
    rows = spark.range(2_000).select(F.col("id").cast("string").alias("entity_id"), F.format_string("common w%04d", "id").alias("title"), F.lit("").alias("body"))
    none = rows.filter("false").select("entity_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.refresh(0, rows, none)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    some = rows.filter("entity_id % 100 = 0")
    index.refresh(1, some.withColumn("title", F.lit("quite new")), none)
    counts = {(r.batch, r.name): r.row_count for r in index.tables.manifests().collect()}
    assert counts[0, "postings"] == 4_000 and counts[1, "postings"] == 40 and counts[1, "texts"] == counts[1, "tombstones"] == 20
    every, few = index.files([""]), index.files(["w0007"])
    assert len(every) >= 5 and 1 <= len(few) <= 2 and index.files(["zz"]) == []
    assert set(index.postings(["w0007"]).inputFiles()) >= {f"file://{f}" for f in few}
    assert not set(index.postings(["w0007"]).inputFiles()) & {f"file://{f}" for f in set(every) - set(few)}
    assert ids(index.matching("w0007")) == ["7"] and ids(index.matching("w0100")) == [] and index.matching("quite n").count() == 20
    assert index.matching("common").count() == 1_980


def test_postings_hold_no_ids(spark, tmp_path):
    """Numbers of a batch start anew in the next one; rows of one id in one batch are one entity."""
    index = index_at(spark, tmp_path)
    none = spark.createDataFrame([], "entity_id string")
    index.refresh(0, spark.createDataFrame([("a" * 64, "one", "two"), ("b" * 64, "one", "")], SCHEMA).coalesce(1), none)
    index.refresh(1, spark.createDataFrame([("c" * 64, "one", ""), ("c" * 64, "", "three")], SCHEMA).coalesce(1), none)
    stored = index.tables.read("postings")
    assert dict(stored.dtypes)["entity"] == "bigint" and "entity_id" not in stored.columns
    assert {(r.batch, r.entity) for r in stored.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert ids(index.matching("one")) == ["a" * 64, "b" * 64, "c" * 64] and ids(index.matching("one three")) == ["c" * 64]
    assert ids(index.postings()) == ["a" * 64] * 2 + ["b" * 64] + ["c" * 64] * 2


def test_a_batch_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    index = index_at(spark, tmp_path)
    none = spark.createDataFrame([], "entity_id string")
    index.refresh(0, spark.createDataFrame([("1", "old", "")], SCHEMA), none)
    seal = index.tables.seal
    monkeypatch.setattr(index.tables, "seal", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.refresh(1, spark.createDataFrame([("1", "new", "")], SCHEMA), none)
    assert ids(index.matching("old")) == ["1"] and ids(index.matching("new")) == []
    monkeypatch.setattr(index.tables, "seal", seal)
    for _ in range(2):
        index.refresh(1, spark.createDataFrame([("1", "new", "")], SCHEMA), none)
    assert ids(index.matching("old")) == [] and ids(index.matching("new")) == ["1"] and Path(index.tables.path).exists()


@pytest.mark.parametrize("name", ["newest", "oldest", "title", "technical"])
def test_beyond_a_boundary(spark, name):
    """Every row as the boundary, with nulls and ties in each order column."""
    keys, draw = ORDER_KEYS[name], random.Random(1)
    rows = [tuple(draw.choice([None, 1, 2]) for _ in keys[:-1]) + (f"w{k:02d}",) for k in range(30)]
    frame = spark.createDataFrame(rows, ", ".join(f"{k} int" for k, _ in keys[:-1]) + ", work_id string").cache()
    ordered = [r.asDict() for r in frame.orderBy(*_order(keys)).collect()]
    for at in range(0, 30, 3):
        got = [r.work_id for r in frame.filter(beyond(keys, ordered[at])).orderBy(*_order(keys)).collect()]
        assert got == [r["work_id"] for r in ordered[at + 1:]]


def test_words_are_cut_once(spark, tmp_path, monkeypatch):
    """Range partitioning reads its rows twice; what it reads must not be the texts."""
    from scholarloom.operators import search

    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        cuts.add(1)
        return text

    monkeypatch.setattr(search, "search_tokens", lambda text: search_tokens(seen(text)))
    index = index_at(spark, tmp_path)
    rows = spark.range(50).select(F.col("id").cast("string").alias("entity_id"), F.format_string("common w%04d", "id").alias("title"), F.lit("Zoë").alias("body"))
    index.refresh(0, rows, rows.filter("false").select("entity_id"))
    assert cuts.value == 100
    assert index.postings().count() == 150
    written = spark.read.parquet(*index.files([""])).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min("term").alias("a"), F.max("term").alias("z"), F.count("*").alias("n"))
    stored = index.tables.read("ranges").select(F.element_at(F.split("file", "/"), -1).alias("name"), "first_term", "last_term", "posting_count")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, stored.collect()))


def test_folding_of_every_character(spark):
    """Case folding as Python folds, for every character alone and behind another; tokens have no accents and no empty words."""
    known = [chr(c) for c in range(1, 0x3000) if chr(c).isalnum()] + ["ſ", "µ", "ς", "ẞ", "Σ", "ᏸ", "ꭰ", "ﬀ"]
    rows = spark.createDataFrame([(c, f"{x}{c}") for c in known for x in ("", "a", "é ")], "c string, text string")
    got = {(r.c, r.text): r.folded for r in rows.select("c", "text", casefold(F.col("text")).alias("folded")).collect()}
    wrong = [k for k, v in got.items() if v != k[1].casefold() and v.casefold() != v]
    assert not wrong
    tokens = spark.createDataFrame([("Straße, ÉTÉ été -- ςΣ ſo µm",), ("",), ("--",), ("Plain PLAIN x1",)], "t string").select(search_tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in tokens] == [["strasse", "ete", "σσ", "so", "μm"], [], [], ["plain", "x1"]]
