import collections
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarloom.llm import crf, pii, pii_examples
from scholarloom.llm.queries import op13


@pytest.fixture(scope="module")
def labelled(spark):
    return pii_examples.labelled(spark, sentences=300).cache()


def hard_texts():
    draw = random.Random(4)
    out = [None, "", " \n", "a@b", "a@b.c", "x@@y.z.", "é.a+b@c-d.e.f@g.h", "..@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.4", "9" * 4_000 + ".1.1.1", "+1 (", "+1 (743) 555-3824, é", "++49 30 1234567--", "4111 1111-1111 1111",
           "4111111111111111 4111111111111111", "+1 (826) 555-4081 190.137.223.204", "+1+2345678901", "call +1-2-3 a@b.de1.2.3.4", "ß" * 20 + " 4111-1111-1111-1111x"]
    return out + ["".join(draw.choice("aé1122233.@+-() \n") for _ in range(200)) for _ in range(400)]


def test_base_spans_are_those_of_the_stated_patterns():
    n = 0
    for text in hard_texts():
        raw = (text or "").encode()
        got = [(pii.KINDS[k], len(raw[:a].decode()), len(raw[:b].decode())) for a, k, b in pii.base_spans(raw)]
        assert got == brute.base_spans(text), text
        n += len(got)
    assert n > 100


def test_long_runs_of_one_kind_of_character_take_time_in_proportion():
    for text in (b"x" * 2_000_000, b"1" * 2_000_000, b"1." * 500_000, b"a@" * 500_000, b"+1 " * 300_000, b"a.b@" + b"c." * 500_000, b"1 " * 500_000):
        pii.base_spans(text)


def test_gradient_and_decoding_against_all_labellings():
    draw = np.random.default_rng(3)
    features, first = draw.integers(0, 7, (11, 2)), np.array([0, 4, 4, 5, 8, 11])
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    chain = crf.Chain(draw.normal(0, 1, (7, 3)), draw.normal(0, 1, (3, 3)), allowed)
    labels = np.array([0, 1, 2, 0, 1, 0, 0, 1, 1, 2, 2])
    value, _, by_pair = chain.likelihood(features, first, labels)
    assert value < 0
    for a, b in ((0, 1), (1, 2), (2, 0)):
        chain.pairs[a, b] += 1e-5
        assert abs((chain.likelihood(features, first, labels)[0] - value) / 1e-5 - by_pair[a, b]) < 1e-3
        chain.pairs[a, b] -= 1e-5
    got, unary = chain.decoded(features, first), chain.unary(features)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        assert tuple(got[lo:hi]) == brute.viterbi(unary[lo:hi], chain.scores)


def test_held_out_sentences(spark, labelled):
    """Spans of other sentences of the same kind: hardly any wrong one is added, and most that the patterns miss are found."""
    maker = pii_examples.Maker(77)
    held = [maker.sentence() for _ in range(600)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(held)], "doc_id long, text string")
    missed = found = wrong = 0
    for row in pii.personal_data(docs, labelled).collect():
        want = set(held[row.doc_id][1])
        base = {(s.kind, s.start, s.end) for s in row.spans if not s.added}
        assert [(s.kind, s.start, s.end) for s in row.spans if not s.added] == brute.base_spans(held[row.doc_id][0])
        added = {(s.kind, s.start, s.end) for s in row.spans if s.added}
        missed, found, wrong = missed + len(want - base), found + len(want & added), wrong + len(added - want)
    assert missed > 200 and found > 0.85 * missed and wrong < 0.02 * found


def test_neighbours_no_longer_hide_each_other(spark, labelled):
    rows = [(1, "é Des +1 (826) 555-4081 190.137.223.204 du"), (2, "ramiar, 4465758382889437 4465758382889437 en"), (3, "write to mar.lo (at) thre (dot) org today"), (4, "number 9807915762804490 of 17.05.2024, 12:30:45")]
    got = {r.doc_id: {rows[r.doc_id - 1][1][s.start:s.end] for s in r.spans} for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), labelled).collect()}
    assert got == {1: {"+1 (826) 555-4081", "190.137.223.204"}, 2: {"4465758382889437"}, 3: {"mar.lo (at) thre (dot) org"}, 4: set()}


def test_hard_rows_empty_tables_and_no_labels(spark, docs, cases, none, labelled):
    empty = spark.createDataFrame([], pii_examples.EXAMPLES_DDL)
    texts = hard_texts()[:22]
    frame = spark.createDataFrame([(None if k % 5 == 0 else k % 7, t, "k", k) for k, t in enumerate(texts)], "doc_id long, text string, spans string, start int")
    want = collections.Counter((None if k % 5 == 0 else k % 7, tuple(brute.base_spans(t))) for k, t in enumerate(texts))
    for table in (empty, labelled):
        rows = pii.personal_data(frame, table).collect()
        assert collections.Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if not s.added)) for r in rows) == want
        assert table is not empty or not any(s.added for r in rows for s in r.spans)
    assert pii.personal_data(docs, labelled).count() == len(cases)
    assert pii.personal_data(none, labelled).count() == 0 and pii.redacted_texts(none, labelled).count() == 0


def test_redacted_texts(spark, labelled):
    docs = spark.createDataFrame([(1, "é a@b.de, +1 (743) 555-3824!", "x"), (2, None, "y"), (3, "none", "z")], "doc_id long, text string, spans string")
    assert [tuple(r) for r in pii.redacted_texts(docs, labelled).orderBy("doc_id").collect()] == [(1, "é <email>, <phone>!", "x"), (2, None, "y"), (3, "none", "z")]


def test_query(spark, tmp_path):
    texts = hard_texts()[:60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for row in got.collect():
        base = brute.base_spans(texts[row.doc_id])
        told = ["%s:%d:%d" % s for s in base]
        assert row.base_sha256 == brute.sha(",".join(told)) and set(told) <= set(row.spans.split(",") if row.spans else [])
        assert tuple(row)[1:5] == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
