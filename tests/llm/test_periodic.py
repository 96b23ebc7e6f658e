import collections
import hashlib
import random
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarloom.llm import periodic
from scholarloom.llm.queries import op11


def texts():
    draw = random.Random(1)
    word = lambda n: "w%d" % draw.randrange(n)
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a b " * 4, "x " * 3 + "a b " * 3 + "a", " ".join("ab" * 500)]
    for k in range(60):
        phrase = [word(4) for _ in range(draw.randrange(1, 45))]
        out += [" ".join(word(2) for _ in range(draw.randrange(60))), " ".join(word(50) for _ in range(150)),
                " ".join([word(9) for _ in range(20)] + phrase * draw.randrange(3, 9) + [word(9) for _ in range(k % 3)] + phrase * draw.randrange(3, 9))]
    return out


def test_the_cover_brings_any_two_places_together():
    assert (periodic.SHIFT < periodic.MOD).all()
    for a in range(periodic.MOD):
        for b in range(periodic.MOD):
            assert {(a + periodic.SHIFT[a, b]) % periodic.MOD, (b + periodic.SHIFT[a, b]) % periodic.MOD} <= set(periodic.COVER)


@pytest.mark.parametrize("at_once", [40, 1_000_000])
def test_runs_against_plain_comparison(at_once, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", at_once)
    lists = [brute.blank_words(t) for t in texts()]
    ids = {w: k for k, w in enumerate({w for words in lists for w in words})}
    rows = periodic.runs_of(np.array([ids[w] for words in lists for w in words], np.uint64), np.cumsum([0, *map(len, lists)]))
    assert len(rows) > 50
    for k, words in enumerate(lists):
        assert [tuple(r[1:]) for r in rows.tolist() if r[0] == k] == brute.periodic_runs(words)


def test_extensions_over_sorted_samples_against_plain_comparison():
    draw = np.random.default_rng(2)
    words = np.concatenate([draw.integers(0, 2, 300), np.tile(draw.integers(0, 9, 37), 9)]).astype(np.uint64)
    first = np.array([0, 300, len(words)])
    text = draw.integers(0, 2, 3_000)
    size = np.diff(first)[text]
    i = draw.integers(0, size - 1)
    j = draw.integers(i + 1, size)
    for t, a, b, n in zip(text.tolist(), i.tolist(), j.tolist(), periodic.Extensions(words, first)(text, i, j).tolist(), strict=True):
        own = words[first[t]:first[t + 1]].tolist()
        assert own[a:a + n] == own[b:b + n] and (b + n == len(own) or own[a + n] != own[b + n])


def test_operator_on_hard_rows(docs, cases, none):
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    want = [(d, tuple(brute.periodic_runs(w)), brute.collapsed(w)) for d, t in cases for w in [brute.blank_words(t)[:60_000]] if len(w) < 5_000]
    rows = [(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect()]
    assert len(rows) == len(cases) and not collections.Counter(want) - collections.Counter(rows)
    assert periodic.periodic_runs(none).count() == 0


def test_long_texts_of_one_word_and_of_long_periods(spark):
    phrase = " ".join("p%d" % k for k in range(997))
    rows = [(1, "same " * 300_000), (2, " ".join([phrase] * 60)), (3, "other " + " ".join([phrase] * 3))]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(map(tuple, got[k].runs)) for k in (1, 2, 3)] == [((0, 300_000, 1),), ((0, 997 * 60, 997),), ()]
    assert got[1].collapsed == "same" and got[2].collapsed == phrase


def test_query_against_the_stated_rules(spark, tmp_path):
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        words = brute.blank_words(text)
        draw, n = 1 if doc is None else zlib.crc32(str(doc).encode()), len(words)
        if draw % 10 == 0 and n:
            g = draw // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute.periodic_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        told = "".join("%d,%d,%d\n" % r for r in runs)
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), brute.sha(brute.collapsed(words))))
    got = op11(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {f.dataType.simpleString() for f in got.schema if not f.name.endswith("sha256")} == {"bigint"}
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_best_run_is_chosen_by_exact_quotients(spark):
    rows = [([(5, 9, 2), (0, 18, 4), (1, 18, 4)],), ([],), ([(7, 10**12 + 1, 10**6), (3, 10**12, 10**6)],)]
    got = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>").select(periodic.best_run(F.col("runs")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(0, 18, 4), None, (7, 10**12 + 1, 10**6)]
