import collections
import math

import brute
import numpy as np
from pyspark.sql import functions as F

from scholarloom.llm import negatives

DDL = "vec_id long, embedding array<float>, label int, row string, score string, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "r", "s", "a") for i, y, v in rows], DDL)


def held(rows, scale=256):
    """The rows that take part, as the plain version wants them."""
    return [(i, y, [math.floor(scale * float(np.float32(x))) for x in v]) for i, y, v in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def same(got, want):
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def vectors(n, dims, seed, labels=3):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, 0.1, (labels, dims))
    return [(k, int(y), (0.5 * middle[(y + k % 2) % labels] + draw.normal(0, 0.1, dims)).astype(np.float32).tolist()) for k, y in enumerate(draw.integers(0, labels, n))]


def test_against_all_pairs(spark, monkeypatch):
    rows = vectors(700, 40, 1)
    want = brute.hard_negatives(held(rows), 50)
    assert len(want) > 200
    same(negatives.hard_negatives(frame(spark, rows).repartition(5), F.col("vec_id") % 50 == 0), want)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 1_000)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 16)
    monkeypatch.setattr(negatives, "MOST_ROWS", 64)
    same(negatives.hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 50 == 0), want)


def test_ties_copies_nulls_and_lengths(spark):
    rows = vectors(120, 12, 2)
    rows += [(100, 1, rows[3][2]), (100, 1, rows[3][2]), (None, 1, rows[3][2]), (None, 0, rows[5][2]), (200, None, rows[1][2]), (300, 1, None)]
    rows += [(400, 1, [None] * 12), (500, 1, [float("nan")] * 12), (600, 1, [float("inf")] * 12), (700, 2, []), (800, 1, rows[3][2][:7]), (1000, 0, [0.0] * 12), (1100, 9, rows[4][2])]
    rows += [(2_000 + k, k % 3, rows[3][2]) for k in range(40)]
    want = brute.hard_negatives(held(rows))
    assert {w[0] for w in want} >= {0, 100, 800, 1000}
    same(negatives.hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 100 == 0), want)


def test_scores_beyond_single_and_double_precision_are_exact(spark):
    for size in (300.0, 3e5, 3e6):
        rows = [(i, y, [size * x for x in v]) for i, y, v in vectors(130, 9, 4)]
        assert max(abs(x) for *_, v in held(rows) for x in v) ** 2 * 9 > {300.0: 2**24, 3e5: 2**45, 3e6: 2**53}[size]
        want = brute.hard_negatives(held(rows), 10)
        assert want
        same(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0), want)


def test_no_rows_and_no_anchors(spark):
    assert negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, vectors(50, 5, 3)), F.lit(False)).count() == 0
    assert negatives.hard_negatives(frame(spark, [(0, 1, [0.1]), (1, 1, [0.1])]), F.col("vec_id") % 100 == 0).count() == 0


def test_the_bitmap_shrinks_and_keeps_what_may_count():
    draw = np.random.default_rng(8)
    values = draw.integers(-100, 100, (64, 3_000)).astype(np.float32)
    anchor = (draw.integers(-100, 100, 64) * (draw.random(64) < 0.4)).astype(np.float32)
    exact = (anchor.astype(np.int64) @ values.astype(np.int64))
    bar, met = float(np.sort(exact)[-5]), []

    def judge(partial, below, above):
        met.append(len(partial))
        return partial + above >= bar

    places, scores = negatives.survivors(anchor, values, values.min(axis=1), values.max(axis=1), None, judge)
    assert set(np.flatnonzero(exact >= bar)) <= set(places.tolist()) and (exact[places] == scores).all()
    assert met[-1] < 0.1 * met[0]
