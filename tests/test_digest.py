"""Digests of date ranges against a plain look at every date."""

import datetime as dt
import random

from pyspark.sql import functions as F

from scholarloom.operators import digest

SCHEMA = "part string, order array<double>, id string, detail string, since timestamp, until timestamp"


def test_first_rows_of_every_date(spark):
    rng, day = random.Random(2), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(400):
        since = day + dt.timedelta(hours=rng.randrange(-300, 2_000))
        until = None if rng.random() < 0.2 else since + dt.timedelta(hours=rng.choice([0, 5, 30, 200, 900]))
        rows.append((rng.choice("ab"), [float(rng.randrange(30))], "i%03d" % k, "", since, until))
    limits = {"a": 3, "b": 5}
    got = {}
    for r in digest.on_dates(spark.createDataFrame(rows, SCHEMA), "2024-01-03", "2024-03-11", limits).collect():
        got.setdefault((r.report_date, r.part), []).append((r.position, r.id))
    for n in range(69):
        date = dt.date(2024, 1, 3) + dt.timedelta(days=n)
        for part, most in limits.items():
            held = sorted((o, i) for p, o, i, _, since, until in rows if p == part and since.date() <= date and (until is None or until.date() > date))
            assert [i for _, i in sorted(got.get((date, part), []))] == [i for _, i in held[:most]]


def test_totals_and_stored_reports(spark, tmp_path):
    moments = spark.createDataFrame([("n", dt.datetime(2023, 12, 1), 2), ("n", dt.datetime(2024, 1, 2, 23), 1), ("n", dt.datetime(2024, 1, 4), -3)], "name string, moment timestamp, change bigint")
    totals = digest.totals_by_date(moments, "2024-01-01", "2024-01-05")
    assert [r.total for r in totals.orderBy("report_date").collect()] == [2, 3, 3, 0, 0]
    tables = digest.report_tables(spark, str(tmp_path / "r"))
    seen = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1, "x", ""), (dt.date(2024, 1, 2), "a", 1, "y", ""), (dt.date(2024, 1, 2), "a", 2, "x", "")], "report_date date, part string, position int, id string, detail string")
    tables.write(0, {"reports": digest.reports(seen, totals)})
    tables.write(1, {"reports": digest.reports(seen.filter("report_date = '2024-01-02'").withColumn("id", F.upper("id")), totals.filter("report_date = '2024-01-02'"))})
    items = sorted(tuple(r) for r in digest.report_items(digest.stored_reports(tables)).collect())
    assert items == [(dt.date(2024, 1, 1), "a", 0, "x", ""), (dt.date(2024, 1, 2), "a", 0, "Y", ""), (dt.date(2024, 1, 2), "a", 1, "X", "")]
    assert digest.stored_reports(tables).count() == 5
