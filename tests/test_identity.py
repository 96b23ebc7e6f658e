"""Identity resolution against a sequential replay of the rules on small random inputs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scholarloom.operators import identity, identity_store, similar
from scholarloom.operators.identity import resolve_identities
from scholarloom.operators.similar import close_titles, similar_titles, titles_near

SCHEMA = (
    "record_id string, upstream_id string, version_no bigint, observed_at timestamp, title string, "
    "author string, year int, label string, identities array<string>"
)


def replay(rows, threshold=0.92, works=None, owner=None, labels=None):
    """The rules one record at a time; returns status, work and candidates by record."""
    works = dict(works or {})
    owner = dict(owner or {})
    labels = {k: set(v) for k, v in (labels or {}).items()}
    out = {}
    for r in sorted(rows, key=lambda r: (r["upstream_id"], r["version_no"], r["observed_at"] or "", r["record_id"])):
        hits = {owner[i] for i in r["identities"] if i in owner}
        if len(hits) > 1:
            out[r["record_id"]] = ("manual_review", None, hits)
            continue
        if hits:
            work = hits.pop()
            for i in r["identities"]:
                owner.setdefault(i, work)
            if r["label"] in labels[work]:
                out[r["record_id"]] = ("already_known", work, set())
            else:
                labels[work].add(r["label"])
                works[work] = (r["title"], *works[work][1:])
                out[r["record_id"]] = ("revision_created", work, set())
            continue
        near = set()
        if r["author"] is not None and r["year"] is not None:
            near = {
                w for w, (title, author, year) in works.items()
                if (author, year) == (r["author"], r["year"])
                and SequenceMatcher(None, r["title"], title, autojunk=False).ratio() >= threshold
            }
        if near:
            out[r["record_id"]] = ("manual_review", None, near)
            continue
        work = "new:" + r["record_id"]
        works[work] = (r["title"], r["author"], r["year"])
        labels[work] = {r["label"]}
        for i in r["identities"]:
            owner[i] = work
        out[r["record_id"]] = ("created", work, set())
    return out, owner


def make_rows(seed, count=60, ids=25, titles=6):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(8, 40))).strip() or "a" for _ in range(titles)]

    def title():
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = rng.choice("abcdef")
            elif rng.random() < 0.5 and len(text) > 1:
                del text[at]
            else:
                text.insert(at, rng.choice("abcdef"))
        return "".join(text)

    return [
        {
            "record_id": f"r{n:03d}", "upstream_id": f"u{rng.randrange(count // 2):03d}",
            "version_no": rng.randint(0, 3), "observed_at": None, "title": title(),
            "author": rng.choice(["ann", "bob", None]), "year": rng.choice([2023, 2024]),
            "label": f"v{rng.randint(1, 3)}",
            "identities": [f"doi:{rng.randrange(ids)}" for _ in range(rng.choice([1, 1, 1, 2]))],
        }
        for n in range(count)
    ]


def tuples(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return [tuple(r[c] for c in names) for r in rows]


def check(spark, rows, expected, owner, **existing):
    got = resolve_identities(spark.createDataFrame(tuples(rows), SCHEMA), **existing)
    names = {r["record_id"]: r["name"] for r in got.decisions.select(
        "record_id", F.sha2("record_id", 256).alias("name")).collect()}

    def name(work):
        return names[work[4:]] if work and work.startswith("new:") else work

    decided = {r["record_id"]: (r["status"], r["work_id"]) for r in got.decisions.collect()}
    assert decided == {k: (s, name(w)) for k, (s, w, _) in expected.items()}
    review = {(r["record_id"], r["candidate_work_id"]) for r in got.review.collect()}
    assert review == {(k, name(w)) for k, (_, _, c) in expected.items() for w in c}
    ids = {r["identity"]: r["work_id"] for r in got.external_ids.collect()}
    assert ids == {i: name(w) for i, w in owner.items()}
    current = got.versions.filter("is_current").groupBy("work_id").count().filter("count <> 1")
    assert current.isEmpty()
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_sequential_rules(spark, seed):
    rows = make_rows(seed)
    expected, owner = replay(rows)
    assert len({s for s, _, _ in expected.values()}) == 4
    check(spark, rows, expected, owner)


def test_resolution_on_top_of_existing_works(spark):
    rows = make_rows(11, count=40)
    works = {"w1": (rows[0]["title"], "ann", 2023), "w2": (rows[1]["title"], "bob", 2024)}
    owner = {"doi:1": "w1", "doi:2": "w2"}
    labels = {"w1": {"v1"}, "w2": {"v2"}}
    expected, owned = replay(rows, works=works, owner=owner, labels=labels)
    check(
        spark, rows, expected, owned,
        existing_works=spark.createDataFrame([(k, *v) for k, v in works.items()], "work_id string, title string, author string, year int"),
        existing_ids=spark.createDataFrame(list(owner.items()), "identity string, work_id string"),
        existing_labels=spark.createDataFrame([(k, x) for k, v in labels.items() for x in v], "work_id string, label string"),
    )


def test_two_ids_joined_by_a_later_record_go_to_review(spark):
    row = dict(upstream_id="u", observed_at=None, author=None, year=None, label="v1")
    rows = [
        {**row, "record_id": "a", "version_no": 1, "title": "one", "identities": ["doi:a"]},
        {**row, "record_id": "b", "version_no": 2, "title": "two", "identities": ["arxiv:b"]},
        {**row, "record_id": "c", "version_no": 3, "title": "three", "identities": ["doi:a", "arxiv:b"]},
    ]
    expected, owner = replay(rows)
    assert expected["c"][0] == "manual_review"
    check(spark, rows, expected, owner)


def test_similar_titles_finds_every_pair(spark):
    rng = random.Random(5)
    titles = sorted({r["title"] for s in range(4) for r in make_rows(s + 20, titles=4)} | {"x", "xy", "xyz"})
    rng.shuffle(titles)
    frame = spark.createDataFrame([("k", t) for t in titles], "block string, title string")
    for threshold in (0.92, 0.8):
        got = {(r["title"], r["other"]) for r in similar_titles(frame, ["block"], threshold).collect()}
        want = {
            (a, b) for a in titles for b in titles
            if SequenceMatcher(None, a, b, autojunk=False).ratio() >= threshold
        }
        assert got == want and len(want) > len(titles)


def test_few_works_at_a_time_give_the_same_decisions(spark, monkeypatch):
    """One work per author and year in the first round, two in the second, and so on."""
    monkeypatch.setattr(identity, "FIRST_WORKS", 1)
    monkeypatch.setattr(identity, "GROWTH", 2)
    rows = make_rows(4, count=40, titles=12)
    expected, owner = replay(rows)
    assert sum(s == "created" for s, _, _ in expected.values()) > 4
    check(spark, rows, expected, owner)


def test_batches_on_stored_state_decide_like_one_run(spark, tmp_path):
    rows = sorted(make_rows(6, count=36), key=lambda r: (r["upstream_id"], r["version_no"], r["record_id"]))
    expected, _ = replay(rows)
    tables = identity_store.identity_tables(spark, str(tmp_path / "identities"))
    cut = next(k for k in range(18, 36) if rows[k]["upstream_id"] != rows[k - 1]["upstream_id"])
    for number, part in enumerate((rows[:cut], rows[cut:])):
        identity_store.resolve_batch(tables, number, spark.createDataFrame(tuples(part), SCHEMA))
    decided = {r["record_id"]: r["status"] for r in tables.read("decisions").collect()}
    assert decided == {k: s for k, (s, _, _) in expected.items()}
    assert tables.read("works").filter("batch = 0").count() > 0
    works, _, _ = identity_store.met_state(tables, 2, spark.createDataFrame(tuples([{**rows[0], "author": "nobody", "identities": ["doi:none"]}]), SCHEMA))
    assert works.isEmpty()


def test_a_long_common_beginning_is_close_without_the_ratio(spark):
    rng = random.Random(9)
    rows = [("k" * rng.randint(0, 60) + "".join(rng.choice("abk") for _ in range(rng.randint(1, 12))), "k" * rng.randint(0, 60) + "".join(rng.choice("abk") for _ in range(rng.randint(1, 12)))) for _ in range(300)]
    rows += [(a, a[:-1] + "z") for a, _ in rows] + [(a, "z" + a[1:]) for a, _ in rows]
    got = spark.createDataFrame(rows, "title string, other string").select("title", "other", close_titles(0.9).alias("close")).collect()
    assert [r.close for r in got] == [SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9 for a, b in rows]


def test_titles_near_few_and_many(spark):
    """Numbered titles, of which one side has few in some blocks: the pairs of the plain rule, and no chunks where titles can be set side by side."""
    rng = random.Random(7)
    words = ["observations", "standing", "committee", "periodical", "literature", "volume", "number", "été"]

    def title(n):
        return " ".join(rng.choice(words) for _ in range(4)) + f" {n}" if n % 3 else f"{words[0]} of the {words[1]} {words[2]} volume number {n:04d}"

    asked = {(b, title(n)) for b, size in (("a", 60), ("b", 60), ("c", 3), ("d", 2)) for n in range(size)}
    shown = {(b, title(n)) for b, size in (("a", 2), ("b", 40), ("c", 50), ("e", 2)) for n in range(size)} | set(list(asked)[:5])
    frames = [spark.createDataFrame(sorted(side), "block string, title string") for side in (asked, shown)]
    got = [tuple(r) for r in titles_near(*frames, ["block"], 0.92).collect()]
    want = {(b, x, y) for b, x in asked for c, y in shown if b == c and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.92}
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_few_shown_titles_need_no_chunks(spark, monkeypatch):
    asked = spark.range(400).selectExpr("'a' AS block", "concat('collected observations of the standing committee number ', lpad(id, 5, '0')) AS title")
    monkeypatch.setattr(similar, "_near", lambda *_: pytest.fail("titles of a series were cut into chunks"))
    assert titles_near(asked, asked.limit(3), ["block"], 0.92).count() == 1_200
