"""Identity resolution: which record creates a work, revises one, is known, or needs review.

The rules are order dependent: each record sees the effect of the earlier ones. Instead of replaying
them in one task, all records are decided at once from a guess of which records are accepted, and
the guess is replaced by the outcome until nothing changes. A decision only depends on earlier
records, and every round the earliest record that is still wrong comes right, so the only stable outcome is
the one of the sequential rules.

Titles are compared with those of guessed works only. A round lets at most a few further records of an
author and year found works, a number that grows by ``GROWTH``; the others wait. A series of near titles thus has few works
at any time, its records are found close to one of them and refused, and no frame holds its pairs. Only titles
that are new on one side are compared in a round, and identities are followed again only where a guess on them changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.operators.ordered import global_position, latest_by, next_in_order, sum_before
from scholarloom.operators.similar import titles_near
from scholarloom.session import durable

BLOCK = ["author", "year"]
#: Works that one author and year may found in the first round, and how that number grows.
FIRST_WORKS, GROWTH = 4, 4


@dataclass(frozen=True)
class Resolution:
    """Frames a run of ``resolve_identities`` yields; all long-form, none nested by group."""

    decisions: DataFrame  # record_id, status, work_id, version_label
    works: DataFrame  # work_id, title, first_author, year, current_version (record_id)
    versions: DataFrame  # work_id, version_label, record_id, title, is_current
    external_ids: DataFrame  # identity, work_id, record_id
    review: DataFrame  # record_id, candidate_work_id, matched_on
    authors: DataFrame | None = None  # work_id, author_order, author: of the creating record, where records name their ``authors``


def _exact_links(ids: DataFrame, accepted: DataFrame) -> DataFrame:
    """(pos, claim): earlier record that owns one of the identities of ``pos``."""
    claims = ids.join(accepted, "pos", "left_semi").groupBy("identity").agg(F.min("pos").alias("claim"))
    return ids.join(claims, "identity").filter("claim < pos").select("pos", "claim").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(pos, root) for every record with a parent, by pointer doubling."""
    up = durable(parents.select("pos", F.col("parent").alias("root")))
    while True:
        step = up.select(F.col("pos").alias("root"), F.col("root").alias("_next"))
        hop = durable(up.join(step, "root", "left"))
        if hop.filter("_next IS NOT NULL").isEmpty():
            return hop.select("pos", "root")
        up = hop.select("pos", F.coalesce("_next", "root").alias("root"))


def _title_spans(members: DataFrame) -> DataFrame:
    """(author, year, title, work, start, until): titles a work shows, with the span they hold.

    Author and year stay those of the creating record; the title is the one of the newest label.
    """
    firsts = members.groupBy("work", "label").agg(F.min(F.struct("pos", "title")).alias("v"))
    shown = firsts.select("work", F.col("v.pos").alias("start"), F.col("v.title").alias("title"))
    return next_in_order(shown, ["work"], "start", "until")


def _has_candidate(asking: DataFrame, spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Positions whose title is close to the one some earlier work shows at that point.

    Counts the spans open at each position with a running sum, so no pair of records is built.
    """
    near = pairs.join(
        spans.select(*BLOCK, F.col("title").alias("other"), "start", "until"), [*BLOCK, "other"]
    )
    opened = near.select(*BLOCK, "title", F.col("start").alias("at"), F.lit(1).alias("delta"))
    closed = near.filter("until IS NOT NULL").select(
        *BLOCK, "title", F.col("until").alias("at"), F.lit(-1).alias("delta")
    )
    changes = opened.unionByName(closed).groupBy(*BLOCK, "title", "at").agg(F.sum("delta").alias("delta"))
    asked = asking.select(*BLOCK, "title", F.col("pos").alias("at"), F.lit(0).alias("delta"))
    rows = changes.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    swept = sum_before(
        rows, [*BLOCK, "title"], "at", F.col("delta"), "open", ties=[F.col("asks").desc()]
    )
    return swept.filter("asks AND open > 0").select(F.col("at").alias("pos"))


def resolve_identities(
    records: DataFrame,
    *,
    existing_works: DataFrame | None = None,
    existing_ids: DataFrame | None = None,
    existing_labels: DataFrame | None = None,
    threshold: float = settings.FUZZY_TITLE_THRESHOLD,
) -> Resolution:
    """Resolve ``records`` against each other and against works that exist already.

    ``records``: record_id, upstream_id, version_no, observed_at, title (normal form), author
    (normal form of the first author, may be NULL), year (may be NULL), label, identities
    (array<string>, ``type:value``), and ``authors`` (array<string>, in order) if there are any. They are
    taken in the order upstream_id, version_no, observed_at, record_id.

    ``existing_works``: work_id, title, author, year; ``existing_ids``: identity, work_id;
    ``existing_labels``: work_id, label. Existing works come before every record.
    """
    columns = ["record_id", "upstream_id", "version_no", "observed_at", "title", "author", "year", "label",
               "identities"]
    incoming = records.select(*columns).withColumn("seed", F.lit(False))
    if existing_works is not None:
        seeds = existing_works.select(
            F.col("work_id").cast("string").alias("record_id"), F.lit("").alias("upstream_id"),
            F.lit(0).cast("bigint").alias("version_no"), F.lit(None).cast("timestamp").alias("observed_at"),
            "title", "author", "year", F.lit(None).cast("string").alias("label"),
            F.array().cast("array<string>").alias("identities"), F.lit(True).alias("seed"),
        )
        incoming = incoming.withColumn("record_id", F.col("record_id").cast("string")).unionByName(seeds)
    incoming = incoming.withColumn("_late", ~F.col("seed"))
    order = ["_late", "upstream_id", "version_no", "observed_at", "record_id"]
    base = durable(global_position(incoming, order).drop("_late", "upstream_id", "version_no", "observed_at"))

    ids = base.select("pos", F.explode(F.array_distinct("identities")).alias("identity"))
    labels = base.filter("label IS NOT NULL").select("pos", "label", "title")
    if existing_works is not None:
        seed_pos = base.filter("seed").select(F.col("record_id").alias("work_id"), "pos", "title")
        if existing_ids is not None:
            known = existing_ids.select("identity", F.col("work_id").cast("string").alias("work_id"))
            ids = ids.unionByName(known.join(seed_pos, "work_id").select("pos", "identity"))
        old = existing_labels.select(F.col("work_id").cast("string").alias("work_id"), "label") \
            if existing_labels is not None else seed_pos.select("work_id", F.lit("").alias("label"))
        labels = labels.unionByName(old.join(seed_pos, "work_id").select("pos", "label", "title"))
    ids = durable(ids)
    # An identity of one record alone leads nowhere.
    linked = durable(ids.join(ids.groupBy("identity").agg(F.count("*").alias("_n")).filter("_n > 1"), "identity", "left_semi"))

    has_block = F.col("author").isNotNull() & F.col("year").isNotNull()
    blocked = base.filter(has_block).select("pos", *BLOCK)
    first_named = linked.groupBy("identity").agg(F.min("pos").alias("_first"))
    follows = linked.join(first_named, "identity").filter("_first < pos").select("pos").distinct().withColumn("_follows", F.lit(True))
    start = base.select("pos", "seed", *BLOCK).join(follows, "pos", "left").withColumn(
        "_free", ~F.col("seed") & has_block & F.col("_follows").isNull())
    waiting = _waiting_rank(start.filter("_free"))
    flags = durable(start.join(waiting, "pos", "left").select("pos", F.coalesce(F.col("_rank") < FIRST_WORKS, F.lit(True)).alias("accepted")))

    room, relink = FIRST_WORKS, True
    asked_before = shown_before = pairs = None
    while True:
        accepted = flags.filter("accepted").select("pos")
        if relink:
            links = durable(_exact_links(linked, accepted))
            parents = links.groupBy("pos").agg(F.min("claim").alias("parent"))
            rooted = _roots(parents.join(accepted, "pos", "left_semi"))
            # Roots of everything an identity may point at: followers by table, creators are their own.
            owners = links.join(rooted.select(F.col("pos").alias("claim"), "root"), "claim", "left").select(
                "pos", F.coalesce("root", "claim").alias("work")
            )
            exact = durable(owners.groupBy("pos").agg(F.min("work").alias("work"), F.max("work").alias("other")))
        member_of = accepted.join(exact.select("pos", "work"), "pos", "left").select(
            "pos", F.coalesce("work", "pos").alias("work")
        )
        members = member_of.join(labels, "pos")
        spans = durable(_title_spans(members).join(
            blocked.select(F.col("pos").alias("work"), *BLOCK), "work"
        ))
        asking = base.filter(~F.col("seed") & has_block).join(exact, "pos", "left_anti").select("pos", *BLOCK, "title")
        pairs, asked_before, shown_before = _known_pairs(asking, spans, threshold, pairs, asked_before, shown_before)
        close = _has_candidate(asking, spans, pairs).withColumn("close", F.lit(True))
        judged = (
            base.select("pos", "seed", *BLOCK).join(flags.select("pos", F.col("accepted").alias("guess")), "pos")
            .join(exact, "pos", "left").join(close, "pos", "left")
            .withColumn("_sure", F.col("seed") | F.when(F.col("work").isNotNull(), F.col("work") == F.col("other")).otherwise(~has_block))
            .withColumn("_fit", F.col("work").isNull() & ~F.col("seed") & has_block & F.col("close").isNull())
            .select("pos", *BLOCK, "guess", "_sure", "_fit")
        )
        judged = durable(judged)
        room *= GROWTH
        queue = _waiting_rank(judged.filter("_fit AND NOT guess"))
        changed = durable(judged.join(queue, "pos", "left").select(
            "pos", "guess", (F.col("_sure") | (F.col("_fit") & (F.col("guess") | (F.col("_rank") < room)))).alias("accepted"),
            (F.col("_rank") >= room).alias("waits")))
        differing = changed.filter("accepted <> guess")
        if changed.filter("accepted <> guess OR coalesce(waits, false)").isEmpty():
            break
        relink = not differing.join(linked, "pos", "left_semi").isEmpty()
        flags = changed.select("pos", "accepted")
    found = _frames(base, ids, labels, flags, exact, owners, spans, pairs, asking)
    if "authors" not in records.columns:
        return found
    created = found.decisions.filter("status = 'created'").select("record_id", "work_id")
    named = records.select(F.col("record_id").cast("string").alias("record_id"), F.posexplode("authors").alias("author_order", "author"))
    return replace(found, authors=created.withColumn("record_id", F.col("record_id").cast("string")).join(named, "record_id").select("work_id", F.col("author_order") + 1, "author").toDF("work_id", "author_order", "author"))


def _waiting_rank(free: DataFrame) -> DataFrame:
    """(pos, _rank): how many earlier records of the same author and year are free to found a work."""
    return sum_before(free.select("pos", *BLOCK), BLOCK, "pos", F.lit(1), "_rank").select("pos", "_rank")


def _known_pairs(asking, spans, threshold, pairs, asked_before, shown_before):
    """Close (asked, shown) titles, and the titles compared so far; only what is new on a side is compared."""
    keys = [*BLOCK, "title"]
    asked, shown = asking.select(*keys).distinct(), spans.select(*keys).distinct()
    if pairs is None:
        asked, shown = durable(asked), durable(shown)
        return durable(titles_near(asked, shown, BLOCK, threshold)), asked, shown
    new_asked = durable(asked.join(asked_before, keys, "left_anti"))
    new_shown = durable(shown.join(shown_before, keys, "left_anti"))
    if not new_shown.isEmpty():
        pairs = pairs.unionByName(durable(titles_near(asked_before, new_shown, BLOCK, threshold)))
        shown_before = shown_before.unionByName(new_shown)
    if not new_asked.isEmpty():
        pairs = pairs.unionByName(durable(titles_near(new_asked, shown_before, BLOCK, threshold)))
        asked_before = asked_before.unionByName(new_asked)
    return pairs, asked_before, shown_before


def _frames(base, ids, labels, flags, exact, owners, spans, pairs, asking) -> Resolution:
    """Split the stable state into the output frames."""
    accepted = flags.filter("accepted").select("pos")
    names = base.select(
        F.col("pos").alias("work"),
        F.when(F.col("seed"), F.col("record_id")).otherwise(F.sha2(F.col("record_id").cast("string"), 256))
        .alias("work_id"),
        F.col("author").alias("first_author"), "year",
    )
    member_of = accepted.join(exact.select("pos", "work"), "pos", "left").select(
        "pos", F.coalesce("work", "pos").alias("work"), F.col("work").isNull().alias("creates")
    )
    firsts = (
        member_of.join(labels, "pos").groupBy("work", "label")
        .agg(F.min(F.struct("pos", "title")).alias("v"))
        .select("work", "label", F.col("v.pos").alias("pos"), F.col("v.title").alias("title"))
    )
    firsts = durable(firsts)
    record = base.select("pos", "record_id", "seed", "label")
    status = (
        F.when(F.col("work").isNull(), "manual_review").when(F.col("creates"), "created")
        .when(F.col("new_label"), "revision_created").otherwise("already_known")
    )
    decisions = (
        record.filter("NOT seed").join(member_of, "pos", "left")
        .join(firsts.select("work", "label", "pos", F.lit(True).alias("new_label")), ["work", "label", "pos"], "left")
        .join(names.select("work", "work_id"), "work", "left")
        .select("record_id", status.alias("status"), "work_id", F.col("label").alias("version_label"))
    )
    current = latest_by(firsts, ["work"], [F.col("pos")])
    versions = (
        firsts.join(current.select("work", F.col("pos").alias("_last")), "work")
        .join(record.select("pos", "record_id"), "pos").join(names, "work")
        .select("work_id", F.col("label").alias("version_label"), "record_id", "title",
                (F.col("pos") == F.col("_last")).alias("is_current"))
    )
    works = (
        current.join(names, "work").join(record.select("pos", "record_id"), "pos")
        .select("work_id", "title", "first_author", "year", F.col("record_id").alias("current_version"))
    )
    claims = ids.join(accepted, "pos", "left_semi").groupBy("identity").agg(F.min("pos").alias("pos"))
    external = (
        claims.join(member_of, "pos").join(names, "work").join(record.select("pos", "record_id"), "pos")
        .select("identity", "work_id", "record_id")
    )
    conflicts = (
        owners.join(exact.filter("work <> other").select("pos"), "pos", "left_semi").distinct()
        .withColumn("matched_on", F.lit("external_id"))
    )
    lookalikes = (
        asking.join(accepted, "pos", "left_anti").join(pairs, [*BLOCK, "title"])
        .join(spans.select(*BLOCK, F.col("title").alias("other"), "work", "start", "until"), [*BLOCK, "other"])
        .filter("start < pos AND (until IS NULL OR pos < until)")
        .select("pos", "work").distinct().withColumn("matched_on", F.lit("title:first_author:year"))
    )
    review = (
        conflicts.unionByName(lookalikes).join(record.select("pos", "record_id"), "pos")
        .join(names.select("work", "work_id"), "work")
        .select("record_id", F.col("work_id").alias("candidate_work_id"), "matched_on")
    )
    return Resolution(decisions, works, versions, external, review)
