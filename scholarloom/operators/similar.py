"""Exact similarity join of titles within a block, without comparing all pairs of a block.

A ratio of at least ``t`` leaves at most ``d = (1 - t) * (len a + len b)`` characters of the two
titles unmatched. Cut the shorter title into more than ``d`` chunks of ``q`` characters: some chunk
``j`` is untouched, with at most ``j`` edits before it and ``d - j`` after it, so it appears in the
longer title shifted by no more than that. An equality join of chunks with the q-grams of the longer
titles, keyed by a coarse position as well, therefore finds every pair that can reach the ratio. The
rows on both sides grow with the length of the titles only. The edit distance, which the JVM
computes within its budget, then drops most candidates before the ratio itself is computed.

Where one side has at most ``FEW`` titles of a block, these are set beside all titles of the other side instead: the
chunks of near titles, as numbered ones, all meet, so that the pairs alone are fewer rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.functions.similarity import matching_ratio
from scholarloom.session import durable

EPSILON = 1e-9
BUCKET = 8
#: Titles of a block that are set beside all others of it, and the slices the others are dealt into.
FEW, SLICES = 16, 32


def _budget(a: Column, b: Column, threshold: float) -> Column:
    """Most characters two titles of these lengths may leave unmatched."""
    return F.floor((1 - threshold) * (a + b) + F.lit(EPSILON)).cast("int")


def _longest(size: Column, threshold: float) -> Column:
    """Length of the longest title one of ``size`` can still match."""
    return F.floor(size * (2 - threshold) / threshold + F.lit(EPSILON)).cast("int")


def _shortest(size: Column, threshold: float) -> Column:
    return F.ceil(size * threshold / (2 - threshold) - F.lit(EPSILON)).cast("int")


def _chunk_length(short: Column, threshold: float) -> Column:
    """Length of the chunks that shorter titles of this length are cut into."""
    most = _budget(short, _longest(short, threshold), threshold)
    return F.greatest(F.lit(1), F.floor(short / (most + 1)).cast("int"))


def _sure(threshold: float) -> Column:
    """Whether a common beginning or end of title and other is long enough alone, as numbered titles have: the longest block the ratio starts from is at least as long."""
    enough = F.ceil(F.lit(threshold) * (F.length("title") + F.length("other")) / 2 - F.lit(EPSILON)).cast("int")
    sure = (F.left("title", enough) == F.left("other", enough)) | (F.right("title", enough) == F.right("other", enough))
    return sure & (F.length("title") >= enough) & (F.length("other") >= enough)


def _within(a: str, b: str, threshold: float) -> Column:
    """Whether the edit distance is within the budget; a distance beyond it is given up early, as -1."""
    return F.call_function("levenshtein", F.col(a), F.col(b), _budget(F.length(a), F.length(b), threshold)) >= 0


def close_titles(threshold: float) -> Column:
    """Whether ratio(title, other) reaches the threshold; the ratio is worked out where a common beginning or end does not tell."""
    sure = _sure(threshold)
    ratio = matching_ratio(F.when(~sure, F.col("title")), F.when(~sure, F.col("other")))
    return sure | (ratio >= threshold)


def _chunks(sized: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """The chunks a title is cut into as the shorter one of a pair, in every bucket of positions an untouched one can be found in."""
    longest = _longest(F.col("size"), threshold)
    cut = sized.select("*", _chunk_length(F.col("size"), threshold).alias("q"), _budget(F.col("size"), longest, threshold).alias("most"), (longest - F.col("size")).alias("extra"))
    chunks = cut.withColumn("index", F.explode(F.sequence(F.lit(0), F.col("most"))))
    start, left = F.col("index") * F.col("q"), F.col("most") - F.col("index")
    first = F.greatest(F.lit(0), start - F.least(F.col("index"), left))
    last = start + F.least(F.col("index"), F.col("extra") + left)
    return chunks.select(
        *block, F.col("title").alias("short_title"), F.col("size").alias("short"), "q", "index",
        F.col("title").substr(start + 1, F.col("q")).alias("gram"),
        F.explode(F.sequence(F.floor(first / BUCKET), F.floor(last / BUCKET))).alias("bucket"))


def _grams(sized: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """The grams of a title as the longer one, cut the way each shorter partner it may have is cut: one or two ways."""
    sizes = sized.select("size").distinct()
    partners = F.sequence(F.greatest(F.lit(1), _shortest(F.col("size"), threshold)), F.col("size"))
    ways = sizes.select("size", F.explode(F.array_distinct(F.transform(partners, lambda s: _chunk_length(s, threshold)))).alias("q")).filter("size >= q")
    return sized.join(F.broadcast(ways), "size").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("q")))).select(
        *block, F.col("title").alias("long_title"), F.col("size").alias("long"), "q", "at",
        F.col("title").substr(F.col("at") + 1, F.col("q")).alias("gram"),
        F.floor(F.col("at") / BUCKET).alias("bucket"))


def _near(shorter: DataFrame, longer: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, long_title, short_title) pairs of different titles within the edit budget."""
    budget = _budget(F.col("short"), F.col("long"), threshold)
    shift = F.col("at") - F.col("index") * F.col("q")
    extra = F.col("long") - F.col("short")
    found = _chunks(shorter, block, threshold).join(_grams(longer, block, threshold), [*block, "q", "gram", "bucket"]).filter(
        (extra >= 0) & (F.col("long_title") != F.col("short_title"))
        & (2 * F.col("short") >= F.lit(threshold) * (F.col("short") + F.col("long")) - F.lit(EPSILON))
        & (F.col("index") <= budget) & (F.abs(shift) <= F.col("index")) & (F.abs(extra - shift) <= budget - F.col("index"))
        & _within("long_title", "short_title", threshold))
    return found.select(*block, "long_title", "short_title").distinct()


def _beside(few: DataFrame, others: DataFrame, block: list[str]) -> DataFrame:
    """Every title of ``few`` beside every one of ``others`` in its block; a large block is dealt into slices."""
    spread = few.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    dealt = others.withColumn("_slice", F.pmod(F.xxhash64(*others.columns), F.lit(SLICES)).cast("int"))
    return dealt.join(spread, [*block, "_slice"])


def _direct(pairs: DataFrame, block: list[str], threshold: float) -> DataFrame:
    a, b = F.length("title"), F.length("other")
    fits = 2 * F.least(a, b) >= F.lit(threshold) * (a + b) - F.lit(EPSILON)
    return pairs.select(*block, "title", "other").filter((F.col("title") != F.col("other")) & fits & (_sure(threshold) | _within("title", "other", threshold)))


def titles_near(asked: DataFrame, shown: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, title, other): ``title`` asked, ``other`` shown, with ratio(title, other) >= threshold, equal titles included.

    Both sides have one row per distinct (block, title). Rows grow with the asked titles times the shown ones of their grams, so
    a side that is kept small, as the works of a series are, keeps the join small whatever the other side holds.
    """
    ask, show = asked.select(*block, "title"), shown.select(*block, F.col("title").alias("other"))
    met = ask.groupBy(*block).agg(F.count("*").alias("_asked")).join(show.groupBy(*block).agg(F.count("*").alias("_shown")), block)
    met = durable(met.select(*block, F.when(F.col("_shown") <= FEW, "shown").when(F.col("_asked") <= FEW, "asked").otherwise("many").alias("_few")))
    kinds = {row[0] for row in met.select("_few").distinct().collect()}  # three at most
    of = lambda frame, few: frame.join(met.filter(F.col("_few") == few).select(*block), block, "left_semi")
    near = [ask.join(show.withColumnRenamed("other", "title"), [*block, "title"], "left_semi").select(*block, "title", F.col("title").alias("other"))]
    if "shown" in kinds:
        near.append(_direct(_beside(of(show, "shown"), of(ask, "shown"), block), block, threshold).filter(close_titles(threshold)))
    if "asked" in kinds:
        near.append(_direct(_beside(of(ask, "asked"), of(show, "asked"), block), block, threshold).filter(close_titles(threshold)))
    if "many" in kinds:
        sized = lambda frame, name: of(frame, "many").select(*block, F.col(name).alias("title"), F.length(name).alias("size"))
        asking, showing = sized(ask, "title"), sized(show, "other")
        found = _near(asking, showing, block, threshold).select(*block, F.col("short_title").alias("title"), F.col("long_title").alias("other")).unionByName(
            _near(showing, asking, block, threshold).select(*block, F.col("long_title").alias("title"), F.col("short_title").alias("other"))).distinct()
        near.append(found.filter(close_titles(threshold)))
    return reduce(DataFrame.unionByName, near)


def similar_titles(titles: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, title, other) pairs, both directions, with ratio(title, other) >= threshold.

    ``titles`` has one row per distinct (block, title). The pair of a title with itself is included. The result has every pair; use
    ``titles_near`` where one side is small.
    """
    shared = titles.groupBy(*block).agg(F.count("*").alias("_n")).filter("_n > 1").select(*block)
    sized = titles.join(shared, block, "left_semi").select(*block, "title", F.length("title").alias("size"))
    both = _near(sized, sized, block, threshold).select(*block, F.explode(F.array(
        F.struct(F.col("long_title").alias("title"), F.col("short_title").alias("other")),
        F.struct(F.col("short_title").alias("title"), F.col("long_title").alias("other")),
    )).alias("p")).select(*block, "p.title", "p.other").distinct()
    close = both.filter(close_titles(threshold))
    return close.unionByName(titles.select(*block, "title", F.col("title").alias("other")))
