"""URL filters: host and path rules first, then gradient-boosted trees on lexical features; DataFrame functions and Spark ML only.

Features: lengths, depth, digit ratio, entropy of the characters, hyphens, parameters, and how often URLs of the same host suffix are
bad among all labelled URLs (smoothed); these shares are a stored table that is joined. The trees are fitted on at most ``SAMPLE`` labelled URLs, those with
the smallest hashes.

- Null url or one without ``://``: empty host and path; no rule fits; the trees judge it like any other.
- Repeated rows: one result each. No training URLs, or all of one label: every URL without a rule is allowed (or blocked, if all are bad).
- Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarloom.llm.common import stored
from scholarloom.llm.rules import bound

SAMPLE = 20_000
TREES, DEPTH, BINS, SEED = 12, 3, 64, 11
SMOOTHING = 20
BLOCK_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "labels", "hyphens", "depth", "digit_ratio", "entropy", "parameters", "suffix_bad", "top_bad"]
#: Words of a host that common block lists name (adult, gambling, advertising, spam, pharmacy).
LISTED = ["adult", "porn", "sex", "casino", "poker", "bet", "bets", "ads", "adserver", "spam", "pills", "viagra"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in longest]
    none = F.lit(None).cast("string")
    return (F.coalesce(*[F.when(f, F.lit(r.name)) for f, r in zip(fits, longest, strict=True)], none),
            F.coalesce(*[F.when(f, F.lit(r.verdict)) for f, r in zip(fits, longest, strict=True)], none))


def entropy(text: Column) -> Column:
    """Bits a character."""
    def told(chars: Column) -> Column:
        def one(char: Column) -> Column:
            p = F.size(F.filter(chars, lambda c: c == char)) / F.size(chars)
            return -p * F.log2(p)
        return F.aggregate(F.transform(F.array_distinct(chars), one), F.lit(0.0), lambda a, b: a + b)

    return F.when(F.length(text) > 0, bound(F.split(text, ""), told)).otherwise(F.lit(0.0))


def ends(host: Column) -> tuple[Column, Column]:
    """(suffix, top): the last two labels of a host, and the last."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path, suffixes and the lexical features of ``url``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = parts(url)
    cut = pages.withColumns({"host": host, "path": path, "whole": url})
    size = F.greatest(F.length("whole"), F.lit(1))
    count = lambda pattern, column: F.regexp_count(column, F.lit(pattern))
    return cut.withColumns({
        "suffix": ends(F.col("host"))[0], "top": ends(F.col("host"))[1],
        "url_length": F.length("whole").cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "labels": count(r"\.", "host").cast("double"), "hyphens": count("-", "host").cast("double"), "depth": count("/", "path").cast("double"),
        "digit_ratio": count("[0-9]", "whole") / size, "entropy": entropy(F.col("host")), "parameters": count("[?&][^?&=#]+=", "whole").cast("double")}).drop("whole")


def suffix_rates(training: DataFrame, key: str, into: str) -> DataFrame:
    """(key, share of bad URLs, drawn towards the share of all), over all rows of ``training``."""
    whole = training.agg(F.coalesce(F.avg("bad"), F.lit(0.0)).alias("all"))
    return training.groupBy(key).agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).join(whole).select(
        key, ((F.col("bad") + SMOOTHING * F.col("all")) / (F.col("n") + SMOOTHING)).alias(into))


class UrlModel:
    """Trees and suffix statistics fitted on (url, bad) rows."""

    def __init__(self, labelled: DataFrame) -> None:
        chosen = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select("url", F.col("bad").cast("double").alias("bad"))
        suffix, top = ends(parts(F.col("url"))[0])
        counted = chosen.select(suffix.alias("suffix"), top.alias("top"), "bad")
        self.share = counted.agg(F.avg("bad")).first()[0] or 0.0
        self.tables = {k: stored(suffix_rates(counted, k, into), f"rates-{k}") for k, into in (("suffix", "suffix_bad"), ("top", "top_bad"))}
        training = lexical(chosen.orderBy(F.xxhash64("url"), "url", "bad").limit(SAMPLE)).drop("path").cache()
        self.model, of_sample = None, training.agg(F.avg("bad")).first()[0] or 0.0
        if 0 < of_sample < 1:
            fitted = self._assembled(training).withColumn("label", F.col("bad"))
            self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED, featuresCol="features", labelCol="label").fit(fitted.select("features", "label"))
        training.unpersist()

    def _assembled(self, frame: DataFrame) -> DataFrame:
        joined = frame.join(self.tables["suffix"], "suffix", "left").join(self.tables["top"], "top", "left")
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined.fillna(self.share, ["suffix_bad", "top_bad"]))

    def scored(self, pages: DataFrame) -> DataFrame:
        """``pages`` (page_id, url) with host, path and ``bad_score``."""
        if self.model is None:
            return lexical(pages).withColumn("bad_score", F.lit(float(self.share)))
        return self.model.transform(self._assembled(lexical(pages))).withColumn("bad_score", F.get(vector_to_array("probability"), F.lit(1)))


def listed_urls(pages: DataFrame) -> DataFrame:
    """(url, bad): a URL is bad if a word of its host is on a block list."""
    words = F.split(parts(F.col("url"))[0], "[.-]")
    return pages.where(F.col("url").isNotNull()).select("url", F.arrays_overlap(words, F.array(*[F.lit(w) for w in LISTED])).cast("int").alias("bad"))


def judged(pages: DataFrame, labelled: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_score): the rule's verdict, else the trees'."""
    scored = UrlModel(labelled).scored(pages.select("page_id", "url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("bad_score") >= BLOCK_AT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), "bad_score")
