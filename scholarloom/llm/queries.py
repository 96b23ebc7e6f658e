"""Registered queries of this package and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarloom.llm import bpe, licences, lines, negatives, periodic, phrases, pii, pii_examples, pseudo, quality, rules, simhash, superkmer, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("op1_quality_votes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_url_trees")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.listed_urls(pages), URL_RULES)


@query("op3_positional_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM q),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN q USING (g)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""".replace("LOWERED", LOWERED))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_pseudo_likelihood")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.pseudo_likelihood(table(spark, sf_dir, "documents"))


@query("op5_simhash_blocks")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(simhash.real_id("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), simhash.real_id("component_id").alias("component_id"))


@query("op6_line_bitmaps", r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, BLANKS), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT doc_id, pos, line, coalesce(owner < doc_id, false) AS dropped FROM l LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""".replace("BLANKS", BLANKS))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_digests(table(spark, sf_dir, "documents"))


@query("op7_license_inheritance")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source, language and a number are the directories; every fiftieth file is a licence file, some of them one or two directories up."""
    doc = F.col("doc_id")
    name = F.when(doc % 50 == 0, F.concat(F.lit("LICENSE-"), doc)).otherwise(F.concat(F.lit("f"), doc, F.lit(".txt")))
    number = (F.crc32(doc.cast("string").cast("binary")) % 8).cast("string")
    path = F.when(doc % 250 == 0, F.concat_ws("/", "source", name)).when(doc % 100 == 0, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", number, name))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    return licences.inherited(licences.own_licences(files))


@query("op8_superkmer_dedup", r"""
WITH d AS (SELECT doc_id, WORDS AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
o AS (SELECT g, min(doc_id) AS owner FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN o USING (g) WHERE owner < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
m AS (SELECT x.doc_id, pos, word, gone.doc_id IS NOT NULL AS removed FROM x LEFT JOIN gone USING (doc_id, pos)),
s AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""".replace("WORDS", BLANK_WORDS))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.kept_digests(table(spark, sf_dir, "documents"))


@query("op9_host_line_frequency", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, WORDS AS w, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
v AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS x FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT d.doc_id, host, s, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             len(list_filter(s, lambda x: trim(x, BLANKS) <> '')) - len(list_distinct(list_filter(s, lambda x: trim(x, BLANKS) <> ''))) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id)),
l AS (SELECT doc_id, host, lower(trim(line, BLANKS)) AS line FROM (SELECT doc_id, host, unnest(s) AS line FROM d)),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
common AS (SELECT host, line FROM l JOIN hosts USING (host) WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT doc_id) > 2 AND (count(DISTINCT doc_id) > 0.05 * max(docs) OR count(DISTINCT doc_id) > 100)),
rest AS (SELECT doc_id FROM l LEFT JOIN (SELECT host, line, true AS common FROM common) USING (host, line) WHERE line <> ''
         GROUP BY doc_id HAVING coalesce(sum(CASE WHEN common IS NULL THEN length(line) END), 0) < 0.5 * sum(length(line)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM rest) AS kept
FROM b""".replace("WORDS", BLANK_WORDS).replace("BLANKS", BLANKS))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


@query("op10_bpe_bitmap_queue")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_repeated_tails(table(spark, sf_dir, "documents")))
    best = F.col("best")
    told = F.concat_ws("", F.transform("runs", lambda run: F.concat(F.concat_ws(",", run.start, run.length, run.period), F.lit("\n"))))
    return found.withColumn("best", periodic.best_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, number % 100 == 0)


@query("op13_personal_data")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), pii_examples.labelled(spark))
    base = F.filter("spans", lambda span: ~span.added)
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda span: F.concat_ws(":", span.kind, span.start, span.end)))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda span: span.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
