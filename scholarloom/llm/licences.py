"""License scans: sparse TF-IDF cosines of header lines and licence files to templates, then inheritance from the nearest directory.

Every line of every file is compared with every notice; every comment block (joined comment lines) with notices and licence texts; every paragraph
and every file as a whole with the texts, which must come to ``LEAST_TEXT``. The best line or block counts, unless a text is found: in
a paragraph, over it in a block, over both in the whole file, as texts of several licences share paragraphs. In a comparison a term's weight is its count in the line times its inverse document frequency,
counted over all files; terms that no template has count in the line's length only, with the weight ``OTHER`` at most, so that names, years and
usual words of a header weigh the same among ten files and among a billion. A file's licence is the template of its best
line, if the cosine is ``LEAST`` or more. A licence file (by its name) gives its licence to its directory; a file without a licence of its
own takes that of the nearest directory above it that has one.

- Null or empty text: no licence of its own. Null path: the root directory, no name.
- Ties: the template that sorts first; for a directory with several licence files the highest cosine, then the licence that sorts first.
- Repeated rows: one result each. Empty table: no rows; no templates: no licences. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import ALNUM, LOWER, columns, mixed, small_batches, split_words, utf8, word_hashes
from scholarloom.llm.licence_texts import all_texts

LEAST, LEAST_TEXT = 0.6, 0.75
MARKS = np.zeros(256, bool)
MARKS[list(b"#*/;%-")] = True  # what comment lines begin with
OTHER = float(np.log(4) + 1)  # the weight of a word that a quarter of the files hold
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Licence notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


class Templates:
    """Distinct terms of all templates (sorted hashes) and the count of each in each template."""

    def __init__(self, templates: dict[str, str] | list[tuple[str, str]]) -> None:
        pairs = sorted(templates.items() if isinstance(templates, dict) else templates)
        self.names = [n for n, _ in pairs]
        whole = [LOWER[np.frombuffer(t.encode(), np.uint8)] for _, t in pairs]
        hashes = []
        for data in whole:
            starts, ends, _ = split_words(data, np.array([0, len(data)]), ALNUM)
            hashes.append(word_hashes(data, starts, ends).view(np.int64))
        self.terms = np.unique(np.concatenate([*hashes, np.zeros(0, np.int64)]))
        self.counts = np.zeros((len(self.terms), len(self.names)))
        for k, own in enumerate(hashes):
            np.add.at(self.counts[:, k], np.searchsorted(self.terms, own), 1)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the terms, whether it is one)."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
        return at, self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)


def _holders(templates: Templates):
    """Per batch: how many files hold each template term, and how many files there are (term -1)."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            data = LOWER[data]
            starts, ends, first = split_words(data, offsets, ALNUM)
            at, known = templates.place(word_hashes(data, starts, ends).view(np.int64))
            file = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            pairs = np.unique(file[known] * max(1, len(templates.terms)) + at[known]) % max(1, len(templates.terms))
            terms, counts = np.unique(pairs, return_counts=True)
            yield columns(schema, term=np.append(terms, -1).astype(np.int32), n=np.append(counts, len(offsets) - 1))
    return work


def inverse_frequencies(files: DataFrame, templates: Templates) -> tuple[np.ndarray, float]:
    """(weight of each template term, weight of any other term), over all files."""
    small_batches(files.sparkSession)
    rows = files.select(F.col("text").cast("string").alias("text")).mapInArrow(_holders(templates), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return weights_of(rows, templates)


def weights_of(rows: list, templates: Templates) -> tuple[np.ndarray, float]:
    held, n = np.zeros(len(templates.terms)), 0
    for r in rows:
        if r.term < 0:
            n = r.n
        else:
            held[r.term] = r.n
    return np.log((1 + n) / (1 + held)) + 1, min(OTHER, float(np.log(1 + n) + 1))


class Words:
    """Words of a batch of texts: hash, text, and the line, comment block (-1 outside) and paragraph of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data, self.texts = LOWER[data], len(offsets) - 1
        starts, ends, first = split_words(data, offsets, ALNUM)
        self.hashes = word_hashes(data, starts, ends)
        self.text = np.repeat(np.arange(self.texts), np.diff(first))
        breaks = np.flatnonzero(data == 10)
        number = np.searchsorted(breaks, starts)
        self.line = number + self.text  # distinct for every line of every text, and rising
        new_text, step = np.diff(self.text, prepend=-1) != 0, np.diff(number, prepend=-2)
        self.paragraph = np.cumsum(new_text | (step > 1))
        opens = np.flatnonzero(new_text | (step > 0))  # the first word of each line that has words
        begin = np.maximum(np.append(-1, breaks)[number[opens]] + 1, offsets[self.text[opens]])
        marks = np.append(0, np.cumsum(MARKS[data]))
        comment = np.repeat(marks[starts[opens]] > marks[begin], np.diff(np.append(opens, len(starts))))
        self.block = np.where(comment, np.cumsum(new_text | (np.diff(comment, prepend=False))), -1)


def best_of_texts(data: np.ndarray, offsets: np.ndarray, templates: Templates, weights: np.ndarray, rare: float) -> tuple[np.ndarray, np.ndarray]:
    """(best template or -1, its cosine) over the lines of each text."""
    words = Words(data, offsets)
    return best_of_units(words, words.line, templates, weights, rare)


def best_of_units(words: Words, unit: np.ndarray, templates: Templates, weights: np.ndarray, rare: float) -> tuple[np.ndarray, np.ndarray]:
    """(best template or -1, its cosine) over the units of each text; words of unit -1 are left out."""
    n, inside = words.texts, unit >= 0
    best, cosine = np.full(n, -1, np.int64), np.zeros(n)
    hashes, text, line = words.hashes[inside], words.text[inside], unit[inside]
    if not len(hashes) or not len(templates.terms):
        return best, cosine
    keys = mixed(hashes + line.astype(np.uint64) * np.uint64(0x9E37_79B9_7F4A_7C15))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    bounds = np.flatnonzero(new)
    chosen, counts = order[bounds], np.diff(np.append(bounds, len(order)))
    at, known = templates.place(hashes[chosen].view(np.int64))
    worth = counts * np.where(known, weights[at], rare)
    lines, where = np.unique(line[chosen], return_inverse=True)
    size = np.sqrt(np.bincount(where, worth * worth))
    scaled = templates.counts * weights[:, None]
    scaled /= np.sqrt((scaled * scaled).sum(axis=0))
    owner = np.zeros(len(lines), np.int64)
    owner[where] = text[chosen]
    for k in range(len(templates.names)):
        dots = np.bincount(where[known], worth[known] * scaled[at[known], k], minlength=len(lines)) / size
        top = np.zeros(n)
        np.maximum.at(top, owner, dots)
        better = top > cosine
        best[better], cosine[better] = k, top[better]
    return best, cosine


def own_licences(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, bodies: list[tuple[str, str]] | None = None, least_text: float = LEAST_TEXT) -> DataFrame:
    """``files`` with ``licence`` and ``cosine``: of the unit that counts, else null and the cosine of the best line.

    Given ``templates``, only the ``bodies`` given are compared as texts.
    """
    notices = TEMPLATES if templates is None else templates
    bodies = bodies if bodies is not None else all_texts() if templates is None else []
    held, long, both = Templates(notices), Templates(bodies), Templates([*notices.items(), *bodies])
    every, rare = inverse_frequencies(files, both)
    weights, long_weights = every[np.searchsorted(both.terms, held.terms)], every[np.searchsorted(both.terms, long.terms)]

    @F.arrow_udf(T.StructType([T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType())]))
    def scan(text: pa.Array) -> pa.Array:
        words = Words(*utf8(text))
        best, cosine = best_of_units(words, words.line, held, weights, rare)
        names = [held.names[b] if b >= 0 and c >= least else None for b, c in zip(best.tolist(), cosine.tolist(), strict=True)]
        for unit, own, own_weights, limit in ((words.block, held, weights, least), (words.paragraph, long, long_weights, least_text), (words.block, long, long_weights, least_text), (words.text, long, long_weights, least_text)):
            found, value = best_of_units(words, unit, own, own_weights, rare)
            for k in np.flatnonzero((found >= 0) & (value >= limit) & ((own is long) | (value > cosine))).tolist():
                names[k], cosine[k] = own.names[found[k]], value[k]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(cosine, pa.float64())], names=["licence", "cosine"])

    return files.withColumn("llm_found", scan(F.col("text").cast("string"))).withColumns({"licence": F.col("llm_found.licence"), "cosine": F.col("llm_found.cosine")}).drop("llm_found")


def directory(path: Column) -> Column:
    """The directory of a path, without its last slash; the root is the empty text."""
    return F.regexp_replace(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))), "/[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """(path, licence, cosine, scope, from_directory) of ``files`` (path, licence, cosine).

    ``scope``: own, inherited or none. Directories, not files, are joined with their ancestors, so a directory with very many files takes part once.
    """
    own = files.select("path", "licence", "cosine", directory(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).rlike(FILE_NAMES).alias("is_licence"))
    given = own.where(F.col("is_licence") & F.col("licence").isNotNull()).groupBy("dir", "licence").agg(F.max("cosine").alias("cosine"))
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "licence")).alias("best")).select(F.col("dir").alias("above"), F.col("best.licence").alias("given"))
    depth = F.size(F.split("dir", "/"))
    above = own.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/").alias("above")))).alias("a"))
    nearest = above.select("dir", "a.depth", "a.above").join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    joined = own.join(nearest, "dir", "left")
    return joined.select(
        "path", F.coalesce("licence", "near.given").alias("licence"), "cosine",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("scope"),
        F.when(F.col("licence").isNull(), F.col("near.above")).alias("from_directory"))
