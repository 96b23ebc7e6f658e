import collections
import hashlib

import brute
import numpy as np
import public_tokenizers
import tiktoken
from oracle import TABLES, compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from scholarloom.llm import bpe, quality

SF_DIR = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    assert len(TABLES) == 14
    con = connect(SF_DIR)
    for name in ("op3_positional_decontamination", "op6_line_bitmaps", "op8_superkmer_dedup", "op9_host_line_frequency"):
        assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_pipeline_equals_plain_stages(spark):
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    good = {r.doc_id for r in quality.quality(read("documents"), read("labels")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in read("documents").collect() if r.doc_id in good]
    rows = [(d, kept) for d, _, _, kept in brute.line_dedup(rows)]
    rows = [row for row, (_, _, component) in zip(rows, brute.components(rows), strict=True) if row[0] == component]
    hit = {w[0] for w in brute.contamination(rows, [(r.item_id, r.text) for r in read("benchmark").collect()]) if w[5]}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = [(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t)) for d, t in rows if d not in hit for ids in [plain.encode_ordinary(t)]]
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == collections.Counter(want)
    assert len(corpus_pipeline.STAGES) == 5 and 0 < len(want) < len(good)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).schema.simpleString() == docs.schema.simpleString()
