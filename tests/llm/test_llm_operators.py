import collections
import random
import re
import textwrap

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

from scholarloom.llm import bpe, licence_texts, licences, lines, phrases, pseudo, quality, rules, simhash, superkmer, urls
from scholarloom.llm.common import utf8
from scholarloom.llm.components import component_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def same(frame, want):
    assert collections.Counter(map(tuple, frame.collect())) == collections.Counter(want)


def test_line_dedup(docs, cases, none):
    want = brute.line_dedup(cases)
    assert sum(w[2] for w in want) > 5
    same(lines.kept_digests(docs), [(d, n, gone, brute.sha(kept)) for d, n, gone, kept in want])
    texts = lines.kept_texts(docs)
    assert texts.columns == docs.columns
    same(texts.select("doc_id", F.coalesce("text", F.lit(""))), [(d, kept) for d, _, _, kept in want])
    assert texts.where("text is not null and n_chars != length(text)").count() == 0
    assert lines.kept_digests(none).count() == 0 and lines.kept_texts(none).count() == 0


def test_a_key_over_many_ranges_has_one_owner(spark):
    rows = [(k, "the same line everywhere\nline number %d" % k) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same(lines.kept_digests(frame), [(d, n, gone, brute.sha(kept)) for d, n, gone, kept in brute.line_dedup(rows)])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_near_duplicates(docs, cases, none):
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    want = [(brute.order(d), signed(fp), brute.order(c)) for d, fp, c in brute.components(cases)]
    same(simhash.near_duplicates(docs), want)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.select("doc_id").distinct().count() == kept.count() == len({c for _, _, c in want})
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_one_row_of_every_group_whatever_the_ids(spark):
    """Groups of null ids only, and a doc_id with different texts in two groups, keep a row each; copies do not."""
    other = [" ".join("%s%d" % (w, k * j) for j in range(40)) for k, w in enumerate(["red", "green", "blue", "grey"], 1)]
    rows = [(None, other[0]), (None, other[0]), (None, other[1]), (7, other[2]), (7, other[3]), (9, other[3]), (7, other[2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({c[1] for c in brute.components(rows)}) == 4
    same(simhash.one_of_each(frame), [(None, other[0]), (None, other[1]), (7, other[2]), (7, other[3])])


def test_rows_of_one_id_are_contaminated_by_their_own_text(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, passage), (None, "clean"), (3, "x " + passage), (3, "also clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    same(phrases.uncontaminated(docs, items, by_row=True), [(None, "clean"), (3, "also clean"), (3, None)])
    assert phrases.uncontaminated(docs, items).count() == 0


def test_every_close_pair_shares_a_key_and_tiles_lose_no_link(spark, monkeypatch):
    draw = np.random.default_rng(3)
    base = draw.integers(-2**63, 2**63 - 1, 12)
    flips = [x ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), draw.choice(64, 3, replace=False).astype(np.int64))) for x in base for _ in range(20)]
    values = sorted({int(v) for v in [*base, *flips]})
    for a in values[:60]:
        for b in values:
            if a != b and (((a ^ b) & (2**64 - 1)).bit_count() <= 3):
                assert any(a & m == b & m for m in simhash.MASKS)
    monkeypatch.setattr(simhash, "TILE", 4)
    roots = {r.node: r.root for r in component_of(simhash.close_links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {v: roots.get(v, v) for v in values} == {v: find(v) for v in values}


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in component_of(links).collect()} == {0}


@pytest.mark.parametrize("block", [phrases.BLOCK_CHARS, 150])
def test_contamination(spark, docs, cases, none, block):
    words = brute.alnum_words(cases[0][1])
    items = [(1, " ".join(words[5:30])), (2, "One, TWO!"), (3, None), (4, "..."), (None, " ".join(words[40:52])), (5, "no such words in any text at all here or there"), (1, " ".join(words[5:30]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute.contamination(cases, items)
    assert sum(w[5] for w in want) > 4
    found = phrases.phrase_matches(phrases.positional_index(docs), bench, block_chars=block)
    same(found.select("n_words", phrases._covered("spans", "n_words"), F.size("items")), [w[1:4] for w in want])
    if block == phrases.BLOCK_CHARS:
        same(phrases.contamination(docs, bench), want)
        clean = phrases.uncontaminated(docs, bench)
        hit = {w[0] for w in want if w[5]}
        assert clean.columns == docs.columns and clean.count() == sum(w[0] not in hit for w in want)
        assert phrases.contamination(none, bench).count() == 0
        assert phrases.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x y z beta q gamma")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    index = phrases.positional_index(docs)
    near = {slop: {r.doc_id for r in phrases.phrase_matches(index, item, slop=slop).where(F.size("items") > 0).collect()} for slop in (0, 1, 4)}
    assert near == {0: {1}, 1: {1, 2}, 4: {1, 2}} or near[0] == {1} and near[1] == {1, 2}


def test_substring_dedup(docs, cases, none):
    want = brute.substring_dedup(cases)
    assert sum(w[2] for w in want) > 100
    same(superkmer.kept_digests(docs), want)
    same(superkmer.kept_texts(docs).select("doc_id", F.sha2("text", 256)), [(w[0], w[3]) for w in want])
    assert superkmer.kept_digests(none).count() == 0


def test_texts_of_one_id_are_told_apart_by_the_whole_hash(spark):
    """Rows of one id whose text hashes agree in the upper half: words of one are not removed from the other."""
    passage = " ".join("p%d" % k for k in range(20))
    texts = spark.range(200_000).select(F.concat(F.lit(passage + " a"), "id").alias("a"), F.concat(F.lit("u"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("w"), k, F.lit("x"), F.col("id"))), " ")).alias("b"))
    upper = lambda c: F.shiftright(F.xxhash64(c), 32)
    both = texts.select("a", upper("a").alias("h")).join(texts.select("b", upper("b").alias("h")), "h").orderBy("a").first()
    assert both is not None
    rows = [(1, passage), (None, both.a), (None, both.b)]
    same(superkmer.kept_digests(spark.createDataFrame(rows, "doc_id long, text string")), brute.substring_dedup(rows))


def test_a_bucket_of_one_minimiser_is_dealt_further(spark, monkeypatch):
    """Every window of every document holds the same words, so one bucket gets all; with a low limit it is split, and the rows stay right."""
    rows = [(k, " ".join("x y z n%d m%d" % ((k * 7 + j) % 40, j % 3) for j in range(30))) for k in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(superkmer, "SPLIT_BYTES", 2_000)
    monkeypatch.setattr(superkmer, "ESTIMATED", 1)
    assert max(superkmer._splits(frame, 13, 16).values()) > 3
    same(superkmer.kept_digests(frame), brute.substring_dedup(rows))


def test_rules(docs, cases, none):
    same(rules.measures(docs.select("doc_id", "text")), [(d, *brute.measures(t)) for d, t in cases])
    kept = rules.judged(docs)
    assert kept.count() == len(cases) and kept.where("kept and base_failed").count() == 0
    assert rules.judged(none).count() == 0


def test_common_lines_deplete(spark):
    rows = [(k, "h" if k < 30 else None, "the very same long line of every document\n" + ("own words %d and more of them, quite enough to stay" % k if k % 2 else "no")) for k in range(60)]
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, source string, text string")
    gone = {r.doc_id for r in rules.depleted(frame, least_docs=20, share=0.5, left=0.3).collect()}
    assert gone == {k for k in range(60) if k % 2 == 0}
    assert rules.depleted(frame, least_docs=30).count() == 0


def test_common_lines_are_taken_out_of_the_texts(spark):
    menu = "  Home | Products | CONTACT us "
    rows = [(k, "h" if k % 2 else None, "own title %d\n%s\n\nown body of number %d, long enough\n%s" % (k, menu, k, menu.lower()), 7) for k in range(60)]
    rows += [(90, "h", menu + "\n" + menu, 7), (91, "other", menu + "\nx", 7), (1, "h", "another text\n" + menu, 7), (None, "h", None, None), rows[3]]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int").repartition(3)
    cut = lambda text, host: text if host == "other" or text is None else "\n".join(x for x in text.split("\n") if x.strip().lower() != menu.strip().lower())
    want = [(d, h, cut(t, h), n if cut(t, h) == t else len(cut(t, h))) for d, h, t, n in rows]
    found = rules.without_common_lines(frame, least_docs=20, share=0.5)
    assert found.schema == frame.schema
    same(found, want)
    same(rules.kept_texts(frame, least_docs=20, share=0.5, left=0.3), [w for w in want if w[0] != 90])


RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def test_urls(spark):
    cases = [
        (1, "http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "x://net", "net", "", None, None), (3, "x://net/", "net", "/", "net/", "block"),
        (4, "https://example.com/de/?q=/x", "example.com", "/de/", "example.com/de/", "block"), (5, "https://notexample.com/de/", "notexample.com", "/de/", None, None),
        (6, "http://a.org/fr/#top", "a.org", "/fr/", "org/fr/", "allow"), (7, None, "", "", None, None), (8, "no scheme", "", "", None, None), (9, "", "", "", None, None),
        (10, "a://b://c/d", "b:", "//c/d", None, None), (11, "http://x.net?y=/en/", "x.net", "", None, None), (11, "http://x.net?y=/en/", "x.net", "", None, None),
        (None, "http://evil.net/\nen/" + "z" * 50_000, "evil.net", "/\nen/" + "z" * 50_000, "net/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in cases], "page_id long, url string, host string, rule string")
    got = urls.judged(pages, urls.listed_urls(pages), RULES)
    same(got.select("page_id", "host", "path", "rule"), [(i, h, p, r) for i, _, h, p, r, _ in cases])
    assert got.where("verdict is null or rule is not null and verdict != case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end").count() == 0
    assert urls.judged(pages.where("false"), urls.listed_urls(pages.where("false")), RULES).count() == 0


def test_url_trees_learn(spark):
    rows = [(k, "http://%s.example.com/p/%d" % ("casino-%d" % (k % 50) if k % 5 == 0 else "site%d" % (k % 70), k)) for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(pages, urls.listed_urls(pages), []).collect()}
    assert got == {k: "block" if k % 5 == 0 else "allow" for k in range(600)}


def test_shares_of_suffixes_count_all_labelled_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE", 40)
    rows = [("http://a%d.%s%d.test/" % (k, "bad" if k % 2 else "fine", k % 60), k % 2) for k in range(1_200)] + [(None, 1), ("http://x.none.test/", None)]
    model = urls.UrlModel(spark.createDataFrame(rows, "url string, bad int"))
    got = {r.suffix: r.suffix_bad for r in model.tables["suffix"].collect()}
    assert model.share == 0.5 and len(got) == 60 and model.model is not None
    for suffix, rate in got.items():
        assert abs(rate - ((20 if suffix.startswith("bad") else 0) + urls.SMOOTHING * 0.5) / (20 + urls.SMOOTHING)) < 1e-12
    pages = spark.createDataFrame([(1, "http://new.bad31.test/"), (2, "http://new.fine30.test/"), (3, "http://new.unseen.test/")], "page_id long, url string")
    told = {r.page_id: r.suffix_bad for r in model._assembled(urls.lexical(pages)).collect()}
    assert told == {1: got["bad31.test"], 2: got["fine30.test"], 3: 0.5}


def test_quality(spark, docs, cases, none):
    data = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    judged = quality.quality(real, labels).join(labels, "doc_id").where("held_out")
    right = judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    model = quality.fit(real, labels)
    scored = quality.scored(docs, model)
    assert scored.columns == [*docs.columns, "llm_score"] and scored.count() == len(cases) and scored.where("llm_score < 0 or llm_score > 1 or llm_score is null").count() == 0
    unlabelled = quality.quality(docs, labels.where("false"))
    assert {r.score for r in unlabelled.collect()} == {1.0}
    assert quality.quality(none, labels).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    assert quality.quality(docs, odd).count() == len(cases)


def test_quality_knows_words(spark):
    """Letter salad, advertising in foreign words and texts without words are rejected, though they look like prose; labelled prose is kept."""
    data = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model, draw = quality.fit(real, labels), random.Random(3)
    salad = " ".join("".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(draw.randint(2, 9))) for _ in range(60)).capitalize() + "."
    spam = "Win big at our casino tonight. Click here for free bonus spins, cheap pills and lucky jackpots now. " * 4
    bad = spark.createDataFrame([(k, t) for k, t in enumerate((salad, spam, "", None, " \n\t", "!!! ... ***"))], "doc_id long, text string")
    assert all(r.llm_score < quality.KEEP_AT for r in quality.scored(bad, model).collect())
    kept = quality.scored(real, model).join(labels.where("quality = 1"), "doc_id").where(quality.held_out())
    assert kept.agg(F.avg((F.col("llm_score") >= quality.KEEP_AT).cast("int"))).first()[0] > 0.97


def test_terms_equal_a_plain_count():
    """Words, pairs, unknown words and the share of known ones, one word at a time."""
    texts = ["The cat, the CAT sat", "", "x", "the-cat zq zq the", "é1 cat é1"]
    of = lambda word: int(quality.lexical_words(*utf8(pa.array([word])))[0][0])
    lexicon = np.sort(np.array([of(w) for w in ("the", "cat", "é1")], np.uint64))
    model = quality.QualityModel(np.ones(quality.TERMS), np.zeros((quality.TERMS, 1)), np.zeros((1, 1), np.float32), np.ones(1), np.ones(1), 0.5, lexicon, 0.8, 0.6)
    counts, trust = quality.term_counts(*utf8(pa.array(texts)), lexicon), model.trust(*utf8(pa.array(texts)))
    for text, row, worth in zip(texts, counts, trust, strict=True):
        words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate(str.maketrans("THECA", "theca")))
        want = np.zeros(quality.TERMS)
        known = [w in ("the", "cat", "é1") for w in words]
        for k, word in enumerate(words):
            want[quality.FIRST_WORD + (of(word) % quality.WORDS if known[k] else quality.WORDS)] += 1 / len(words)
            if k and known[k] and known[k - 1]:
                mixed = quality.mixed(np.array([of(words[k - 1]) * int(quality._STEP) + of(word) & 2**64 - 1], np.uint64))
                want[quality.FIRST_PAIR + int(mixed[0] % np.uint64(quality.PAIRS))] += 1 / len(words)
        assert np.allclose(row[quality.FIRST_WORD:], want[quality.FIRST_WORD:])
        assert abs(worth - (min(1, (sum(known) + 3 * 0.8) / (len(words) + 3) / 0.6) if words else 0)) < 1e-12


def test_votes_equal_a_plain_loop():
    draw = np.random.default_rng(0)
    counts = draw.random((40, quality.TERMS))
    model = quality.QualityModel(np.ones(quality.TERMS), draw.normal(size=(quality.TERMS, 8)), quality.unit(draw.normal(size=(60, 8))).astype(np.float32), draw.random(60), (draw.random(60) > 0.4) * 1.0, 0.5)
    latent = model.latent(counts)
    for row, score in zip(latent, model.scores(counts), strict=True):
        cosines = sorted(((float(row @ v), k) for k, v in enumerate(model.vectors)), reverse=True)[:quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.SHARPNESS * model.votes[k] for c, k in cosines]
        want = sum(w * model.good[k] for w, (_, k) in zip(weights, cosines, strict=True)) / sum(weights) if sum(weights) else 0.5
        assert abs(want - score) < 1e-4


def test_pseudo_likelihood(spark, docs, cases, none):
    got = pseudo.pseudo_likelihood(docs)
    assert got.count() == len(cases)
    assert got.where("n_tokens = 0 and (log_likelihood != 0 or mean_log_likelihood is not null)").count() == 0
    assert pseudo.pseudo_likelihood(none).count() == 0
    net = pseudo.Network.fresh()
    tokens, first = np.array([3, 5, 3, 99, 7, 7], np.uint8), np.array([0, 4, 4, 6])
    want = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        own, total = [pseudo.EDGE] * 2 + tokens[lo:hi].tolist() + [pseudo.EDGE] * 2, 0.0
        for at in range(2, len(own) - 2):
            h = np.tanh(net.hidden + sum(net.embed[k][own[at + p]] for k, p in enumerate(pseudo.PLACES)))
            logits = h @ net.out + net.bias
            total += float(logits[own[at]] - np.log(np.exp(logits).sum()))
        want.append(total)
    assert np.allclose(pseudo.log_likelihoods(net, tokens, first), want, atol=1e-4)


def test_words_of_a_class_have_their_own_probability(spark):
    """A word seen once scores lower than a usual one of the same class, by the logarithm of how often each occurs; repeated rows count once each."""
    usual, odd = "station", "qqxzion"
    texts = ["w%dx" % (k % 120) + " and the " + usual for k in range(240)] + ["a " + usual + " b", "a " + odd + " b", "a " + odd + " b", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    totals = pseudo.word_counts(frame)
    frequent = np.zeros(0, np.int64)
    tokens = pseudo.tokenised(frame, frequent)
    got = {r.doc_id: r.word_log for r in tokens.join(pseudo.word_terms(tokens, pseudo.within_classes(totals, frequent)), "row").collect()}
    assert abs(got[240] - got[241] - np.log(241 / 2)) < 1e-9 and got[241] == got[242] and 243 not in got
    counts = collections.Counter(w for t in texts for w in brute.alnum_words(t))
    kind = lambda w: (ord(w[-1]) * 31 + (ord(w[-2]) if len(w) > 1 else 0) * 7) % pseudo.CLASSES
    sizes = collections.Counter()
    for w, n in counts.items():
        sizes[kind(w)] += n
    for doc, text in enumerate(texts[:-1]):
        assert abs(got[doc] - sum(np.log(counts[w] / sizes[kind(w)]) for w in brute.alnum_words(text))) < 1e-9
    scored = {r.doc_id: r.log_likelihood for r in pseudo.pseudo_likelihood(frame.where("doc_id >= 100")).collect()}
    assert scored[240] != scored[241] and scored[243] == 0


def test_every_place_is_a_target(monkeypatch):
    """One target a step is recorded: over all rounds each place of each document is met once, whatever the batch."""
    step, sizes = pseudo.Network.step, [1, 1, 2, 3, 1, 5, 8]
    met = []
    monkeypatch.setattr(pseudo.Network, "step", lambda self, around, target, memory: (met.extend(target.tolist()), step(self, around, target, memory))[1])
    rows, at = [], 0
    for size in sizes:
        rows.append(bytes(range(at, at + size)))
        at += size
    batch = pa.RecordBatch.from_pydict({"shard": [0] * len(rows), "key": [0] * len(rows), "doc": list(range(len(rows))), "tokens": rows})
    shared = type("Shared", (), {"value": pseudo.Network.fresh().flat()})
    for k in range(pseudo.ROUNDS):
        list(pseudo._train(shared, k * pseudo.STRIDE // pseudo.ROUNDS)(pseudo._shards([batch])))
    assert sorted(met) == list(range(at))


def test_neighbours_tell_more_than_frequencies(spark):
    """On documents it was not trained on, the network beats the token frequencies of those it was trained on. (Word order is random in these texts, language is not.)"""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own, rest = real.where("doc_id % 5 != 0"), real.where("doc_id % 5 = 0")
    frequent = pseudo.frequent_words(own)
    seen = pseudo.tokenised(own, frequent)
    net = pseudo.trained(seen)
    counts = np.ones(pseudo.VOCABULARY)
    for r in seen.collect():
        counts += np.bincount(np.frombuffer(bytes(r.tokens), np.uint8), minlength=pseudo.VOCABULARY)
    logs, by_net, by_count = np.log(counts / counts.sum()), 0.0, 0.0
    for r in rest.collect():
        tokens, first = pseudo.tokens_of(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]), frequent)
        by_net += pseudo.log_likelihoods(net, tokens, first)[0]
        by_count += logs[tokens].sum()
    assert by_net > 0.95 * by_count


def test_scores_do_not_depend_on_order_or_partitions(spark, monkeypatch):
    """Rows of one table, dealt and ordered in three ways, with repeated rows and several shards: equal scores; the join and the broadcast shares give the same sums."""
    monkeypatch.setattr(pseudo, "SHARD", 20_000)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table = real.unionByName(real.where("doc_id % 9 = 0")).unionByName(spark.createDataFrame([(None, "one two"), (None, "one two"), (None, "three")], "doc_id long, text string"))
    told = []
    for frame, usual in ((table.coalesce(1), 50), (table.repartition(3), 65_536), (table.repartition(8).sortWithinPartitions(F.desc("text")), 0)):
        monkeypatch.setattr(pseudo, "USUAL", usual)
        told.append(sorted((r.doc_id or -1, r.n_tokens, r.log_likelihood) for r in pseudo.pseudo_likelihood(frame).collect()))
    for other in told[1:]:
        assert len(other) == len(told[0]) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * max(1, abs(a[2])) for a, b in zip(told[0], other, strict=True))


def test_word_order_is_learned(spark):
    """Where the neighbours decide the word, the network beats the frequencies by far, and shuffled words score lower."""
    draw = np.random.default_rng(6)
    follow = {w: (w * 7 + 3) % 60 for w in range(60)}
    rows = []
    for k in range(400):
        word, out = int(draw.integers(60)), []
        for _ in range(60):
            out.append("w%da" % word)
            word = follow[word] if draw.random() < 0.9 else int(draw.integers(60))
        rows.append((k, " ".join(out)))
    rows += [(1_000 + k, " ".join(draw.permutation(rows[k][1].split()))) for k in range(20)]
    got = {r.doc_id: r.mean_log_likelihood for r in pseudo.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered, shuffled = np.mean([got[k] for k in range(20)]), np.mean([got[1_000 + k] for k in range(20)])
    assert ordered > np.log(1 / 60) + 1 and ordered > shuffled + 1


def test_licences(spark, none):
    rows = [
        ("a/LICENSE", "MIT text\nReleased under the MIT License."), ("a/x.c", None), ("a/b/y.c", "// Licensed under the Apache License, Version 2.0.\nint x;"), ("a/b/z.c", "int z;"),
        ("c/w.c", ""), (None, "nothing"), ("a/b/c/d/v.c", "x" * 100_000), ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3"), ("a/x.c", None)]
    files = spark.createDataFrame([(p, t, "m") for p, t in rows], "path string, text string, dir string")
    got = collections.Counter((r.path, r.licence, r.scope, r.from_directory) for r in licences.inherited(licences.own_licences(files)).collect())
    assert got == collections.Counter([
        ("a/LICENSE", "MIT", "own", None), ("a/x.c", "MIT", "inherited", "/a"), ("a/x.c", "MIT", "inherited", "/a"), ("a/b/y.c", "Apache-2.0", "own", None), ("a/b/z.c", "MIT", "inherited", "/a"),
        ("c/w.c", None, "none", None), (None, None, "none", None), ("a/b/c/d/v.c", "GPL-3.0", "inherited", "/a/b/c"), ("a/b/c/COPYING.txt", "GPL-3.0", "own", None)])
    assert licences.inherited(licences.own_licences(files.where("false"))).count() == 0
    assert {r.scope for r in licences.inherited(licences.own_licences(files, {})).collect()} == {"none"}


def test_whole_texts_and_wrapped_blocks_are_found(spark):
    wrap = lambda text, mark="", width=60: "\n".join(mark + part for part in textwrap.wrap(text, width))
    t = licence_texts
    rows = {
        "LICENSE": ("Copyright (c) 2020 Some One\n\n" + "\n\n".join(map(wrap, (t.GRANT, t.KEPT, t.AS_IS))), "MIT"),
        "COPYING": (dict(t.all_texts()[:7])["GPL-2.0"], "GPL-2.0"),
        "b/LICENSE": ("Copyright 2021 A B\n\n" + "\n\n".join(map(wrap, (t.REDISTRIBUTION, t.TWO, t.THIRD, t.BSD_AS_IS))), "BSD-3-Clause"),
        "b2/LICENSE": ("Copyright 2021 A B\n\n" + "\n\n".join(map(wrap, (t.REDISTRIBUTION, t.TWO, t.BSD_AS_IS))), "BSD-2-Clause"),
        "c/m.c": ("/*\n" + wrap(t.MPL, " * ", 40) + "\n */\nint main(void) { return 0; }", "MPL-2.0"),
        "c/i.py": (wrap(t.ISC, "# ", 50) + "\nimport sys\nprint(sys.path)", "ISC"),
        "c/s.js": ("// Released under\n// the MIT License\nlet x = 1", "MIT"),
        "c/prose.txt": ("It was a long day and the people of the town were tired of the rain, which had fallen for weeks on the roofs and the fields.", None)}
    files = spark.createDataFrame([(p, x) for p, (x, _) in rows.items()], "path string, text string")
    assert {r.path: r.licence for r in licences.own_licences(files).collect()} == {p: want for p, (_, want) in rows.items()}


def test_a_header_passes_at_every_corpus_size():
    """Shares of files that hold a template term as in prose with some licences; only the number of files grows."""
    held = licences.Templates(licences.TEMPLATES)
    usual = licences.Templates({"x": "the of to and in is or with for any this under that are a free use work source form"}).terms
    rare = licences.Templates({"x": "released license mit licensed version 2 0 apache"}).terms
    share = np.where(np.isin(held.terms, usual), 0.3, np.where(np.isin(held.terms, rare), 0.02, 0.0005))
    for n in (1_000, 100_000, 30_000_000):
        rows = [Row(term=-1, n=n)] + [Row(term=k, n=int(x * n)) for k, x in enumerate(share)]
        weights, other = licences.weights_of(rows, held)
        for header in ("Code released under the MIT License", "Project code released under the MIT License", "Copyright 2019 Ada Example, released under the MIT License"):
            data = np.frombuffer(header.encode(), np.uint8)
            best, cosine = licences.best_of_texts(data, np.array([0, len(data)]), held, weights, other)
            assert held.names[best[0]] == "MIT" and cosine[0] >= licences.LEAST, (n, header, cosine)


def test_licence_cosines_equal_a_plain_sum(spark):
    texts = ["Released under MIT rules\nthe license of this work", "licensed under the the GNU license", "x y z"]
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    n, df = len(texts), collections.Counter(w for t in texts for w in set(brute.alnum_words(t)))
    terms = {w for t in licences.TEMPLATES.values() for w in brute.alnum_words(t)}
    idf = lambda w: np.log((1 + n) / (1 + (df[w] if w in terms else 0))) + 1
    vector = lambda t: {w: c * idf(w) for w, c in collections.Counter(brute.alnum_words(t)).items()}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    for r in licences.own_licences(files).collect():
        best = max(sum(x * t.get(w, 0) for w, x in v.items()) / size(v) / size(t) for line in r.text.split("\n") for v in [vector(line)] for t in map(vector, licences.TEMPLATES.values()))
        assert abs(best - r.cosine) < 1e-9


def test_bpe(docs, cases, none):
    ranks = bpe.read_ranks(PATH)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text in cases:
        ids = plain.encode_ordinary(text or "")
        want.append((doc, len(ids), __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(text or "")))
    same(bpe.round_trip(docs, PATH, public_tokenizers.PATTERN), want)
    coded = bpe.decoded(bpe.encoded(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert coded.where("decoded != cast(coalesce(text, '') as binary)").count() == 0
    assert bpe.round_trip(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_on_odd_pieces():
    ranks = bpe.read_ranks(PATH)
    core, draw = tiktoken._tiktoken.CoreBPE(ranks, {}, r"[\s\S]+"), np.random.default_rng(2)
    for n in (1, 2, 3, 40, 5_000):
        for letters in (b"a", b"ab", b"thero ", bytes(range(256))):
            piece = bytes(draw.choice(np.frombuffer(letters, np.uint8), n))
            assert bpe.merged(piece, ranks) == core.encode_single_piece(piece)


def test_limits_of_small_and_large_hosts(spark):
    """A line in three of fifty documents is above the limit, as is one in 150 of 9 000; one in two, or in 90 of 9 000, is not."""
    rows = [(k, "small", ("menu of the site\n" if k < 3 else "rarely\n" if k < 5 else "") + "own %d" % k) for k in range(50)]
    rows += [(100 + k, "large", ("everywhere\n" if k < 150 else "somewhere\n" if k < 240 else "") + "text %d" % k) for k in range(9_000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = rules.marked_lines(frame).where("common").join(spark.createDataFrame([("menu of the site",), ("rarely",), ("everywhere",), ("somewhere",)], "name string").select("name", F.xxhash64("name").alias("line")), "line")
    assert {r.name for r in found.select("name").distinct().collect()} == {"menu of the site", "everywhere"}
    assert {r.doc_id for r in rules.depleted(frame).collect()} == {0, 1, 2, *range(100, 250)}


def test_columns_with_names_of_our_own_keep_their_values(spark):
    """Columns that an operator could name itself come back as given, whatever the case."""
    texts = ["the same long line here\nfirst of all", "the same long line here\nsecond text", "one two three four five six seven eight nine ten", "alone"]
    rows = [(k, t, "h", len(t), "a%d" % k, "b%d" % k, "c%d" % k, "d%d" % k, "e%d" % k, "f%d" % k, "g%d" % k) for k, t in enumerate(texts)]
    names = ["llm_doc", "LLM_KEY", "llm_marks", "llm_kept", "llm_gone", "llm_host", "llm_score"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, " + ", ".join(n + " string" for n in names))
    items = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    for found in (lines.kept_texts(frame), simhash.one_of_each(frame), phrases.uncontaminated(frame, items, by_row=True), phrases.uncontaminated(frame, items),
                  rules.kept_texts(frame), rules.without_common_lines(frame), quality.good_documents(frame, labels)):
        assert found.columns == frame.columns
        for row in found.collect():
            assert tuple(row)[4:] == rows[row.doc_id][4:]
