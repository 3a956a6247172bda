import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import sentence
from thicket.llm import classifier, licenses, ngram_join, queries, rules
from thicket.llm._components import components
from thicket.llm._words import chunks


# -- n-gram join ---------------------------------------------------------------


def edited(rng, text, times):
    w = text.split(" ")
    for _ in range(times):
        w[rng.randrange(len(w))] = sentence(rng, 1)
    return " ".join(w)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    rng = random.Random(7)
    passage = sentence(rng, 60)
    rows = []
    for _ in range(40):
        base = sentence(rng, rng.choice([4, 9, 12, 25, 60, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])))
    hub = sentence(rng, 120)
    rows += [edited(rng, hub, rng.randint(1, 3)) for _ in range(60)]
    rows += [f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}" for _ in range(20)]
    rows += [passage] * 3 + [None, "", " ", "a", "A", "a b", "a b c d e f"]
    rng.shuffle(rows)
    want = brute.near_duplicates(enumerate(rows), words, percent)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, words, percent).collect()}
    assert got == want


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    hub = sentence(rng, 80)
    rows = [edited(rng, hub, rng.randint(0, 2)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, 3, 90).collect()}
    assert got == brute.near_duplicates(enumerate(rows), 3, 90)


@pytest.mark.parametrize("few", [0, 100_000])
def test_what_pivots_leave_is_searched_too(spark, monkeypatch, few):
    """Chains of near copies and unlike texts that share parts, in one cluster."""
    rng = random.Random(18)
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "FEW_TASKS", few)
    sets, texts = [], []
    for _ in range(12):
        text = sentence(rng, 60)
        for _ in range(6):
            texts.append(text)
            text = edited(rng, text, 1)  # a chain: neighbours link, ends do not
    rng.shuffle(texts)
    want = brute.near_duplicates(enumerate(texts), 3, 85)
    for c in chunks(pa.array(texts), 1 << 30):
        flat, off = next((f, o) for _, f, o, _, _ in ngram_join._sets(pa.array(texts), 3))
        sets = [flat[a:b].tobytes() for a, b in zip(off, off[1:])]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(sets)], "rep long, hashes binary")
    clusters = spark.createDataFrame([(i, 0) for i in range(len(sets))], "node long, root long")
    found = {r.node: r.root for r in components(ngram_join.cluster_links(clusters, df, 85)).collect()}
    assert {i: found.get(i, i) for i in range(len(sets))} == {i: c for i, (_, c) in want.items()}


def test_linked_sets_share_a_stricter_key():
    """A whole part of one equals a whole part of the other, or one that lacks a shingle."""
    rng = np.random.default_rng(6)
    linked = 0
    for _ in range(3000):
        percent = int(rng.choice([60, 80, 90, 97]))
        size = int(rng.integers(2, 400))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2))
        common = int(size * (1 - rng.random() * (100 - percent) / 90))
        more = int(rng.integers(0, size - common + 1))
        x, y = np.sort(pool[:size]), np.sort(np.concatenate([pool[:common], pool[size : size + more]]))
        if not len(y) or 100 * common < percent * (size + more) or size + more == common:
            continue
        linked += 1
        (kx, lx), (ky, ly) = (ngram_join.near_part_keys(s, percent) for s in (x, y))
        assert set(kx[~lx]) & set(ky) or set(ky[~ly]) & set(kx)
    assert linked > 300


def test_merge_skip_counts():
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 15))) for _ in range(rng.randint(1, 9))]
        count = {y: sum(y in x for x in lists) for y in range(30)}
        for least in range(1, len(lists) + 2):
            assert ngram_join.merge_skip(lists, least) == [(y, n) for y, n in count.items() if n >= least]


def test_one_row_of_a_group_stays(spark):
    rng = random.Random(9)
    text = sentence(rng, 30)
    rows = [("b", text), ("a", text), ("a", text), (None, text), ("a", sentence(rng, 30)), (None, sentence(rng, 30)), ("c", None), ("c", None), ("d", ""), ("e", text.upper())]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    kept = [tuple(r) for r in ngram_join.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([("a", text), rows[4], rows[5], ("c", None), ("c", None), ("d", "")], key=str)


def test_odd_documents(spark, odd_docs, no_docs):
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(odd_docs, 3, 90).collect()}
    assert {got[i] for i in (0, 1, 2)} == {0, 1, 2}
    assert (got[4], got[50], got[6], got[8]) == (3, 3, 5, 7)
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert not {4, 6, 8, 50} & {r.doc_id for r in kept.collect()}
    assert ngram_join.keep_one(no_docs).count() == 0


def test_repeated_ids_are_one_document(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "x")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_divide_skip_finds_all():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint64)) for _ in range(80)]
    searcher = ngram_join.Searcher(sets)
    for x in range(80):
        others = np.ones(80, bool)
        others[x] = False
        for percent in (50, 80):
            want = {y for y in range(80) if y != x and 100 * len(np.intersect1d(sets[x], sets[y])) >= percent * len(np.union1d(sets[x], sets[y]))}
            assert set(searcher.overlaps(x, percent, others).tolist()) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, b) for a, b in ((rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)) if a != b] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long").repartition(5)
    assert {r.node: r.root for r in components(df).collect()} == {x: find(x) for x in up}


# -- rules -----------------------------------------------------------------------


def test_rule_statistics(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    got = rules.score(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert tuple(r[k] for k in rules.STATS) == brute.rule_stats(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert rules.score(no_docs).count() == 0
    assert rules.keep_good(odd_docs).columns == odd_docs.columns


def test_rule_statistics_of_random_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab# \n\n\té\r") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for c in chunks(pa.array(texts), 3000):
        s = rules.text_stats(c)
        for i in range(len(c)):
            assert tuple(int(s[k][i]) for k in rules.STATS) == brute.rule_stats(texts[c.first + i])


def test_posterior_separates_kinds_of_bad_texts():
    good, symbols, repeats = (sum(v * 3**i for i, v in enumerate(p)) for p in ([2, 2, 2, 2, 2, 1, 2], [0, 2, 2, 2, 2, 1, 0], [2, 0, 2, 2, 0, 1, 2]))
    p = rules.fit({good: 900, symbols: 50, repeats: 50})
    assert p[good] > 0.9 > 0.1 > max(p[symbols], p[repeats])
    assert len(rules.fit({})) == 3 ** len(rules.RULES)


def test_rules_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op8_quality_rules(spark, sf).withColumnRenamed("quality", "p").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = found.agg(F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad"), F.avg(F.when((F.col("quality") == 1) & ~F.col("base_failed"), F.col("kept").cast("int"))).alias("good")).first()
    assert r.bad < 0.1 and r.good > 0.95


# -- classifier --------------------------------------------------------------------


def test_classifier_is_accurate_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_quality_classifier(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_classifier_scores_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(7, 1), (10, 1), (14, 0), (99, 1), (3, None)], "doc_id long, quality int")
    w = classifier.train(odd_docs, labels, F.lit(True))
    got = classifier.score(odd_docs, w).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = classifier.train(odd_docs, labels.where("false"), F.lit(True))
    assert {r.score for r in classifier.score(odd_docs, none).collect()} == {0.5}
    assert classifier.score(no_docs, w).count() == 0
    assert classifier.keep_good(odd_docs, none, 0.3).count() == odd_docs.count()


def test_chunk_scores_equal_sparse_dot_products():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << classifier.BITS) + 1)
    texts = ["", "one two two one", "A b! c? 12", "x"]
    c = next(chunks(pa.array(texts)))
    idx, off = classifier.features(c)
    for i, got in enumerate(classifier.chunk_scores(c, w)):
        f, x = classifier.row_values(idx[off[i] : off[i + 1]])
        assert got == pytest.approx(1 / (1 + np.exp(-(w[f] @ x + w[-1]))))


# -- licences -----------------------------------------------------------------------


def test_license_scan(spark, odd_docs, no_docs):
    mit = licenses.TEMPLATES["MIT-text"]
    texts = ["x\nreleased under the mit license\ny", f"intro words here\n\n{mit}\n\nmore words", mit.replace(" to deal", "\nto deal").upper(), "Released under a MIT licence", "Licensed under CC BY-NC 4.0!", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.n_units) for r in licenses.scan(df).collect()}
    assert [got[i][0] for i in range(7)] == ["MIT", "MIT-text", "MIT-text", None, "CC-BY-NC-4.0", None, None]
    assert licenses.scan(odd_docs).count() == odd_docs.count()
    assert licenses.scan(no_docs).count() == 0


def plain_dice(unit, template):
    import re

    grams = [set(zip(w, w[1:])) for w in (re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", brute.lower(x)).split() for x in (unit, template))]
    return 2 * len(grams[0] & grams[1]) / max(1, len(grams[0]) + len(grams[1]))


def test_license_scan_of_official_layouts(spark):
    """Headers and files as laid out, with blank lines and comment marks."""
    from thicket.llm._license_texts import NOTICES, TEXTS

    code = "\n\n".join(f"def f{i}(x):\n    return x + {i} * other_{i}(x)" for i in range(40))

    def marked(text, mark):
        return "\n".join(f"{mark} {x}".rstrip() for x in text.strip().split("\n"))

    texts, want = [], []
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense"):
        for mark in ("", "#", " *", "//"):
            texts.append(f"{marked('Copyright (c) 2020 A. Body', mark)}\n{mark}\n{marked(TEXTS[name], mark)}\n\n{code}")
            want.append(name)
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0"):
        texts.append(f"/*\n{marked(chr(10).join(x + chr(10) for x in NOTICES[name]), ' *')}\n */\n\n{code}")
        want.append(name)
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"):
        texts += [TEXTS[name], f"{code}\n\n{TEXTS[name]}\n{code}"]
        want += [name, name]
    texts.append(code)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.dice) for r in licenses.scan(df).collect()}
    for i, name in enumerate(want):
        assert got[i][0] and got[i][0].startswith(name) and got[i][1] >= 0.9, (name, got[i], texts[i][:80])
    assert got[len(want)] == (None, 0.0)


def test_license_units_equal_brute_force():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(9)]
    templates = {f"t{k}": " ".join(rng.choice(vocab) for _ in range(k)) for k in (5, 9, 14, 30)}
    texts = []
    for _ in range(400):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 4))]
        w = rng.choice(list(templates.values())).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] += rng.choice(["", "\n", "\n\n", "\n * \n", "!"])
        texts.append("\n\n".join([*parts[:2], " ".join(w), *parts[2:]]))
    compiled = licenses.Templates(licenses.compile_templates(templates), 0.8)
    for c in chunks(pa.array(texts)):
        for i, (name, dice, n) in enumerate(zip(*licenses.scan_chunk(c, compiled))):
            lines, spans, words = [], set(), 0
            for line in texts[c.first + i].split("\n"):
                k = len(brute.words_of("".join(x if x.isalnum() else " " for x in line)))
                lines.append((words, words + k))
                words += k
            edges = sorted({0, words, *(a for a, b in lines if a == b)})
            spans = {*lines, *((a, b) for j, a in enumerate(edges) for b in edges[j + 1 :])}
            flat = brute.words_of("".join(x if x.isalnum() else " " for x in texts[c.first + i]))
            score = {(k, s): plain_dice(" ".join(flat[s[0] : s[1]]), t) for k, t in templates.items() for s in spans if s[0] < s[1]}
            good = {k: v for k, v in score.items() if v >= 0.8}
            assert n == len({s for _, s in good})
            assert dice == pytest.approx(max(good.values(), default=0.0))
            assert name == (min(k for (k, _), v in good.items() if v == max(good.values())) if good else None)


def test_license_scan_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_license_scan(spark, sf).collect():
        lines = docs[r.doc_id].split("\n")
        best = max((plain_dice(x, t) for x in {*lines, docs[r.doc_id]} for t in licenses.TEMPLATES.values()), default=0)
        assert r.dice == pytest.approx(best if best >= licenses.THRESHOLD else 0.0)


# -- pipeline ------------------------------------------------------------------------


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was = {r.doc_id for r in at.select("doc_id").collect()}
        at = stage(spark, at, sf)
        assert at.columns == docs.columns, name
        now = {r.doc_id for r in at.select("doc_id").collect()}
        assert now < was, name
        if name != "n-gram Jaccard join":
            good = [i for i in was if labels.get(i) == 1]
            assert sum(i in now for i in good) >= 0.98 * len(good), name
        else:
            groups = brute.near_duplicates([(i, before[i]) for i in was], 5, 80)
            assert now == {i for i, (_, root) in groups.items() if i == root}
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == now


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ftrl_equals_its_formulas():
    """Each step by the published per-coordinate update, in plain numbers."""
    rng = random.Random(6)
    z, n, model = [0.0] * 9, [0.0] * 9, classifier.Ftrl(8)
    for _ in range(300):
        f = sorted(rng.sample(range(8), rng.randint(0, 4)))
        x = [rng.random() for _ in f]
        y = int(sum(f) % 2 == 0)
        model.learn(np.array(f, np.int64), np.array(x), y)
        at, xs, w = [*f, 8], [*x, 1.0], []
        for i in at:
            if abs(z[i]) <= classifier.L1:
                w.append(0.0)
            else:
                sign = 1 if z[i] > 0 else -1
                w.append(-(z[i] - sign * classifier.L1) / ((classifier.BETA + n[i] ** 0.5) / classifier.ALPHA + classifier.L2))
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, xs))))
        for i, xi, wi in zip(at, xs, w):
            g = (p - y) * xi
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / classifier.ALPHA
            z[i] += g - sigma * wi
            n[i] += g * g
        assert model.z == pytest.approx(z) and model.n == pytest.approx(n)


def test_scores_are_dot_products(odd_docs):
    texts = [r.text for r in odd_docs.collect()]
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1 << classifier.BITS) + 1)
    for c in chunks(pa.array(texts, pa.string())):
        idx, off = classifier.features(c)
        for i, s in enumerate(classifier.chunk_scores(c, w)):
            f, x = classifier.row_values(idx[off[i] : off[i + 1]])
            assert s == pytest.approx(1 / (1 + np.exp(-(w[-1] + sum(w[a] * b for a, b in zip(f, x))))))


def test_classifier_takes_ids_of_any_type(spark, odd_docs):
    docs = odd_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = spark.createDataFrame([("d7", 1), ("d10", 1), ("d14", 0)], "doc_id string, quality int")
    w = classifier.train(docs, labels, F.lit(True))
    assert classifier.score(docs, w).count() == docs.count()
