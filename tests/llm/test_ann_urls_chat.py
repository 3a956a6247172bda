import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from thicket.llm import ann, chat, queries, urls

TOKENIZER = P.path("byte_bpe_50k.json")


# -- nearest neighbours ---------------------------------------------------------


def exact(rows, queries_, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows])
    norm = np.sqrt((v * v).sum(1))
    for q in queries_:
        at = np.flatnonzero(ids == q)[0]
        s = v @ v[at] / norm / norm[at]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores_over_shards(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24))
    v[1000:2000] = v[7]  # a third are equal
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, shard_size=400).collect()
    want = exact(rows, range(0, 3000, 50), 5)
    hits = 0
    for q, best in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert q not in {r.vec_id for r in own}
        for r in own:
            a, b = v[q], v[r.vec_id]
            assert r.score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)
        if 1000 <= q < 2000:
            assert [r.vec_id for r in own] == [i for i, _ in best]
        hits += len({r.vec_id for r in own} & {i for i, _ in best})
    assert hits >= 0.95 * 5 * len(want)


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = queries.op1_hnsw(spark, sf).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, i) in found for q, best in want.items() for i, _ in best) >= 0.95 * 5 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [0.0, 4.0]), (None, [1.0, 1.0]), (8, []), (6, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.lit(True), k=2).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 10, 0.707107), (6, 1, 0, 1.0), (6, 2, 10, 0.707107), (7, 1, 10, 0.707107), (7, 2, 0, 0.0), (10, 1, 0, 0.707107), (10, 2, 6, 0.707107)]
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(df, F.lit(False)).count() == 0


def test_cosine_of_any_magnitude():
    from fractions import Fraction

    rng = np.random.default_rng(5)
    a = rng.normal(size=(400, 6)) * 10.0 ** rng.integers(-300, 300, (400, 1))
    b = rng.normal(size=(400, 6)) * 10.0 ** rng.integers(-300, 300, (400, 1))
    a[::7, 2:] *= 1e-200
    a[1], b[1] = 5e-324, 1.7e308
    want = []
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = [Fraction(v) for v in x], [Fraction(v) for v in y]
        dot, xx, yy = sum(p * q for p, q in zip(x, y)), sum(p * p for p in x), sum(p * p for p in y)
        want.append(math.copysign(math.sqrt(dot * dot / (xx * yy)), 1 if dot >= 0 else -1))
    assert ann.cosine(a, b) == pytest.approx(want, abs=1e-12)
    assert ann.cosine(np.array([[1.0, 0], [1e-200, 1e-200]]), np.array([[1.0, 0], [1e-200, 1e-200]])) == pytest.approx([1, 1])


def test_vectors_of_any_magnitude(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 12)) * 10.0 ** rng.choice([-300, -200, -170, 0, 100, 200, 300], (300, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=5, shard_size=100).collect()
    want = exact([(i, x) for i, x in enumerate(v / np.abs(v).max(1, keepdims=True))], range(0, 300, 10), 5)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(q, k, i) for q, best in want.items() for k, (i, _) in enumerate(best, 1)}
    assert all(-1 <= round(r.score, 12) <= 1 for r in got)


def test_recall_over_production_shards(spark):
    """Four graphs and more of the size that the operator chooses by itself."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(18_000, 512))
    table = pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.astype(np.float32).ravel(), 512).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    rows = ann.valid_vectors(df, "vec_id", "embedding")
    assert ann.build(rows, 5).select("shard").distinct().count() >= 4
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=5).collect()
    u = v.astype(np.float32).astype(float)
    want = exact(list(enumerate(u)), range(0, 18_000, 100), 5)
    found = {(r.query_id, r.vec_id) for r in got}
    recall = sum((q, i) in found for q, best in want.items() for i, _ in best) / (5 * len(want))
    print("recall at 5:", recall)
    assert recall >= 0.9


def test_graph_survives_its_flat_form():
    rng = np.random.default_rng(2)
    v = ann._unit(rng.normal(size=(700, 16)))
    g = ann.Hnsw(v, np.arange(700))
    again = ann.Hnsw.load(g.dump(), v)
    assert (again.search(v[:50], 6) == g.search(v[:50], 6)).all()
    assert (g.search(v[:50], 1)[:, 0] == np.arange(50)).all()


# -- urls ------------------------------------------------------------------------


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    return brute.lower(host), re.match(r"(?s)[^?#]*", rest[len(host):])[0]


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [None, "", "x", "http://", "HTTP://A.COM", "http://a.com/", "http://WWW.Example.com/en/x?y#z", "http://xexample.com/en/", "http://example.com/en", "a://b://c.net/es/", "http://a.net?/es/", "http://É.net/fr/é", "http://m.example.com/en/\n/x", "ftp://net/es/1", "http://u:p@example.com:80/en/"]


def test_url_rules(spark, sf):
    df = spark.createDataFrame(list(enumerate(ODD_URLS)), "page_id long, url string").withColumn("host", F.lit(1))
    for frame, query in ((df, lambda: urls.filter_urls(df, urls.parse_rules(queries.URL_RULES))), (spark.read.parquet(f"{sf}/pages.parquet"), lambda: queries.op7_url_filter(spark, sf))):
        source = {r.page_id: r.url for r in frame.collect()}
        got = query().collect()
        assert len(got) == len(source)
        for r in got:
            host, path = plain_url(source[r.page_id])
            rule, verdict = plain_rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.blocked_score > 0.5 else "allow"))
    assert urls.filter_urls(df.where("false"), urls.parse_rules(queries.URL_RULES)).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_trees_learn_from_labels(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.4
        path = "".join(rng.choice("0123456789") for _ in range(12)) if bad else "about/the/" + "".join(rng.choice("abcdef") for _ in range(6))
        rows.append((f"http://h{rng.randint(0, 9)}.{'biz' if bad != (rng.random() < 0.2) else 'org'}/{path}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    model = urls.UrlFilter().fit(df.limit(400), "url", "bad")
    got = model.score(df, "url").collect()
    assert sum((r.blocked_score > 0.5) == r.bad for r in got) >= 0.97 * len(got)
    plan = model.score(df, "url")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_growing_a_tree_by_hand():
    # Feature 0 tells most; feature 1 tells the rest on its right side.
    cells = {}
    for b0, b1, g in ((0, 0, -8), (0, 1, -8), (1, 0, 6), (1, 1, -3)):
        for key in ((0, b0, 0, b0), (0, b0, 1, b1), (1, b1, 1, b1)):
            a, h = cells.get(key, (0.0, 0.0))
            cells[key] = (a + g, h + 5)
    tree = urls.grow(cells, 2)
    assert tree.root == (0, 0) and tree.sides[1] == (1, 0)
    assert tree.leaves[2] < 0 < tree.leaves[3]


# -- chat -------------------------------------------------------------------------


def test_escaping_is_reversible():
    rng = random.Random(2)
    bits = ["<", "\\", "s>", "/s>", "|", "[", "INST]", "/INST]", "<s>", "</s>", "<|", "a", "\n", "|>"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in ("<s>", "</s>", "<|", "[INST]", "[/INST]"))


def plain_digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def conversations(rng):
    out = []
    for c in range(30):
        for n in range(rng.randint(1, 40)):
            role = "system" if n == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool|x>", None])
            out.append((c, n, role, rng.choice([None, "", "</s>[INST] ok [/INST]", "word " * rng.randint(1, 60), "é😀<|user|>"])))
    out += [(99, 0, "user", "x " * 5000), (99, 1, "assistant", "y " * 5000), (None, 0, "assistant", "lost"), (99, 1, "assistant", "y " * 5000)]
    return out


def test_budget_counts_turns_as_written(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    rows = [(1, n, "tool|x>", "</s>[INST] ok [/INST]" * 12) for n in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, TOKENIZER, budget=500, history_tokens=0).collect()
    for w in windows:
        turns = chat.parse_window(w.text)
        assert w.n_tokens == sum(len(lib.encode(chat.render([chat.Turn(r, t, 0)], 0)[0], add_special_tokens=False).ids) for r, t in turns)
        assert w.over_budget == (w.n_tokens > 500)


def test_windows(spark):
    rows = conversations(random.Random(4))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(0))
    windows = chat.format_conversations(df, TOKENIZER, budget=120, history_tokens=40)
    want = {}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: plain_digest(t) for c, t in want.items()}
    per = {}
    for w in windows.collect():
        turns = chat.parse_window(w.text)
        per.setdefault(w.conv_id, []).append(w)
        own = want[w.conv_id]
        new = turns[w.n_context :]
        assert own[w.first_turn : w.first_turn + len(new)] == new
        assert w.over_budget == (w.n_tokens > 120)
        assert not w.over_budget or len(new) == 1
        context = turns[: w.n_context]
        if w.first_turn and own[0][0] == "system":
            assert context[0] == own[0]
            context = context[1:]
        assert own[w.first_turn - len(context) : w.first_turn] == context
        targets = [chat.unescape(w.text[a:b]) for a, b in zip(w.loss_start, w.loss_end)]
        assert targets == [t for r, t in new if r == "assistant"]
    assert all([w.window for w in ws] == list(range(len(ws))) for ws in per.values())
    assert any(w.n_context > 1 for ws in per.values() for w in ws)
    assert chat.format_conversations(df.where("false"), TOKENIZER).count() == 0
    assert chat.digests(chat.format_conversations(df.where("false"), TOKENIZER)).count() == 0


def test_chat_query(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op3_chat_windows(spark, sf).collect()}
    assert got == {c: plain_digest(t) for c, t in want.items()}


def test_trees_on_held_out_urls(spark):
    """Of the URLs on which a rule decides, a fifth is not learned from."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = urls.with_rule(urls.split_url(pages, "url"), urls.parse_rules(queries.URL_RULES)).where("rule IS NOT NULL")
    rows = ruled.select("page_id", "url", (F.col("rule_verdict") == "block").alias("y"))
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    model = urls.UrlFilter().fit(rows.where(~held), "url", "y")
    got = model.score(rows.where(held), "url").select("y", "blocked_score").collect()
    share = sum(r.y for r in got) / len(got)
    right = sum((r.blocked_score > 0.5) == r.y for r in got) / len(got)
    print("held out:", len(got), "blocked:", round(share, 3), "right:", round(right, 3))
    assert model.trees and right >= max(share, 1 - share)
