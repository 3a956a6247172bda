import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
import pytest
from pyspark.sql import functions as F
import tiktoken
from tokenizers import Tokenizer

from thicket.llm import _vocab, bpe, packing, queries, tokenfile
from thicket.llm._pretok import token_starts
from thicket.llm._words import chunks
from thicket.storage import scratch_path

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_vocab.load_ranks(RANKS), special_tokens={})


def test_boundaries_equal_the_pattern():
    rng, pattern = random.Random(2), regex.compile(P.PATTERN)
    alphabet = list("ab'stmdrvleLL 1\n\t !?é　中٣$😀 \x85\xa0")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(20_000)]
    for c in chunks(pa.array(texts), 1 << 14):
        start, raw = token_starts(c.buf, c.off), c.buf.tobytes()
        end = np.append(start[1:], len(raw))
        at = np.searchsorted(start, c.off)
        for i in range(len(c)):
            assert [raw[start[k] : end[k]].decode() for k in range(at[i], at[i + 1])] == pattern.findall(texts[c.first + i])


def test_merging_equals_the_library():
    rng, enc, lib = random.Random(4), _vocab.rank_encoder(RANKS), reference()
    texts = ["".join(rng.choice("etaoinshr qz") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["ab" * 4000, "-" * 999, ""]
    small = _vocab.CachedEncoder(enc.encode_slice, 1 << 8)  # it must be emptied often
    for c in chunks(pa.array(texts), 4096):
        ids, rows, _ = enc.encode(c)
        again, _, _ = small.encode(c)
        assert (ids == again).all()
        for i in range(len(c)):
            assert ids[rows[i] : rows[i + 1]].tolist() == lib.encode_ordinary(texts[c.first + i])


def test_encode_and_decode(spark, odd_docs, no_docs):
    lib = reference()
    encoded = bpe.encode(odd_docs, RANKS)
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in encoded.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(texts[r.doc_id])
        assert len(np.frombuffer(r.starts, "<u4")) == len(regex.findall(P.PATTERN, texts[r.doc_id]))
    got = bpe.decode(encoded, RANKS).collect()
    assert len(got) == odd_docs.count()
    assert all(bytes(r.bytes).decode() == texts[r.doc_id] for r in got)
    assert bpe.decode(bpe.encode(no_docs, RANKS), RANKS).count() == 0


def expected_ids(texts):
    return {i: e.ids for i, e in zip(texts, Tokenizer.from_file(JSON).encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}


def test_added_tokens_equal_the_library(spark):
    """Their text counts as one token, as in the library; op4's ranks know none."""
    rng, mark = random.Random(6), "<|endoftext|>"
    texts = ["".join(rng.choice([mark, mark[:5], mark[5:], "a", " b", "\n", "é😀", "<|"]) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    texts += ["", mark, "x" + mark[:5], mark[5:] + "y", mark * 3, f"a{mark}b"]
    want, enc = expected_ids(dict(enumerate(texts))), _vocab.library_encoder(JSON)
    for c in chunks(pa.array(texts), 4096):
        ids, rows, _ = enc.encode(c)
        for i in range(len(c)):
            assert ids[rows[i] : rows[i + 1]].tolist() == want[c.first + i]
    assert want[len(texts) - 1] == [64, 50256, 65]
    df = spark.createDataFrame([(1, f"a{mark}b"), (2, "plain")], "doc_id long, text string")
    assert {r.doc_id: r.doc_tokens for r in packing.pack(df, JSON).collect()}[1] == 4
    path = scratch_path(spark, "t")
    tokenfile.write(df, path, JSON, end_id=2)
    assert np.frombuffer(tokenfile.read(spark, path).orderBy("start").first().ids, "<u4").tolist() == [64, 50256, 65, 2]


def test_ranges_of_slices_are_decoded(spark, odd_docs):
    encoded = bpe.encode(odd_docs, RANKS)
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for first, count in ((0, 3), (2, 5), (1, 10**6), (10**6, 2), (-4, 2)):
        for r in bpe.decode_slices(encoded, RANKS, F.lit(first), F.lit(count)).collect():
            want = regex.findall(P.PATTERN, texts[r.doc_id])[max(first, 0) :][:count]
            assert bytes(r.bytes).decode() == "".join(want)


def test_documents_are_read_by_id(spark, odd_docs):
    path = scratch_path(spark, "t")
    tokenfile.write(odd_docs.repartition(3), path, JSON, end_id=2, segment_ids=300)
    want = expected_ids({r.doc_id: r.text for r in odd_docs.collect()})
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read_ids(spark, path, [3, 11, 50, 999, 3]).collect()}
    assert got == {i: want[i] + [2] for i in (3, 11, 50)}
    assert tokenfile.read_ids(spark, path, []).count() == 0


def test_packing_places_every_id_once(spark, odd_docs, no_docs):
    pieces = packing.pack(odd_docs.where("doc_id < 50"), JSON, end_id=1, window=64, shard_docs=5).collect()
    want = expected_ids({r.doc_id: r.text for r in odd_docs.where("doc_id < 50").collect()})
    for i, ids in want.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()] == ids + [1]
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert all(p.doc_tokens == len(ids) + 1 for p in own)
    windows = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert windows.get(p.sequence_id, 0) == p.offset
        windows[p.sequence_id] = p.offset + p.length
    assert max(windows.values()) <= 64
    assert sum(n < 64 for n in windows.values()) <= odd_docs.rdd.getNumPartitions()
    assert packing.pack(no_docs, JSON).count() == 0


def test_packing_prefers_lexical_neighbours():
    docs = [np.array(x) for x in ([1, 2, 3, 4], [9, 9, 8, 7], [1, 2, 3, 5], [9, 8, 7, 6])]
    index = packing.InvertedIndex(docs, np.ones(10), 4.0)
    assert list(index.ranked(0, np.ones(4, bool)))[1] == 2
    assert list(index.ranked(1, np.ones(4, bool)))[1] == 3
    out = packing.WindowPacker(8, 0).shard(docs, np.ones(10), 4.0)
    assert [d for d, *_ in out] == [0, 2, 1, 3]


def plain_bm25(docs, idf, mean, seed):
    """Scores of all documents against the distinct terms of one."""
    out = []
    for d in docs:
        score = 0.0
        for t in set(docs[seed].tolist()):
            tf = d.tolist().count(t)
            score += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0.0
        out.append(score)
    return out


def plain_packer(docs, idf, mean, window):
    """Pieces (document, start, length, sequence, offset) by scoring every seed against all."""
    at, out, seq = [0] * len(docs), [], 0
    for i, d in enumerate(docs):
        while len(d) - at[i] >= window:
            out.append((i, at[i], window, seq, 0))
            at[i], seq = at[i] + window, seq + 1
    used, opened, seed = 0, None, None

    def put(i):
        nonlocal used, opened, seq
        if opened is None:
            opened, seq, used = seq, seq + 1, 0
        n = min(len(docs[i]) - at[i], window - used)
        out.append((i, at[i], n, opened, used))
        at[i], used = at[i] + n, used + n
        if used == window:
            opened = None
        return opened is None

    while left := [i for i, d in enumerate(docs) if at[i] < len(d)]:
        if seed not in left:
            seed = left[0]
        if put(seed):
            continue
        scores = np.round(plain_bm25(docs, idf, mean, seed), 4)
        for i in sorted((i for i in left if i != seed), key=lambda i: -scores[i]):
            if put(i):
                seed = i
                break
    return out


def test_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, rng.integers(1, 60)) for _ in range(50)]
    idf = rng.random(40)
    index, free = packing.InvertedIndex(docs, idf, 30.0), rng.random(50) < 0.5
    for seed in range(50):
        assert index.scores(seed) == pytest.approx(plain_bm25(docs, idf, 30.0, seed), rel=1e-5)
    index.keep(free)
    for seed in np.flatnonzero(free):
        assert index.scores(seed)[free] == pytest.approx(np.array(plain_bm25(docs, idf, 30.0, seed))[free], rel=1e-5)


def test_choice_of_neighbours_equals_brute_force():
    rng = np.random.default_rng(4)
    idf = rng.random(300) + 0.1
    docs = [rng.integers(0, 300, rng.choice([1, 3, 20, 50, 90])) // rng.choice([1, 30]) for _ in range(400)]
    docs += [docs[3].copy(), docs[7].copy(), np.arange(200), np.zeros(64, np.int64)]
    got = packing.WindowPacker(64, 0).shard(docs, idf, 30.0)
    assert [tuple(map(int, p)) for p in got] == plain_packer(docs, idf, 30.0, 64)


def test_repeated_rows_are_packed_each(spark, odd_docs):
    pieces = packing.pack(odd_docs.where("doc_id IN (3, 11)").union(odd_docs.where("doc_id IN (3, 50)")), JSON, window=64).collect()
    want = expected_ids({r.doc_id: r.text for r in odd_docs.where("doc_id IN (3, 11, 50)").collect()})
    assert sum(p.length for p in pieces if p.doc_id == 3) == 2 * (len(want[3]) + 1)
    assert sum(p.length for p in pieces) == sum(len(want[i]) + 1 for i in (3, 3, 11, 50))


def test_packing_reaches_neighbours_far_apart_in_the_file(spark):
    rng = random.Random(9)
    rows = []
    for copy in range(2):
        for g in range(150):
            if not copy:
                rows.append(" ".join(rng.choice("river stone cloud seven paper under light green table music window north carry answer".split()) + str(rng.randint(0, 99)) for _ in range(12)))
            else:
                rows.append(rows[g] if g % 2 else rows[g] + " more")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    at = {}
    for p in packing.pack(df, JSON, window=128, shard_docs=64).collect():
        at.setdefault(p.doc_id, set()).add(p.sequence_id)
    together = [bool(at[g] & at[150 + g]) for g in range(150)]
    assert sum(together[1::2]) >= 0.9 * 75 and sum(together[::2]) >= 0.7 * 75


def test_content_keys_order_copies_together():
    orders, bits = packing.content_orders(np.linspace(0.1, 9, 1 << 16))
    ids, rows = np.array([5, 60_000, 7, 9, 60_000, 5, 7, 1]), np.array([0, 3, 4, 7, 8])
    keys = packing.content_keys(ids, rows, orders, bits)
    assert keys[0] == keys[2] and len(set(keys.tolist())) == 3


def test_token_files(spark, odd_docs, no_docs):
    path = scratch_path(spark, "t")
    tokenfile.write(odd_docs, path, JSON, end_id=2, segment_ids=500)
    got = tokenfile.read(spark, path).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()))
    want = expected_ids(dict(rows))
    start = 0
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r in got:
        ids = np.array(want[r.doc_id] + [2], "<u4")
        assert (r.start, bytes(r.ids)) == (start, ids.tobytes())
        start += len(ids)
    one = spark.read.parquet(f"{path}/segments").where("seg = 0").orderBy("part").first()
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    seg = tokenfile.Segment(bytes(one.image), dictionary)
    assert seg.find(one.first_id).tolist() == want[one.first_id] + [2]
    assert seg.find(10**9) is None
    empty = scratch_path(spark, "t")
    tokenfile.write(no_docs, empty, JSON)
    assert tokenfile.read(spark, empty).count() == 0


def test_segments_hold_their_dictionary():
    image = tokenfile.pack_segment(np.array([70_000, 1, 2]), [5, 9], np.array([0, 2, 3]), b"", 3)
    seg = tokenfile.Segment(image, b"")
    assert seg.find(5).tolist() == [70_000, 1]
    assert seg.find(9).tolist() == [2]


def test_queries_over_the_tables(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, lib = expected_ids(docs), reference()
    for r in queries.op4_byte_bpe(spark, sf).collect():
        ids = np.array(lib.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    start = 0
    for r in queries.op6_token_binary(spark, sf).orderBy("doc_id").collect():
        ids = np.array(want[r.doc_id] + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for r in queries.op2_lexical_packing(spark, sf).collect():
        ids = np.array(want[r.doc_id] + [1], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes()))
