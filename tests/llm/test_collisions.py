"""Texts made to share hashes are still told apart."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from thicket.llm import _vocab, _words, ngram_join, rules
from thicket.llm._words import Words, chunks, mix64, segment_hash, shingles

PAIRS = [("m~0&1s!", "ڀֿxt8)"), ("ju0HG~\nDz|{ְ.R", "")]


def chunk_of(texts):
    return next(chunks(pa.array(texts, pa.string()), 1 << 30))


def same_lane(n=3_000_000, seed=1):
    """Pairs of different 16-byte words whose first lanes agree: the second
    block is made to undo the difference of the first."""
    rng = np.random.default_rng(seed)
    a, b, tail = (rng.integers(33, 127, (n, 8)).astype(np.uint8).view("<u8").ravel() for _ in range(3))
    sized = mix64(np.full(1, 16, np.uint64) * _words._SIZE[0] + _words._SEED[0])
    other = tail ^ mix64(a ^ sized) ^ mix64(b ^ sized)
    fine = ((other.view(np.uint8).reshape(-1, 8) > 32) & (other.view(np.uint8).reshape(-1, 8) < 127)).all(1) & (a != b)
    return [(x.tobytes() + y.tobytes(), z.tobytes() + w.tobytes()) for x, y, z, w in zip(a[fine], tail[fine], b[fine], other[fine])]


def test_one_lane_can_be_made_to_agree_but_not_both():
    pairs = same_lane()
    assert len(pairs) > 200
    c = chunk_of([x.decode() for p in pairs for x in p])
    start, size = c.off[:-1], np.diff(c.off)
    first, second = (segment_hash(c.buf, start, size, i) for i in (0, 1))
    assert (first[::2] == first[1::2]).all() and (second[::2] != second[1::2]).all()
    h, off = shingles(Words(c), 3)
    assert len(np.unique(h)) == len(h) == off[-1]
    assert len(np.unique(Words(c).codes())) == 2 * len(pairs)


def test_near_duplicates_of_made_pairs(spark):
    texts = [t for a, b in PAIRS[:1] for t in (f"{a} x y", f"{b} x y")]
    texts += [f"{x.decode()} x y" for p in same_lane(600_000) for x in p]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, 3, 90).collect()}
    assert got == brute.near_duplicates(enumerate(texts), 3, 90)


@pytest.mark.parametrize("bits", [0, 1, 6, 64])
def test_rule_statistics_with_a_poor_hash(monkeypatch, bits):
    good = _words.segment_hash

    def poor(*args, **kwargs):
        return good(*args, **kwargs) & np.uint64((1 << bits) - 1)

    monkeypatch.setattr(_words, "segment_hash", poor)
    rng = random.Random(5)
    texts = [t for p in PAIRS for t in p] + [x.decode() for p in same_lane(400_000) for x in p]
    texts += ["".join(rng.choice("ab# \n\n\té\r") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["\n".join(rng.choice(["one line", "two lines", "three"]) for _ in range(9)) for _ in range(50)]
    texts += [" ".join(x.decode() for p in same_lane(400_000) for x in p) * 2]
    for c in chunks(pa.array(texts), 3000):
        s = rules.text_stats(c)
        for i in range(len(c)):
            assert tuple(int(s[k][i]) for k in rules.STATS) == brute.rule_stats(texts[c.first + i])


@pytest.mark.parametrize("bits", [1, 5, 64])
def test_cached_slices_with_a_poor_hash(monkeypatch, bits):
    good = _words.segment_hash
    monkeypatch.setattr(_vocab, "segment_hash", lambda *a, **k: good(*a, **k) & np.uint64((1 << bits) - 1))
    encoder = _vocab.CachedEncoder(lambda piece: list(piece), 1 << 10)
    rng = random.Random(2)
    for _ in range(5):
        texts = ["".join(rng.choice("abc é\n'x1") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["a" * 50, "a" * 49 + "b", "a" * 5000]
        c = chunk_of(texts)
        ids, rows, _ = encoder.encode(c)
        assert [bytes(ids[a:b].tolist()).decode() for a, b in zip(rows, rows[1:])] == texts
