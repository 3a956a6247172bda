"""Quality rules by weak supervision.

Cheap statistics of each whole text let rules vote good or bad, or abstain.
Texts with the same votes are alike to the model, so the corpus is counted by
vote pattern (at most 3^rules rows, combined map-side); expectation-maximisation
over those counts estimates how each rule votes on good and on bad texts, and
gives every pattern its posterior probability of quality. No label is used.

Null and empty texts have no words; all statistics are zero and the base fails.
Rows repeat as they come. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._words import SPACE, Chunk, Words, chunks, exact_codes, mix64, tidy
from thicket.storage import materialize

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GOOD, NONE, BAD = 2, 1, 0
RULES = ("symbols", "repeats", "word_length", "capitals", "distinct", "line_repeats", "marks")
THRESHOLD = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True  # lead bytes beyond ASCII
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&*+/<=>?@[\\]^_`{|}~"]] = True


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])


_STEP = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """How many codes each row has."""
    top = int(code.max(initial=0)) + 1
    return np.bincount(np.unique(row * top + code) // top, minlength=n) if len(code) else np.zeros(n, np.int64)


def text_stats(chunk: Chunk) -> dict[str, np.ndarray]:
    """Exact statistics of each row of a chunk."""
    buf, off, n = chunk.buf, chunk.off, len(chunk)
    words = Words(chunk)
    inside = ~SPACE[buf]
    out = {
        "n_words": words.counts(),
        "word_chars": _per_row(inside & ((buf & 0xC0) != 0x80), off),
        "n_symbols": _per_row(_SYMBOL[buf], off),
        "n_upper": _per_row(_UPPER[buf], off),
        "n_letters": _per_row(_LETTER[buf], off),
        "n_marks": _per_row(_MARK[buf], off),
    }
    row = np.repeat(np.arange(n), out["n_words"])
    code = words.codes()
    out["n_distinct"] = _distinct(row, code, n)

    rows = np.flatnonzero(np.diff(off) > 0)
    start = np.unique(np.concatenate([off[rows], np.flatnonzero(buf == 10) + 1]))
    start = start[start < len(buf)]
    stop = np.append(start[1:], len(buf))
    size = stop - start - (buf[stop - 1] == 10) if len(start) else start
    filled = np.concatenate([[0], np.cumsum(inside)])
    real = filled[start + size] > filled[start] if len(start) else np.zeros(0, bool)
    start, size = start[real], size[real]
    line_row = np.searchsorted(off, start, side="right") - 1
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_row, exact_codes(buf, start, size), n)

    out["n_repeat_words"] = np.zeros(n, np.int64)
    long = np.maximum(out["n_words"] - 2, 0)
    if long.sum():
        at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long - words.off[:-1], long)
        c = code.astype(np.uint64)
        key = mix64(mix64(mix64(row[at].astype(np.uint64) * _STEP[0] + c[at]) * _STEP[1] + c[at + 1]) * _STEP[2] + c[at + 2])
        order = np.sort(key)
        at = at[np.isin(key, order[1:][order[1:] == order[:-1]])]  # all that come twice, and by chance others
        order = at[np.lexsort((code[at + 2], code[at + 1], code[at], row[at]))]
        twin = np.ones(max(len(order) - 1, 0), bool)
        for x in (row, code, code[1:], code[2:]):
            twin &= x[order[1:]] == x[order[:-1]]
        found = np.union1d(order[1:][twin], order[:-1][twin])
        covered = np.zeros(len(code), bool)
        for k in range(3):
            covered[found + k] = True
        out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Vote pattern of each row: base 3, the first rule's vote lowest."""

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    words, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_letters"], 1)
    mean = s["word_chars"] / words
    enough = s["n_words"] >= 50
    every = [
        vote(s["n_symbols"] > 0.1 * words, s["n_symbols"] <= 0.02 * words),
        vote(s["n_repeat_words"] > 0.4 * words, s["n_repeat_words"] <= 0.15 * words),
        vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 9)),
        vote(s["n_upper"] > 0.4 * letters, s["n_upper"] <= 0.15 * letters),
        vote(enough & (s["n_distinct"] < 0.15 * words), s["n_distinct"] >= 0.3 * words),
        vote(s["n_dup_lines"] > 0.5 * s["n_lines"], np.zeros(len(words), bool)),
        vote(s["n_marks"] > 0.3 * words, s["n_marks"] <= 0.05 * words),
    ]
    return sum(v * 3**i for i, v in enumerate(every))


def fit(counts: dict[int, int], rules: int = len(RULES), rounds: int = 100, false_alarm: float = 0.01, detection: float = 0.1) -> np.ndarray:
    """Posterior probability of quality by pattern. Each rule's votes are taken
    to be independent given the quality. It starts from a corpus that is mostly
    good and from rules that call few good texts bad and three in ten bad ones.
    ``false_alarm`` bounds the share of good texts that a rule may call bad, and
    ``detection`` from below that of bad ones: else the two classes may settle
    on one kind of bad text and take the others for good."""
    pattern = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in pattern.tolist()], float)
    vote = (pattern[:, None] // 3 ** np.arange(rules)) % 3
    prior = 0.8
    given = np.tile(np.array([[0.02, 0.3, 0.68], [0.3, 0.3, 0.4]])[:, None, :], (1, rules, 1))  # class good, bad; votes bad, none, good

    def posterior(vote: np.ndarray) -> np.ndarray:
        log = np.log([prior, 1 - prior])[:, None] + np.log(given[:, np.arange(rules), vote]).sum(2)
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))

    for _ in range(rounds if weight.sum() else 0):
        good = posterior(vote)
        new = np.empty_like(given)
        for c, p in enumerate((good * weight, (1 - good) * weight)):
            for v in range(3):
                new[c, :, v] = ((vote == v) * p[:, None]).sum(0) + (1.0 if v != (BAD if c == 0 else GOOD) else 0.2)
        given = new / new.sum(2, keepdims=True)
        given[0, :, BAD] = np.minimum(given[0, :, BAD], false_alarm)
        given[1, :, BAD] = np.maximum(given[1, :, BAD], detection)
        prior = float(np.clip((good * weight).sum() / weight.sum(), 0.05, 0.99))
    return posterior((np.arange(3**rules)[:, None] // 3 ** np.arange(rules)) % 3)


def stats(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the five statistics, ``base_failed`` and ``pattern``."""
    keep = list(keep)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(len(keep))):
                s = text_stats(chunk)
                cols = [batch.column(i).slice(chunk.first, len(chunk)) for i in range(len(keep))]
                cols += [pa.array(s[k].astype(np.int64)) for k in STATS] + [pa.array(base_failed(s)), pa.array(votes(s).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *STATS, "base_failed", "pattern"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{k} long" for k in STATS), "base_failed boolean", "pattern int"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(tidy(run), schema)


def _posterior(patterns: DataFrame) -> np.ndarray:
    return fit({r.pattern: r["count"] for r in patterns.groupBy("pattern").count().collect()})  # 3^rules rows at most


def score(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` with ``quality`` (posterior probability) and ``kept``."""
    table = materialize(stats(docs, text, keep), "rule-stats")
    by = table.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(_posterior(table))], "pattern int, quality double")
    return table.join(F.broadcast(by), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, base: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes the posterior and,
    if asked, the base (which fails every short text). Two narrow passes over
    the texts, no shuffle of them."""
    good = _posterior(stats(docs, text, [])) >= threshold
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.zeros(batch.num_rows, bool)
            for chunk in chunks(batch.column(at)):
                s = text_stats(chunk)
                mask[chunk.first : chunk.first + len(chunk)] = good[votes(s)] & ~(base & base_failed(s))
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(tidy(run), docs.schema)
