"""URL filter: allow and block rules, and a boosted-tree classifier.

Everything here is DataFrame expressions. Lexical features are cut into few
bins; training rows are counted by bin vector, so that every boosting round is
one aggregation over those counts. It returns the gradient histogram of each
pair of features (pairs * bins^2 rows at most, whatever the data), from which
the driver picks a tree of depth two: the root's split, then the best split of
each side. The trees become one CASE expression that scores every URL in the
scan, in generated code.

A null URL, or one without ``://``, has an empty host and path and no rule. Its
features are those of its text (empty if null). Without labelled URLs there are
no trees and nothing is blocked by them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.storage import materialize

TREES, RATE, RIDGE = 16, 0.3, 1.0
SUFFIX_BUCKETS = 256


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parse_rules(lines: Sequence[str]) -> list[Rule]:
    """``allow com/`` and the like; the longest first, then as text."""
    out = []
    for line in lines:
        verdict, text = line.split()
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict}")
        at = text.find("/")
        out.append(Rule(verdict, text[:at] if at >= 0 else text, text[at:] if at >= 0 else ""))
    return sorted(out, key=lambda r: (-len(r.text), r.text))


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path`` to a frame of the columns of ``df``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    return sum((F.when(value > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def _suffix(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.element_at(F.split(host, r"\."), -1)), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical_values(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers of a URL on a grid that is fine enough for every cut."""
    text = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    digits = F.length(F.regexp_replace(text, "[^0-9]", "")) / size
    share = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.length(host)
    entropy = F.when(F.length(host) == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(F.filter(F.split(host, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    )
    params = F.when(F.instr(text, "?") > 0, _count(text, "&") + 1).otherwise(0)
    out = {
        "length": F.length(text), "depth": _count(path, "/"), "digits": F.round(digits * 200), "entropy": F.round(entropy * 50), "params": params,
        "labels": _count(host, "."), "signs": _count(host, "-") + _count(path, "-") + _count(path, "_"),
    }
    return {k: F.least(v, F.lit(GRID)).cast("int") for k, v in out.items()}


SMOOTH = 10  # URLs of the overall rate that each suffix is given
GRID = 2047  # the largest value told apart
BINS = 8
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "signs", "suffix")


@dataclass(frozen=True)
class Tree:
    """Root split, and for each side its split; leaves in order. A split
    (feature, t) sends bins up to t left; None keeps a side whole."""

    root: tuple[int, int]
    sides: tuple[tuple[int, int] | None, tuple[int, int] | None]
    leaves: tuple[float, float, float, float]

    def value(self, cols: Sequence[Column]) -> Column:
        def side(k: int) -> Column:
            low, high = self.leaves[2 * k : 2 * k + 2]
            split = self.sides[k]
            return F.lit(low) if split is None else F.when(cols[split[0]] <= split[1], low).otherwise(high)

        return F.when(cols[self.root[0]] <= self.root[1], side(0)).otherwise(side(1))


def _gain(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def grow(cells: dict[tuple[int, int, int, int], tuple[float, float]], n_features: int) -> Tree | None:
    """The greedy tree of a pair histogram: (f, b, f2, b2) -> sums of gradient
    and curvature, with f <= f2."""
    grid = [[[[(0.0, 0.0)] * BINS for _ in range(BINS)] for _ in range(n_features)] for _ in range(n_features)]
    for (f, b, f2, b2), v in cells.items():
        grid[f][f2][b][b2] = v
        grid[f2][f][b2][b] = v

    def best(rows: list[list[tuple[float, float]]]) -> tuple[float, tuple[int, int] | None, list[tuple[float, float]]]:
        """Best split of features' bins: gain, split, sums of both sides."""
        g, h = (sum(x[k] for x in rows[0]) for k in (0, 1))
        top: tuple[float, tuple[int, int] | None, list[tuple[float, float]]] = (1e-6, None, [(g, h), (g, h)])
        for f, row in enumerate(rows):
            a = c = 0.0
            for t in range(BINS - 1):
                a, c = a + row[t][0], c + row[t][1]
                if c > 1e-9 and h - c > 1e-9:
                    gain = _gain(a, c) + _gain(g - a, h - c) - _gain(g, h)
                    if gain > top[0]:
                        top = (gain, (f, t), [(a, c), (g - a, h - c)])
        return top

    whole = [[grid[f][f][b][b] for b in range(BINS)] for f in range(n_features)]
    _, root, _ = best(whole)
    if root is None:
        return None
    sides, leaves = [], []
    for bins in (range(root[1] + 1), range(root[1] + 1, BINS)):
        part = [[tuple(sum(grid[root[0]][f][b][b2][k] for b in bins) for k in (0, 1)) for b2 in range(BINS)] for f in range(n_features)]
        _, split, sums = best(part)
        sides.append(split)
        leaves += [-RATE * g / (h + RIDGE) for g, h in sums]
    return Tree(root, tuple(sides), tuple(leaves))


class UrlFilter:
    """``fit`` on labelled URLs, then ``judge`` any."""

    def __init__(self, trees: int = TREES):
        self.n_trees, self.trees, self.base = trees, [], 0.0
        self.cuts: dict[str, list[int]] = {}
        self.share, self.seen = 0.5, [(0, 0)] * SUFFIX_BUCKETS  # blocked and all URLs of each suffix

    def _values(self, df: DataFrame, url: str) -> DataFrame:
        return df.withColumns({f"_{k}": v for k, v in lexical_values(F.col(url), F.col("host"), F.col("path")).items()})

    def _bins(self, df: DataFrame, url: str, label: str | None = None) -> DataFrame:
        """Adds the bin columns; the suffix's is its rate of blocked URLs, for a
        row that is learned from (``label``) that of the others."""
        out = self._values(df, url)
        out = out.withColumns({f"_{k}": _bin(F.col(f"_{k}"), cuts) for k, cuts in self.cuts.items()})
        y, n = (F.element_at(F.array(*[F.lit(s[i]) for s in self.seen]), _suffix(F.col("host")) + 1) for i in (0, 1))
        if label is not None:
            y, n = y - F.col(label), n - 1
        rate = (y + SMOOTH * self.share) / (n + SMOOTH)
        return out.withColumn("_suffix", _bin(rate, (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)))

    def _fit_cuts(self, rows: DataFrame) -> None:
        """Cuts at the eighths of each number's distribution, from its exact
        counts over the grid (a row a number and grid value at most)."""
        names = FEATURES[:-1]
        pair = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_{k}").alias("v")) for i, k in enumerate(names)])).alias("x")
        counts = self._values(rows, "_url").select(pair).groupBy("x.f", "x.v").count().collect()
        for i, k in enumerate(names):
            own = sorted((r.v, r["count"]) for r in counts if r.f == i)
            total, so_far, cuts = sum(c for _, c in own), 0, set()
            for v, c in own[:-1]:
                before, so_far = so_far, so_far + c
                if so_far * BINS // total > before * BINS // total:
                    cuts.add(v)
            self.cuts[k] = sorted(cuts)[: BINS - 1]

    def _raw(self) -> Column:
        cols = [F.col(f"_{f}") for f in FEATURES]
        return sum((t.value(cols) for t in self.trees), F.lit(self.base))

    def fit(self, labelled: DataFrame, url: str, blocked: str) -> UrlFilter:
        """``labelled`` has ``url`` and the boolean ``blocked``; others are
        not read. Suffix statistics are smoothed by the overall rate; a row's own
        label is left out of those it is learned with."""
        rows = split_url(labelled.where(F.col(blocked).isNotNull()).select(F.col(url).alias("_url"), F.col(blocked).cast("int").alias("_y")), "_url")
        stats = rows.groupBy(_suffix(F.col("host")).alias("s")).agg(F.sum("_y").alias("y"), F.count("*").alias("n")).collect()  # SUFFIX_BUCKETS rows
        n, y = sum(r.n for r in stats), sum(r.y for r in stats)
        if not n or y in (0, n):
            self.base = 0.0 if not n else math.log((y + 0.5) / (n - y + 0.5))
            return self
        self.share = y / n
        for r in stats:
            self.seen[r.s] = (r.y, r.n)
        self.base = math.log(y / (n - y))
        self._fit_cuts(rows)
        names = [f"_{f}" for f in FEATURES]
        counts = materialize(self._bins(rows, "_url", "_y").groupBy(*names).agg(F.sum("_y").alias("y"), F.count("*").alias("n")), "url-bins")
        pairs = list(combinations_with_replacement(range(len(FEATURES)), 2))
        cell = F.explode(F.array(*[F.lit(i * BINS * BINS) + F.col(names[a]) * BINS + F.col(names[b]) for i, (a, b) in enumerate(pairs)])).alias("cell")
        for _ in range(self.n_trees):
            p = 1 / (1 + F.exp(-self._raw()))
            step = counts.select((F.col("n") * p - F.col("y")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), cell)
            cells = {}
            for r in step.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # pairs * BINS^2 rows at most
                i, at = divmod(r.cell, BINS * BINS)
                cells[(pairs[i][0], at // BINS, pairs[i][1], at % BINS)] = (r.g, r.h)
            tree = grow(cells, len(FEATURES))
            if tree is None:
                break
            self.trees.append(tree)
        return self

    def score(self, df: DataFrame, url: str) -> DataFrame:
        """``df`` with ``host``, ``path`` and ``blocked_score`` (0 to 1)."""
        kept = split_url(df, url).columns
        scored = self._bins(split_url(df, url), url).withColumn("_raw", self._raw())
        return scored.select(*kept, (1 / (1 + F.exp(-F.col("_raw")))).alias("blocked_score"))


def with_rule(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``rule`` (text) and ``rule_verdict`` of the longest rule that fits
    ``host`` and ``path``; null where none does."""
    text = verdict = None
    for r in rules:
        fits = r.fits(F.col("host"), F.col("path"))
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return df.withColumns({"rule": none if text is None else text, "rule_verdict": none if verdict is None else verdict})


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", id_col: str = "page_id", trees: int = TREES) -> DataFrame:
    """``id_col, host, path, rule, verdict, blocked_score``: the rule's verdict,
    or that of trees learned from the URLs on which a rule decides."""
    source = df.select(F.col(id_col), F.col(url).alias("_url"))
    ruled = with_rule(split_url(source, "_url"), rules)
    labelled = ruled.where(F.col("rule").isNotNull()).select("_url", (F.col("rule_verdict") == "block").alias("_blocked"))
    model = UrlFilter(trees).fit(labelled, "_url", "_blocked")
    judged = with_rule(model.score(source, "_url"), rules)
    own = F.when(F.col("blocked_score") > 0.5, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "blocked_score")
