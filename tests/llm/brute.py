"""Plain versions of what operators compute."""

import re
from collections import Counter, defaultdict


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def near_duplicates(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words_of(lower(t))
        sets[i] = frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets, key=lambda i: len(sets[i])):
        common = Counter(j for s in sets[i] for j in seen[s])
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            seen[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def rule_stats(text):
    w = words_of(text)
    windows = list(zip(w, w[1:], w[2:]))
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)
