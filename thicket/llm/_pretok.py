"""Pre-tokenisation without regular expressions.

The public byte-level BPE pattern cuts text into contractions, runs of letters,
of digits, of other symbols (each with one leading space) and white space. Here
an array of codepoint classes is turned into an array of transition functions
of a small automaton; an associative scan over their composition gives the
automaton's state before every character at once, and so every boundary.

All functions that composition can reach are enumerated (the transition
monoid), so that composing two arrays of functions is one table lookup.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Character classes.
LETTER, NUMBER, OTHER, QUOTE, BLANK, WHITE, STMD, R_, V_, L_, E_ = range(11)
# Symbols of the automaton, which already hold what look-ahead decides:
# letter, number, other, quote of a contraction, first letter of a two-letter
# contraction, space that leads the next run, white space alone before a visible
# character, white space followed by more of it or by the end.
S_LET, S_NUM, S_OTH, S_QUOTE, S_MID, S_LEAD, S_ALONE, S_RUN = range(8)
# States: what the character before belongs to.
NONE, IN_LET, IN_NUM, IN_OTH, IN_WS, LED, QUOTED = range(7)

# The code points with the property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, sym: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character."""
    if state == QUOTED:
        return (QUOTED if sym == S_MID else NONE), False
    if sym in (S_LET, S_MID, S_NUM, S_OTH):
        into = {S_LET: IN_LET, S_MID: IN_LET, S_NUM: IN_NUM, S_OTH: IN_OTH}[sym]
        return into, state not in (into, LED)
    if sym == S_QUOTE:
        return (IN_OTH, False) if state in (IN_OTH, LED) else (QUOTED, True)
    if sym == S_LEAD:
        return LED, True
    if sym == S_ALONE:
        return NONE, True
    return IN_WS, state != IN_WS


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Function ids of pairs of symbols (a symbol plus 8: after a reset), flat
    composition table, and start flags of a pair after a function."""
    gens = [tuple(_step(q, s)[0] for q in range(7)) for s in range(8)]
    gens += [tuple([_step(NONE, s)[0]] * 7) for s in range(8)]
    ids = {f: i for i, f in enumerate(dict.fromkeys(gens))}
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[q] for q in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    fs = list(ids)
    assert len(fs) <= 64
    table = np.zeros((64, 64), np.uint8)
    for a, f in enumerate(fs):
        for b, g in enumerate(fs):
            table[a, b] = ids[tuple(g[q] for q in f)]
    pairs = np.array([ids[tuple(gens[b][q] for q in gens[a])] for a in range(16) for b in range(16)], np.uint8)

    def start(state: int, sym: int) -> bool:
        return sym >= 8 or _step(state, sym)[1]

    flags = np.zeros((64, 16, 16), np.uint8)
    for i, f in enumerate(fs):
        for a in range(16):
            for b in range(16):
                flags[i, a, b] = start(f[NONE], a) + 2 * start(gens[a][f[NONE]], b)
    return pairs, table.ravel(), flags.ravel()


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        k = kind.get(unicodedata.category(chr(cp))[0])
        if k is not None:
            out[cp] = k
    out[WHITE_SPACE] = WHITE
    out[0x20] = BLANK
    out[ord("'")] = QUOTE
    out[[ord(c) for c in "stmd"]] = STMD
    for c, k in zip("rvle", (R_, V_, L_, E_)):
        out[ord(c)] = k
    return out


#: By class, plus 16 where white space or the end of the text follows.
_TO_SYMBOL = np.array(
    [S_LET, S_NUM, S_OTH, S_OTH, S_LEAD, S_ALONE, *[S_LET] * 5, *[0] * 5, S_LET, S_NUM, S_OTH, S_OTH, S_RUN, S_RUN, *[S_LET] * 5], np.uint8
)


def _scan(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive scan of composition: pairs are composed, scanned, filled in."""
    n = len(f)
    if n < 3:
        out = f.copy()
        if n == 2:
            out[1] = table[(int(f[0]) << 6) | int(f[1])]
        return out
    half = n // 2
    left = f[0 : 2 * half : 2].astype(np.uint16) << 6
    left |= f[1 : 2 * half : 2]
    inner = _scan(table.take(left), table)
    out = np.empty(n, np.uint8)
    out[0] = f[0]
    out[1 : 2 * half : 2] = inner
    rest = f[2::2]
    left = inner[: len(rest)].astype(np.uint16) << 6
    left |= rest
    out[2::2] = table.take(left)
    return out


def token_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pattern's matches start, over all rows of a
    chunk (UTF-8 bytes, row offsets). Matches cover every byte of each row."""
    n_bytes = len(buf)
    if not n_bytes:
        return np.zeros(0, np.int64)
    raw = buf.tobytes()
    if raw.isascii():
        cp, at = buf, None
    else:
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
    n = len(cp)
    bounds = off[:-1][np.diff(off) > 0]
    first = bounds if at is None else np.searchsorted(at, bounds)
    last = np.append(first[1:], n) - 1
    cls = classes().take(cp)
    follow = np.empty(n, bool)
    follow[:-1] = (cls[1:] == BLANK) | (cls[1:] == WHITE)
    follow[last] = True
    sym = _TO_SYMBOL.take(cls + (follow.view(np.uint8) << 4))
    quote = np.flatnonzero(cls == QUOTE)
    if len(quote):
        stop = last[np.searchsorted(last, quote)]
        a = np.where(quote < stop, cls[np.minimum(quote + 1, n - 1)], OTHER)
        b = np.where(quote + 1 < stop, cls[np.minimum(quote + 2, n - 1)], OTHER)
        pair = ((a == R_) & (b == E_)) | ((a == V_) & (b == E_)) | ((a == L_) & (b == L_))
        sym[quote[(a == STMD) | pair]] = S_QUOTE
        sym[quote[pair] + 1] = S_MID
    sym[first] += 8
    if n % 2:
        sym = np.append(sym, np.uint8(S_OTH))
    pairs, table, flags = automaton()
    two = (sym[0::2] << 4) | sym[1::2]
    before = np.zeros(len(two), np.uint16)
    before[1:] = _scan(pairs.take(two), table)[:-1]
    before <<= 8
    before |= two
    found = flags.take(before)
    start = np.empty(len(sym), bool)
    start[0::2] = found & 1
    start[1::2] = found >> 1
    start = np.flatnonzero(start[:n])
    return start if at is None else at[start]
