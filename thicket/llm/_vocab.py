"""Token ids of whole chunks: slices of the pre-tokeniser looked up in a cache.

The cache is an open-addressing table in numpy arrays, so a chunk's slices are
looked up together; only slices not seen before are encoded one at a time. It
keeps the slices' bytes and compares them on every hit: a slice whose hash
belongs to another is encoded by itself. The table is emptied when full, which
bounds its memory and changes no result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from thicket.llm._pretok import token_starts
from thicket.llm._words import MASK, Chunk, same_segments, segment_hash, words8

SLOTS = 1 << 21


class CachedEncoder:
    """``encode_slice`` gives the ids of one pre-token."""

    def __init__(self, encode_slice: Callable[[bytes], list[int]], slots: int = SLOTS):
        self.encode_slice, self.slots = encode_slice, slots
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int32)
        self.len = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(self.slots, np.int32)
        self.word = np.zeros(self.slots, np.uint64)  # the first eight bytes
        self.byte_at = np.zeros(self.slots, np.int64)
        self.bytes = np.zeros(1 << 16, np.uint8)  # the last eight stay free
        self.used = self.filled = self.held = 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and which keys are there."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != h) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            there = self.keys[slot[open_]]
            open_ = open_[(there != h[open_]) & (there != 0)]
        return slot, self.keys[slot] == h

    def _keep(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of new slices are kept, and their sizes."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        if self.held + len(flat) + 8 > len(self.bytes):
            grown = np.zeros(max(2 * len(self.bytes), self.held + len(flat) + 8), np.uint8)
            grown[: self.held] = self.bytes[: self.held]
            self.bytes = grown
        self.bytes[self.held : self.held + len(flat)] = flat
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = self.held + np.cumsum(size) - size
        self.held += len(flat)
        return at, size

    def _kept(self) -> np.ndarray:
        return np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))

    def _add(self, h: np.ndarray, pieces: list[bytes]) -> None:
        ids, (kept, size) = [self.encode_slice(x) for x in pieces], self._keep(pieces)
        word = self._kept()[kept] & MASK[np.minimum(size, 8)]
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(lens.sum()))
        if self.used + len(flat) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(flat)), np.int32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.filled += len(h)
        left = np.arange(len(h))
        while len(left):
            slot, _ = self._find(h[left])
            _, first = np.unique(slot, return_index=True)
            s, i = slot[first], left[first]
            self.keys[s], self.at[s], self.len[s] = h[i], at[i], lens[i]
            self.byte_at[s], self.size[s], self.word[s] = kept[i], size[i], word[i]
            left = np.delete(left, first)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, offsets of rows in them, and byte offsets at which
        pre-tokens start."""
        buf, off = chunk.buf, chunk.off
        start = token_starts(buf, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64), start
        size = np.diff(np.append(start, len(buf)))
        view = words8(buf)
        h = segment_hash(buf, start, size, view=view)
        h[h == 0] = 1
        slot, found = self._find(h)
        if not found.all():
            miss = np.flatnonzero(~found)
            if self.filled + len(miss) > 0.6 * self.slots and self.filled:
                self._reset()
                miss = np.arange(len(h))
            new, first = np.unique(h[miss], return_index=True)
            if len(new) > 0.6 * self.slots:  # one row alone fills the table
                self.slots = 1 << int(np.ceil(np.log2(2 * len(new))))
                self._reset()
            raw = buf.tobytes()
            s, e = start[miss[first]], (start + size)[miss[first]]
            self._add(new, [raw[a:b] for a, b in zip(s.tolist(), e.tolist())])
            slot, found = self._find(h)
        n, at, pool = self.len[slot], self.at[slot], self.pool
        same = (size == self.size[slot]) & ((view[start] & MASK[np.minimum(size, 8)]) == self.word[slot])
        long = np.flatnonzero(same & (size > 8))
        same[long] = same_segments(view, start[long] + 8, self._kept(), self.byte_at[slot[long]] + 8, size[long] - 8)
        if not same.all():
            # Another slice has this hash: these are encoded outside the cache.
            other, raw = np.flatnonzero(~same), buf.tobytes()
            more = [self.encode_slice(raw[a : a + k]) for a, k in zip(start[other].tolist(), size[other].tolist())]
            n[other] = list(map(len, more))
            at[other] = len(pool) + np.cumsum(n[other]) - n[other]
            pool = np.append(pool, np.array([x for y in more for x in y], pool.dtype))
        end = np.cumsum(n, dtype=np.int64)
        ids = pool[np.arange(end[-1]) + np.repeat(at - (end - n), n)]
        rows = np.concatenate([[0], end])[np.searchsorted(start, off)]
        return ids, rows, start


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-level BPE: the adjacent pair of lowest rank merges first, the
    leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 96:
        return _merge_long(piece, ranks)
    none = 1 << 60
    cut = list(range(len(piece) + 1))
    rank = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while rank:
        low = min(rank)
        if low == none:
            break
        i = rank.index(low)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(piece[cut[i] : cut[i + 2]], none)
        if i:
            rank[i - 1] = ranks.get(piece[cut[i - 1] : cut[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts: n log n steps."""
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] != j or not alive[j] or end[j] != e or end[i] != j:
            continue
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, nxt[i], end[nxt[i]]))
        if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, i, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


@lru_cache(4)
def rank_encoder(path: str) -> CachedEncoder:
    """One per Python worker and vocabulary."""
    ranks = load_ranks(path)
    return CachedEncoder(lambda piece: merge_pairs(piece, ranks))


@lru_cache(4)
def vocabulary_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in the order of their ids, and their offsets."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def _byte_letters() -> str:
    """The printable stand-in of each byte in tokenizers' byte-level models."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return "".join(out)


class LibraryEncoder(CachedEncoder):
    """Slices are encoded by the model of a tokenizers file. The library also
    looks for the file's added tokens, before it cuts slices and in every text;
    rows that hold one are left to the library's own ``encode``."""

    def __init__(self, tokenizer, slots: int = SLOTS):
        model, letters = tokenizer.model, _byte_letters()
        super().__init__(lambda piece: [t.id for t in model.tokenize(piece.decode("latin-1").translate(letters))], slots)
        self.tokenizer = tokenizer
        self.added = sorted({t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()} - {b""})

    def _holding(self, chunk: Chunk) -> list[int]:
        """Rows in which an added token's text stands."""
        raw, rows = chunk.buf.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(chunk.off, at, side="right")) - 1
                if at + len(token) <= chunk.off[row + 1]:
                    rows.add(row)
                    at = raw.find(token, int(chunk.off[row + 1]))
                else:  # across rows
                    at = raw.find(token, at + 1)
        return sorted(rows)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As above; slices start as if there were no added tokens."""
        ids, rows, start = super().encode(chunk)
        odd = self._holding(chunk)
        if not odd:
            return ids, rows, start
        sizes, parts, done = np.diff(rows), [], 0
        for i in odd:
            own = self.tokenizer.encode(chunk.text(i).decode("utf-8"), add_special_tokens=False).ids
            parts += [ids[rows[done] : rows[i]], np.array(own, ids.dtype)]
            sizes[i], done = len(own), i + 1
        parts.append(ids[rows[done] :])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), start


@lru_cache(4)
def library_encoder(path: str) -> LibraryEncoder:
    """One per Python worker and tokenizer file."""
    from tokenizers import Tokenizer

    return LibraryEncoder(Tokenizer.from_file(path))
