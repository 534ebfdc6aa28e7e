"""Canonical length-limited Huffman codes in numpy, with vectorised encoding and table-driven decoding from checkpoints."""

from __future__ import annotations

import numpy as np

#: No code is longer.
LIMIT = 18
#: A checkpoint, the bit offset, for each so many ids.
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths up to `limit` by package-merge; 0 for ids that don't occur. A single id gets one bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    weights, levels = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        even = len(weights) // 2 * 2
        packages = weights[0:even:2] + weights[1:even:2]
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        weights = both[rank]
        levels.append(rank < len(leaves))
    lengths, take = np.zeros(len(leaves), dtype=np.int64), 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        code <<= n - last
        last = n
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        #: Of each id the code and, in the low byte, its length.
        self.both = canonical(lengths).astype(np.int64) << 8 | self.lengths
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, the first one highest in its byte, and the bit offset of every STRIDE-th id."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.uint32)
        both = self.both[ids]
        n = both & 255
        ends = np.cumsum(n)
        starts = ends - n
        # Each code in the 64 bits from the start of the 32-bit word that it starts in; codes share no bit, so adding is setting.
        window = (both >> 8).view(np.uint64) << (64 - n - (starts & 31)).view(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
        out[word[first]] += np.add.reduceat(window >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], starts[::STRIDE].astype(np.uint32)

    def _lookup(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            ids = np.flatnonzero(self.lengths)
            ids = ids[np.lexsort((ids, self.lengths[ids]))]
            spans = 1 << (LIMIT - self.lengths[ids])
            symbol, length = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
            symbol[: spans.sum()] = np.repeat(ids, spans)
            length[: spans.sum()] = np.repeat(self.lengths[ids], spans)
            self._table = symbol, length
        return self._table

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All n ids; every stretch between checkpoints is decoded at the same time as the others."""
        if not n:
            return np.zeros(0, dtype=np.uint32)
        symbol, length = self._lookup()
        data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4 + LIMIT * STRIDE // 8, np.uint8)]).astype(np.uint32)
        words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((STRIDE, len(at)), dtype=np.uint32)
        for k in range(STRIDE):
            peek = (words[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
            out[k] = symbol[peek]
            at = np.minimum(at + length[peek], len(payload) * 8)
        return out.T.reshape(-1)[:n]
