"""Words and word shingles of whole batches of texts as 64-bit hashes, computed on the UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

#: The bytes that part words: space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of all rows; a row's edge always parts words."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = space[:-1]
    before |= edge[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word and its row number."""
    starts, ends, rows = word_spans(data, offsets)
    return run_hashes(LOWER[data], starts, ends), rows


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``symbols[start:end]`` of bytes or of 64-bit hashes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(symbols)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, len(symbols))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles; of its whole word sequence if it is shorter."""
    h, rows = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))
    n = len(h)
    salt = [np.uint64((0xA0761D6478BD642F * (2 * j + 1)) % (1 << 64)) for j in range(k)]
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        part = h[j:] * salt[j]
        grams[: n - j] += (part ^ (part >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB + 2 * j)
    grams = mix(grams)
    out = []
    none = np.zeros(0, dtype=np.int64)
    for a, c in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if c >= k:
            out.append(np.unique(grams[a : a + c - k + 1]).view(np.int64))
        elif c:
            whole = np.array([0x243F6A8885A308D3 + c], dtype=np.uint64)
            for j in range(c):
                whole = mix(whole + h[a + j : a + j + 1] * salt[j])
            out.append(whole.view(np.int64))
        else:
            out.append(none)
    return [np.sort(s) for s in out]
