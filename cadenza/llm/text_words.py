"""Words of UTF-8 bytes as arrays: where they stand, and 64-bit hashes of them."""

import numpy as np

_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _33)) * _FIRST
    h = (h ^ (h >> _33)) * _SECOND
    return h ^ (h >> _33)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Hashes of the words data[starts[k]:ends[k]]: sums of a random number for each byte times a power of its place."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + chunk)))
        s0, e0 = int(starts[k]), int(ends[to - 1])
        if len(_powers[0]) < e0 - s0 + 1:
            steps = max(e0 - s0 + 1, 2 * chunk)
            for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                each = np.full(steps, base, np.uint64)
                each[0] = 1
                _powers[i] = np.cumprod(each)
        sums = np.zeros(e0 - s0 + 1, np.uint64)
        np.cumsum(_BYTES[data[s0:e0]] * _powers[0][: e0 - s0], out=sums[1:])
        s, e = starts[k:to] - s0, ends[k:to] - s0
        out[k:to] = (sums[e] - sums[s]) * _powers[1][s] + (e - s).astype(np.uint64) * _FIRST
        k = to
    return mixed(out)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts data[offsets[k]:offsets[k + 1]], and which words each text has, as bounds.

    Words are what stands between ASCII white space, within one text.
    """
    size = len(data)
    blank = np.ones(size + 2, bool)
    blank[1:-1] = BLANK[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    here = ~blank[1:-1]
    starts = np.flatnonzero(here & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(here & (blank[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
