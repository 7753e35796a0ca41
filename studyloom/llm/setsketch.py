"""SetSketch: registers of exponentially spaced, truncated minima.

Register i of a set is K_i = floor(1 - log_b(min over elements of x_i)), cut off at 0 and
65535, where x_i is an exponential variable with rate RATE drawn from the element's hash.
Sketches of a union are the larger registers, so they merge. With b close to 1 a register of
two sets is equal with a probability close to their Jaccard similarity, which makes bands of
registers locality-sensitive; how often one is larger, smaller or equal gives the
similarity's likelihood, given both sizes.
"""

from __future__ import annotations

import numpy as np

REGISTERS, BANDS = 128, 32
BASE, RATE = 1.001, 20.0
TOP = 65535
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
_TERMS = _mixed(np.arange(1001, REGISTERS + 1001, dtype=np.uint64) * _STEP)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes, as uint16; an empty set has zeros."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(elements), 512):
        np.minimum(least, (elements[k : k + 512, None] * _FACTORS + _TERMS).min(0), out=least)
    u = (least >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(n, REGISTERS) registers to (n, BANDS) 64-bit keys, which hold the band's number too."""
    words = np.ascontiguousarray(sketches).view(np.uint64).reshape(len(sketches), BANDS, -1)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, words.shape[:2]).copy()
    for k in range(words.shape[2]):
        out = _mixed(out ^ words[:, :, k])
    return out.view(np.int64)


def _larger(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likeliest_jaccard(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, points: int = 128) -> np.ndarray:
    """For each pair the similarity of the largest likelihood: `larger` and `smaller` count registers in which
    the first sketch is above or below the second; the sets have n_a and n_b elements."""
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, points)[None, :] * np.minimum(u / v, v / u)
    over, under = _larger(np.maximum(u - v * j, 0)), _larger(np.maximum(v - u * j, 0))
    equal = REGISTERS - larger - smaller
    tiny = 1e-12
    log = larger[:, None] * np.log(over + tiny) + smaller[:, None] * np.log(under + tiny) + equal[:, None] * np.log(np.maximum(1 - over - under, tiny))
    return j[np.arange(len(j)), log.argmax(1)]
