"""Words of a text as 64-bit hashes, and arrays of integers packed for shuffles and tables."""

from __future__ import annotations

import numpy as np

from .common import memory

CACHE_WORDS = 300_000


def word_hashes(text: str) -> np.ndarray:
    """A-Z lower-cased, cut at ASCII white space; equal words have equal hashes. Different ones coincide with a
    probability of n*n / 2**65 among n words."""
    import xxhash

    words, known = text.encode("utf-8").lower().split(), memory("words")
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ZSTD: dict[str, object] = {}


def _zstd(kind: str):
    """This worker's compressor or decompressor: making one takes longer than using it on a short array."""
    import zstandard

    if kind not in _ZSTD:
        _ZSTD[kind] = zstandard.ZstdCompressor(level=1) if kind == "out" else zstandard.ZstdDecompressor()
    return _ZSTD[kind]


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers or floats as zstd-compressed byte planes; ascending ones as differences."""
    a = np.ascontiguousarray(values)
    if ascending and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return a.dtype.char.encode() + _zstd("out").compress(planes.tobytes())


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(data[:1].decode())
    planes = np.frombuffer(_zstd("in").decompress(data[1:]), np.uint8).reshape(dtype.itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if ascending else a
