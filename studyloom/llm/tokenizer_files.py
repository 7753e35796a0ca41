"""Encoding whole texts with the tokenizers and sentencepiece libraries, at corpus speed.

A text is cut only at ASCII white space, where the vocabulary files at hand cut as well, so
that each piece can be encoded once per worker and looked up afterwards. Whether a file
allows that is read from the file (`separable`); where it does not, whole texts go to the
library.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
from collections.abc import Iterable

from .common import memory

#: Pieces that a worker remembers before it starts a new cache; it keeps the last one beside it.
CACHE_PIECES = 700_000
#: ASCII punctuation but the apostrophe, which may begin a suffix like 's.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_alphabet() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the
    others for 256, 257 and so on in turn."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


ALPHABET = byte_alphabet()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Digest of the vocabulary file's bytes and of the library's version: the tokenizer's version."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{lib.__name__}|{lib.__version__}".encode()).hexdigest()


class PieceEncoder:
    """ids(texts) gives each text's ids as little-endian bytes of `dtype`."""

    def __init__(self, path: str) -> None:
        import numpy as np

        self.special: list[bytes] = []
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.raw, self.separable, self.vocab = lib.encode, False, lib.get_piece_size()
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            lib = Tokenizer.from_file(path)
            lib.no_truncation()
            lib.no_padding()
            self.raw = lambda texts: [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
            self.vocab = lib.get_vocab_size(with_added_tokens=True)
            self.special = [a["content"].encode("utf-8").lower() for a in spec.get("added_tokens") or []]
            self.separable = lower_and_space(spec)
            self.model = lib.model
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.separable:
            return [self._pack(x) for x in self.raw(texts)] if texts else []
        # A text with a special string goes to the library as it is; lower-casing could make or break one.
        lower = [t.encode("utf-8").lower() for t in texts]
        pieces = [None if any(s in b for s in self.special) else b.split() for b in lower]
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        self._learn(set().union(*filter(None, pieces)).difference(self.cache))
        get, out = self.cache.__getitem__, []
        for t, own in zip(texts, pieces, strict=True):
            out.append(self._pack(self.raw([t])[0]) if own is None else b"".join(map(get, own)))
        return out

    def _learn(self, missing: set[bytes]) -> None:
        cache, older, parts, rest = self.cache, self.older, [], []

        def look(pieces: Iterable[bytes], whole: bool) -> None:
            for p in pieces:
                if p in older:
                    cache[p] = older[p]
                elif p.isalpha():  # ASCII letters, small ones by now
                    cache[p] = self._word(p.decode("ascii"))
                elif whole or (stem := p.rstrip(MARKS)) == p or not stem or not last_char(stem).lower().isalpha():
                    rest.append(p)
                else:
                    # Punctuation at the end, after what stays a letter in lower case, is a token run of its own.
                    parts.append((p, stem, p[len(stem) :]))

        look(missing, False)
        look({x for _, *two in parts for x in two}.difference(cache, rest), True)
        odd = []
        for p in rest:
            text = p.decode("utf-8")
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                cache[p] = self._word(p.decode("latin-1").translate(ALPHABET))
            else:
                odd.append((p, text))
        for (p, _), ids in zip(odd, self.raw([t for _, t in odd]) if odd else [], strict=True):
            cache[p] = self._pack(ids)
        for p, a, b in parts:
            cache[p] = cache[a] + cache[b]

    def _word(self, text: str) -> bytes:
        """One run of small letters passes the library's first steps unchanged, up to the byte alphabet."""
        return self._pack([k.id for k in self.model.tokenize(text)])


def last_char(p: bytes) -> str:
    k = len(p) - 1
    while k and 0x80 <= p[k] < 0xC0:
        k -= 1
    return p[k:].decode("utf-8")


def lower_and_space(spec: dict) -> bool:
    """True for a file that lower-cases, folds white space and splits words before merging, and drops the space."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [s.get("type") for s in normal.get("normalizers", [])]
    first, *rest = pre.get("pretokenizers") or [{}]
    if [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] != [("ByteLevel", False, False)]:
        return False
    return steps == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and bool(first.get("invert")) and not (spec.get("post_processor") or {})


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    loaded = memory("pieces")
    if path not in loaded:
        loaded[path] = PieceEncoder(path)
    return loaded[path]
