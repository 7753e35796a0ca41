import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from common import awkward, frame
from tokenizers import Tokenizer

from studyloom.llm import byte_bpe, rans, token_counts, token_files
from studyloom.llm.common import scratch
from studyloom.llm.tokenizer_files import PieceEncoder

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["<|endoftext|>a b", "x<|startoftext|>", "<|ENDOFTEXT|>", "it's don't, 'll.", "a.İ*", "Σς. éÉ,", "é, x", "\x1cA\x85b", "a" * 3000]


def library(texts):
    t = Tokenizer.from_file(WORD)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_equal_library():
    rng = random.Random(4)
    parts = ["abc THE ", "éàüß ", "'s 're", ".,!?%", "日本 Σς ", "0123 ", "\n\t\x0b ", "İ ı K "]
    texts = ODD + ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    enc = PieceEncoder(WORD)
    assert enc.separable
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.ids(texts)] == library(texts)


def test_sentencepiece_whole_texts():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = PieceEncoder(path)
    texts = ["", "Hello  World", "é 日本 <s>"]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.ids(texts)] == lib.encode(texts)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 40_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint16)
    table = rans.Table.scaled(np.bincount(ids, minlength=3000))
    coded = rans.encode_blocks([ids, ids[: n // 3], ids[:0]], table)
    assert [x.tolist() for x in rans.decode_blocks(coded, table)] == [ids.tolist(), ids[: n // 3].tolist(), []]
    again = rans.Table.load(table.dump())
    block = rans.Block(coded[0], again)
    for k in range(len(block.crcs)):  # a checkpoint suffices
        own = rans.decode_segments([(block, k)], again)[0]
        assert own.tolist() == ids[k * 64 * 256 : (k + 1) * 64 * 256].tolist()


def test_rans_detects_damage():
    ids = np.arange(5000) % 50
    table = rans.Table.scaled(np.bincount(ids))
    coded = bytearray(rans.encode_blocks([ids], table)[0])
    coded[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks([bytes(coded)], table)


def test_token_files(spark):
    rows = awkward()
    out = scratch(spark, "test-files")
    token_files.write_token_files(frame(spark, rows), out, WORD, 2)
    got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r["start"])
    wanted = Counter((i, tuple(x + [2])) for (i, _), x in zip(rows, library([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == wanted
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_token_files_of_nothing(spark):
    out = scratch(spark, "test-files")
    token_files.write_token_files(frame(spark, []), out, WORD, 2)
    assert token_files.read_token_files(spark, out).count() == 0


def test_token_counts_and_cache(spark):
    rows, cache = awkward(), scratch(spark, "test-cache")
    texts = [(100 + k, t) for k, t in enumerate(ODD)]
    rows = rows + texts
    got = token_counts.count_tokens(frame(spark, rows), cache, WORD, limit=50).collect()
    counts = [len(x) for x in library([t for _, t in rows])]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter((i, len((t or "").encode()), n, n > 50) for (i, t), n in zip(rows, counts, strict=True))
    stored = spark.read.parquet(cache).count()
    assert stored == spark.read.parquet(cache).select("content_digest").distinct().count() < len(rows)
    more = frame(spark, [*rows, (500, "quite new")])
    assert token_counts.count_tokens(more, cache, WORD).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_counts.count_tokens(frame(spark, []), scratch(spark, "test-cache"), WORD).count() == 0


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_merges():
    rng, own, lib = random.Random(9), byte_bpe.Ranks(RANKS, P.PATTERN), encoding()
    parts = ["ab ", "the aou", "0123.", "éàüß日本", "aaaa", "=-*", "xyz\n\t ", "ing tion "]
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 40)))
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_byte_bpe_query_shape(spark):
    rows, lib = awkward(), encoding()
    got = byte_bpe.encode_digests(frame(spark, rows), RANKS).collect()
    ids = [lib.encode_ordinary(t or "") for _, t in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter(map(tuple, got)) == Counter((i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for (i, t), x in zip(rows, ids, strict=True))
    whole = byte_bpe.encode_decode(frame(spark, rows), RANKS).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in whole) == Counter((i, tuple(x), (t or "").encode()) for (i, t), x in zip(rows, ids, strict=True))
    assert byte_bpe.encode_digests(frame(spark, []), RANKS).count() == 0


def test_a_worker_remembers_one_owner():
    from studyloom.llm.common import memory
    from studyloom.llm.words import word_hashes

    first = word_hashes("Some words, some more").tolist()
    assert memory("words")
    memory("ranks")["x"] = 1
    assert not memory("words") and not memory("ranks")
    assert word_hashes("some WORDS, some more").tolist() == first


def test_blocks_of_a_group_do_not_touch_each_other():
    """A block's bytes are the same alone and beside longer and shorter ones."""
    import numpy as np

    from studyloom.llm import rans

    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 300, n) for n in (0, 1, 63, 64, 65, 16384, 16385, 40000)] * 3
    table = rans.Table.scaled(np.bincount(np.concatenate(blocks)))
    coded = rans.encode_blocks(blocks, table)
    assert coded == [rans.encode_blocks([b], table)[0] for b in blocks]
    assert all((x == b).all() for x, b in zip(rans.decode_blocks(coded, table), blocks, strict=True))
