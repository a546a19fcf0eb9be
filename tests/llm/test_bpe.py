import hashlib
import random
import struct
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from brindle.llm.bpe import PerfectHash, coder, encode_decode, read_ranks

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(FILE), special_tokens={})


def test_perfect_hash():
    keys = {f"key{i}".encode(): i for i in range(3000)}
    table = PerfectHash(keys)
    assert table.n == len(keys) == len(set(table.values))
    assert all(table.get(k) == v for k, v in keys.items())
    assert table.get(b"stranger") == -1 and PerfectHash({b"a": 7}).get(b"a") == 7


def test_like_the_library(library):
    rng, bpe = random.Random(2), coder(FILE, P.PATTERN)
    kinds = (lambda: rng.randrange(32, 127), lambda: rng.randrange(0x300), lambda: rng.choice((9, 10, 32, 39, 0x1C, 0x85, 0xA0, 0x2028, 0x3000)), lambda: rng.randrange(0xE000, 0x110000), lambda: rng.randrange(0x500, 0xD000), lambda: rng.choice((0x558, 0x11DE3)))
    texts = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in [*texts, "", "a" * 50_000, " " * 20_000, "ab" * 20_000, "<|endoftext|>", "don't we'll 'S"]:
        packed = bpe.encode(text)
        assert library.encode_ordinary(text) == [i for (i,) in struct.iter_unpack("<I", packed)]
        assert bpe.decode(packed) == text.encode()


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_query(frame, corpus, library, request):
    expected = Counter()
    for doc_id, text, *_ in corpus:
        ids = library.encode_ordinary(text or "")
        expected[doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    rows = encode_decode(request.getfixturevalue(frame), FILE, P.PATTERN).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == expected
    assert all(bytes(r["decoded"]) == (coder(FILE, P.PATTERN).decode(bytes(r["ids"]))) for r in rows)


def test_empty(empty):
    assert encode_decode(empty, FILE, P.PATTERN).collect() == []
