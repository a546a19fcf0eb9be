import json
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from brindle.llm import sstable
from brindle.llm.common import shared_dir
from tokenizers import Tokenizer

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(corpus, library):
    ordered = sorted(corpus, key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode()))
    out, start = [], 0
    for doc_id, text, *_ in ordered:
        ids = [*library(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_written_and_read_back(frame, corpus, library, request, monkeypatch):
    found = sstable.token_table(request.getfixturevalue(frame), FILE, 2)
    assert Counter(map(tuple, found.collect())) == Counter(expected(corpus, library))


def test_lookup(docs, corpus, library):
    uri = f"{shared_dir(docs.sparkSession)}/lookup"
    shards = [(r, sstable.Shard(r["path"])) for r in sstable.write_tokens(docs, uri, FILE, 2).collect()]
    assert sum(s.docs for _, s in shards) == len(corpus)
    assert sum(s.ids for _, s in shards) == sum(r["ids"] for r, _ in shards)
    for doc_id in {r[0] for r in corpus}:
        own = sorted([*library(r[1]), 2] for r in corpus if r[0] == doc_id)
        assert sorted(ids.tolist() for _, s in shards for ids in s.get(doc_id)) == own
    assert not any(s.get(i) for _, s in shards for i in (10**9, -(2**63), 2**63 - 1))


def test_many_blocks_and_varints(tmp_path):
    writer = sstable.ShardWriter(f"{tmp_path}/one.sst", 4)
    values = {i * 3: np.arange(i % 50, dtype="<u4") for i in range(-3000, 3000)}
    for doc_id, ids in values.items():
        writer.add(sstable.identifier_key(doc_id) + bytes(4), ids.tobytes())
    writer.close()
    shard = sstable.Shard(f"{tmp_path}/one.sst")
    assert len(shard.blocks) > 5 and [sstable.identifier(k) for k, _ in shard.items()] == list(values)
    for doc_id in range(-9100, 9100, 7):
        found = shard.get(doc_id)
        assert [f.tolist() for f in found] == ([values[doc_id].tolist()] if doc_id in values else [])
    assert sum(sstable.identifier_key(i) in shard.bloom for i in range(1, 30_000, 3)) < 500
    with pytest.raises(ValueError):
        (tmp_path / "other").write_bytes(b"x" * 100)
        sstable.Shard(f"{tmp_path}/other")


def test_word_by_word_is_the_library(library):
    texts = ["a b", " a", "a ", " ", "", "a\nb c\n", "\na", "a\x1cb c", "a\0 b", "don't <|endoftext|> x", "end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", " <|endoftext|>\n<|endof text|>", "a  b", "a \nb", "日本 é\nü"]
    words = sstable.encoder(FILE)
    assert [np.frombuffer(x, f"<u{words.width}").tolist() for x in words.encode(texts)] == [library(t) for t in texts]


def test_texts_with_added_tokens(spark, library):
    rows = [(1, "end <|endoftext|> next"), (2, "<|endoftext|>"), (3, "plain words"), (4, "x<|endoftext|>. y")]
    found = sstable.token_table(spark.createDataFrame(rows, "doc_id long, text string"), FILE, 2).collect()
    assert Counter(map(tuple, found)) == Counter(expected(rows, library))
    assert library(rows[0][1]) == [437, 220, 50256, 1306]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    path = tmp_path / "other.json"
    path.write_text(json.dumps({**json.loads(open(FILE).read()), **change}))
    with pytest.raises(ValueError):
        sstable.WordEncoder(str(path))


def test_empty(empty):
    assert sstable.token_table(empty, FILE, 2).collect() == []
