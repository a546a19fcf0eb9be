"""Token ids as sorted-string tables: shards of documents in key order, looked up by binary search.

A shard holds data blocks, then a sparse index (first key, place and length of each block), a Bloom filter of the
document identifiers and a footer of fixed length. Within a block an entry keeps only what its key doesn't share
with the key before it; each block begins with a whole key. Numbers in entries are base-128 varints.

    entry   shared, unshared, value length (varints), key's rest, value
    key     null flag (1 byte), identifier (8 bytes, big-endian, sign bit flipped), ordinal of repeats (4 bytes)
    value   ids, little-endian, of 2 bytes if the vocabulary allows and of 4 otherwise
    footer  index at, index length, filter at, filter length, documents, ids (u64 each), hashes, width (u32), magic
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import by_words, shared_dir, written

MAGIC = b"BRINDSST"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES, SHARD_BYTES, BITS_PER_KEY, HASHES = 1 << 16, 1 << 26, 10, 7
#: Distinct words whose ids a worker keeps; beyond that it goes back to those of its last batch. Documents encoded at a time.
MEMO, BATCH = 800_000, 2000
#: Most ranges that ids are dealt into, and a size that Spark gives where it doesn't know.
MOST_RANGES, UNKNOWN = 1_000_000, 1 << 60
MANIFEST = "part int, seq int, path string, first_key binary, last_key binary, docs long, ids long"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow knows: file, hdfs, s3, gs."""
    return fs.FileSystem.from_uri(uri)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def identifier_key(doc_id: int | None) -> bytes:
    """Null ids come first, as Spark sorts them."""
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def identifier(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


class Bloom:
    def __init__(self, bits: np.ndarray, hashes: int = HASHES):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        bloom = cls(np.zeros(max(64, len(keys) * BITS_PER_KEY) // 8 + 1, np.uint8))
        for key in keys:
            for at in bloom._at(key):
                bloom.bits[at >> 3] |= 1 << (at & 7)
        return bloom

    def _at(self, key: bytes) -> list[int]:
        h, m = xxhash.xxh3_128_intdigest(key), len(self.bits) * 8
        return [((h & (1 << 64) - 1) + i * (h >> 64)) % m for i in range(self.hashes)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[at >> 3] & 1 << (at & 7) for at in self._at(key))


class ShardWriter:
    """Writes to a name of its own and moves the whole file to its final name: a task that runs again overwrites it
    with the same bytes, and a reader never sees half a file."""

    def __init__(self, uri: str, width: int):
        self.store, self.path = place(uri)
        self.temporary = f"{self.path}.{os.getpid()}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.out = self.store.open_output_stream(self.temporary)
        self.width, self.at, self.docs, self.ids = width, 0, 0, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.own = [], []
        self.start = b""

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.start = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first, self.last = self.first or key, key
        self.docs += 1
        self.ids += len(value) // self.width
        if not self.own or self.own[-1] != key[:9]:
            self.own.append(key[:9])

    def _end_block(self) -> None:
        self.index.append(_varint(len(self.start)) + self.start + _varint(self.at) + _varint(len(self.block)))
        self.out.write(bytes(self.block))
        self.at += len(self.block)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._end_block()
        index, bloom = b"".join(self.index), Bloom.of(self.own).bits.tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, HASHES, self.width, MAGIC))
        self.out.close()
        self.store.move(self.temporary, self.path)


class Shard:
    """Reads a shard: get() looks one identifier up, items() goes through all."""

    def __init__(self, uri: str):
        store, path = place(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.docs, self.ids, hashes, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.bloom = Bloom(np.frombuffer(self.file.read_at(bloom_n, bloom_at), np.uint8), hashes)
        index, at, self.keys, self.blocks = self.file.read_at(index_n, index_at), 0, [], []
        while at < index_n:
            n, at = _read_varint(index, at)
            self.keys.append(index[at : at + n])
            start, at = _read_varint(index, at + n)
            length, at = _read_varint(index, at)
            self.blocks.append((start, length))

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        start, length = self.blocks[block]
        data, at, key = self.file.read_at(length, start), 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def numbers(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of this identifier."""
        key = identifier_key(doc_id)
        if key not in self.bloom:
            return []
        found: list[np.ndarray] = []
        for block in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.blocks)):
            for own, value in self._entries(block):
                if own[:9] > key:
                    return found
                if own[:9] == key:
                    found.append(self.numbers(value))
        return found


#: What a tokenizer's file must say, so that its words are those of by_words().
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class WordEncoder:
    """Encodes with a byte-level Tokenizer of the tokenizers library, word by word as by_words() cuts texts; words met
    before are looked up. Texts that hold an added token ("<|endoftext|>") go to the library whole. Files of another
    pre-tokenizer, with a normalizer, or with a model other than plain BPE are refused (ValueError)."""

    ENDS = (".", ",")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        if told.get("normalizer") or any(pre.get(k) != v for k, v in PRE_TOKENIZER.items()) or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} is no tokenizer of byte-level BPE without prefix space and normalizer")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in told.get("added_tokens") or []) or r"(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.model = self.tokenizer.model
        self.kind = "H" if self.width == 2 else "I"
        # byte-level vocabularies: bytes that print stand for themselves, the others for characters from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in prints]
        self.visible = {b: 256 + i for i, b in enumerate(others)}
        self.memo: dict[str, bytes] = {}
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _look_up(self, words: list[str]) -> None:
        """A word of letters, behind a space or not, is one match of the pattern and goes to the model alone, its bytes
        as the characters that stand for them; all else takes the tokenizer's whole way."""
        memo, one, rest, kind, space = self.memo, self.model.tokenize, [], self.kind, chr(self.visible[32])
        for word in words:
            letters = word[1:] if word[:1] == " " else word
            if self.added.search(word) or not letters.isalpha() or not letters.isascii() and max(letters) >= "\u0250":
                rest.append(word)
                continue
            text = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.visible)
            found = one(text if letters is word else space + text)
            memo[word] = array(kind, [t.id for t in found]).tobytes()
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for word, found in zip(part, self.batch(part, add_special_tokens=False), strict=True):
                memo[word] = self._packed(found.ids)

    def _ids(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        missing = {w for w in words if w not in memo}
        # a full stop or comma after a letter is a token of its own
        ended = {w for w in missing if w[-1:] in self.ENDS and len(w) > 2 and w[-2] < "\u0250" and w[-2].isalpha()}
        stems = {w[:-1] for w in ended}.difference(memo)
        self._look_up(list((missing - ended) | stems | {e for e in self.ENDS if e not in memo}))
        for word in ended:
            memo[word] = memo[word[:-1]] + memo[word[-1]]
        out = list(map(memo.__getitem__, words))
        for word in missing:
            if len(word) > 64:
                del memo[word]
        if len(memo) > MEMO:  # what this batch had stays
            self.memo = {w: i for w, i in zip(words, out, strict=True) if len(w) <= 64}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return by_words(texts, self._ids, self.added)


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, uri: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below uri and returns the manifest, one row per shard, itself a written table.

    Rows are dealt by ranges of id_col and sorted, repeats of an id by their text; null ids come first. Null text
    is empty: its document is the end id alone. An empty table has no shards. Identifiers are whole numbers.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer_file)
    name = tokenizer_file.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = encoder(SparkFiles.get(name)), TaskContext.get().partitionId(), 0
        end, shard, last, repeat, rows = words._packed([end_id]), None, None, 0, []

        def done() -> None:
            shard.close()
            rows.append((part, seq, f"{uri}/shard-{part:06d}-{seq:04d}.sst", shard.first, shard.last, shard.docs, shard.ids))

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(texts), strict=True):
                    key = identifier_key(doc_id)
                    repeat = repeat + 1 if key == last else 0
                    if shard and shard.at >= SHARD_BYTES and not repeat:  # the repeats of an id share a shard
                        done()
                        shard, seq = None, seq + 1
                    if shard is None:
                        place(uri)[0].create_dir(place(uri)[1], recursive=True)
                        shard = ShardWriter(f"{uri}/shard-{part:06d}-{seq:04d}.sst", words.width)
                    shard.add(key + struct.pack(">I", repeat), ids + end)
                    last = key
        if shard:
            done()
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in MANIFEST.split(", ")])

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # as many ranges as the session shuffles into, or more where those would be larger than shards
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual, needed = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // SHARD_BYTES), MOST_RANGES)
    ranged = ordered.repartitionByRange(needed, "id") if size < UNKNOWN and needed > usual else ordered.repartitionByRange("id")
    return written(ranged.sortWithinPartitions("id", "text").mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "start")
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, rows = Shard(path), []
                for key, value in shard.items():
                    ids = shard.numbers(value).astype("<u4")
                    rows.append((identifier(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, n), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """Writes shards (in the shared folder, if no uri is given) and reads them back."""
    uri = uri or f"{shared_dir(docs.sparkSession)}/shards"
    return read_tokens(write_tokens(docs, uri, tokenizer_file, end_id, id_col, text_col)).withColumnRenamed("doc_id", id_col)
