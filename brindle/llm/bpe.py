"""Byte-level BPE by two tiers: a minimal perfect hash of the vocabulary, and merges by a heap over linked bytes.

A pre-token that is in the vocabulary as a whole is one lookup in the perfect hash. Any other is merged pair by
pair, lowest rank and then leftmost first, from a heap of candidate pairs over a linked list of its bytes, which
takes n log n steps for a pre-token of n bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose ids a worker keeps; beyond that it starts anew, so that its memory is bounded.
MEMO = 400_000


class PerfectHash:
    """A minimal perfect hash of byte strings: hash, displace and compress.

    Keys fall into buckets by one half of a keyed digest; each bucket, largest first, gets the first seed that
    sends its keys to free slots. There are as many slots as keys. A slot keeps its key, to tell strangers.
    """

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 3):
        n = max(1, len(ranks))
        self.n, self.buckets = n, -(-n // per_bucket)
        split: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ranks:
            first, second = self._halves(key)
            split[first % self.buckets].append((second, key))
        self.seeds, self.keys, self.values = [0] * self.buckets, [b""] * n, [-1] * n
        free = [True] * n
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(split[b])):
            own = split[b]
            if len(own) <= 1:
                singles += [(b, *own[0])] if own else []
                continue
            seed = 1
            while True:
                slots = {self._slot(second, seed) for second, _ in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for second, key in own:
                self._put(self._slot(second, seed), key, ranks[key], free)
        rest = (i for i in range(n) if free[i])
        for b, _, key in singles:  # a bucket of one key names its slot: seeds below zero
            slot = next(rest)
            self.seeds[b] = -slot - 1
            self.keys[slot], self.values[slot] = key, ranks[key]

    def _put(self, slot: int, key: bytes, value: int, free: list[bool]) -> None:
        self.keys[slot], self.values[slot], free[slot] = key, value, False

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int]:
        return struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())

    def _slot(self, second: int, seed: int) -> int:
        x = (second ^ seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 29) % self.n

    def get(self, key: bytes) -> int:
        """The key's rank, or -1."""
        first, second = self._halves(key)
        seed = self.seeds[first % self.buckets]
        slot = -seed - 1 if seed < 0 else self._slot(second, seed)
        return self.values[slot] if self.keys[slot] == key else -1


class ByteBPE:
    """Encodes as a rank file says, without special tokens; decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = PerfectHash(ranks)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # merges ask for the same pairs over and over: the pair of ranks is a quicker key than their bytes
        self.pairs: dict[tuple[int, int], int] = {}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.split = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.stand_in: dict[int, str] = {}
        self.seen: set[str] = {chr(c) for c in range(0x250)}

    def _pair(self, left: int, right: int) -> int:
        rank = self.pairs.get((left, right))
        if rank is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            rank = self.pairs[left, right] = self.whole.get(self.bytes_of[left] + self.bytes_of[right])
        return rank

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := self._pair(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one side has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self._pair(rank, ids[k])) >= 0:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := self._pair(ids[h], rank)) >= 0:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def _resolve(self, token: str) -> bytes:
        piece = token.encode()
        rank = self.whole.get(piece)
        ids = [rank] if rank >= 0 else self.merge(piece)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= 64:
            self.memo[token] = packed
        return packed

    def _pre_tokens(self, text: str) -> Iterator[str] | list[str]:
        """The pattern's matches. Where the regex module and the tiktoken library class a character differently
        (they follow different editions of Unicode), a stand-in of the library's class takes its place."""
        if not text.isascii() and (new := set(text) - self.seen):
            self.seen |= new
            for c in new:
                kind = _library_class(c)
                if kind != next((k for k, p in _CLASSES.items() if p.match(c)), "!"):
                    self.stand_in[ord(c)] = kind
        if self.stand_in and (other := text.translate(self.stand_in)) != text:
            return (text[m.start() : m.end()] for m in self.split.finditer(other))
        return self.split.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, resolve = self.memo, self._resolve
        return b"".join([memo.get(t) or resolve(t) for t in self._pre_tokens(text)])

    def decode(self, packed: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for (i,) in struct.iter_unpack("<I", packed)])


_CLASSES = {"a": regex.compile(r"\p{L}"), "1": regex.compile(r"\p{N}"), " ": regex.compile(r"\s")}


@cache
def _probes():
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    return [(kind, tiktoken.Encoding(p, pat_str=p, mergeable_ranks=single, special_tokens={})) for kind, p in (("a", r"\p{L}"), ("1", r"\p{N}"), (" ", r"\s"))]


def _library_class(c: str) -> str:
    return next((kind for kind, probe in _probes() if probe.encode_ordinary(c)), "!")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def coder(path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids (packed, little-endian unsigned 32-bit), decoded (bytes), and
    their SHA-256. Null and empty texts have no ids. With ids=False the digests alone. rank_file is a path on the
    driver, sent to the executors by Spark. Other columns are not read, nothing is shuffled."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]
    extra = [("ids", pa.binary()), ("decoded", pa.binary())] if ids else []
    schema = pa.schema([("n_tokens", pa.int64()), *extra, ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(SparkFiles.get(name), pattern)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                packed = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(packed)
                out.append((len(packed) // 4, *((packed, decoded) if ids else ()), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], [batch.schema.names[0], *schema.names])

    kind = docs.select(id_col).dtypes[0][1]
    fields = "n_tokens long, " + "ids binary, decoded binary, " * ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {fields}")
