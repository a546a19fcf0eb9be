"""Media columns: ISO base media files. Walks nested boxes and decodes sample tables, never payloads.

probe() reads the header boxes of a file and gives for each track its codec, duration and sample places, among
them the byte ranges of key frames. mux() stores bytes losslessly as the samples of one track, so that a
payload can be carried as a media column and be found again by the sample tables alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes, by ISO/IEC 14496-12: fixed names of the format.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"}
SAMPLE_BYTES, CHUNK_SAMPLES, KEY_EVERY, RATE, UNIT = 4096, 4, 8, 8000, 64


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    number: int = 0
    ends: int = 0

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        """First byte and length of each key frame."""
        return list(zip(self.offsets[self.key].tolist(), self.sizes[self.key].tolist(), strict=True))


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the content of each box from at to end."""
    while at < end:
        if at + 8 > end:
            raise ValueError(f"a box's head at {at} is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box's 64-bit size is cut off")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has a size of {size}")
        if kind == b"uuid":
            head += 16
        yield kind, min(at + head, at + size), at + size
        at += size


class Content:
    """What a box holds; reading beyond its end is a ValueError."""

    def __init__(self, data: memoryview, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def take(self, form: str, at: int) -> tuple:
        if at < 0 or self.at + at + struct.calcsize(form) > self.end:
            raise ValueError(f"a table at {self.at} is cut off")
        return struct.unpack_from(form, self.data, self.at + at)

    def u32(self, at: int) -> int:
        return self.take(">I", at)[0]

    def table(self, at: int, kind: str, columns: int, entries: int) -> np.ndarray:
        if self.at + at + columns * entries * np.dtype(kind).itemsize > self.end:
            raise ValueError(f"a table at {self.at} has {entries} entries and no room for them")
        return np.frombuffer(self.data, kind, columns * entries, self.at + at).astype(np.int64).reshape(entries, columns)


def _sizes(found: dict[bytes, Content], length: int) -> np.ndarray | None:
    if box := found.get(b"stsz"):
        same, n = box.u32(4), box.u32(8)
        if not same:
            return box.table(12, ">u4", 1, n)[:, 0]
        if same * n > length:
            raise ValueError(f"{n} samples of {same} bytes are more than the file holds")
        return np.full(n, same, np.int64)
    if box := found.get(b"stz2"):
        bits, n = box.take(">B", 7)[0], box.u32(8)
        if bits == 4:
            pairs = box.table(12, "u1", 1, (n + 1) // 2)[:, 0]
            return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n]
        if bits not in (8, 16):
            raise ValueError(f"sample sizes of {bits} bits")
        return box.table(12, f">u{bits // 8}", 1, n)[:, 0]
    return None


def _offsets(found: dict[bytes, Content], sizes: np.ndarray) -> np.ndarray:
    n = len(sizes)
    if box := found.get(b"co64"):
        chunks = box.table(8, ">u8", 1, box.u32(4))[:, 0]
    elif box := found.get(b"stco"):
        chunks = box.table(8, ">u4", 1, box.u32(4))[:, 0]
    else:
        chunks = np.zeros(0, np.int64)
    if not n:
        return chunks[:0]
    if not len(chunks) or b"stsc" not in found:
        raise ValueError("samples without chunks")
    runs = found[b"stsc"].table(8, ">u4", 3, found[b"stsc"].u32(4))
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if not len(runs) or runs[0, 0] != 1 or (spans < 0).any():
        raise ValueError("chunks out of order")
    per_chunk = np.minimum(np.repeat(runs[:, 1], spans), n)  # no chunk holds more than all
    counts = np.clip(n - (np.cumsum(per_chunk) - per_chunk), 0, per_chunk)
    if counts.sum() != n:
        raise ValueError("chunks and samples differ in number")
    of, before = np.repeat(np.arange(len(chunks)), counts), np.cumsum(sizes) - sizes
    first = np.searchsorted(of, np.arange(len(chunks)))
    return chunks[of] + before - before[np.minimum(first, n - 1)][of]


def _sample_table(found: dict[bytes, Content], track: Track, length: int) -> None:
    if (box := found.get(b"stsd")) and box.u32(4):
        track.codec = box.take("4s", 12)[0].decode("latin-1")
    sizes = _sizes(found, length)
    if sizes is None:
        return
    n, track.sizes, track.offsets = len(sizes), sizes, _offsets(found, sizes)
    if n and (track.offsets.min() < 0 or (track.offsets + sizes).max() > length):
        raise ValueError("samples lie beyond the end of the file")
    if box := found.get(b"stts"):
        steps = box.table(8, ">u4", 2, box.u32(4))
        if steps[:, 0].sum() != n:
            raise ValueError("times and samples differ in number")
        deltas = np.repeat(steps[:, 1], steps[:, 0])
        track.times = np.cumsum(deltas) - deltas
        track.ends = int(deltas.sum())
    track.key = np.ones(n, bool)
    if box := found.get(b"stss"):  # without it every sample is a key frame
        keys = box.table(8, ">u4", 1, box.u32(4))[:, 0]
        if len(keys) and (keys.min() < 1 or keys.max() > n):
            raise ValueError("a key frame's number is no sample's")
        track.key = np.zeros(n, bool)
        track.key[keys - 1] = True


def _within(data: memoryview, at: int, end: int) -> dict[bytes, Content]:
    """The first box of each name in a container and the containers in it."""
    found, stack = {}, [(at, end)]
    while stack:
        for kind, a, b in boxes(data, *stack.pop()):
            if kind in CONTAINERS:
                stack.append((a, b))
            else:
                found.setdefault(kind, Content(data, a, b))
    return found


def _track(data: memoryview, at: int, end: int) -> Track:
    track, found = Track(), _within(data, at, end)
    if box := found.get(b"tkhd"):
        track.number = box.u32(20 if box.take(">B", 0)[0] == 1 else 12)
    if box := found.get(b"mdhd"):
        track.timescale, track.duration = box.take(">IQ", 20) if box.take(">B", 0)[0] == 1 else box.take(">II", 12)
    if box := found.get(b"hdlr"):
        track.kind = box.take("4s", 8)[0].decode("latin-1")
    _sample_table(found, track, len(data))
    return track


def _run(box: Content, start: int, defaults: tuple[int, int, int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, durations and flags of the samples of a track run (trun)."""
    flags, n = box.u32(0) & 0xFFFFFF, box.u32(4)
    at = 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4)
    present = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
    if n > length and not any(present):
        raise ValueError(f"a run of {n} samples is more than the file holds")
    table = box.table(at, ">u4", sum(present), n) if any(present) else np.zeros((n, 0), np.int64)
    columns = [table[:, sum(present[:i])] if there else np.full(n, default, np.int64) for i, (there, default) in enumerate(zip(present[:3], defaults, strict=True))]
    if flags & 4 and n and not present[2]:
        columns[2][0] = box.u32(8 + 4 * bool(flags & 1))
    durations, sizes, marks = columns
    if n and (start < 0 or start + int(sizes.sum()) > length):
        raise ValueError("samples of a fragment lie beyond the end of the file")
    return sizes, durations, marks


def _fragment(data: memoryview, start: int, at: int, end: int, tracks: dict[int, Track], extends: dict[int, tuple[int, int, int]]) -> None:
    """Adds the samples of a movie fragment (moof, which starts at start) to its tracks."""
    follows = start
    for kind, a, b in boxes(data, at, end):
        if kind != b"traf":
            continue
        parts = [(k, Content(data, x, y)) for k, x, y in boxes(data, a, b)]
        head = next((c for k, c in parts if k == b"tfhd"), None)
        if head is None or (track := tracks.get(head.u32(4))) is None:
            raise ValueError("a fragment of no track")
        flags, place = head.u32(0) & 0xFFFFFF, 8
        base = start if flags & 0x20000 else follows
        if flags & 1:
            base, place = head.take(">Q", 8)[0], 16
        place += 4 * bool(flags & 2)
        defaults = list(extends.get(track.number, (0, 0, 0)))
        for i, bit in enumerate((0x8, 0x10, 0x20)):
            if flags & bit:
                defaults[i], place = head.u32(place), place + 4
        clock = next((c.take(">Q", 4)[0] if c.take(">B", 0)[0] == 1 else c.u32(4) for k, c in parts if k == b"tfdt"), track.ends)
        follows = base
        for k, box in parts:
            if k != b"trun":
                continue
            first = base + box.take(">i", 8)[0] if box.u32(0) & 1 else follows
            sizes, durations, marks = _run(box, first, tuple(defaults), len(data))
            track.sizes = np.append(track.sizes, sizes)
            track.offsets = np.append(track.offsets, first + np.cumsum(sizes) - sizes)
            if clock + int(durations.sum()) >= 1 << 63:
                raise ValueError("a fragment's times are out of range")
            track.times = np.append(track.times, clock + np.cumsum(durations) - durations)
            track.key = np.append(track.key, marks & 0x10000 == 0)
            clock, follows = clock + int(durations.sum()), first + int(sizes.sum())
        track.ends = max(track.ends, clock)
        track.duration = max(track.duration, track.ends)


def parse(data: bytes) -> list[Track]:
    """The tracks of a file, with the samples of its fragments. Whatever is broken raises ValueError; a file without
    tracks has none. Tables are read only as far as the file's length allows what they say."""
    view = memoryview(data)
    try:
        top = list(boxes(view, 0, len(view)))
        movies = [(k, a, b) for kind, at, end in top if kind == b"moov" for k, a, b in boxes(view, at, end)]
        tracks = [_track(view, a, b) for k, a, b in movies if k == b"trak"]
        trex = [Content(view, x, y) for k, a, b in movies if k == b"mvex" for kind, x, y in boxes(view, a, b) if kind == b"trex"]
        extends = {c.u32(4): (c.u32(12), c.u32(16), c.u32(20)) for c in trex}
        for kind, at, end in top:
            if kind == b"moof":
                _fragment(view, at - 8, at, end, {t.number: t for t in tracks}, extends)
        return tracks
    except (struct.error, OverflowError, IndexError, TypeError, MemoryError) as e:
        raise ValueError(f"a box is broken: {e}") from e


def _box(kind: bytes, *parts: bytes) -> bytes:
    content = b"".join(parts)
    return struct.pack(">I4s", 8 + len(content), kind) + content


def _full(kind: bytes, content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), content)


def mux(payload: bytes) -> bytes:
    """An ISO media file with one track of unsigned 8-bit samples ("raw "): the payload's bytes, in samples of
    SAMPLE_BYTES, chunks of CHUNK_SAMPLES and a key frame every KEY_EVERY samples."""
    sizes = [min(SAMPLE_BYTES, len(payload) - a) for a in range(0, len(payload), SAMPLE_BYTES)]
    n, chunks = len(sizes), -(-len(sizes) // CHUNK_SAMPLES)
    keys = list(range(1, n + 1, KEY_EVERY))
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    last = sizes[-1]
    steps = [(n - 1, SAMPLE_BYTES), (1, last)] if n > 1 and last != SAMPLE_BYTES else [(n, sizes[0])]
    tail = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1), (chunks, tail, 1)] if chunks > 1 and tail != CHUNK_SAMPLES else [(1, min(n, CHUNK_SAMPLES), 1)]
    flat = lambda rows: b"".join(struct.pack(f">{len(r)}I", *r) for r in rows)

    def moov(offsets: list[int]) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1) + entry),
            _full(b"stts", struct.pack(">I", len(steps)) + flat(steps)),
            _full(b"stss", struct.pack(f">{len(keys) + 1}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)) + flat(runs)),
            _full(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), 1)
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun") + b"\0")
        matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0) + matrix + bytes(8), 1, 7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, len(payload), 0x10000, 0x100) + matrix + bytes(24) + struct.pack(">I", 2), 1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    start = len(ftyp) + len(moov([0] * chunks)) + 16
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return b"".join((ftyp, moov([start + c * CHUNK_SAMPLES * SAMPLE_BYTES for c in range(chunks)]), mdat, payload))


def demux(data: bytes, track: Track) -> bytes:
    """The samples' bytes, in order, by their places in the tables."""
    return b"".join(data[o : o + n] for o, n in zip(track.offsets.tolist(), track.sizes.tolist(), strict=True))


def feature(tracks: list[Track]) -> str:
    return json.dumps([{"codec": t.codec, "kind": t.kind, "duration": round(t.seconds, 6), "samples": len(t.sizes), "keyframes": t.key_ranges()} for t in tracks], separators=(",", ":"))


def probe(files: DataFrame, content_col: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per file and track: keep's columns, track, kind, codec, duration (seconds), samples,
    keyframes (array of start and length), error. A file without tracks has one row with a null track; so has
    one that is broken or null, with its error."""
    fields = "track int, kind string, codec string, duration double, samples long, keyframes array<struct<start:long,length:long>>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, content in enumerate(batch.column(batch.num_columns - 1)):
                try:
                    tracks, error = parse(content.as_py() or b""), None
                except ValueError as e:
                    tracks, error = [], str(e)
                for k, t in enumerate(tracks):
                    rows.append((k, t.kind, t.codec, t.seconds, len(t.sizes), [{"start": a, "length": n} for a, n in t.key_ranges()], None))
                if not tracks:
                    rows.append((None, None, None, None, None, None, error))
                index += [i] * max(1, len(tracks))
            kinds = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string())
            kept = [batch.column(k).take(pa.array(index, pa.int64())) for k in range(len(keep))]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[: len(keep)], *(f.split()[0] for f in ("track", "kind", "codec", "duration", "samples", "keyframes", "error"))])

    rows = files.select(*keep, F.col(content_col).alias("_content"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), fields]))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, payload length without padding and the media file that holds the text's bytes (null text: empty),
    padded by zeros to a positive multiple of UNIT. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [mux(b.ljust(max(UNIT, -(-len(b) // UNIT) * UNIT), b"\0")) for b in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {docs.select(id_col).dtypes[0][1]}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What stored() made, read back through the sample tables; a row for each, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(2):
                data = content.as_py()
                tracks = parse(data)
                payload = demux(data, tracks[0])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(tracks)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
