import hashlib
import json
import random
import struct
import zlib
from collections import Counter
from contextlib import suppress

import pytest
from brindle.llm.media import _box, _full, boxes, demux, digests, mux, parse, probe, stored


@pytest.mark.parametrize("n", [1, 64, 4095, 4096, 4097, 16384, 16385, 40_000, 200_001])
def test_round_trip(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    data = mux(payload)
    (track,) = parse(data)
    assert (track.codec, track.kind, track.timescale, track.duration) == ("raw ", "soun", 8000, n)
    assert demux(data, track) == payload and track.sizes.sum() == n
    assert track.times.tolist() == list(range(0, n, 4096))
    for k, (start, length) in enumerate(track.key_ranges()):
        assert data[start : start + length] == payload[k * 8 * 4096 :][:length]


def test_other_forms_of_the_tables():
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = _box(b"stbl", _full(b"stsd", u32(1) + _box(b"avc1", bytes(78))), _full(b"stts", u32(2, 3, 10, 2, 5)), _full(b"stsc", u32(2, 1, 2, 1, 2, 1, 1)), _full(b"stz2", bytes(3) + bytes([4]) + u32(5) + bytes([0x12, 0x34, 0x50])), _full(b"stco", u32(4, 1000, 2000, 3000, 4000)))
    mdhd, hdlr = _full(b"mdhd", u32(0, 0, 600, 40, 0)), _full(b"hdlr", u32(0) + b"vide" + bytes(13))
    moov = _box(b"moov", _box(b"trak", _box(b"mdia", mdhd, hdlr, _box(b"minf", stbl))))
    (track,) = parse(_box(b"free", b"x") + moov + struct.pack(">I4s", 0, b"mdat") + b"payload" * 600)
    assert (track.codec, track.kind, track.seconds) == ("avc1", "vide", 40 / 600)
    assert track.sizes.tolist() == [1, 2, 3, 4, 5] and track.offsets.tolist() == [1000, 1001, 2000, 3000, 4000]
    assert track.times.tolist() == [0, 10, 20, 30, 35] and track.key.all()


def fragmented():
    """Two fragments of three and two samples; the first of each is a key frame."""
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = _box(b"stbl", _full(b"stsd", u32(1) + _box(b"avc1", bytes(78))), _full(b"stts", u32(0)), _full(b"stsc", u32(0)), _full(b"stsz", u32(0, 0)), _full(b"stco", u32(0)))
    mdhd, hdlr = _full(b"mdhd", u32(0, 0, 600, 0, 0)), _full(b"hdlr", u32(0) + b"vide" + bytes(13))
    tkhd = _full(b"tkhd", u32(0, 0, 7, 0, 0) + bytes(60))
    moov = _box(b"moov", _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, _box(b"minf", stbl))), _box(b"mvex", _full(b"trex", u32(7, 1, 20, 5, 0x10000))))
    out = moov
    for sizes, clock in (((4, 5, 6), 0), ((3, 2), 60)):
        def moof(at, sizes=sizes, clock=clock):
            trun = _full(b"trun", struct.pack(">IiI", len(sizes), at, 0) + u32(*sizes), flags=0x205)
            return _box(b"moof", _full(b"mfhd", u32(1)), _box(b"traf", _full(b"tfhd", u32(7), flags=0x20000), _full(b"tfdt", u32(clock)), trun))

        out += moof(len(moof(0)) + 8) + _box(b"mdat", bytes(range(sum(sizes))))
    return out


def test_fragments():
    data = fragmented()
    (track,) = parse(data)
    assert (track.codec, track.sizes.tolist(), track.key.tolist()) == ("avc1", [4, 5, 6, 3, 2], [True, False, False, True, False])
    assert track.times.tolist() == [0, 20, 40, 60, 80] and track.seconds == 100 / 600
    assert [data[o : o + n] for o, n in zip(track.offsets, track.sizes, strict=True)] == [bytes(range(4)), bytes(range(4, 9)), bytes(range(9, 15)), bytes(range(3)), bytes([3, 4])]


@pytest.mark.parametrize("data", [mux(bytes(50_000)), fragmented()])
def test_broken_files_are_value_errors(data):
    rng = random.Random(1)
    heads = data[:1200]
    for at in [*range(0, len(heads), 3), *(rng.randrange(len(data)) for _ in range(100))]:
        with suppress(ValueError):
            parse(data[:at])
    for _ in range(4000):
        broken = bytearray(data)
        for _ in range(rng.choice((1, 1, 2, 5))):
            broken[rng.randrange(len(heads))] = rng.choice((0, 1, 255, rng.randrange(256)))
        with suppress(ValueError):
            parse(bytes(broken))


def test_probe(spark):
    files = spark.createDataFrame([("a", bytearray(mux(b"x" * 9000))), ("b", bytearray(b"\0\0\0\5moov")), ("c", None), ("d", bytearray())], "path string, content binary")
    rows = {r["path"]: r for r in probe(files).collect()}
    assert rows["a"]["codec"] == "raw " and rows["a"]["samples"] == 3 and rows["a"]["duration"] == 9000 / 8000
    assert [tuple(k) for k in rows["a"]["keyframes"]] == parse(mux(b"x" * 9000))[0].key_ranges()
    assert rows["b"]["error"] and rows["b"]["track"] is None and rows["c"]["error"] is None and rows["d"]["track"] is None
    with pytest.raises(ValueError):
        list(boxes(memoryview(b"\0\0\0\x50free"), 0, 8))


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_digests(frame, corpus, request):
    rows = digests(stored(request.getfixturevalue(frame))).collect()
    expected, media = Counter(), {}
    for doc_id, text, *_ in corpus:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        expected[doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
        media[doc_id, len(raw)] = mux(payload)
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == expected
    for r in rows:
        if r["doc_id"] not in (5, 7, None):
            data = media[r["doc_id"], r["n_bytes"]]
            assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert json.loads(r["feature"])[0]["codec"] == "raw "


def test_empty(empty):
    assert digests(stored(empty)).collect() == []
