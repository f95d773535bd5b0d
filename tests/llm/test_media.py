import hashlib
import random
import struct
import zlib

from loomtext.llm.media import box, full, media_columns, parse, read_payload, store, stored_texts


def padded(data):
    return data + bytes(-len(data) % 64 if data else 64)


def test_exact_round_trip_and_keyframes():
    rnd = random.Random(1)
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 5000, 300_000):
        payload = padded(rnd.randbytes(n))
        file = store(payload)
        (track,) = parse(file)
        assert read_payload(file, track) == payload and (track.codec, track.handler) == ("raw", "vide")
        assert track.duration == len(payload) // 64
        assert [file[a:b] for a, b in track.ranges()] == [payload[i : i + 64] for i in range(0, len(payload), 1024)]


def test_foreign_tables():
    """Sizes by sample, 64-bit offsets, several chunk runs, no stss, a wide box, a box to the end."""
    sizes, groups = [5, 7, 11, 13, 17], [2, 1, 2]
    body = bytes(range(53))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 60) + body[:12] + b"gap" + body[12:23] + b"gap?" + body[23:]
    base = 16
    chunks = [base, base + 15, base + 30]
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(20))), full(b"stsz", struct.pack(">II", 0, 5), struct.pack(">5I", *sizes)), full(b"co64", struct.pack(">I", 3), struct.pack(">3Q", *chunks)), full(b"stsc", struct.pack(">I", 3), struct.pack(">9I", 1, 2, 1, 2, 1, 1, 3, 2, 1)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQI", 0, 0, 90000, 180000, 0), version=1), full(b"hdlr", struct.pack(">I4s", 0, b"vide")), box(b"minf", stbl))
    moov = box(b"moov", box(b"trak", mdia))
    file = mdat + struct.pack(">I", 0) + moov[4:]
    (track,) = parse(file)
    assert (track.codec, track.timescale, track.duration) == ("avc1", 90000, 180000)
    assert read_payload(file, track) == body and len(track.ranges()) == 5
    assert [b - a for a, b in track.ranges()] == sizes and len(groups) == 3


def test_broken_files():
    file = store(bytes(4096))
    for n in (0, 3, 8, 40, 200, 400, 600):
        parse(file[:n])
    assert parse(b"not a container at all, just text") == []
    rnd = random.Random(2)
    for _ in range(300):
        bad = bytearray(file)
        for _ in range(5):
            bad[rnd.randrange(700)] = rnd.randrange(256)
        for t in parse(bytes(bad)):
            assert len(t.sizes) < 1 << 33


def test_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "é" * 50, 0), (3, "é" * 50, 0), (None, "x" * 2_000_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, codec int")
    got = stored_texts(df).collect()
    assert len(got) == 5
    for r, (i, text, _) in zip(got, rows):
        data = (text or "").encode()
        pay = padded(data)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(store(pay)), hashlib.sha256(store(pay)).hexdigest())
    assert got[2][1:] == got[3][1:] and got[0][1:] == got[1][1:] and stored_texts(df.limit(0)).count() == 0
    files = spark.createDataFrame([(1, bytearray(store(bytes(2048)))), (2, bytearray(b"zz")), (3, None)], "id long, data binary")
    a, b, c = media_columns(files, "id", "data").collect()
    assert a.codec == "raw" and a.seconds == 32 / 25 and len(a.keyframes) == 2 and b.codec is c.codec is None


def test_deeply_nested_boxes_end_in_no_error():
    from loomtext.llm.media import box

    file = b""
    for _ in range(3000):
        file = box(b"moov", file)
    assert parse(file) == []
