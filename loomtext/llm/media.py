"""ISO media containers: boxes and sample tables, without decoding payloads.

``parse`` walks the nested boxes of a file (32- and 64-bit sizes, a last box to
the end of the file), decodes the sample tables of each track and gives codec,
duration and the byte ranges of keyframes. ``store`` writes a payload into such
a file as a track of uncompressed 8-bit frames of 64 bytes, 16 to a chunk, each
chunk beginning with a keyframe; ``read_payload`` reads it back through the
sample tables.

Defined results: a null or empty text is a payload of 64 zero bytes; bytes that
are no container give a null codec and no ranges; a box that runs past its
parent ends there; equal inputs give equal files and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.rows import map_slices

FRAME = 64
GROUP = 16
TIMESCALE = 25
#: Boxes of a path that are kept; containers of tracks nest less deep.
PATH = 16
#: Boxes that hold boxes, with the bytes before their children.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"moof": 0, b"traf": 0, b"mvex": 0}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes) -> bytes:
    """The container of a payload whose length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // GROUP)
    firsts = (np.arange(0, n, GROUP) + 1).astype(">u4")
    runs = [(1, GROUP)] if n % GROUP == 0 or chunks == 1 else [(1, GROUP), (chunks, n % GROUP)]
    if chunks == 1:
        runs = [(1, n)]
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIII", 8, 8, 0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))

    def moov(base: int, wide: bool) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * FRAME * GROUP
        where = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)), full(b"stss", struct.pack(">I", len(firsts)), firsts.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, k, 1) for a, k in runs)), full(b"stsz", struct.pack(">II", FRAME, n)), where,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        mdia = box(b"mdia", mdhd, full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = len(payload) >= 1 << 31
    head = moov(0, wide)
    data = box(b"mdat", payload)
    return ftyp + moov(len(ftyp) + len(head) + len(data) - len(payload), wide) + data


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of the bodies of all boxes, parents first, however deep
    they nest; a path names at most the box and the PATH - 1 boxes around it."""
    open_ = [(start, end, ())]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        stop = end if size == 0 else min(end, start + size)
        if size and size < head:
            continue
        inner = (*path[-PATH + 1 :], kind)
        yield inner, start + head, stop
        open_.append((stop, end, path))
        if kind in CONTAINERS:
            open_.append((start + head + CONTAINERS[kind], stop, inner))


def _table(data: memoryview, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    """Rows of a counted table whose count is at ``at``."""
    width = int(kind[-1]) * columns
    n = min(struct.unpack_from(">I", data, at)[0], max(0, end - at - 4) // width)
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    keys: np.ndarray | None = None

    def ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keys].tolist(), (self.offsets + self.sizes)[self.keys].tolist()))


def _track(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> Track:
    out = Track()
    if b"mdhd" in boxes:
        at, _ = boxes[b"mdhd"]
        wide = data[at] == 1
        out.timescale, out.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
    if b"hdlr" in boxes:
        out.handler = bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1")
    if b"stsd" in boxes:
        at, end = boxes[b"stsd"]
        out.codec = bytes(data[at + 12 : min(end, at + 16)]).decode("latin-1").strip()
    sizes = np.zeros(0, np.int64)
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(min(n, len(data) // fixed), fixed, np.int64) if fixed else _table(data, at + 8, end, 1)[:, 0]
    chunks = np.zeros(0, np.int64)
    for kind, word in ((b"stco", ">u4"), (b"co64", ">u8")):
        if kind in boxes:
            chunks = _table(data, boxes[kind][0] + 4, boxes[kind][1], 1, word)[:, 0]
    runs = _table(data, boxes[b"stsc"][0] + 4, boxes[b"stsc"][1], 3) if b"stsc" in boxes else np.zeros((0, 3), np.int64)
    per = np.zeros(len(chunks), np.int64)
    for first, many, _ in runs.tolist():
        per[max(0, first - 1) :] = many
    per = np.diff(np.minimum(np.cumsum(np.r_[0, np.minimum(per, len(sizes))]), len(sizes)))
    chunk = np.repeat(np.arange(len(chunks)), per)
    sizes = sizes[: len(chunk)]
    before = np.cumsum(sizes) - sizes
    first = np.r_[True, chunk[1:] != chunk[:-1]] if len(chunk) else np.zeros(0, bool)
    out.offsets = chunks[chunk] + before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(chunk)])) if len(chunk) else sizes
    out.sizes = sizes
    keys = _table(data, boxes[b"stss"][0] + 4, boxes[b"stss"][1], 1)[:, 0] - 1 if b"stss" in boxes else np.arange(len(sizes))
    out.keys = keys[(keys >= 0) & (keys < len(sizes))]
    return out


def parse(file: bytes) -> list[Track]:
    """The tracks of a file; none if it is no container or is cut in a table's head."""
    data, tracks, boxes = memoryview(file), [], None
    try:
        for path, start, end in walk(data, 0, len(data)):
            if path[-1] == b"trak":
                if boxes is not None:
                    tracks.append(_track(data, boxes))
                boxes = {}
            elif boxes is not None and b"trak" in path:
                boxes[path[-1]] = (start, end)
        if boxes is not None:
            tracks.append(_track(data, boxes))
    except (struct.error, IndexError, ValueError):
        return []
    return tracks


def read_payload(file: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in order."""
    a, b = track.offsets, track.offsets + track.sizes
    cut = np.flatnonzero(np.r_[True, a[1:] != b[:-1]]) if len(a) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(a)] if len(a) else cut
    return b"".join(file[a[i] : b[j - 1]] for i, j in zip(cut.tolist(), ends.tolist()))


def feature_of(track: Track) -> str:
    ranges = track.ranges()
    shown = ",".join(f"{a}-{b}" for a, b in ranges)
    return f"codec={track.codec};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(ranges)};ranges={shown}"


def media_columns(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, codec, handler, seconds, samples, keyframes) of the first track with
    samples of each file; a null or other file has null codec and no keyframes."""

    def make():
        def run(ids, blobs):
            cols = {c: [] for c in (id_col, "codec", "handler", "seconds", "samples", "keyframes")}
            for key, blob in zip(ids, blobs):
                track = next((t for t in parse(blob or b"") if len(t.sizes)), None)
                cols[id_col].append(key)
                cols["codec"].append(track and track.codec)
                cols["handler"].append(track and track.handler)
                cols["seconds"].append(track.duration / track.timescale if track and track.timescale else None)
                cols["samples"].append(len(track.sizes) if track else 0)
                cols["keyframes"].append([{"start": a, "end": b} for a, b in track.ranges()] if track else [])
            return cols

        return run

    kind = files.schema[id_col].dataType.simpleString()
    return map_slices(files.select(id_col, data_col), make, f"`{id_col}` {kind}, codec string, handler string, seconds double, samples long, keyframes array<struct<start:bigint,end:bigint>>")


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a container, and what is read back from it."""

    def make():
        def run(ids, texts):
            cols = {c: [] for c in (id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "n_keyframes")}
            for key, data in zip(ids, texts):
                data = data or b""
                file = store(data + bytes(-len(data) % FRAME if data else FRAME))
                track = parse(file)[0]
                back = read_payload(file, track)
                row = (key, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(track), track.codec, track.duration / track.timescale, len(track.keys))
                for name, value in zip(cols, row):
                    cols[name].append(value)
            return cols

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, n_keyframes long"
    return map_slices(docs.select(id_col, F.col(text_col).cast("binary")), make, schema)
