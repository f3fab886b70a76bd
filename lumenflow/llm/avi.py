"""AVI motion-JPEG columns: write, parse, decode, and cut into timed clips.

A payload of 8-bit samples is stored as baseline greyscale JPEG frames inside
an AVI file. A frame carries ``WIDTH`` samples, each as one flat 8 x 8 block:
with a DC quantiser of 8 the DC coefficient is exactly the sample minus 128,
so baseline JPEG is lossless here and any decoder sees flat squares.

The Huffman table gives the category c of a DC difference a code of 9 - c bits
(a unary code, 8 for none to 1 for eight bits), so that code, difference and
end-of-block together always take 10 bits: frames with this table are packed
and unpacked as arrays. Other baseline frames (greyscale, or the luma of colour
ones; with restart markers; without Huffman tables, as motion JPEG has them)
go through a plain sequential decoder.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 192
FPS = 25
BINS = 16
HISTORY = 8
SIGMAS = 3.0
LEAST_CHANGE = 0.35
FLUSH = 4 << 20

_ZIGZAG = np.array([i for _, i in sorted(((y + x, (x if (y + x) % 2 == 0 else y)), 8 * y + x) for y in range(8) for x in range(8))])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: one code of each length from 1 to 9 bits: categories 8 down to 0
_DC_TABLE = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_AC_TABLE = bytes([1] + [0] * 15) + bytes([0])
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * WIDTH, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, b"\0" + _DC_TABLE)
    + _segment(0xC4, b"\x10" + _AC_TABLE)
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def _fields() -> tuple[np.ndarray, np.ndarray]:
    """(difference + 255) -> 10-bit field, and back; 999 marks fields that don't occur."""
    d = np.arange(-255, 256)
    c = np.array([int(abs(x)).bit_length() for x in d])
    field = ((((1 << (8 - c)) - 1) << (c + 1)) | np.where(d < 0, d + (1 << c) - 1, d)) << 1
    back = np.full(1024, 999, np.int16)
    back[field] = d
    return field.astype(np.uint64), back


_FIELD, _DIFFERENCE = _fields()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """(frames, WIDTH) samples -> JPEG files."""
    n = len(samples)
    d = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    f = _FIELD[d].reshape(n, WIDTH // 4, 4)
    word = f[..., 0] << np.uint64(30) | f[..., 1] << np.uint64(20) | f[..., 2] << np.uint64(10) | f[..., 3]
    scans = np.ascontiguousarray(word.astype(">u8").view(np.uint8).reshape(n, -1, 8)[..., 3:]).reshape(n, -1)
    return [HEADER + s.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for s in scans]


#: The Huffman tables of the JPEG standard, which motion JPEG leaves out: counts by length, then symbols
_STANDARD_TABLES = {
    0x00: "00010501010101010100000000000000 000102030405060708090a0b",
    0x01: "00030101010101010101010000000000 000102030405060708090a0b",
    0x10: "0002010303020403050504040000017d 0102030004110512213141061351610722711432"
    "8191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
    "636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2"
    "c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    0x11: "00020102040403040705040400010277 0001020311040521310612415107617113223281"
    "08144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758"
    "595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8"
    "b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
}


def _tree(table: bytes) -> tuple[dict, bytes]:
    """16 counts and symbols -> ((length, code) -> symbol, what follows)."""
    code, k, tree = 0, 16, {}
    for length, count in enumerate(table[:16], 1):
        for _ in range(count):
            tree[length, code] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return tree, table[k:]


def block_means(frame: np.ndarray) -> np.ndarray:
    """(height, width) samples -> rounded means of the 8 x 8 blocks, row by row; blocks at the edges may be smaller."""
    ys, xs = np.arange(0, frame.shape[0], 8), np.arange(0, frame.shape[1], 8)
    total = np.add.reduceat(np.add.reduceat(frame.astype(np.int64), ys, axis=0), xs, axis=1)
    count = np.diff(np.append(ys, frame.shape[0]))[:, None] * np.diff(np.append(xs, frame.shape[1]))[None, :]
    return ((2 * total + count) // (2 * count)).astype(np.uint8).reshape(-1)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """JPEG files of one size -> (frames, blocks) 8-bit means of their 8 x 8 blocks of greyscale or luma samples."""
    if not frames:
        return np.zeros((0, 0), np.uint8)
    if not all(f.startswith(HEADER) for f in frames):
        means = [block_means(decode_any(f)) for f in frames]
        if len({len(m) for m in means}) > 1:
            raise ValueError("frames of different sizes")
        return np.stack(means)
    at = len(HEADER)
    scans = b"".join(f[at : f.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff") for f in frames)
    if len(scans) != len(frames) * WIDTH * 5 // 4:
        raise ValueError("a scan of another length")
    raw = np.zeros((len(scans) // 5, 8), np.uint8)
    raw[:, 3:] = np.frombuffer(scans, np.uint8).reshape(-1, 5)
    word = raw.reshape(-1).view(">u8").astype(np.uint64)
    fields = np.stack([(word >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1)
    d = _DIFFERENCE[fields].reshape(len(frames), WIDTH)
    if (d == 999).any():
        raise ValueError("a scan holds codes that are not in its table")
    return (np.cumsum(d, axis=1, dtype=np.int32) + 128).astype(np.uint8)


class _Bits:
    """A scan's bits up to its next restart marker."""

    def __init__(self, data: bytes):
        self.bits, self.pos = "".join(f"{x:08b}" for x in data.replace(b"\xff\0", b"\xff")), 0

    def symbol(self, tree: dict) -> int:
        code = 0
        for length in range(1, 17):
            if self.pos >= len(self.bits):
                raise ValueError("a scan ends early")
            code = code << 1 | (self.bits[self.pos] == "1")
            self.pos += 1
            if (length, code) in tree:
                return tree[length, code]
        raise ValueError("a code that is not in its table")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = int(self.bits[self.pos : self.pos + n] or "0", 2)
        self.pos += n
        return v if v >> (n - 1) else v - (1 << n) + 1


def decode_any(jpeg: bytes) -> np.ndarray:
    """A baseline JPEG, decoded one code at a time -> (height, width) samples, of a colour frame the luma."""
    quant, codes, at, every, parts, frame = {}, {}, 2, 0, [], None
    for k, table in _STANDARD_TABLES.items():
        codes[k] = _tree(bytes.fromhex(table))[0]
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a broken JPEG header")
        marker, size = struct.unpack(">xBH", jpeg[at : at + 4])
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                quant[body[0] & 15], body = np.frombuffer(body[1 : wide + 1], ">u2" if wide == 128 else np.uint8).astype(int), body[wide + 1 :]
        elif marker == 0xC4:
            while body:
                codes[body[0]], body = _tree(body[1:])
        elif marker in (0xC0, 0xC1):
            height, width, n = struct.unpack(">HHB", body[1:6])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            parts = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            break
        elif 0xC0 < marker < 0xD0 and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
    if not frame or not height or not width or [p for p, _ in parts] != [c[0] for c in frame]:
        raise ValueError("only frames of one scan are read")
    wide, high = max(c[1] for c in frame), max(c[2] for c in frame)
    if (frame[0][1], frame[0][2]) != (wide, high):
        raise ValueError("luma is sampled less than colour")
    if len(frame) == 1:
        frame, wide, high = [(frame[0][0], 1, 1, frame[0][3])], 1, 1
    end = jpeg.rfind(b"\xff\xd9")
    segments = re.split(rb"\xff[\xd0-\xd7]", jpeg[at : end if end >= at else len(jpeg)])
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)[:, None]
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    out = np.zeros((down * 8 * high, across * 8 * wide), np.uint8)
    bits, last = _Bits(b""), [0] * len(frame)
    for unit in range(across * down):
        if unit % every == 0 if every else not unit:
            if unit // (every or 1) >= len(segments):
                raise ValueError("a scan ends early")
            bits, last = _Bits(segments[unit // (every or 1)]), [0] * len(frame)
        for c, ((_, h, v, table), (_, trees)) in enumerate(zip(frame, parts)):
            dc, ac = codes[trees >> 4], codes[0x10 | trees & 15]
            for y, x in ((y, x) for y in range(v) for x in range(h)):
                block, k = np.zeros(64), 1
                last[c] += bits.signed(bits.symbol(dc))
                block[0] = last[c] * quant[table][0]
                while k < 64 and (rs := bits.symbol(ac)):
                    k += rs >> 4
                    if rs & 15:
                        if k > 63:
                            raise ValueError("a block of over 64 values")
                        block[_ZIGZAG[k]] = bits.signed(rs & 15) * quant[table][k]
                    k += 1
                if not c:
                    top, left = 8 * (unit // across * high + y), 8 * (unit % across * wide + x)
                    out[top : top + 8, left : left + 8] = np.clip(np.rint(basis.T @ block.reshape(8, 8) @ basis + 128), 0, 255)
    return out[:height, :width]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = 8 * WIDTH, height: int = 8, fps: int = FPS) -> bytes:
    """Frames -> an AVI file with one motion-JPEG stream and an idx1 index."""
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<10I16x", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, width, height)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 3 * width * height, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    sizes = np.fromiter(map(len, chunks), np.uint32, n)
    index = np.empty(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, [len(f) for f in frames]
    index["at"] = 4 + np.cumsum(sizes) - sizes  # from the word "movi"
    movi = _chunk(b"LIST", b"movi" + b"".join(chunks))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames per second, the frames of the first video stream by the file's idx1 index, or as they lie where it has none).

    Other streams' chunks are left out, and empty ones (dropped frames) too. ValueError if it is not such a file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, rate, movi, index, streams, video = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0]), 0.0, None, b"", 0, None
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        kind = data[at + 8 : at + 12] if name == b"LIST" else b""
        if kind == b"movi":
            movi = (at + 8, min(end, at + 8 + size))
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        elif name == b"strh":
            if data[at + 8 : at + 12] == b"vids" and video is None:
                scale, per = struct.unpack("<II", data[at + 28 : at + 36])
                rate, video = (per / scale if scale else 0.0), b"%02d" % streams
            streams += 1
        at += 12 if kind in (b"hdrl", b"strl") else 8 + size + (size & 1)
    if movi is None or video is None or rate <= 0:
        raise ValueError("no video stream with a frame rate")
    mine = {video + b"dc", video + b"db"}
    if len(index) >= 16:
        entries = np.frombuffer(index[: len(index) // 16 * 16], [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
        first = int(entries["at"][0])
        base = movi[0] if data[movi[0] + first : movi[0] + first + 4] == entries["id"][0] else 0  # places count from the word movi, or from the file's start
        spans = [(int(e["at"]) + base + 8, int(e["size"])) for e in entries if e["id"] in mine]
    else:
        spans, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            if name == b"LIST":
                at += 12
                continue
            if name in mine:
                spans.append((at + 8, size))
            at += 8 + size + (size & 1)
    return rate, [data[a : a + n] for a, n in spans if n]


def shots(frames: np.ndarray, bins: int = BINS, history: int = HISTORY, sigmas: float = SIGMAS, least: float = LEAST_CHANGE) -> np.ndarray:
    """First frames of the shots: 0, and frames whose histogram differs from the one before by over ``least`` and by
    over the mean plus ``sigmas`` deviations of the up to ``history`` differences before."""
    n, width = frames.shape
    if not n:
        return np.zeros(0, np.int64)
    cells = (np.arange(n)[:, None] * bins + frames.astype(np.int64) * bins // 256).reshape(-1)
    hist = np.bincount(cells, minlength=n * bins).reshape(n, bins)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)  # whole numbers, so sums are exact
    k = np.minimum(np.arange(n - 1), history)
    s, s2 = np.concatenate(([0], np.cumsum(d))), np.concatenate(([0], np.cumsum(d * d)))
    i = np.arange(n - 1)
    total, total2 = s[i] - s[i - k], s2[i] - s2[i - k]
    # d > mean + sigmas * deviation, times k
    cut = (d > least * 2 * width) & (d * k > total + sigmas * np.sqrt(np.maximum(total2 * k - total * total, 0)))
    return np.concatenate(([0], np.flatnonzero(cut) + 1))


CLIP = "array<struct<start_ms:long,end_ms:long,first_frame:int,frames:int>>"


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with bytes 32 to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" ")


def text_to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text as an AVI file.

    Null and empty texts give one blank frame; equal texts equal files; ids may be null or repeat; other columns are
    ignored. A file holds some 2 bytes a byte of text; Spark's binary values end at 2 GB, so a text of over some
    900 MB fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sizes, media, held = 0, [], [], 0
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                p = payload(t)
                sizes.append(len((t or "").encode("utf-8")))
                media.append(write_avi(encode_frames(np.frombuffer(p, np.uint8).reshape(-1, WIDTH))))
                held += len(media[-1])
                if held >= FLUSH or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    at, sizes, media, held = i + 1, [], [], 0

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def read_clips(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns, ``payload`` binary (the decoded samples), ``clips`` (one struct a shot) and ``error`` string, what keeps
    a file from being read: then, and for null media, payload and clips are null. A file without frames has an empty
    payload and no clips. Columns of these names are replaced."""
    kept = [c for c in media.columns if c not in ("payload", "clips", "error")]
    rows = media.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("clips", T._parse_datatype_string(CLIP)), T.StructField("error", T.StringType())])
    at = kept.index(media_col)
    clip_type = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("first_frame", pa.int32()), ("frames", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, payloads, clips, errors, held = 0, [], [], [], 0
            for i, m in enumerate(b.column(at)):
                m = m.as_py()
                samples = own = error = None
                if m is not None:
                    held += len(m)
                    try:
                        rate, jpegs = read_avi(m)
                        frames = decode_frames(jpegs)
                    except (ValueError, IndexError, KeyError, struct.error) as e:  # broken files, which say so in their row
                        error = f"{type(e).__name__}: {e}"
                    else:
                        first = shots(frames).tolist()
                        samples = frames.tobytes()
                        own = [{"start_ms": round(1000 * a / rate), "end_ms": round(1000 * z / rate), "first_frame": a, "frames": z - a} for a, z in zip(first, [*first[1:], len(frames)])]
                payloads.append(samples)
                clips.append(own)
                errors.append(error)
                if held >= FLUSH or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*[c.slice(start, len(clips)) for c in b.columns], pa.array(payloads, pa.binary()), pa.array(clips, clip_type), pa.array(errors, pa.string())], [*kept, "payload", "clips", "error"])
                    start, payloads, clips, errors, held = i + 1, [], [], [], 0

    return rows.mapInArrow(run, schema)
