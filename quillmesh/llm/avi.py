"""AVI motion-JPEG media columns: writing, RIFF index parsing, intra-frame decoding, shots, timed clips.

Decoding: baseline and extended sequential JPEG with 8-bit samples, Huffman codes, one to four components, any sampling
factors, any size, restart intervals, AC terms, dequantisation and the inverse cosine transform; frames without Huffman tables get
the standard ones. Frames with equal headers are decoded side by side: a step handles one block of each. Without an idx1 chunk
(or with one whose entries don't point at chunks) the frames are those found by walking the movi list.

Writing: a frame holds 576 samples as 24 x 24 blocks of 8 x 8 equal pixels, so a sample is a block's DC term: with a quantiser
of 8, term k is the flat block of value k + 128, and the baseline JPEG of it is lossless.

Shots are found on the first component at an eighth of its size, a sample for each block (its mean, which the DC term is), as is usual for
intra frames: consecutive frames differ by half the summed differences of their 16-bin histograms; a cut is a difference above the mean
plus three deviations of the eight before it, and above a floor. Clips are timed by the frame rate.

Defined cases: a null or empty text is one frame of bytes 255; clips() gives no rows for a null file or one that is no AVI file
of decodable frames, while the functions on single files raise ValueError; equal texts give equal files and rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
#: Frames handled side by side.
BATCH = 1024
BINS, BEFORE, DEVIATIONS, FLOOR = 16, 8, 3.0, 0.05
KEY_FRAME = 0x10


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def head() -> bytes:
    """All of a frame before its coded data."""
    # a DC code of four bits for each of the nine lengths of a difference, an AC code of one bit for the end of a block
    dc = bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])
    ac = bytes([0x10, 1, *[0] * 15, 0x00])
    size = struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1)
    return b"".join([b"\xff\xd8", segment(0xE0, b"AVI1\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00"), segment(0xDB, bytes([0]) + bytes([8] * 64)), segment(0xC0, size + bytes([1, 0x11, 0])), segment(0xC4, dc), segment(0xC4, ac), segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))])


HEAD = head()
LENGTHS = np.array([int(v).bit_length() for v in range(256)])


def coded(samples: np.ndarray) -> list[bytes]:
    """Frames (rows of FRAME bytes) as JPEG."""
    out = []
    for at in range(0, len(samples), BATCH):
        s = samples[at : at + BATCH].astype(np.int64) - 128
        diff = np.diff(s, axis=1, prepend=0)
        bits = LENGTHS[np.abs(diff)]
        extra = np.where(diff < 0, diff + (1 << bits) - 1, diff)
        value, length = ((bits << bits) | extra) << 1, bits + 5
        ends = np.cumsum(length, axis=1)
        n_bytes = -(-ends[:, -1] // 8)
        base = np.concatenate([[0], np.cumsum(n_bytes)])
        start = ends - length
        where = base[:-1, None] + (start >> 3)
        value = value << (24 - (start & 7) - length)
        size = int(base[-1]) + 3
        packed = np.bincount(where.ravel(), (value >> 16).ravel(), size) + np.bincount(where.ravel() + 1, ((value >> 8) & 255).ravel(), size) + np.bincount(where.ravel() + 2, (value & 255).ravel(), size)
        packed[base[1:] - 1] += (1 << (n_bytes * 8 - ends[:, -1])) - 1
        data = packed.astype(np.uint8).tobytes()
        out += [HEAD + data[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def written(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames, with its index."""
    side, largest = SIDE * 8, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, KEY_FRAME, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    picture = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    chunks = [chunk(b"00dc", f) for f in frames]
    sizes = np.array([len(c) for c in chunks])
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), KEY_FRAME
    index[:, 2], index[:, 3] = 4 + np.cumsum(sizes) - sizes, [len(f) for f in frames]
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", index.tobytes()))


def chunks(data: bytes, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks between two places; what runs over the end is cut there."""
    while at + 8 <= stop:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(size, stop - at - 8)
        at += 8 + size + (size & 1)


def is_frame(name: bytes) -> bool:
    return len(name) == 4 and name[:2].isdigit() and name[2:] in (b"dc", b"db")


def found_frames(data: bytes, at: int, stop: int) -> list[tuple[int, int]]:
    """Where the frames of a movi list begin, and their sizes, groups of records included."""
    out = []
    for name, start, size in chunks(data, at, stop):
        if is_frame(name):
            out.append((start, size))
        elif name == b"LIST" and data[start : start + 4] == b"rec ":
            out += found_frames(data, start + 4, start + size)
    return out


def indexed(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the RIFF index lists, or else those of the movi list, and the frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, rate = None, None, float(RATE)
    for name, start, size in chunks(data, 12, len(data)):
        kind = data[start : start + 4]
        if name == b"LIST" and kind == b"movi":
            movi = (start, start + size)
        elif name == b"LIST" and kind == b"hdrl":
            where = data.find(b"strh", start, start + size)
            if where >= 0 and where + 36 <= len(data):
                scale, per = struct.unpack_from("<II", data, where + 28)
                rate = per / scale if scale and per else rate
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 16 * 4, start).reshape(-1, 4)
    if movi is None:
        raise ValueError("no list of frames")
    places = None
    if index is not None:
        rows = [r for r in index.tolist() if is_frame(r[0].to_bytes(4, "little"))]
        for base in (movi[0], 0):  # offsets count from the list, or from the file
            if rows and all(data[base + r[2] : base + r[2] + 4] == r[0].to_bytes(4, "little") and base + r[2] + 8 + r[3] <= len(data) for r in rows):
                places = [(base + r[2] + 8, r[3]) for r in rows]
                break
    if places is None:
        places = found_frames(data, movi[0] + 4, movi[1])
    frames = [data[a : a + n] for a, n in places if n]
    if not frames:
        raise ValueError("no frames")
    return frames, rate


# Fixed values of the JPEG standard: the order of coefficients, and the Huffman tables of frames that carry none (how many
# codes there are of each length, then the symbols, by class and number).
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
STANDARD = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: (
        "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a "
        "73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    0x11: (
        "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a "
        "73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}


def codes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each sixteen bits: the symbol of the code that they start with, or -1, and its length; of 16 counts, then the symbols."""
    symbols, lengths = np.full(1 << 16, -1), np.zeros(1 << 16, np.int64)
    if len(body) < 16 or len(body) < 16 + sum(body[:16]) or sum(n << (16 - bits) for bits, n in enumerate(body[:16], 1)) > 1 << 16:
        raise ValueError("a Huffman table that is cut or has more codes than there is room for")
    code, k = 0, 16
    for bits in range(1, 17):
        for _ in range(body[bits - 1]):
            a = code << (16 - bits)
            symbols[a : a + (1 << (16 - bits))], lengths[a : a + (1 << (16 - bits))] = body[k], bits
            code, k = code + 1, k + 1
        code <<= 1
    return symbols, lengths


@dataclass
class Component:
    number: int
    across: int
    down: int
    scale: np.ndarray
    dc: tuple[np.ndarray, np.ndarray]
    ac: tuple[np.ndarray, np.ndarray]


@dataclass
class Header:
    """What stands before a frame's coded data, and where that begins."""

    begin: int
    height: int
    width: int
    components: list[Component]
    restart: int

    def units(self) -> tuple[int, int]:
        """Coding units down and across the picture."""
        down, across = max(c.down for c in self.components), max(c.across for c in self.components)
        return -(-self.height // (8 * down)), -(-self.width // (8 * across))


def header(frame: bytes) -> Header:
    at, huffman, scales, parts, restart, size = 2, {}, {}, [], 0, (0, 0)
    while frame[:2] == b"\xff\xd8" and at + 4 <= len(frame) and frame[at] == 0xFF:
        marker, length = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + length]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = 2 if body[k] >> 4 else 1
                if len(body) < k + 1 + 64 * wide:
                    raise ValueError("a cut quantisation table")
                scales[body[k] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, k + 1).astype(np.int64)
                k += 1 + 64 * wide
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise ValueError("a cut frame header")
            if body[0] != 8:
                raise ValueError("samples of other than 8 bits")
            size = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k]] = codes(body[k + 1 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            if len(body) < 2:
                raise ValueError("a cut restart interval")
            restart = int.from_bytes(body[:2], "big")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a sequential Huffman frame")
        at += 2 + length
        if marker == 0xDA:
            if not body or len(body) < 1 + 2 * body[0]:
                raise ValueError("a cut scan header")
            if not parts or 0 in size or body[0] != len(parts) or any(not h or not v for _, h, v, _ in parts):
                raise ValueError("no frame header, or components in several scans")
            of = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            table = lambda k: huffman[k] if k in huffman else codes(bytes.fromhex("".join(STANDARD[k])))
            if any(k >> 4 > 3 or k & 15 > 3 for k in of.values()):
                raise ValueError("no such table")
            try:
                components = [Component(n, h, v, scales[q], table(of[n] >> 4), table(0x10 | of[n] & 15)) for n, h, v, q in parts]
            except KeyError as e:
                raise ValueError("a table is missing") from e
            if len(components) == 1:
                components[0].across = components[0].down = 1
            return Header(at, *size, components, restart)
    raise ValueError("not a JPEG frame")


def coefficients(frames: list[bytes], h: Header) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of frames with one header, for each component: DC terms (frame, rows, columns of blocks), and AC terms as (block, place, value), quantised.

    A run between restart marks is decoded by itself; all runs go side by side, one block of each at a step.
    """
    down, across = h.units()
    total, each = down * across, h.restart or down * across
    runs, first = [], []
    for i, f in enumerate(frames):
        data = f[h.begin :]
        end = data.rfind(b"\xff\xd9")
        data = data[: end if end >= 0 else len(data)]
        if total * sum(c.down * c.across for c in h.components) > 4 * len(data):  # a block has two codes, of a bit each at least
            raise ValueError("a picture larger than its data")
        parts = RESTART.split(data) if h.restart else [data]
        if len(parts) < -(-total // each):
            raise ValueError("a run is missing")
        for k in range(-(-total // each)):
            runs.append(parts[k].replace(b"\xff\x00", b"\xff"))
            first.append(i * total + k * each)
    data = np.frombuffer(b"".join(runs) + b"\x00" * 8, np.uint8).astype(np.int64)
    ahead = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]  # forty bits from each byte
    last = len(ahead) - 1
    bit = np.concatenate([[0], np.cumsum([len(p) for p in runs])])[:-1].astype(np.int64) * 8
    first = np.array(first)
    left = np.minimum(each, total - first % total)
    out = [(np.zeros((len(frames) * total, c.down * c.across), np.int64), [], [], []) for c in h.components]
    before = np.zeros((len(h.components), len(runs)), np.int64)

    def symbol(table: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, the bits after them (up to sixteen, as a function of the size), and the code lengths."""
        word = ahead[np.minimum(at >> 3, last)] << (at & 7)
        code = (word >> 24) & 0xFFFF
        return table[0][code], word, table[1][code]

    def value(word: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
        extra = (word >> (40 - used - size)) & ((1 << size) - 1)
        return np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)

    for unit in range(each):
        live = np.flatnonzero(left > unit) if unit >= left.min() else slice(None)
        for ci, c in enumerate(h.components):
            for block in range(c.down * c.across):
                at = bit[live]
                size, word, used = symbol(c.dc, at)
                if (size < 0).any() or (size > 11).any():
                    raise ValueError("an unknown code")
                before[ci, live] += value(word, used, size)
                here = first[live] + unit
                out[ci][0][here, block] = before[ci, live]
                at = at + used + size
                k = np.ones(len(at), np.int64)
                todo = np.arange(len(at))
                while len(todo):
                    now = at[todo]
                    s, word, used = symbol(c.ac, now)
                    if (s < 0).any():
                        raise ValueError("an unknown code")
                    run, size = s >> 4, s & 15
                    k[todo] += run
                    some = size > 0
                    if some.any():
                        if (k[todo[some]] > 63).any():
                            raise ValueError("too many terms in a block")
                        # code and value may take 32 bits, of which 33 are at hand
                        out[ci][1].append(here[todo[some]] * (c.down * c.across) + block)
                        out[ci][2].append(k[todo[some]].copy())
                        out[ci][3].append(value(word, used, size)[some])
                    at[todo] = now + used + size
                    k[todo] += 1
                    todo = todo[(s != 0) & (k[todo] < 64)]
                bit[live] = at
    done = []
    for c, (dc, *ac) in zip(h.components, out, strict=True):
        grid = dc.reshape(len(frames), down, across, c.down, c.across).transpose(0, 1, 3, 2, 4).reshape(len(frames), down * c.down, across * c.across)
        done.append((grid, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in ac)))
    return done


COSINES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def eighths(grid: np.ndarray, c: Component) -> np.ndarray:
    """A sample for each block: the mean, from its DC term."""
    return np.clip(np.rint(grid * c.scale[0] / 8) + 128, 0, 255).astype(np.uint8)


def grouped(frames: list[bytes]) -> Iterator[tuple[list[int], list[bytes], Header]]:
    """Frames of equal headers together, at most BATCH at a time."""
    heads: dict[bytes, list[int]] = {}
    for i, f in enumerate(frames):
        cut = f.find(b"\xff\xda")
        heads.setdefault(f[:cut] + f[cut : cut + 4] if cut >= 0 else b"", []).append(i)
    for rows in heads.values():
        h = header(frames[rows[0]])
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            yield part, [frames[i] for i in part], h


def pictures(frames: list[bytes]) -> list[list[np.ndarray]]:
    """For each frame the samples of each component at its own resolution, cropped to the picture."""
    out: list[list[np.ndarray]] = [[] for _ in frames]
    for rows, part, h in grouped(frames):
        tall, wide = max(c.down for c in h.components), max(c.across for c in h.components)
        for c, (grid, block, place, v) in zip(h.components, coefficients(part, h), strict=True):
            n, down, across = grid.shape
            terms = np.zeros((n * down * across, 64))
            unit = c.down * c.across
            order = np.arange(n * down * across).reshape(n, down // c.down, c.down, across // c.across, c.across).transpose(0, 1, 3, 2, 4).reshape(-1, unit)
            terms[:, 0] = grid.ravel() * c.scale[0]
            terms[order.ravel()[block], np.array(ZIGZAG)[place]] = v * c.scale[place]
            pixels = np.einsum("ux,bvu,vy->byx", COSINES, terms.reshape(-1, 8, 8), COSINES, optimize=True)
            plane = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8).reshape(n, down, across, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, down * 8, across * 8)
            high, width = -(-h.height * c.down // tall), -(-h.width * c.across // wide)
            for i, row in enumerate(rows):
                out[row].append(plane[i, :high, :width])
    return out


def thumbnails(frames: list[bytes]) -> list[np.ndarray]:
    """The first component of each frame at an eighth of its size."""
    out: list = [None] * len(frames)
    for rows, part, h in grouped(frames):
        small = eighths(coefficients(part, h)[0][0], h.components[0])
        for i, row in enumerate(rows):
            out[row] = small[i]
    return out


def decoded(frames: list[bytes]) -> np.ndarray:
    """The first component of frames of one size at an eighth of it, a row for each."""
    small = thumbnails(frames)
    if len({x.shape for x in small}) > 1:
        raise ValueError("frames of several sizes")
    return np.stack(small).reshape(len(small), -1)


def differences(samples: np.ndarray) -> np.ndarray:
    """Between the histograms of each frame and the one before; 0 for the first."""
    n, size = samples.shape
    h = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    return np.concatenate([[0.0], np.abs(np.diff(h, axis=0)).sum(1) / (2 * size)])


def cuts(diff: np.ndarray) -> np.ndarray:
    """First frames of shots, 0 included."""
    n = len(diff)
    sums, squares = np.concatenate([[0.0], np.cumsum(diff)]), np.concatenate([[0.0], np.cumsum(diff * diff)])
    to = np.arange(n)
    frm = np.maximum(to - BEFORE, 1)
    m = np.maximum(to - frm, 1)
    mean = np.where(to > frm, (sums[to] - sums[np.minimum(frm, to)]) / m, 0)
    var = np.where(to > frm, (squares[to] - squares[np.minimum(frm, to)]) / m, 0) - mean * mean
    limit = np.maximum(mean + DEVIATIONS * np.sqrt(np.maximum(var, 0)), FLOOR)
    return np.flatnonzero((to == 0) | ((to > frm) & (diff > limit)))


def payload_of(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def stored(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload."""
    counts = [len(p) // FRAME for p in payloads]
    frames = coded(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    ends = np.cumsum(counts)
    return [written(frames[e - n : e]) for e, n in zip(ends.tolist(), counts, strict=True)]


def read_back(files: list[bytes]) -> list[tuple[np.ndarray, float]]:
    """The samples of each file, a row for each frame, and its frame rate."""
    frames = [indexed(f) for f in files]
    samples = decoded([x for f, _ in frames for x in f])
    ends = np.cumsum([len(f) for f, _ in frames])
    return [(samples[e - len(f) : e], rate) for e, (f, rate) in zip(ends.tolist(), frames, strict=True)]


CLIP = "array<struct<shot:int,first_frame:int,last_frame:int,start_s:double,stop_s:double>>"
CLIP_ARROW = pa.list_(pa.struct([("shot", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("stop_s", pa.float64())]))


def clips_of(diff: np.ndarray, rate: float) -> list[dict]:
    """Timed clips of a file, a row for each shot, from the differences of its frames."""
    first = cuts(diff).tolist()
    return [{"shot": i, "first_frame": a, "last_frame": b - 1, "start_s": a / rate, "stop_s": b / rate} for i, (a, b) in enumerate(zip(first, [*first[1:], len(diff)], strict=True))]


def groups(texts: list[bytes]):
    """Runs of texts of up to BATCH frames together, or one text."""
    run, n = [], 0
    for t in texts:
        k = len(t) // FRAME + 1
        if run and n + k > BATCH:
            yield run
            run, n = [], 0
        run.append(t)
        n += k
    if run:
        yield run


def encode_media(docs: DataFrame) -> DataFrame:
    """docs' doc_id with media: the text as an AVI file."""

    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([f for g in groups([t.as_py() for t in texts]) for f in stored([payload_of(t) for t in g])], pa.binary())

    return docs.select("doc_id", F.arrow_udf(encode, "binary")(text_bytes()).alias("media"))


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, shot, first_frame, last_frame, start_s, stop_s) of a table with media: a row for each shot."""

    def detect(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            try:
                frames, rate = indexed(f.as_py() or b"")
                rows.append(clips_of(differences(decoded(frames)), rate))
            except ValueError:
                rows.append([])
        return pa.array(rows, CLIP_ARROW)

    return media.select("doc_id", F.inline(F.arrow_udf(detect, CLIP)("media")))


DIGEST = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIP}"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id with digests of each text's file and of what is read back from it, and its timed clips, which feature tells in short."""

    def digest(texts: pa.Array) -> pa.Array:
        rows = []
        for g in groups([t.as_py() for t in texts]):
            files = stored([payload_of(t) for t in g])
            for t, f, (samples, rate) in zip(g, files, read_back(files), strict=True):
                back = samples.tobytes()
                rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(f), hashlib.sha256(f).hexdigest(), clips_of(differences(samples), rate)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), CLIP_ARROW]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"])

    read = docs.select("doc_id", F.arrow_udf(digest, DIGEST)(text_bytes()).alias("m")).select("doc_id", "m.*")
    times = F.array_join(F.transform("clips", lambda c: F.format_string("%d-%d@%.2f-%.2f", c["first_frame"], c["last_frame"], c["start_s"], c["stop_s"])), ",")
    return read.withColumn("feature", F.concat(F.lit("clips="), F.size("clips").cast("string"), F.lit(";"), times))
