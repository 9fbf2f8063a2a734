"""Media columns: AVI files of motion-JPEG frames, written losslessly, read back by their RIFF index, split into shots.

A payload byte is stored as one quantised coefficient of a baseline JPEG frame of 24 x 24 samples (nine blocks, 576
bytes): bytes 0-127 as -128..-1, bytes 128-255 as 1..128, so no coefficient is zero. The frame's Huffman tables give a
category of s bits a code of 12 - s bits, so each coefficient takes 12 bits and whole frames are coded and decoded by
table look-up. Decoding yields the stored bytes again, and by the inverse cosine transform the frame's samples.

Cases: null and empty texts are one frame of 255s; equal texts give equal values; a text of any length is one file, whose
frames are coded together, up to the 2 GB of a binary value (texts of about 1 GB); a null id is kept; a repeated row is
stored once per row; an empty table gives no row. Other columns of the input, whatever their names, are ignored.

`clips` also reads files of other coders: frames of any size, colour and tables, baseline JPEG with the Huffman tables in
each frame, whose luminance counts. A file that isn't such gives one row without clip that says why.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Parameters: payload bytes and side of a frame, frames a second, frames looked back on and deviations that start a shot.
UNIT, SIDE, RATE, BACK, DEVIATIONS = 576, 24, 25, 8, 2.0
_BITS = 12

#: Fixed values of the JPEG standard: the order in which a block's coefficients are stored (rows of anti-diagonals).
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def _codes(categories: range) -> dict[int, int]:
    """Canonical Huffman codes, the longest category's first: category s has 12 - s bits."""
    out, code, length = {}, 0, 0
    for s in sorted(categories, key=lambda s: _BITS - s):
        code <<= _BITS - s - length
        length = _BITS - s
        out[s] = code
        code += 1
    return out


def _words(values: np.ndarray, categories: range) -> np.ndarray:
    """The 12 bits of each value: its category's code, then its bits; negative values as ones' complement."""
    codes, out = _codes(categories), np.zeros(len(values), np.uint16)
    for i, v in enumerate(values.tolist()):
        s = abs(v).bit_length()
        out[i] = codes[s] << s | (v if v >= 0 else v + (1 << s) - 1)
    return out


def _table(kind: int, categories: range) -> bytes:
    """A table segment's body: class and number, how many codes of 1 to 16 bits, the categories in the order of codes."""
    order = sorted(categories, key=lambda s: _BITS - s)
    return bytes([kind << 4, *(sum(_BITS - s == n for s in order) for n in range(1, 17)), *order])


_FIRST, _REST = range(0, 10), range(1, 9)  # differences of first coefficients reach 256, others 128
_COEFFICIENT = np.concatenate([np.arange(-128, 0), np.arange(1, 129)])  # by byte
_REST_WORD = _words(_COEFFICIENT, _REST)
_FIRST_WORD = _words(np.arange(-256, 257), _FIRST)
_REST_BYTE = np.zeros(1 << _BITS, np.uint8)
_REST_BYTE[_REST_WORD] = np.arange(256)
_FIRST_VALUE = np.zeros(1 << _BITS, np.int32)
_FIRST_VALUE[_FIRST_WORD] = np.arange(-256, 257)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + b"".join(
    [
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
        _segment(0xC4, _table(0, _FIRST)),
        _segment(0xC4, _table(1, _REST)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
)
_TAIL = b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes filled up with 255 to a positive multiple of UNIT)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + b"\xff" * (-len(b) % UNIT if b else UNIT)


def encode(data: bytes) -> bytes:
    """An AVI file that holds `data`, a positive multiple of UNIT bytes."""
    b = np.frombuffer(data, np.uint8).reshape(-1, UNIT // 64, 64)
    words = _REST_WORD[b]
    first = _COEFFICIENT[b[:, :, 0]]
    words[:, :, 0] = _FIRST_WORD[np.diff(first, axis=1, prepend=0) + 256]
    w = words.reshape(len(b), -1, 2)
    packed = np.stack([w[:, :, 0] >> 4, (w[:, :, 0] & 15) << 4 | w[:, :, 1] >> 8, w[:, :, 1] & 255], axis=2).astype(np.uint8).tobytes()
    size = UNIT * _BITS // 8
    frames = [_HEAD + packed[k : k + size].replace(b"\xff", b"\xff\0") + _TAIL for k in range(0, len(packed), size)]
    index, movie, at = [], [b"movi"], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 16, at, len(f)))
        movie.append(c)
        at += len(c)
    n = len(frames)
    main = struct.pack("<10I16x", 1_000_000 // RATE, 0, 0, 16, n, 0, 1, 0, SIDE, SIDE)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def read_frames(media: bytes) -> tuple[int, list[bytes]]:
    """(microseconds of a frame, JPEG files) of an AVI file, by its index, or chunk by chunk where it has none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, micros, movie, stop, index = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]), 0, 0, 0, None
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            micros = struct.unpack_from("<I", media, at + 20)[0]
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movie, stop = at + 8, min(at + 8 + size, len(media))
        elif name == b"idx1":
            index = [(n, o, k) for n, _, o, k in struct.iter_unpack("<4sIII", media[at + 8 : at + 8 + size // 16 * 16])]
        at += 8 + size + size % 2
    if index is None:
        index, at = [], movie + 4
        while at + 8 <= stop:
            name, size = struct.unpack_from("<4sI", media, at)
            index.append((name, at - movie, size))
            at += 8 + size + size % 2
    video = [(o, k) for n, o, k in index if n[2:] in (b"dc", b"db")]
    if video and media[movie + video[0][0] + 2 : movie + video[0][0] + 4] not in (b"dc", b"db"):
        movie = 0  # offsets from the file's beginning
    return micros, [media[movie + o + 8 : movie + o + 8 + k] for o, k in video]


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(bits, symbol) by the next 16 bits, (0, 0) where no code begins so."""
    out, code, at = [(0, 0)] * (1 << 16), 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            low = code << (16 - bits)
            out[low : low + (1 << (16 - bits))] = [(bits, symbols[at])] * (1 << (16 - bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """The bits of a stretch of entropy-coded data."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data.replace(b"\xff\0", b"\xff") + b"\xff" * 8, 0

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: list[tuple[int, int]]) -> int:
        bits, symbol = table[self.peek()]
        if not bits or self.at > 8 * len(self.data):
            raise ValueError("broken entropy-coded data")
        self.at += bits
        return symbol

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.peek() >> (16 - size)
        self.at += size
        return v if v >> (size - 1) else v - (1 << size) + 1


def luminance(jpeg: bytes) -> np.ndarray:
    """Samples (height, width) of the first component of a baseline frame, decoded by the tables that it carries."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant, huff, parts, planes, at, every, height, width = {}, {}, {}, {}, 2, 0, 0, 0
    while at + 4 <= len(jpeg):
        if jpeg[at] != 255:
            raise ValueError("broken segments")
        marker = jpeg[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                quant[number] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of other than 8 bits")
            height, width = struct.unpack_from(">HH", body, 1)
            parts = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
            if not parts or not height or not width:
                raise ValueError("no components")
            most = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
            across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
            planes = {c: np.zeros((down * v, across * h, 64), np.float32) for c, (h, v, _) in parts.items()}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            if not parts:
                raise ValueError("no frame header")
            end = at
            while end + 1 < len(jpeg) and not (jpeg[end] == 255 and jpeg[end + 1] != 0 and not 0xD0 <= jpeg[end + 1] <= 0xD7):
                end = jpeg.find(b"\xff", end + 1) if jpeg[end] != 255 else jpeg.find(b"\xff", end + 2)
                end = len(jpeg) if end < 0 else end
            scan = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            _scan(jpeg[at:end], scan, parts, planes, huff, every, (across, down), (height, width), most)
            at = end
    if not planes:
        raise ValueError("no frame")
    first = next(iter(parts))
    h, v, number = parts[first]
    if number not in quant:
        raise ValueError("no quantisation table")
    grid = planes[first] * quant[number]
    blocks = np.zeros_like(grid)
    blocks[:, :, _ZIGZAG] = grid
    rows, columns, _ = blocks.shape
    whole = _inverse(blocks.reshape(-1, 8, 8)).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
    return whole[: -(-height * v // most[1]), : -(-width * h // most[0])]


def _scan(data: bytes, scan: list[tuple[int, int, int]], parts: dict, planes: dict, huff: dict, every: int, grid: tuple[int, int], size: tuple[int, int], most: tuple[int, int]) -> None:
    """Fill the planes' coefficients from a scan's data; restart markers begin a new stretch."""
    if any(c not in parts or (0, d) not in huff or (1, a) not in huff for c, d, a in scan):
        raise ValueError("no Huffman tables")
    if len(scan) > 1:
        units = [[(c, d, a, y * v + j, x * h + i) for c, d, a in scan for h, v, _ in [parts[c]] for j in range(v) for i in range(h)] for y in range(grid[1]) for x in range(grid[0])]
    else:  # a scan of one component has its own blocks only
        c, d, a = scan[0]
        h, v, _ = parts[c]
        units = [[(c, d, a, y, x)] for y in range(-(-size[0] * v // (8 * most[1]))) for x in range(-(-size[1] * h // (8 * most[0])))]
    stretches = re.split(b"\xff[\xd0-\xd7]", data) if every else [data]
    step = every or len(units)
    for k in range(0, len(units), step):
        if k // step >= len(stretches):
            raise ValueError("missing data")
        bits, last = _Bits(stretches[k // step]), dict.fromkeys(parts, 0)
        for unit in units[k : k + step]:
            for c, d, a, y, x in unit:
                last[c] += bits.value(bits.symbol(huff[0, d]))
                block, i = planes[c][y, x], 1
                block[0] = last[c]
                while i < 64:
                    s = bits.symbol(huff[1, a])
                    if s & 15:
                        i += s >> 4
                        if i > 63:
                            raise ValueError("broken block")
                        block[i] = bits.value(s & 15)
                        i += 1
                    elif s == 0xF0:
                        i += 16
                    else:
                        break


def _is_own(frames: list[bytes]) -> bool:
    return all(f.startswith(_HEAD) and f.endswith(_TAIL) for f in frames)


def decode(media: bytes) -> tuple[int, bytes, np.ndarray]:
    """(microseconds of a frame, stored bytes, samples of each frame) of a file that `encode` made."""
    micros, frames = read_frames(media)
    if not _is_own(frames):
        raise ValueError("frames of another coder hold no payload")
    scan = b"".join(f[len(_HEAD) : -len(_TAIL)].replace(b"\xff\0", b"\xff") for f in frames)
    p = np.frombuffer(scan, np.uint8).reshape(-1, 3).astype(np.uint16)
    words = np.stack([p[:, 0] << 4 | p[:, 1] >> 4, (p[:, 1] & 15) << 8 | p[:, 2]], axis=1).reshape(len(frames), UNIT // 64, 64)
    stored = _REST_BYTE[words]
    first = np.cumsum(_FIRST_VALUE[words[:, :, 0]], axis=1)
    stored[:, :, 0] = np.where(first < 0, first + 128, first + 127)
    blocks = np.zeros(stored.shape, np.float32)
    blocks[:, :, _ZIGZAG] = _COEFFICIENT[stored]
    samples = _inverse(blocks.reshape(-1, 8, 8)).reshape(len(frames), -1)
    return micros, stored.tobytes(), samples


def _inverse(blocks: np.ndarray) -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    basis = basis.astype(np.float32)
    return np.clip(np.rint(basis @ blocks @ basis.T) + 128, 0, 255).astype(np.uint8)


def histograms(samples: np.ndarray) -> np.ndarray:
    """16 steps of brightness of each frame."""
    n = len(samples)
    row = np.repeat(np.arange(n), samples.shape[1])
    return np.bincount(row * 16 + (samples.reshape(-1) >> 4), minlength=16 * n).reshape(n, 16)


def seen(media: bytes) -> tuple[int, np.ndarray]:
    """(microseconds of a frame, histograms of the frames, as of UNIT samples each) of any baseline motion-JPEG file."""
    micros, frames = read_frames(media)
    if not frames:
        raise ValueError("no frames")
    if _is_own(frames):
        return micros, histograms(decode(media)[2])
    out: list[np.ndarray] = []
    for f in frames:
        if f or not out:
            x = luminance(f).reshape(1, -1)
            out.append(histograms(x)[0] * (UNIT / x.shape[1]))
        else:  # an empty chunk shows the frame before it again
            out.append(out[-1])
    return micros, np.stack(out)


def shots(h: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot: one starts where the histogram's change is over the mean of the last BACK changes by DEVIATIONS of their deviation."""
    n = len(h)
    change = np.abs(np.diff(h, axis=0)).sum(axis=1)
    one, two = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change * change)])
    at = np.arange(len(change))
    low = np.maximum(0, at - BACK)
    past = np.maximum(1, at - low)
    mean = (one[at] - one[low]) / past
    spread = np.sqrt(np.maximum(0, (two[at] - two[low]) / past - mean * mean))
    starts = [0, *(np.flatnonzero((at >= 2) & (change > mean + DEVIATIONS * spread + UNIT / 32)) + 1).tolist()]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the text of each row as an AVI file."""
    bounded_batches(docs.sparkSession, 64)
    kind = dict(docs.dtypes)[doc_id]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = [payload(t) for t in p.pop("t")]
            yield p.assign(n_bytes=[n for n, _ in made], media=[encode(b) for _, b in made])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary")


def clips(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, clip, start_ms, end_ms, frames, error) of each shot of each file; one row that tells the error of a file that can't be read; none for null."""
    bounded_batches(files.sparkSession, 64)
    kind = dict(files.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, m in zip(p["k"], p["m"], strict=True):
                if m is None:
                    continue
                try:
                    micros, h = seen(m)
                    rows += [(k, i, a * micros // 1000, (a + n) * micros // 1000, n, None) for i, (a, n) in enumerate(shots(h))]
                except (ValueError, struct.error, IndexError) as e:  # a broken file is a row of its own, not a failed job
                    rows.append((k, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["key", "clip", "start_ms", "end_ms", "frames", "error"], dtype=object)
            yield out.astype({c: "Int64" for c in ("clip", "start_ms", "end_ms", "frames")})

    return files.select(F.col(key).alias("k"), F.col(media).alias("m")).mapInPandas(run, f"key {kind}, clip long, start_ms long, end_ms long, frames long, error string")


def digest(files: DataFrame) -> DataFrame:
    """What the stored files hold, read back: payload, its hashes, the file's hash and the clips as text."""
    bounded_batches(files.sparkSession, 64)
    kind = dict(files.dtypes)["doc_id"]

    def row(m: bytes) -> tuple:
        micros, data, samples = decode(m)
        cut = ";".join(f"{a * micros // 1000}-{(a + n) * micros // 1000}" for a, n in shots(histograms(samples)))
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"frames={len(samples)} mean={samples.mean():.2f} clips={cut}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = pd.DataFrame(map(row, p.pop("media")), columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=p.index)
            yield pd.concat([p, got], axis=1)

    return files.select("doc_id", "n_bytes", "media").mapInPandas(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
