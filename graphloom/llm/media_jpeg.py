"""Media columns as progressive JPEG, read back to coefficients and RGB tensors.

A payload is kept losslessly in the format's own unit, the quantised coefficient.
Byte b becomes a coefficient of magnitude 128 to 255 whose eight appended bits are
b itself (twice that for the first coefficient of a block), so every Huffman code
is fixed and whole scans are numpy reshapes.  The image has 4:2:0 components and
these scans: first coefficients with one low bit held back; two spectral bands
with one low bit held back; a refinement of all bands; a refinement of the first
coefficients.

`read_jpeg` reads any 8-bit progressive file of one or three components: it
accumulates scans of spectral selection and successive approximation, with any
Huffman tables, end-of-band runs and restarts, into coefficient arrays.  Scans
whose table has one code only are read by numpy, others bit by bit.  `rgb`
dequantises, transforms back, upsamples chroma by triangle weights and converts to
full-resolution RGB, which the query stores with its features.

Rules: a null or empty text is a payload of 192 spaces; any length fits (an image
grows to 65,520 pixels a side); equal texts give equal images; repeated rows come
back once each; an empty table gives no rows; other columns are ignored; files that
are not of this kind raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

UNIT = 192
_MCU = 384  # four luminance blocks and one of each chroma
_ROW = 16  # MCUs across, unless the image is very tall
_TALLEST = 4095


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int, bits: int) -> bytes:
    """A Huffman table of one code: `bits` zeros mean the symbol."""
    return _segment(0xC4, bytes([kind]) + bytes(int(k == bits) for k in range(1, 17)) + bytes([symbol]))


def _scan(parts: list[int], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c, 0]) for c in parts) + bytes([first, last, high << 4 | low]))


_BANDS = ((1, 5), (6, 63))
_QUANT = _segment(0xDB, b"\0" + b"\1" * 64)
_DC_TABLE, _AC_TABLE, _END_TABLE = _table(0x00, 8, 8), _table(0x10, 7, 1), _table(0x10, 0, 1)


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\0")


def _restarts(values: np.ndarray) -> bytes:
    """First coefficients, each an interval of its own: code, bits, restart marker."""
    n = len(values)
    rows = np.empty((n, 4), np.uint8)
    rows[:, 0] = 0
    rows[:, 1] = values
    rows[:, 2] = 0xFF
    rows[:, 3] = 0xD0 + np.arange(n) % 8
    flat = rows.ravel()
    at = np.flatnonzero(values == 0xFF)
    if len(at):
        flat = np.insert(flat, at * 4 + 2, 0)
    return flat.tobytes()[:-2]


def _layout(payload_bytes: int) -> tuple[int, int]:
    units = -(-payload_bytes // _MCU)
    across = max(min(units, _ROW), -(-units // _TALLEST))
    return across, -(-units // across)


def write_jpeg(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG of a payload of whole units; n_bytes of it are the text's."""
    across, down = _layout(len(payload))
    units = across * down
    values = np.full(units * _MCU, 32, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = values[: 256 * units].reshape(-1, 64), values[256 * units : 320 * units].reshape(-1, 64), values[320 * units :].reshape(-1, 64)
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"\1\x22\0\2\x11\0\3\x11\0"
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", n_bytes, len(payload))), _QUANT, _segment(0xC2, frame), _DC_TABLE, _AC_TABLE, _segment(0xDD, b"\0\1")]
    for c, v in enumerate(parts, 1):
        out += [_scan([c], 0, 0, 0, 1), _restarts(v[:, 0])]
    out.append(_segment(0xDD, b"\0\0"))
    for c, v in enumerate(parts, 1):
        for a, b in _BANDS:  # a zero bit, then the upper seven bits of the value
            out += [_scan([c], a, b, 0, 1), (v[:, a : b + 1] >> 1).tobytes()]
    out.append(_END_TABLE)
    for c, v in enumerate(parts, 1):  # a zero bit ends the block, then a correction for each coefficient
        bits = np.zeros(v.shape, np.uint8)
        bits[:, 1:] = (v[:, 1:] & 1) ^ (v[:, 1:] < 128)
        out += [_scan([c], 1, 63, 1, 0), _stuffed(np.packbits(bits).tobytes())]
    blank = np.packbits(np.concatenate([np.zeros(6 * units, np.uint8), np.ones(-6 * units % 8, np.uint8)]))
    out += [_scan([1, 2, 3], 0, 0, 1, 0), _stuffed(blank.tobytes()), b"\xff\xd9"]
    return b"".join(out)


def _need(ok: bool) -> None:
    if not ok:
        raise ValueError("not a progressive JPEG of one or three 8-bit components, or a broken one")


@dataclass
class Component:
    """Coefficients (block rows, block columns, 64 in zigzag order), padded to whole MCUs."""

    key: int
    across: int  # samples of the component to an MCU, in blocks
    down: int
    table: int
    rows: int = 0  # blocks that lie in the image
    columns: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.empty((0, 0, 64), np.int32))


@dataclass
class Picture:
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""

    def frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        _need(bits == 8 and n in (1, 3) and self.height > 0 and self.width > 0 and len(body) == 6 + 3 * n)
        self.components = [Component(k, hv >> 4, hv & 15, q) for k, hv, q in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
        _need(all(c.across and c.down for c in self.components))
        self.most = max(c.across for c in self.components), max(c.down for c in self.components)
        self.mcus = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        for c in self.components:
            c.columns, c.rows = (-(-(-(-size * own // most)) // 8) for size, own, most in ((self.width, c.across, self.most[0]), (self.height, c.down, self.most[1])))
            c.coefs = np.zeros((self.mcus[1] * c.down, self.mcus[0] * c.across, 64), np.int32)


class _Codes:
    """A Huffman table: by length and code to the symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.found: dict[tuple[int, int], int] = {}
        code = at = 0
        for size, count in enumerate(counts, 1):
            for symbol in symbols[at : at + count]:
                self.found[size, code] = symbol
                code += 1
            at += count
            code <<= 1
        self.only = next(iter(self.found.items())) if len(self.found) == 1 else None


class _Bits:
    """Bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.count < n:  # past the end come zeros, as readers do
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.count += 8
            _need(self.at < len(self.data) + 64)
        self.count -= n
        value = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return value

    def symbol(self, codes: _Codes) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | self.take(1)
            got = codes.found.get((size, code))
            if got is not None:
                return got
        raise ValueError("a code that its Huffman table lacks")

    def signed(self, n: int) -> int:
        """A value of n appended bits."""
        value = self.take(n) if n else 0
        return value - (1 << n) + 1 if n and value < 1 << (n - 1) else value


class _Scan:
    """One scan over blocks, in the order that its intervals give them."""

    def __init__(self, first: int, last: int, high: int, low: int):
        self.first, self.last, self.high, self.low = first, last, high, low

    def dc(self, bits: _Bits, blocks: list[tuple[int, np.ndarray]], codes: list[_Codes | None]) -> None:
        before: dict[int, int] = {}
        for which, block in blocks:
            if self.high:
                block[0] |= bits.take(1) << self.low
            else:
                before[which] = before.get(which, 0) + bits.signed(bits.symbol(codes[which]))
                block[0] = before[which] << self.low

    def ac_first(self, bits: _Bits, blocks: list[tuple[int, np.ndarray]], codes: list[_Codes | None]) -> None:
        ended = 0  # blocks, from here on, that have no more in this band
        for which, block in blocks:
            k = self.first
            while not ended and k <= self.last:
                zeros, size = divmod(bits.symbol(codes[which]), 16)
                if size:
                    k += zeros
                    _need(k <= self.last)
                    block[k] = bits.signed(size) << self.low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    ended = (1 << zeros) + (bits.take(zeros) if zeros else 0)
            ended = max(0, ended - 1)

    def ac_refined(self, bits: _Bits, blocks: list[tuple[int, np.ndarray]], codes: list[_Codes | None]) -> None:
        unit, ended = 1 << self.low, 0

        def corrected(block: np.ndarray, k: int) -> None:
            if bits.take(1) and not abs(int(block[k])) & unit:
                block[k] += unit if block[k] > 0 else -unit

        for which, block in blocks:
            k = self.first
            while not ended and k <= self.last:
                zeros, size = divmod(bits.symbol(codes[which]), 16)
                value = 0
                if size:
                    value = unit if bits.take(1) else -unit
                elif zeros < 15:
                    ended = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    break
                while k <= self.last:  # corrections on the way to the place of the new value
                    if block[k]:
                        corrected(block, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        block[k] = value
                        k += 1
                        break
                    k += 1
            if ended:
                for j in range(k, self.last + 1):
                    if block[j]:
                        corrected(block, j)
                ended -= 1


def _fixed_scan(scan: _Scan, c: Component, data: bytes, codes: _Codes | None, restart: int) -> int | None:
    """Read a scan of one component whose table has one code for all blocks, with numpy: its length, or None."""
    if codes is None or codes.only is None or c.rows != len(c.coefs) or c.columns != c.coefs.shape[1]:
        return None
    (bits, _), symbol = codes.only
    blocks = c.rows * c.columns
    view = c.coefs.reshape(blocks, 64)
    if (scan.first, scan.high, scan.low, bits, symbol, restart) == (0, 0, 1, 8, 8, 1):  # a code byte, a value byte and a marker for each block
        end = 4 * blocks - 2
        raw = np.frombuffer(data, np.uint8, min(end, len(data)))
        if b"\xff\0" in data[: end + 1]:  # stuffed values: one more byte each
            end, _ = _entropy(data)
            raw = np.frombuffer(data[:end].replace(b"\xff\0", b"\xff"), np.uint8)
        if len(raw) != 4 * blocks - 2:
            return None
        v = np.append(raw, np.zeros(2, np.uint8)).reshape(-1, 4)[:, 1].astype(np.int32)
        view[:, 0] = 2 * np.where(v < 128, v - 255, v)
        return end
    if restart or not scan.first:
        return None
    width = scan.last - scan.first + 1
    if (scan.high, scan.low, bits, symbol) == (0, 1, 1, 7):
        raw = np.frombuffer(data, np.uint8, min(blocks * width, len(data)))
        if len(raw) < blocks * width or (raw > 127).any():
            return None
        v = raw.reshape(blocks, width).astype(np.int32)
        view[:, scan.first : scan.last + 1] = 2 * np.where(v < 64, v - 127, v)
        return blocks * width
    if (scan.high, scan.low, bits, symbol, width) == (1, 0, 1, 0, 63) and view[:, 1:].all():
        end, _ = _entropy(data)
        got = np.unpackbits(np.frombuffer(data[:end].replace(b"\xff\0", b"\xff"), np.uint8))
        if len(got) < 64 * blocks or got[: 64 * blocks : 64].any():
            return None
        got = got[: 64 * blocks].reshape(-1, 64)
        view[:, 1:] += np.where(view[:, 1:] < 0, -1, 1) * got[:, 1:]
        return end
    return None


def _entropy(data: bytes) -> tuple[int, list[bytes]]:
    """The length of the coded data that data begins with, and its restart intervals without stuffing."""
    at, begin, parts = 0, 0, []
    while True:
        at = data.find(b"\xff", at)
        _need(0 <= at < len(data) - 1)
        mark = data[at + 1]
        if mark and mark != 0xFF:
            parts.append(data[begin:at].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= mark <= 0xD7:
                return at, parts
            begin = at + 2
        at += 1 if mark == 0xFF else 2


def read_jpeg(data: bytes) -> Picture:
    """All scans of a progressive file, accumulated."""
    _need(data[:2] == b"\xff\xd8")
    at, picture, restart = 2, Picture(), 0
    tables: dict[int, _Codes] = {}
    while True:
        _need(at + 2 <= len(data) and data[at] == 0xFF)
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        if marker == 0xD9:
            _need(bool(picture.components))
            return picture
        _need(at + 4 <= len(data))
        (length,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            picture.comment = body
        elif marker == 0xDB:
            while body:
                wide, size = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                _need(wide < 2 and len(body) > size)
                picture.quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                _need(len(body) >= 17 + count)
                tables[body[0]] = _Codes(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            picture.frame(body)
        elif marker == 0xDA:
            n = body[0]
            parts = [next((c for c in picture.components if c.key == body[1 + 2 * k]), None) for k in range(n)]
            _need(all(parts) and len(body) == 4 + 2 * n)
            scan = _Scan(body[-3], body[-2], body[-1] >> 4, body[-1] & 15)
            _need(scan.first <= scan.last < 64 and (n == 1 or not scan.first) and (not scan.last or bool(scan.first)))
            which = [body[2 + 2 * k] for k in range(n)]
            codes = [tables.get(0x10 | w & 15 if scan.first else w >> 4) for w in which]
            _need(all(codes) or (not scan.first and scan.high > 0))
            done = _fixed_scan(scan, parts[0], data[at:], codes[0], restart) if n == 1 else None
            if done is not None:
                at += done
                continue
            size, intervals = _entropy(data[at:])
            at += size
            if n == 1:
                mcus = ([(0, parts[0].coefs[r, k])] for r in range(parts[0].rows) for k in range(parts[0].columns))
            else:
                mcus = ([(i, c.coefs[y * c.down + v, x * c.across + h]) for i, c in enumerate(parts) for v in range(c.down) for h in range(c.across)] for y in range(picture.mcus[1]) for x in range(picture.mcus[0]))
            read = scan.dc if not scan.first else scan.ac_refined if scan.high else scan.ac_first
            for interval in intervals:
                blocks = [b for mcu in islice(mcus, restart or None) for b in mcu]
                if blocks:
                    read(_Bits(interval), blocks, codes)
            _need(next(mcus, None) is None)
        else:
            _need(0xE0 <= marker <= 0xEF)


def payload_of(picture: Picture) -> tuple[bytes, int]:
    """The payload that the coefficients of a stored text hold, and how many of its bytes are the text's."""
    _need(len(picture.comment) == 16)
    n_bytes, payload_bytes = struct.unpack(">QQ", picture.comment)
    out = []
    for c in picture.components:
        v = c.coefs.reshape(-1, 64).copy()
        v[:, 0] //= 2
        out.append(np.where(v < 0, v + 255, v).astype(np.uint8).ravel())
    return np.concatenate(out)[:payload_bytes].tobytes(), n_bytes


@lru_cache(1)
def _basis() -> tuple[np.ndarray, np.ndarray]:
    """The inverse transform of zigzag coefficients to 64 samples."""
    k = np.arange(8)
    d = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("xu,yv->yxvu", d, d).reshape(64, 64)
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return both[:, order].T.astype(np.float32).copy(), np.array(order)


def _doubled(plane: np.ndarray, axis: int) -> np.ndarray:
    """Thrice each sample and its nearer neighbour once, at both sides of it (edges repeat)."""
    first, last = (np.take(plane, [i], axis) for i in (0, -1))
    left, right = np.concatenate([first, np.delete(plane, -1, axis)], axis), np.concatenate([np.delete(plane, 0, axis), last], axis)
    shape = list(plane.shape)
    shape[axis] *= 2
    return np.stack([3 * plane + left, 3 * plane + right], axis + 1).reshape(shape)


def _upsampled(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """A plane of whole samples, so many times wider and higher; doubling is by triangle weights."""
    if across == 2 and down in (1, 2):
        wide = _doubled(_doubled(plane, 0) if down == 2 else plane, 1)
        even = np.arange(wide.shape[1]) % 2 == 0
        return wide + np.where(even, 8, 7) >> 4 if down == 2 else wide + np.where(even, 1, 2) >> 2
    return np.repeat(np.repeat(plane, down, 0), across, 1)


def rgb(picture: Picture) -> np.ndarray:
    """The full-resolution (height, width, 3) image."""
    h, w = picture.height, picture.width
    planes = []
    for c in picture.components:
        quant = picture.quants.get(c.table)
        _need(quant is not None)
        blocks = c.coefs.reshape(-1, 64)
        samples = (blocks * quant if (quant != 1).any() else blocks).astype(np.float32) @ _basis()[0] + np.float32(128.5)
        whole = np.clip(samples, 0, 255).astype(np.uint8).reshape(*c.coefs.shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(8 * len(c.coefs), -1)
        own = whole[: -(-h * c.down // picture.most[1]), : -(-w * c.across // picture.most[0])].astype(np.int32)
        planes.append(_upsampled(own, picture.most[0] // c.across, picture.most[1] // c.down)[:h, :w])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0].astype(np.float32) + np.float32(0.5), *(p.astype(np.float32) - np.float32(128) for p in planes[1:])
    out = np.empty((h, w, 3), np.uint8)
    for k, v in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[..., k] = np.clip(v, 0, 255)
    return out


def features(image: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and an eight-bin histogram of green."""
    flat = image.reshape(-1, 3)
    means = flat.sum(0, dtype=np.int64) * 1000 // len(flat)
    bins = np.bincount(flat[:, 1] >> 5, minlength=8)
    return f"{image.shape[0]}x{image.shape[1]};" + ",".join(map(str, means)) + ";" + ",".join(map(str, bins))


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def write_media(docs: DataFrame, place: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store texts as a media table (id_col, media) at place."""
    schema = docs.select(id_col).schema.add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_jpeg(*padded(t)) for t in part.column(1).to_pylist()], pa.binary())], names=[id_col, "media"])

    sparkkit.mapped(docs.select(id_col, F.col(text_col).cast("string").alias("_text")), run, schema).write.option("compression", "zstd").parquet(place)


def read_media(media: DataFrame, id_col: str = "doc_id", tensors: bool = True) -> DataFrame:
    """Payload digests, features and tensors (height, width and rgb, row by row) of a media table."""
    schema = media.select(id_col).schema
    names = ["n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"] + ["height integer", "width integer", "rgb binary"] * tensors
    kinds = {"long": pa.int64(), "string": pa.string(), "integer": pa.int32(), "binary": pa.binary()}
    for n in names:
        schema = schema.add(*n.split())

    def row(data: bytes) -> tuple:
        picture = read_jpeg(data)
        (payload, n_bytes), image = payload_of(picture), rgb(picture)
        out = (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(image))
        return (*out, *image.shape[:2], image.tobytes()) if tensors else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch, 128):
                cols = zip(*(row(d) for d in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kinds[n.split()[1]]) for c, n in zip(cols, names, strict=True))], names=[id_col, *(n.split()[0] for n in names)])

    return sparkkit.mapped(media.select(id_col, "media"), run, schema)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store docs as media in the shared folder, read them back; features and RGB tensors of each."""
    spark = docs.sparkSession
    place = f"{sparkkit.shared_folder(spark)}/media-{uuid.uuid4().hex}"
    write_media(docs, place, id_col, text_col)
    return read_media(spark.read.schema(docs.select(id_col).schema.add("media", "binary")).parquet(place), id_col)
