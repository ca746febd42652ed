"""Decoders of image files' bytes to numpy arrays (t, z, y, x): TIFF, NIfTI-1, DICOM and OME-Zarr chunks.

Classic and big TIFF in strips or tiles, uncompressed, deflated, LZW or PackBits; little-endian DICOM, plain, run-length encoded or lossless JPEG, nested
sequences skipped; Zarr v2, raw or by zlib, gzip, LZ4, Zstandard or Blosc.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# fixed values: TIFF tags and sample formats, NIfTI and DICOM codes
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _STRIPS, _ROWS, _COUNTS, _PREDICTOR, _TILE_W, _TILE_H, _TILES, _TILE_COUNTS, _FORMAT = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339
_TIFF_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
# plain (implicit, explicit) and packed (run lengths, lossless JPEG) transfer syntaxes
_DICOM_PLAIN = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1")
_DICOM_PACKED = ("1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70")
_LONG_VR = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN")


#: Reads size bytes from a place in a file.
Read = Callable[[int, int], bytes]


def tiff_pages(read: Read) -> Iterator[tuple[dict, str]]:
    """Each page's tags and byte order; reads headers and tags only."""
    head = read(0, 16)
    order = "<" if head[:2] == b"II" else ">"
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # classic files count and point with 4 bytes, big ones with 8
    word, wide, first, entry = ("Q", 8, "Q", 20) if magic == 43 else ("I", 4, "H", 12)
    at = struct.unpack(order + word, head[8:16] if magic == 43 else head[4:8])[0]
    while at:
        start = at + struct.calcsize(first)
        n = struct.unpack(order + first, read(at, start - at))[0]
        listed = read(start, entry * n + wide)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, listed, entry * k)
            raw = listed[entry * (k + 1) - wide : entry * (k + 1)]
            code, size = _TIFF_TYPES.get(kind, ("B", 1))
            if size * count > wide:
                raw = read(struct.unpack(order + word, raw)[0], size * count)
            tags[tag] = struct.unpack(order + code * count, raw[: size * count])
        at = struct.unpack(order + word, listed[entry * n :])[0]
        yield tags, order


def tiff(data: bytes) -> np.ndarray:
    """All pages of the first page's shape, as slices."""
    pages = [_tiff_page(data, TiffLayout.of(tags, order)) for tags, order in tiff_pages(lambda at, n: data[at : at + n])]
    return np.stack([p for p in pages if p.shape == pages[0].shape])[None]


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: a byte n below 128 is followed by n + 1 literal bytes, one above by a byte that stands 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first, widened one code early; 256 clears the table, 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = []
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length())) if len(table) + 1 >= 1 << width else width
    return b"".join(out)


#: By the compression tag.
_UNPACK = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}


@dataclass(frozen=True)
class TiffLayout:
    """How a page's cells lie in the file: blocks are tiles, or strips as wide as the page."""

    height: int
    width: int
    dtype: str
    packing: int
    predictor: int
    block_height: int
    block_width: int
    tiled: bool
    places: tuple[int, ...]
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, tags: dict, order: str) -> TiffLayout:
        w, h = tags[_WIDTH][0], tags[_LENGTH][0]
        dtype = order + {1: "u", 2: "i", 3: "f"}[tags.get(_FORMAT, (1,))[0]] + str(tags.get(_BITS, (8,))[0] // 8)
        tiled = _TILES in tags
        bw, bh = (tags[_TILE_W][0], tags[_TILE_H][0]) if tiled else (w, min(h, tags.get(_ROWS, (h,))[0]))
        places, sizes = (tags[_TILES], tags[_TILE_COUNTS]) if tiled else (tags[_STRIPS], tags[_COUNTS])
        return cls(h, w, dtype, tags.get(_COMPRESSION, (1,))[0], tags.get(_PREDICTOR, (1,))[0], bh, bw, tiled, places, sizes)

    def box(self, k: int) -> tuple[int, int, int, int]:
        """y, x, height and width of a block's cells in the page."""
        across = -(-self.width // self.block_width)
        y, x = k // across * self.block_height, k % across * self.block_width
        return y, x, min(self.block_height, self.height - y), min(self.block_width, self.width - x)


def tiff_cells(data: bytes, dtype: str, packing: int, predictor: int, width: int, rows: int, across: int) -> np.ndarray:
    """A block's rows, of which the first `across` cells of width lie in the page."""
    if packing not in _UNPACK:
        raise ValueError(f"TIFF compression {packing} is not supported")
    cells = np.frombuffer(_UNPACK[packing](data), dtype=dtype, count=rows * width).reshape(rows, width)
    if predictor == 2:
        cells = np.cumsum(cells, axis=1, dtype=dtype)
    return cells[:, :across]


def _tiff_page(data: bytes, page: TiffLayout) -> np.ndarray:
    image = np.zeros((page.height, page.width), dtype=np.dtype(page.dtype).newbyteorder("="))
    for k, (start, size) in enumerate(zip(page.places, page.sizes, strict=True)):
        y, x, rows, across = page.box(k)
        image[y : y + rows, x : x + across] = tiff_cells(data[start : start + size], page.dtype, page.packing, page.predictor, page.block_width, rows, across)
    return image


@dataclass(frozen=True)
class NiftiLayout:
    """A volume's header: (t, z, y, x), the kind of its numbers, where they begin, slope and intercept."""

    shape: tuple[int, int, int, int]
    dtype: str
    start: int
    slope: float
    intercept: float

    @classmethod
    def of(cls, head: bytes) -> NiftiLayout:
        order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
        dim = struct.unpack(order + "8h", head[40:56])
        code = struct.unpack(order + "h", head[70:72])[0]
        start, slope, intercept = struct.unpack(order + "3f", head[108:120])
        shape = [max(1, dim[k]) if k <= dim[0] else 1 for k in range(1, 5)]
        return cls(tuple(shape[::-1]), order + _NIFTI[code], int(start), slope, intercept)


def scaled(values: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    return values * slope + intercept if slope and (slope, intercept) != (1, 0) else values


def nifti(data: bytes) -> np.ndarray:
    """A single-file volume, scaled by its slope and intercept."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    v = NiftiLayout.of(data[:352])
    return scaled(np.frombuffer(data, dtype=v.dtype, count=int(np.prod(v.shape)), offset=v.start).reshape(v.shape), v.slope, v.intercept)


def _after_items(data: bytes, at: int, explicit: bool) -> int:
    """Where a sequence of undefined length ends: behind its items, whose own elements may hold further sequences."""
    while at + 8 <= len(data):
        tag, size = struct.unpack_from("<HHI", data, at)[:2], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if tag == (0xFFFE, 0xE0DD):
            return at
        if tag == (0xFFFE, 0xE000) and size != 0xFFFFFFFF:
            at += size
            continue
        while at + 8 <= len(data) and struct.unpack_from("<HH", data, at) != (0xFFFE, 0xE00D):
            kind = data[at + 4 : at + 6]
            long = not explicit or kind in _LONG_VR
            size = struct.unpack_from("<I", data, at + (8 if explicit else 4))[0] if long else struct.unpack_from("<H", data, at + 6)[0]
            at += 12 if explicit and long else 8
            at = _after_items(data, at, explicit) if size == 0xFFFFFFFF else at + size
        at += 8
    return at


def _dicom_tags(data: bytes) -> dict[tuple[int, int], bytes]:
    """Elements of the data set itself, those of nested sequences left out."""
    at = 132 if data[128:132] == b"DICM" else 0
    found: dict[tuple[int, int], bytes] = {}
    explicit = True
    while at + 8 <= len(data):
        tag = struct.unpack("<HH", data[at : at + 4])
        if (explicit or tag[0] == 2) and data[at + 4 : at + 6].isalpha():
            long = data[at + 4 : at + 6] in _LONG_VR
            size = struct.unpack("<I", data[at + 8 : at + 12])[0] if long else struct.unpack("<H", data[at + 6 : at + 8])[0]
            at += 12 if long else 8
        else:
            size = struct.unpack("<I", data[at + 4 : at + 8])[0]
            at += 8
        if size == 0xFFFFFFFF:
            start, at = at, _after_items(data, at, explicit)
            if tag == (0x7FE0, 0x10):
                found[tag] = data[start:at]
            continue
        found[tag] = data[at : at + size]
        if tag == (2, 0x10):
            syntax = found[tag].rstrip(b"\0 ").decode()
            if syntax not in (*_DICOM_PLAIN, *_DICOM_PACKED):
                raise ValueError(f"DICOM transfer syntax {syntax} is not supported")
            explicit = syntax != _DICOM_PLAIN[0]
        at += size
    return found


def _dicom_shape(found: dict[tuple[int, int], bytes]) -> tuple[int, int, int, int]:
    short = lambda tag: struct.unpack("<H", found[tag][:2])[0]
    return 1, int(found.get((0x28, 8), b"1").strip(b"\0 ")), short((0x28, 0x10)), short((0x28, 0x11))


def dicom_shape(data: bytes) -> tuple[int, int, int, int]:
    """(t, z, y, x) of an image; frames are slices."""
    return _dicom_shape(_dicom_tags(data))


def _fragments(data: bytes) -> list[bytes]:
    """Items of encapsulated pixel data, the table of offsets left out."""
    found, at = [], 0
    while at + 8 <= len(data) and struct.unpack_from("<HH", data, at) == (0xFFFE, 0xE000):
        size = struct.unpack_from("<I", data, at + 4)[0]
        found.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return found[1:]


def run_length_frame(data: bytes, width: int) -> bytes:
    """A frame of DICOM's run-length encoding: a segment of packed bytes for each byte of a cell, the highest first."""
    n, *starts = struct.unpack_from("<16I", data)
    if n != width:
        raise ValueError(f"{n} segments for cells of {width} bytes")
    ends = [*starts[1:n], len(data)]
    planes = [np.frombuffer(unpacked_bits(data[a:b]), dtype=np.uint8) for a, b in zip(starts[:n], ends, strict=True)]
    least = min(map(len, planes))
    return np.stack([p[:least] for p in planes[::-1]], axis=1).tobytes()


class _Bits:
    """Bits of a JPEG scan, high ones first; a zero byte after 255 is stuffing."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 2 if byte == 255 and self.data[self.at + 1 : self.at + 2] == b"\0" else 1
            self.held, self.n = (self.held << 8 | byte) & 0xFFFFFFFFFF, self.n + 8
        return self.held >> self.n - n & (1 << n) - 1

    def take(self, n: int) -> int:
        v = self.peek(n)
        self.n -= n
        return v


def lossless_jpeg(data: bytes) -> np.ndarray:
    """A frame of one component of lossless JPEG (Huffman codes of the differences from a predictor)."""
    at, codes, shape, bits = 2, {}, (0, 0), 8
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            bits, shape = body[0], struct.unpack_from(">HH", body, 1)
            if body[5] != 1:
                raise ValueError("lossless JPEG of several components is not supported")
        elif marker in (0xC0, 0xC1, 0xC2):
            raise ValueError("lossy JPEG is not supported")
        elif marker == 0xC4:
            counts, values, code = body[1:17], iter(body[17:]), 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[length, code] = next(values)
                    code += 1
                code <<= 1
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals of lossless JPEG are not supported")
        elif marker == 0xDA:
            predictor, shift = body[3], body[5] & 15
            break
    # all codes of up to 16 bits, by the bits that come next
    table = np.zeros(1 << 16, dtype=np.int32)
    for (length, code), value in codes.items():
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | value
    known, scan = table.tolist(), _Bits(data[at:])
    h, w = shape
    out, above = np.zeros((h, w), dtype=np.int64), [1 << bits - shift - 1] * w
    foretold = {1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + (b - c >> 1), 6: lambda a, b, c: b + (a - c >> 1), 7: lambda a, b, c: a + b >> 1}[predictor]
    for y in range(h):
        row: list[int] = []
        for x in range(w):
            # the first row is foretold from the left, and each row's first cell from above
            guess = above[0] if not x else row[-1] if not y else foretold(row[-1], above[x], above[x - 1])
            told = known[scan.peek(16)]
            scan.n -= told >> 8
            k = told & 255
            step = 0 if not k else 32768 if k == 16 else scan.take(k)
            row.append((guess + (step if k in (0, 16) or step >> k - 1 else step - (1 << k) + 1)) & 0xFFFF)
        out[y], above = row, row
    return out << shift


def dicom(data: bytes) -> np.ndarray:
    """A little-endian image, plain, run-length encoded or of lossless JPEG, rescaled by its slope and intercept. Frames are decoded one by one."""
    found = _dicom_tags(data)
    number = lambda tag, default: float(found[tag].strip(b"\0 ")) if tag in found else default
    short = lambda tag, default: struct.unpack("<H", found[tag][:2])[0] if tag in found else default
    shape = _dicom_shape(found)
    dtype = ("<i" if short((0x28, 0x103), 0) else "<u") + str(short((0x28, 0x100), 16) // 8)
    syntax, cells = found.get((2, 0x10), b"").rstrip(b"\0 ").decode(), found[0x7FE0, 0x10]
    if syntax in _DICOM_PACKED:
        parts = _fragments(cells)
        if len(parts) != shape[1]:
            # a frame in several fragments
            parts = [b"".join(parts)] if shape[1] == 1 else parts
        if len(parts) != shape[1]:
            raise ValueError(f"{len(parts)} fragments for {shape[1]} frames")
        cells = b"".join(run_length_frame(p, np.dtype(dtype).itemsize) if syntax == _DICOM_PACKED[0] else lossless_jpeg(p).astype(dtype).tobytes() for p in parts)
    values = np.frombuffer(cells, dtype=dtype, count=int(np.prod(shape))).reshape(shape)
    return scaled(values, number((0x28, 0x1053), 1.0), number((0x28, 0x1052), 0.0))


def _unshuffled(data: bytes, width: int, bits: bool) -> bytes:
    """Undoes Blosc's shuffles: bytes (or bits) of equal place in their elements stand together. What is left behind whole elements stays."""
    n = len(data) // width
    cells = np.frombuffer(data, dtype=np.uint8, count=n * width)
    if not bits:
        return cells.reshape(width, n).T.tobytes() + data[n * width :]
    if n % 8:
        return data
    return np.packbits(np.unpackbits(cells, bitorder="little").reshape(width * 8, n).T, bitorder="little").tobytes() + data[n * width :]


#: By the number in a Blosc header.
_BLOSC = {0: "blosclz", 1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def _unpacked(kind: str, data: bytes, size: int) -> bytes:
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "blosclz":
        raise ValueError("Blosc's own codec blosclz is not supported")
    return pa.Codec(kind).decompress(data, size).to_pybytes()


def blosc(data: bytes) -> bytes:
    """A Blosc container (version 1): blocks of LZ4, Snappy, zlib or Zstandard, shuffled by bytes or bits or not at all."""
    _, _, flags, width, size, block, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 2:
        return data[16 : 16 + size]
    kind = _BLOSC[flags >> 5]
    out = []
    for k, at in enumerate(struct.unpack_from(f"<{-(-size // block)}I", data, 16)):
        n = min(block, size - k * block)
        # a whole block may be split into streams, one for each byte of an element
        streams = width if not flags & 16 and n == block and width <= 16 and block // width >= 128 else 1
        cells = []
        for _ in range(streams):
            packed = struct.unpack_from("<i", data, at)[0]
            raw = data[at + 4 : at + 4 + packed]
            cells.append(raw if packed == n // streams else _unpacked(kind, raw, n // streams))
            at += 4 + packed
        joined = b"".join(cells)
        out.append(_unshuffled(joined, width, bool(flags & 4)) if flags & 5 and width > (0 if flags & 4 else 1) else joined)
    return b"".join(out)


def zarr_chunk(data: bytes, meta: str) -> np.ndarray:
    """A chunk of a Zarr v2 array, by the array's .zarray text."""
    m = json.loads(meta)
    how = (m.get("compressor") or {}).get("id")
    size = int(np.prod(m["chunks"])) * np.dtype(m["dtype"]).itemsize
    known = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "blosc": blosc, "zstd": lambda d: _unpacked("zstd", d, size), "lz4": lambda d: _unpacked("lz4_raw", d[4:], struct.unpack_from("<I", d)[0])}
    if how not in known:
        raise ValueError(f"Zarr compressor {how} is not supported")
    if m.get("filters"):
        raise ValueError("Zarr filters are not supported")
    return np.frombuffer(known[how](data), dtype=m["dtype"]).reshape(m["chunks"], order=m.get("order", "C"))


#: By the file name's ending, longest first.
DECODERS = {".ome.tiff": tiff, ".ome.tif": tiff, ".nii.gz": nifti, ".tiff": tiff, ".tif": tiff, ".nii": nifti, ".dcm": dicom, ".dicom": dicom}


def decode(path: str, data: bytes) -> np.ndarray:
    """An image file's array (t, z, y, x)."""
    for ending, decoder in DECODERS.items():
        if path.lower().endswith(ending):
            return decoder(data)
    raise ValueError(f"no decoder for {path}")
