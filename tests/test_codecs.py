"""Blosc containers and packed DICOM frames, made by hand."""

import json
import struct

import numpy as np
import pyarrow as pa
import pytest

from roiforge.sources import formats
from tests.test_sources import packed_bits


def shuffled(data: bytes, width: int, bits: bool) -> bytes:
    n = len(data) // width
    cells = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    if bits:
        return data if n % 8 else np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, bitorder="little").tobytes() + data[n * width :]
    return cells.T.tobytes() + data[n * width :]


def contained(data: bytes, width: int, block: int, codec: str, shuffle: int, split: bool = True) -> bytes:
    """A container as the format's description has it."""
    number = {"lz4_raw": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec]
    starts, body, n = [], b"", -(-len(data) // block)
    for k in range(0, len(data), block):
        starts.append(16 + 4 * n + len(body))
        part = data[k : k + block]
        cells = shuffled(part, width, shuffle == 4) if shuffle else part
        streams = width if split and len(part) == block and block // width >= 128 else 1
        for j in range(streams):
            raw = cells[j * len(cells) // streams : (j + 1) * len(cells) // streams]
            packed = __import__("zlib").compress(raw) if codec == "zlib" else pa.Codec(codec).compress(raw).to_pybytes()
            packed = raw if len(packed) >= len(raw) else packed
            body += struct.pack("<i", len(packed)) + packed
    flags = shuffle | number << 5 | (0 if split else 16)
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), block, 16 + 4 * n + len(body)) + struct.pack(f"<{n}I", *starts) + body


@pytest.mark.parametrize("codec", ["lz4_raw", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("shuffle", [0, 1, 4])
def test_blosc(codec, shuffle):
    rng = np.random.default_rng(1)
    for image in ((np.arange(6000) // 5).reshape(1, 1, 1, 60, 100).astype("<u2"), rng.integers(0, 9, (1, 1, 2, 50, 41)).astype("<i4"), rng.random((1, 1, 1, 31, 37)).astype("<f8"), np.zeros((1, 1, 1, 64, 64), np.uint8)):
        for split in (True, False):
            data = contained(image.tobytes(), image.dtype.itemsize, 4096, codec, shuffle, split)
            meta = json.dumps({"compressor": {"id": "blosc"}, "chunks": image.shape, "dtype": image.dtype.str})
            assert np.array_equal(formats.zarr_chunk(data, meta), image), (image.dtype, split)


def test_other_chunks():
    image = np.arange(20, dtype="<u2").reshape(1, 1, 1, 4, 5)
    raw = image.tobytes()
    meta = lambda how, **more: json.dumps({"compressor": {"id": how} if how else None, "chunks": image.shape, "dtype": "<u2", **more})
    assert np.array_equal(formats.zarr_chunk(struct.pack("<BBBBIII", 2, 1, 2, 2, len(raw), len(raw), 16 + len(raw)) + raw, meta("blosc")), image)
    assert np.array_equal(formats.zarr_chunk(pa.Codec("zstd").compress(raw).to_pybytes(), meta("zstd")), image)
    assert np.array_equal(formats.zarr_chunk(struct.pack("<I", len(raw)) + pa.Codec("lz4_raw").compress(raw).to_pybytes(), meta("lz4")), image)
    for how, more, said in (("bz2", {}, "bz2"), (None, {"filters": [{"id": "delta"}]}, "filters")):
        with pytest.raises(ValueError, match=said):
            formats.zarr_chunk(raw, meta(how, **more))
    with pytest.raises(ValueError, match="blosclz"):
        formats.zarr_chunk(struct.pack("<BBBBIII", 2, 1, 0, 2, 40, 40, 30) + struct.pack("<Ii", 20, 4) + b"abcd", meta("blosc"))


def encapsulated(frames: list[bytes], syntax: bytes, shape: tuple[int, int], signed: bool = False, bits: int = 16) -> bytes:
    us = lambda g, e, v: struct.pack("<HH2sHH", g, e, b"US", 2, v)
    syntax += b"\0" * (len(syntax) % 2)
    frames = [f + b"\0" * (len(f) % 2) for f in frames]
    count = str(len(frames)).encode().ljust(2)
    items = struct.pack("<HHI", 0xFFFE, 0xE000, 0) + b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(f)) + f for f in frames) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    head = b"\0" * 128 + b"DICM" + struct.pack("<HH2sH", 2, 0x10, b"UI", len(syntax)) + syntax
    return head + struct.pack("<HH2sH", 0x28, 8, b"IS", len(count)) + count + us(0x28, 0x10, shape[0]) + us(0x28, 0x11, shape[1]) + us(0x28, 0x100, bits) + us(0x28, 0x103, int(signed)) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF) + items


def run_lengths(image: np.ndarray) -> bytes:
    planes = image.astype(image.dtype.newbyteorder(">")).tobytes()
    width = image.dtype.itemsize
    segments = [packed_bits(planes[k::width]) for k in range(width)]
    starts = np.cumsum([64, *map(len, segments)])[:width]
    return struct.pack("<16I", width, *starts, *[0] * (15 - width)) + b"".join(segments)


def lossless(image: np.ndarray, predictor: int, bits: int = 16) -> bytes:
    """Every category has a code of five bits: its own number."""
    cells = image.astype(int).tolist()
    out = ""
    for y, row in enumerate(cells):
        for x, v in enumerate(row):
            a, b, c = row[x - 1] if x else 0, cells[y - 1][x] if y else 0, cells[y - 1][x - 1] if x and y else 0
            if not x:
                guess = b if y else 1 << bits - 1
            elif not y:
                guess = a
            else:
                guess = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + (b - c >> 1), 6: b + (a - c >> 1), 7: a + b >> 1}[predictor]
            d = (v - guess + 32768) % 65536 - 32768
            d = 32768 if d == -32768 else d
            k = abs(d).bit_length()
            out += format(k, "05b") + ("" if k in (0, 16) else format(d if d > 0 else d + (1 << k) - 1, f"0{k}b"))
    out += "1" * (-len(out) % 8)
    scan = bytes(int(out[k : k + 8], 2) for k in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")
    segment = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    counts = bytes([0, 0, 0, 0, 17] + [0] * 11)
    return b"\xff\xd8" + segment(0xC3, struct.pack(">BHHB3B", bits, *image.shape, 1, 1, 17, 0)) + segment(0xC4, b"\0" + counts + bytes(range(17))) + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + scan + b"\xff\xd9"


def test_run_length_dicom():
    rng = np.random.default_rng(2)
    frames = [np.repeat(rng.integers(-900, 900, (12, 5)), 4, axis=1).astype("<i2") for _ in range(3)]
    data = encapsulated([run_lengths(f) for f in frames], b"1.2.840.10008.1.2.5", (12, 20), signed=True)
    assert np.array_equal(formats.decode("a.dcm", data)[0], frames) and formats.dicom_shape(data) == (1, 3, 12, 20)
    small = rng.integers(0, 255, (6, 9)).astype(np.uint8)
    assert np.array_equal(formats.decode("a.dcm", encapsulated([run_lengths(small)], b"1.2.840.10008.1.2.5", (6, 9), bits=8))[0, 0], small)


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg_dicom(predictor):
    rng = np.random.default_rng(predictor)
    frames = [np.cumsum(rng.integers(-40, 45, (15, 18)), axis=1).astype("<u2"), rng.integers(0, 65536, (15, 18)).astype("<u2")]
    frames[1][3, 4], frames[1][3, 5] = 0, 32768
    data = encapsulated([lossless(f, predictor) for f in frames], b"1.2.840.10008.1.2.4.70", (15, 18))
    assert np.array_equal(formats.decode("a.dcm", data)[0], frames)


def test_other_syntaxes_are_named():
    with pytest.raises(ValueError, match=r"1\.2\.840\.10008\.1\.2\.4\.90"):
        formats.decode("a.dcm", encapsulated([b"xx"], b"1.2.840.10008.1.2.4.90", (1, 1)))
