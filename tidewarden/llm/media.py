"""Media columns: Netpbm and BMP images decoded to numpy, resized by area, tiled and hashed.

`text_media` stores the UTF-8 bytes of a text, padded with blanks to a positive
multiple of 192, as the samples of a 64 pixel wide RGB image: an odd number of
image rows makes a binary Netpbm (P6) file, an even number a top-down 24 bit BMP.
`media_features` reads any column of such files back: it decodes the samples,
area-resizes through an integral image, and returns an NPY tile and a
difference hash. Both work row by row within Arrow batches, without a shuffle.

A row takes about four times its payload of memory: the integral image is kept
only at the rows where cells of the grids begin or end.

Defined results: a null text counts as empty (one image row of blanks); null or
undecodable media (cut short, sizes or samples out of range, unknown packing) give a
row with null outputs; repeated rows and ties give equal rows; an empty table gives none; only the named columns are read, so
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewarden.llm.common import sliced

WIDTH = 64
LUMA = np.array([0.299, 0.587, 0.114])


def encode_netpbm(samples: bytes, width: int) -> bytes:
    """RGB samples, row by row, as a P6 file."""
    return b"P6\n%d %d\n255\n" % (width, len(samples) // (3 * width)) + samples


def encode_bmp(samples: bytes, width: int) -> bytes:
    """The same as a top-down 24 bit BMP; each sample triple is stored blue first."""
    rows = len(samples) // (3 * width)
    pixels = np.frombuffer(samples, np.uint8).reshape(rows, width, 3)[:, :, ::-1]
    stride = -(-3 * width // 4) * 4
    out = np.zeros((rows, stride), np.uint8)
    out[:, : 3 * width] = pixels.reshape(rows, -1)
    size = rows * stride
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + size, 0, 0, 54, 40, width, -rows, 1, 24, 0, size, 2835, 2835, 0, 0) + out.tobytes()


def _header(data: bytes, count: int, start: int) -> tuple[list[int], int]:
    """`count` decimal fields of a Netpbm header and the place behind them; # starts a comment."""
    fields, i = [], start
    while len(fields) < count:
        while i < len(data) and data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            while i < len(data) and data[i] != 10:
                i += 1
            continue
        j = i
        while j < len(data) and 48 <= data[j] <= 57:
            j += 1
        if j == i:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[i:j]))
        i = j
    return fields, i


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    if not 1 <= kind <= 6:
        raise ValueError("not Netpbm")
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    fields, at = _header(data, 2 if bitmap else 3, 2)
    width, rows, top = fields[0], fields[1], 1 if bitmap else fields[2]
    if min(width, rows, top) < 1 or top > 65535:
        raise ValueError("bad Netpbm size")
    if kind <= 3:
        body = b" ".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        digits = bytes(c for c in body if c in b"01") if bitmap else None
        flat = np.frombuffer(digits, np.uint8) - 48 if bitmap else np.array(body.split(), dtype=np.int64)
        flat = flat[: width * rows * channels].astype(np.int64)
    elif kind == 4:
        line = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, line * rows, at + 1).reshape(rows, line)
        flat = np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", width * rows * channels, at + 1)
    if flat.size and not bitmap and not 0 <= int(flat.min()) <= int(flat.max()) <= top:
        raise ValueError("sample out of range")
    image = flat.reshape(rows, width, channels)
    if bitmap:
        image = (1 - image) * 255  # in a bitmap 1 is black
    elif top != 255:
        image = (image.astype(np.int64) * 255 + top // 2) // top
    image = image.astype(np.uint8)
    return np.repeat(image, 3, axis=2) if channels == 1 else image


#: Where red, green and blue lie in a pixel whose header names no masks.
MASKS = {16: (0x7C00, 0x3E0, 0x1F), 32: (0xFF0000, 0xFF00, 0xFF)}


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The channel under a mask, brought to 0..255."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((pixels.astype(np.int64) & mask) >> low) * 255 + most // 2) // most


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, head, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    rows = abs(height)
    if width < 1 or rows < 1 or depth not in (1, 4, 8, 16, 24, 32) or packing not in ((0, 3) if depth in MASKS else (0,)):
        raise ValueError("unsupported BMP")
    stride = -(-width * depth // 32) * 4
    lines = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if depth <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
        index = bits @ (1 << np.arange(depth - 1, -1, -1))
        image = palette[index[:, :width]]
    elif depth in MASKS:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else MASKS[depth]
        pixels = lines.view(f"<u{depth // 8}")[:, :width]
        image = np.stack([_masked(pixels, m) for m in masks], axis=2).astype(np.uint8)
    else:
        image = lines[:, : 3 * width].reshape(rows, width, 3)[:, :, ::-1]
    return image if height < 0 else image[::-1]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or an uncompressed BMP file: uint8, rows x columns x RGB."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:1] == b"P" and len(data) > 2:
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


class Integral:
    """sums[k, x]: all samples above row corners[k] and left of pixel corner x."""

    def __init__(self, image: np.ndarray, cells: tuple[int, ...]):
        """cells: into how many rows of cells the image will be divided; only their first and last rows are kept."""
        self.rows, self.cols = image.shape[:2]
        lows = np.concatenate([_edges(self.rows, n)[0] for n in cells])
        self.corners = np.unique(np.concatenate([lows, np.minimum(lows + 1, self.rows)]))
        bands = np.add.reduceat(image, self.corners[:-1], axis=0, dtype=np.int64)
        self.sums = np.zeros((len(self.corners), self.cols + 1, 3), np.int64)
        np.cumsum(bands, axis=0, out=self.sums[1:, 1:])
        np.cumsum(self.sums[1:, 1:], axis=1, out=self.sums[1:, 1:])


def _edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For the edges of equal cells the pixel corner before each, and how far behind it the edge lies."""
    edge = np.arange(cells + 1) * size
    return edge // cells, (edge % cells) / cells


def _between(table: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, axis: int) -> np.ndarray:
    """The table at edges; between corners it is linear."""
    part = part.reshape([-1 if k == axis else 1 for k in range(3)])
    return np.take(table, low, axis) * (1 - part) + np.take(table, high, axis) * part


def resize(table: Integral, rows: int, cols: int) -> np.ndarray:
    """Mean of the area of each cell of a rows x cols grid over the image, from its integral."""
    low, part = _edges(table.rows, rows)
    at = [np.searchsorted(table.corners, np.minimum(low + k, table.rows)) for k in (0, 1)]
    corner = _between(table.sums, *at, part, 0)
    low, part = _edges(table.cols, cols)
    corner = _between(corner, low, np.minimum(low + 1, table.cols), part, 1)
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums / (table.rows * table.cols / (rows * cols))


def difference_hash(table: Integral) -> str:
    """64 bits from left-right and 64 from up-down comparisons of grey cells, as hex."""
    across = np.rint(resize(table, 8, 9) @ LUMA * 256)
    down = np.rint(resize(table, 9, 8) @ LUMA * 256)
    bits = np.concatenate([(across[:, 1:] > across[:, :-1]).ravel(), (down[1:] > down[:-1]).ravel()])
    return np.packbits(bits).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    """The array as a version 1.0 NPY file."""
    head = "{'descr': '%s', 'fortran_order': False, 'shape': %r, }" % (array.dtype.str, array.shape)
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin1") + array.tobytes()


def store(payload: bytes) -> bytes:
    return (encode_netpbm if len(payload) // (3 * WIDTH) % 2 else encode_bmp)(payload, WIDTH)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes of the text and `media`, the image file that holds it."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = 3 * WIDTH
        for batch in sliced(batches, text_col):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text_col).to_pylist()]
            media = [store(r.ljust(max(1, -(-len(r) // unit)) * unit, b" ")) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_features(df: DataFrame, keep: list[str], media_col: str = "media", tile: int = 16) -> DataFrame:
    """The kept columns, the media, its decoded samples, an NPY tile of tile x tile RGB and the difference hash."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "media", "width", "height", "samples", "tile_npy", "dhash"]

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data or b"")
        except (ValueError, OverflowError, struct.error, IndexError):
            return None, None, None, None, None
        table = Integral(image, (tile, 8, 9))
        small = np.rint(resize(table, tile, tile)).astype(np.uint8)
        return image.shape[1], image.shape[0], image.tobytes(), npy(small), difference_hash(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
        for batch in sliced(batches, media_col):
            rows = [one(x) for x in batch.column(media_col).to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column(media_col), *made], names)

    out = f"{kinds}, media binary, width int, height int, samples binary, tile_npy binary, dhash string"
    return df.select(*keep, media_col).mapInArrow(run, out)
