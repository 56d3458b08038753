"""Media columns: Netpbm and BMP decoded to arrays, area-resized, written as NPY tiles with difference hashes.

``media_features`` decodes a binary column. Resizing integrates the image once (a summed-area table)
and reads every output cell's exact area off it, fractional edges included.

Defined cases: null media give null features; bytes that are no image of the known kinds, or are cut
short, give null features and the reason in ``media_error``; columns of the input are kept, and the new
ones get underscores where a name is taken. An empty text becomes one row of 255s (``text_as_pgm``).
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare_name, tidy

#: Rows of an image that are integrated at a time.
STRIP = 1 << 15


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8, copy=False).tobytes()


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers behind the magic, and where the samples begin; comments are passed over."""
    values, i = [], 2
    while len(values) < fields:
        while i < len(data) and (data[i : i + 1].isspace() or data[i : i + 1] == b"#"):
            if data[i : i + 1] == b"#":
                end = data.find(b"\n", i)
                i = len(data) if end < 0 else end
            i += 1
        j = i
        while j < len(data) and data[j : j + 1].isdigit():
            j += 1
        if i == j:
            raise ValueError("netpbm header")
        values.append(int(data[i:j]))
        i = j
    return values, i + 1


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    plain, bits, channels = kind <= 3, kind in (1, 4), 3 if kind in (3, 6) else 1
    head, at = _netpbm_header(data, 2 if bits else 3)
    w, h, top = head[0], head[1], 1 if bits else head[2]
    if not w or not h or not 0 < top < 65536:
        raise ValueError("netpbm size")
    n = w * h * channels
    if n > 8 * len(data):  # no kind has more samples than its bytes have bits
        raise ValueError("netpbm samples")
    if plain:
        body = data[at - 1 :]
        if b"#" in body:
            body = b"\n".join(x.split(b"#")[0] for x in body.split(b"\n"))
        words = [b"%c" % c for c in b"".join(body.split())] if bits else body.split()
        flat = np.array(words[:n], dtype=np.int64)
    elif bits:
        row = -(-w // 8)
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    if len(flat) < n:
        raise ValueError("netpbm samples")
    if (flat > top).any() or (flat < 0).any():
        raise ValueError("netpbm sample beyond its maximum")
    if bits:
        flat = 255 * (1 - flat.astype(np.uint8))
    elif top not in (255, 65535):  # to the full range of its type
        flat = np.rint(flat * ((65535 if top > 255 else 255) / top))
    shape = (h, w, 3) if channels == 3 else (h, w)
    return flat.reshape(shape).astype(np.uint16 if top > 255 else np.uint8, copy=False)


def _decode_bmp(data: bytes) -> np.ndarray:
    at, head = struct.unpack_from("<II", data, 10)
    w, h, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if head < 40 or depth not in (8, 24, 32) or packed not in (0, 3) or packed == 3 and depth != 32 or w <= 0 or h == 0:
        raise ValueError("bmp kind")
    rows, step = abs(h), -(-w * depth // 32) * 4
    if rows * step > len(data):
        raise ValueError("bmp samples")
    body = np.frombuffer(data, np.uint8, rows * step, at).reshape(rows, step)[:, : w * depth // 8]
    if h > 0:
        body = body[::-1]
    if packed == 3:
        pixels = np.ascontiguousarray(body).view("<u4").astype(np.int64)
        return np.stack([_bit_field(pixels, mask) for mask in struct.unpack_from("<III", data, 54)], axis=-1)
    if depth == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        table = np.zeros((256, 3), np.uint8)
        table[:colours] = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
        image = table[body]
        return np.ascontiguousarray(image[..., 0]) if (table == table[:, :1]).all() else image
    return np.ascontiguousarray(body.reshape(rows, w, depth // 8)[..., 2::-1])


def _bit_field(pixels: np.ndarray, mask: int) -> np.ndarray:
    """A colour by its mask of adjacent bits, to the full range of a byte."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    if top & (top + 1):
        raise ValueError("bmp mask")
    return np.rint((pixels & mask) / (1 << shift) * (255 / top)).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples of a P1 to P6 Netpbm or an uncompressed BMP image, over the full range of 8 or 16 bits."""
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither netpbm nor bmp")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the image over each cell of a height x width grid, as float64 (grey images only).

    The integral is linear along both axes within a sample, so its value at a cell's corner is read
    between the four sums around it. Tall images are integrated strip by strip.
    """
    h, w = image.shape
    rows, cols = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    left = np.minimum(cols.astype(np.int64), w - 1)
    total = np.zeros((height + 1, width + 1))
    above = np.zeros(width + 1)
    for top in range(0, h, STRIP):
        strip = image[top : top + STRIP]
        table = np.zeros((strip.shape[0] + 1, w + 1))
        np.cumsum(np.cumsum(strip, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
        across = table[:, left] + (cols - left) * (table[:, left + 1] - table[:, left]) + above
        inside = np.nonzero((rows >= top) & (rows <= top + strip.shape[0]))[0]
        y = rows[inside] - top
        up = np.minimum(y.astype(np.int64), strip.shape[0] - 1)
        total[inside] = across[up] + (y - up)[:, None] * (across[up + 1] - across[up])
        above = across[-1]
    return np.diff(np.diff(total, axis=0), axis=1) / (h / height * w / width)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def dhash(image: np.ndarray) -> str:
    """Difference hash: 8 x 9 cells, one bit for each pair of neighbours in a row."""
    cells = area_resize(grey(image), 8, 9)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def media_features(df: DataFrame, column: str = "media", tile: int = 16) -> DataFrame:
    """The input's columns, and width, height, channels, samples (decoded, as bytes), tile (NPY, tile x tile, grey, uint8), dhash, media_error."""
    names = []
    for stem in ("width", "height", "channels", "samples", "tile", "dhash", "media_error"):
        names.append(spare_name(df.columns + names, stem))
    kinds = [T.IntegerType(), T.IntegerType(), T.IntegerType(), T.BinaryType(), T.BinaryType(), T.StringType(), T.StringType()]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    at = df.columns.index(column)

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        try:
            image = decode(data)
        except (ValueError, struct.error, IndexError, OverflowError) as e:
            return (None,) * 6 + (str(e) or "media",)
        small = np.clip(np.rint(area_resize(grey(image), tile, tile) / (257 if image.dtype == np.uint16 else 1)), 0, 255).astype(np.uint8)
        return image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, image.tobytes(), npy(small), dhash(image), None

    def run(batches):
        arrow = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                rows = [features(x) for x in b.column(at).to_pylist()]
                new = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.fieldNames())

    return df.mapInArrow(tidy(run), schema)


def text_as_pgm(documents: DataFrame, width: int = 24, rows: int = 24) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, filled up with 255 to a positive multiple of width x rows, as a grey P5 image."""
    unit = width * rows

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                sizes, media = [], []
                for t in b.column(1).to_pylist():
                    data = (t or "").encode()
                    full = max(1, -(-len(data) // unit)) * unit
                    sizes.append(len(data))
                    media.append(encode_pgm(np.frombuffer(data.ljust(full, b"\xff"), np.uint8).reshape(-1, width)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), documents.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


def op5_media(documents: DataFrame) -> DataFrame:
    """Each text's payload stored as an image, read back, digested and hashed."""
    read = media_features(text_as_pgm(documents))
    payload = F.col("samples")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("dhash").alias("feature"),
        F.sha2("tile", 256).alias("tile_sha256"),
    )
