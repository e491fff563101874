"""Media columns: texts or any bytes as PNG images in binary columns, read back with checks, hashed by low frequencies.

`encode_png` writes an 8-bit greyscale PNG: signature, IHDR, zlib data in IDAT chunks of a bounded size, IEND, each chunk
with its CRC-32. `decode_png` tests every checksum and undoes all five row filters with numpy. `cosine_hash` shrinks the
image to 32 x 32 cell means, takes the low-frequency corner of its two-dimensional cosine transform and compares each
coefficient with their median.

Defined results: a null payload counts as empty; an empty one gives one row of zero bytes; equal payloads give equal
images and hashes; a damaged image raises PngError (`decode_png`) or gives a null payload and hash (`media_features`
with errors="null"). Repeated rows stay repeated. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._workers import tidied

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT = 64
IDAT_BYTES = 1 << 16
CELLS = 32
LOW = 8


class PngError(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = UNIT, level: int = 1) -> bytes:
    """payload (a positive multiple of width) as a greyscale PNG; the filter of None, Sub and Up with the smallest sum of residuals serves all rows."""
    if not payload or len(payload) % width:
        raise PngError("the payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    tried = (rows, sub, up)
    cost = [int(np.minimum(x, np.negative(x)).sum(dtype=np.int64)) for x in tried]  # as signed residuals
    kind = int(np.argmin(cost))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind]
    data = zlib.compress(lines.tobytes(), level)
    parts = [data[i : i + IDAT_BYTES] for i in range(0, len(data), IDAT_BYTES)]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *(_chunk(b"IDAT", x) for x in parts), _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows of one-byte samples without their filters. Runs of None, Sub and Up rows are undone at once; Average and Paeth row by row."""
    out = lines.copy()
    height = len(out)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), height], strict=True):
        kind = int(kinds[a]) if height else 0
        if kind == 0:
            continue
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                line, left, corner = out[y].tolist(), 0, 0
                for x, value in enumerate(line):
                    if kind == 3:
                        guess = (left + above[x]) >> 1
                    else:
                        p = left + above[x] - corner
                        da, db, dc = abs(p - left), abs(p - above[x]), abs(p - corner)
                        guess = left if da <= db and da <= dc else above[x] if db <= dc else corner
                    corner, left = above[x], (value + guess) & 255
                    line[x] = left
                out[y] = line
        else:
            raise PngError(f"unknown filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG as (height, width); every chunk's checksum, the zlib stream's and the sizes are tested."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, header, parts, ended = 8, None, [], False
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data):
            raise PngError("a chunk is cut short")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise PngError(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if header is None or not ended:
        raise PngError("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlace = header
    if (depth, colour, interlace) != (8, 0, 0):
        raise PngError("only 8-bit greyscale without interlace")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise PngError("the samples don't fill the image")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _basis() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(CELLS)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * CELLS))


BASIS = _basis()


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: the 8 x 8 lowest frequencies of the image's 32 x 32 cell means, each against the median of all but the first."""

    def shrunk(x: np.ndarray) -> np.ndarray:  # cell means along axis 0; a short axis repeats its rows
        edges = np.arange(CELLS + 1) * len(x) // CELLS
        if len(x) < CELLS:
            return x[np.arange(CELLS) * len(x) // CELLS].astype(np.float64)
        return np.add.reduceat(x, edges[:-1], axis=0, dtype=np.float64) / np.diff(edges)[:, None]

    cells = shrunk(shrunk(image).T).T
    low = (BASIS @ cells @ BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media binary): each text's UTF-8, zero bytes up to a positive multiple of 64, as a PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 512):
                raw = texts.slice(at, 512).cast(pa.binary()).to_pylist()
                media = [encode_png(x.ljust(max(UNIT, -(-len(x) // UNIT) * UNIT), b"\0")) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 512), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(tidied(run), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, errors: str = "raise") -> DataFrame:
    """FEATURES of a media column (doc_id, n_bytes, media): what is hashed is what the image gives back."""

    def row(n: int, png: bytes) -> tuple:
        try:
            image = decode_png(png)
        except PngError:
            if errors == "raise":
                raise
            return (None, None, None, len(png), hashlib.sha256(png).hexdigest(), None)
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(n, x) for n, x in zip(batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2)), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), FEATURES)
