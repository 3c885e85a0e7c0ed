"""Texts as PNG media columns.

Encoding: a text's UTF-8 bytes, padded with bytes 0 to a positive multiple of WIDTH, become an 8-bit grey image of that width; each row takes
the filter (none, sub or up) with the least absolute sum, rows are deflated into IDAT chunks, each chunk ends in its CRC. Decoding walks the
chunks with checksum tests, inflates them and undoes all five row filters in numpy. The feature is a cosine-transform hash: the image is
averaged down to 32 x 32, and the signs of its 63 lowest non-constant frequencies against their median make 16 hex digits.

Null and empty texts are one row of zeros. Equal texts give equal bytes. Very long texts are images of many rows. Repeated rows are encoded
each. An empty table gives an empty result.
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

from parlance.llm.common import ARROW_BATCH_BYTES, arrow_map, bound_arrow, utf8

WIDTH, LEVEL = 64, 6
IDAT_BYTES = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """PNG of a payload whose length is a multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    choices = np.stack([rows, rows - left, rows - above])
    cost = np.abs(choices.view(np.int8).astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    body = np.empty((len(rows), width + 1), np.uint8)
    body[:, 0] = best
    body[:, 1:] = choices[best, np.arange(len(rows))]
    packed = zlib.compress(body.tobytes(), LEVEL)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if da <= db and da <= dc else b if db <= dc else c


def unfilter(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Undo the row filters of 8-bit grey rows; runs of like rows are undone at once."""
    out = np.zeros_like(data)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(kinds)]):
        kind, part = int(kinds[a]), data[a:z]
        above = out[a - 1] if a else np.zeros(data.shape[1], np.uint8)
        if kind == 0:
            out[a:z] = part
        elif kind == 1:
            out[a:z] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:z] = np.cumsum(np.vstack([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(a, z):
                up, row, left, corner = above.tolist(), [], 0, 0
                for x, v in enumerate(data[y].tolist()):
                    left = (v + ((left + up[x]) // 2 if kind == 3 else _paeth(left, up[x], corner))) & 255
                    corner = up[x]
                    row.append(left)
                out[y] = above = np.array(row, np.uint8)
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out


def decode(media: bytes) -> np.ndarray:
    """Rows of an 8-bit grey PNG; every chunk's checksum is tested."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, size, data, ended = len(SIGNATURE), None, [], False
    while len(media) - at >= 12 and not ended:
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit grey image without interlace")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("chunks are missing")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[0], size[1] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


_n = np.arange(32)
_COSINES = np.cos(np.pi * (2 * _n[None, :] + 1) * _n[:8, None] / 64)


def cosine_hash(image: np.ndarray) -> str:
    """Hash of the lowest frequencies of the image, averaged down (or repeated up) to 32 x 32."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n <= 32:
            image = np.take(image, np.arange(32) * n // 32, axis=axis)
        else:
            starts = np.arange(32) * n // 32
            sums = np.add.reduceat(image.astype(np.float64), starts, axis=axis)
            counts = np.diff(np.r_[starts, n])
            image = sums / (counts[:, None] if axis == 0 else counts[None, :])
    low = np.rint((_COSINES @ image.astype(np.float64) @ _COSINES.T).ravel()[1:] * 1024)
    bits = np.r_[False, low > np.median(low)]
    return np.packbits(bits).tobytes().hex()


_DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_bytes and the binary column media of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(b.column(1))
        media = [encode(t + bytes(-len(t) % width if t else width), width) for t in texts]
        return pa.record_batch([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes bigint, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """id, n_bytes, media and the payload and feature read back from it; payloads leave in batches of bounded bytes, however well they were packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held, size = 0, [], 0
            for i, m in enumerate(b.column(2)):
                image = decode(m.as_py())
                held.append((image.tobytes(), cosine_hash(image)))
                size += image.size
                if size >= ARROW_BATCH_BYTES or i == b.num_rows - 1:
                    payload, feature = zip(*held)
                    yield pa.record_batch([*b.slice(at, len(held)).columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], [*b.schema.names, "payload", "feature"])
                    at, held, size = i + 1, [], 0

    bound_arrow(media.sparkSession)
    return media.mapInArrow(run, f"id {dict(media.dtypes)['id']}, n_bytes bigint, media binary, payload binary, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, lengths, digests of payload and media, and the feature of every document. Stored media are read back one by one, and only digests leave."""
    media = to_media(docs)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for m in b.column(2):
            stored = m.as_py()
            image = decode(stored)
            payload = image.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], _DIGESTS)

    kind = dict(media.dtypes)["id"]
    return arrow_map(media, run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
