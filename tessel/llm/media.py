"""Media columns: texts or pixels as PNG in binary columns, read back with checksum tests, and cosine-transform hashes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Payload bytes are padded with FILL to a positive multiple of UNIT and stored as rows of WIDTH 8-bit samples.
UNIT, FILL, WIDTH = 576, 255, 576
#: Bytes that an IDAT chunk holds at most, zlib's level, and the side of the grid and of the low frequencies of a hash.
CHUNK, LEVEL, GRID, LOW = 1 << 20, 1, 32, 8
#: Fixed values of the format: signature, channels of its colour types.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Bytes that one byte of a deflate stream can stand for at most, rounded up.
MOST_INFLATED = 1040


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray) -> np.ndarray:
    """Scan lines of 8-bit grey samples with their filter bytes: each row takes none, left or up, by the least sum of
    absolute differences."""
    h, w = rows.shape
    tries = np.zeros((3, h, w), dtype=np.uint8)
    tries[0] = rows
    tries[1, :, 0] = rows[:, 0]
    tries[1, :, 1:] = rows[:, 1:] - rows[:, :-1]
    tries[2, 0] = rows[0]
    tries[2, 1:] = rows[1:] - rows[:-1]
    cost = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    kind = cost.argmin(axis=0)
    return np.concatenate((kind[:, None].astype(np.uint8), tries[kind, np.arange(h)]), axis=1)


def encode_png(rows: np.ndarray) -> bytes:
    """Grey 8-bit samples (height x width) as a PNG file."""
    h, w = rows.shape
    data = zlib.compress(filter_rows(rows).tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[k : k + CHUNK]) for k in range(0, len(data), CHUNK)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples from scan lines with filter bytes; step: bytes between a sample and the one to its left.

    Runs of rows with the same filter none, left or up are done at once. Average and the Paeth predictor need the samples to
    the left, above, and above the left, so their runs go by diagonals: a diagonal needs only the two before it.
    """
    kind, out = lines[:, 0], lines[:, 1:].copy()
    if kind.size and kind.max() > 4:
        raise ValueError("unknown filter")
    h, w = out.shape
    if not out.size:
        return out
    cuts = np.flatnonzero(np.diff(np.minimum(kind, 3))) + 1
    zero = np.zeros(w, np.uint8)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), h]):
        up = out[a - 1] if a else zero
        if kind[a] == 1:
            for c in range(step):
                out[a:b, c::step] = np.cumsum(out[a:b, c::step], axis=1, dtype=np.uint8)
        elif kind[a] == 2:
            out[a] += up
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind[a] > 2:
            _unfilter_diagonals(out[a:b], kind[a:b] == 3, up, step)
    return out


def _unfilter_diagonals(rows: np.ndarray, average: np.ndarray, up: np.ndarray, step: int) -> None:
    """Rows of average (where marked) and of Paeth filters, in place; up: the row above them. Diagonal d holds the pixels
    (y, d - y)."""
    h, w = rows.shape[0], rows.shape[1] // step
    x = np.zeros((h + 1, w + 1, step), dtype=np.int16)  # with a row above and a column of zeros to the left
    x[0, 1:] = up.reshape(w, step)
    x[1:, 1:] = rows.reshape(h, w, step)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        c = d - y
        left, above, corner = x[y + 1, c], x[y, c + 1], x[y, c]
        by_left, by_above, by_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        paeth = np.where((by_left <= by_above) & (by_left <= by_corner), left, np.where(by_above <= by_corner, above, corner))
        guess = np.where(average[y, None], (left + above) >> 1, paeth)
        x[y + 1, c + 1] = (x[y + 1, c + 1] + guess) & 255
    rows[:] = x[1:, 1:].reshape(h, w * step).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height x bytes of a row) of an 8-bit PNG that is not interlaced; ValueError if a checksum or anything else
    is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("wrong header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("cut off")
    w, h, depth, colour, packing, filtering, interlaced = head
    if depth != 8 or colour not in CHANNELS or packing or filtering or interlaced:
        raise ValueError("only 8-bit samples, not interlaced")
    step = CHANNELS[colour]
    packed, size = b"".join(parts), h * (w * step + 1)
    if size > MOST_INFLATED * (len(packed) + 1):
        raise ValueError("wrong size")  # no stream is so much shorter than its data
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(packed, size + 1)  # never more than the header says
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size or not inflate.eof:
        raise ValueError("wrong size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(h, w * step + 1), step)


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(low)[:, None])


_LOW = _cosines(GRID, LOW)


def _means(x: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Means over n equal parts of an axis; a shorter axis is repeated first."""
    size = x.shape[axis]
    if size < n:
        x, size = np.repeat(x, -(-n // size), axis=axis), size * -(-n // size)
    cuts = np.arange(n) * size // n
    return np.add.reduceat(x, cuts, axis=axis, dtype=np.float64) / np.diff([*cuts, size]).reshape((-1, 1) if axis == 0 else (1, -1))


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies of the grid of means are above their median (without the mean)."""
    grid = _means(_means(samples, 1, GRID), 0, GRID)
    low = (_LOW @ grid @ _LOW.T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % UNIT or (0 if text else UNIT))


def store_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_bytes and media (the PNG, binary) to every row of docs, in place of columns of these names.

    The text's UTF-8 bytes, padded, are the samples. A null text counts as empty and is stored as padding alone. Whole
    texts are stored; equal texts give equal files; an empty table gives an empty one.
    """

    def work(texts):
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        media = [encode_png(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in raw]
        return [pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())]

    return _added(docs, text_col, "n_bytes long, media binary", work)


def read_media(docs: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds payload (binary, the samples), feature (the cosine hash) and error to every row of docs, in place of columns of
    these names. A file that is null, damaged or of another kind has a null payload and feature, and error says why."""

    def work(media):
        payload, feature, error = [], [], []
        for m in media.to_pylist():
            try:
                samples = decode_png(m or b"")
                payload.append(samples.tobytes())
                feature.append(cosine_hash(samples) if samples.size else None)
                error.append(None)
            except ValueError as e:
                payload.append(None)
                feature.append(None)
                error.append(str(e))
        return [pa.array(payload, pa.binary()), pa.array(feature, pa.string()), pa.array(error, pa.string())]

    return _added(docs, media_col, "payload binary, feature string, error string", work)


def tail_checksums(docs: DataFrame, payload_col: str = "payload") -> DataFrame:
    """payload_bytes, payload_sha256 and tail_crc32 (of the last 32 bytes), by built-in functions."""
    p = F.col(payload_col)
    n = F.length(p)
    return docs.withColumns({"payload_bytes": n.cast("long"), "payload_sha256": F.sha2(p, 256), "tail_crc32": F.crc32(F.substring(p, F.greatest(n - 31, F.lit(1)), F.lit(32)))})


def _added(docs: DataFrame, col: str, added: str, work) -> DataFrame:
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in added.split(", ")]
    docs = docs.drop(*(n for n in names if n != col))
    at = docs.columns.index(col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *work(b.column(at))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added]))


def op8_media(spark, sf_dir: str) -> DataFrame:
    stored = store_text(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    read = tail_checksums(read_media(stored))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
