"""TIFF files in a column: every page one row, and texts stored as images.

The reader follows the chain of image directories and decodes uncompressed,
PackBits, LZW and deflate strips or tiles of 8-bit samples, with or without
horizontal differencing. The writer stores bytes losslessly as gray pages, 64
samples wide. A page's own checksum draws its form, whatever its size: one page
in sixteen by LZW with differencing, four by PackBits, four in deflated and
differenced tiles, one uncompressed, the rest in deflated strips.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

#: samples of a row, bytes of a page, rows of a strip and of a tile
WIDE, PAGE, STRIP, TILE = 64, 1 << 16, 256, 256
#: bytes of samples that are handed on at once
BATCH = 1 << 22

#: fixed values of the format
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
CLEAR, END = 256, 257


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: bytes


def packbits(data: bytes) -> bytes:
    """Runs of three or more bytes as pairs, the rest as literals of up to 128."""
    out, done = bytearray(), 0

    def literals(part: bytes) -> None:
        for at in range(0, len(part), 128):
            piece = part[at : at + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literals(data[done : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(data[m.start()])
        done = m.end()
    literals(data[done:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, each width left one code early as the format asks."""
    bits, held, out = 0, 0, bytearray()
    size, table, following = 9, {}, 258

    def put(code: int) -> None:
        nonlocal bits, held
        held = held << size | code
        bits += size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        if key in table:
            prefix = table[key]
            continue
        put(prefix)
        table[key] = following
        following += 1
        prefix = byte
        if following == 4095:
            put(CLEAR)
            size, table, following = 9, {}, 258
        elif following == 1 << size:
            size += 1
    if prefix >= 0:
        put(prefix)
        if following + 1 == 1 << size and size < 12:
            size += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, total = [], 0
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last = list(first), 9, None
    part, held, at = 0, 0, 0
    while total < size:
        while held < width:
            if at >= len(data):
                return b"".join(out)
            piece = data[at : at + 64]
            part = (part & ((1 << held) - 1)) << 8 * len(piece) | int.from_bytes(piece, "big")
            held += 8 * len(piece)
            at += 64
        held -= width
        code = part >> held & ((1 << width) - 1)
        if code == CLEAR:
            table, width, last = list(first), 9, None
            continue
        if code == END:
            break
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code stands before its entry")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        total += len(entry)
        last = entry
    return b"".join(out)


def unpacked(data: bytes, compression: int, size: int) -> bytes:
    """The bytes of one strip or tile."""
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return unpackbits(data, size)[:size]
    if compression == LZW:
        return unlzw(data, size)[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression} is not read")


def undone(rows: np.ndarray, predictor: int) -> np.ndarray:
    """Samples (row, column, sample) from their horizontal differences."""
    if predictor == 1:
        return rows
    if predictor != 2:
        raise ValueError(f"predictor {predictor} is not read")
    return np.cumsum(rows, axis=1, dtype=np.uint8)


def directories(content: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The tags of every image directory in the order of their chain; a chain that comes back to itself is an error."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", content, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a circle")
        seen.add(at)
        tags, n = {}, struct.unpack_from(order + "H", content, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            form = f"{order}{count}{TYPES[kind]}"
            where = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                where = struct.unpack_from(order + "I", content, where)[0]
            tags[tag] = struct.unpack_from(form, content, where)
        yield tags
        at = struct.unpack_from(order + "I", content, at + 2 + 12 * n)[0]


def page(content: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags:
            return tags[tag][0]
        if default is None:
            raise ValueError(f"tag {tag} is missing")
        return default

    width, height, samples = one(256), one(257), one(277, 1)
    compression, predictor = one(259, 1), one(317, 1)
    if any(x != 8 for x in tags.get(258, (1,))) or one(284, 1) != 1:
        raise ValueError("only 8-bit samples side by side are read")
    pixels = np.zeros((height, width, samples), np.uint8)
    if 324 in tags:
        wide, high = one(322), one(323)
        across = -(-width // wide)
        for k, (at, n) in enumerate(zip(tags[324], tags[325], strict=True)):
            top, side = k // across * high, k % across * wide
            raw = np.frombuffer(unpacked(content[at : at + n], compression, wide * high * samples), np.uint8)
            tile = undone(raw.reshape(high, wide, samples), predictor)
            pixels[top : top + high, side : side + wide] = tile[: height - top, : width - side]
    else:
        high = min(one(278, height), height)
        for k, (at, n) in enumerate(zip(tags[273], tags[279], strict=True)):
            rows = min(high, height - k * high)
            raw = np.frombuffer(unpacked(content[at : at + n], compression, rows * width * samples), np.uint8)
            pixels[k * high : k * high + rows] = undone(raw.reshape(rows, width, samples), predictor)
    return Page(width, height, samples, compression, predictor, pixels.tobytes())


def pages_of(content: bytes) -> Iterator[Page]:
    return (page(content, tags) for tags in directories(content))


def form(content: bytes) -> tuple[int, int, bool]:
    """(compression, predictor, tiled) of a page with these samples."""
    drawn = zlib.crc32(content) % 16
    if drawn == 0:
        return LZW, 2, False
    if drawn <= 4:
        return PACKBITS, 1, False
    if drawn <= 8:
        return DEFLATE, 2, True
    return (NONE, 1, False) if drawn == 9 else (DEFLATE, 1, False)


PACK = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}


def written(payload: bytes) -> bytes:
    """A file that holds the payload, whose length is a multiple of WIDE."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for begin in range(0, len(payload), PAGE):
        compression, predictor, tiled = form(payload[begin : begin + PAGE])
        rows = np.frombuffer(payload, np.uint8)[begin : begin + PAGE].reshape(-1, WIDE)
        height, high = len(rows), TILE if tiled else min(STRIP, len(rows))
        if predictor == 2:
            rows = np.diff(rows, axis=1, prepend=np.uint8(0))
        parts = []
        for top in range(0, height, high):
            part = rows[top : top + high]
            if tiled and len(part) < high:
                part = np.concatenate([part, np.zeros((high - len(part), WIDE), np.uint8)])
            packed = PACK[compression](part.tobytes())
            parts.append((len(out), len(packed)))
            out += packed
        places = []
        for values in zip(*parts, strict=True):
            places.append(len(out) if len(parts) > 1 else values[0])
            if len(parts) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        tags = [(256, WIDE), (257, height), (258, 8), (259, compression), (262, 1), (277, 1), (317, predictor)]
        tags += [(322, WIDE), (323, TILE)] if tiled else [(278, high)]
        entries = [(t, 4, 1, v) for t, v in tags] + [(t, 4, len(parts), v) for t, v in zip((324, 325) if tiled else (273, 279), places, strict=True)]
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *x) for x in sorted(entries))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@arrow_udf(BinaryType())
def stored(texts: pa.Array) -> pa.Array:
    """A file of every text's bytes, filled with zeros to a multiple of 64 and 64 at least; a null text is empty."""
    out = []
    for x in texts:
        raw = (x.as_py() or "").encode()
        out.append(written(raw + bytes(-len(raw) % WIDE or (0 if raw else WIDE))))
    return pa.array(out, pa.binary())


PAGES = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"


def pages(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row per page with the id of its file.

    A null file has no rows. Where a file or a page cannot be read, one row
    carries the ``error``; pages before it stay. Ids may be null or repeated;
    other columns are not looked at.
    """
    names = [x.split()[0] for x in PAGES.split(", ")]

    types = (pa.int32(),) * 6 + (pa.binary(), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            whose: list[int] = []
            held = 0

            def out(batch=batch) -> pa.RecordBatch:
                columns = [pa.array([x[n] for x in found], t) for n, t in zip(names, types, strict=True)]
                return pa.record_batch([batch.column(0).take(pa.array(whose)), *columns], [batch.schema.names[0], *names])

            for k, content in enumerate(batch.column(1)):
                if not content.is_valid:
                    continue
                number = 0
                try:
                    for p in pages_of(content.as_py()):
                        found.append(p._asdict() | {"page": number, "error": None})
                        whose.append(k)
                        number, held = number + 1, held + len(p.pixels)
                        if held > BATCH:
                            yield out()
                            found, whose, held = [], [], 0
                except (ValueError, struct.error, zlib.error, IndexError, KeyError) as broken:
                    found.append(dict.fromkeys(names) | {"page": number, "error": str(broken) or type(broken).__name__})
                    whose.append(k)
            if found:
                yield out()

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, content_col).mapInArrow(rows, f"`{id_col}` {kind}, {PAGES}")


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features_of(sizes: list[tuple[int, int]], payload: bytes) -> dict:
    """What is computed from the samples read back: hashes, and pages, size, sum, distinct values and the 64 bits of bands above the mean."""
    values = np.frombuffer(payload, np.uint8)
    edges = np.arange(64) * len(values) // 64
    bands = np.add.reduceat(values.astype(np.int64), edges) / np.diff(np.append(edges, len(values)))
    bits = int("".join("1" if x else "0" for x in bands > values.mean()), 2)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "feature": f"{len(sizes)}:{sizes[0][0]}x{sum(h for _, h in sizes)}:{int(values.sum())}:{len(np.unique(values))}:{bits:016x}",
    }


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file from its page rows, which follow one another; the pages of one file are held."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    now, sizes, pixels = None, [], []

    def done() -> dict:
        return {k: now[k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256")} | features_of(sizes, b"".join(pixels))

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in DIGEST.split(", ")]
        return pa.record_batch([pa.array([r[n] for r in rows], kind) for n, kind in zip(names, types, strict=True)], names)

    for batch in batches:
        rows = []
        columns = [batch.column(k) for k in range(len(batch.schema.names))]
        places = {name: k for k, name in enumerate(batch.schema.names)}
        for i in range(len(batch)):
            broken = columns[places["error"]][i].as_py()
            if broken:
                raise ValueError(f"a page cannot be read back: {broken}")
            own = columns[0][i].as_py()
            if now is None or own["file"] != now["file"]:
                if now is not None:
                    rows.append(done())
                now, sizes, pixels = own, [], []
            sizes.append((columns[places["width"]][i].as_py(), columns[places["height"]][i].as_py()))
            pixels.append(columns[places["pixels"]][i].as_py())
        if rows:
            yield batch_of(rows)
    if now is not None:
        yield batch_of([done()])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a file, read its pages back and return their features; null and empty texts are one row of zeros.

    The page rows of a file stand one after another in the partition of its
    document, so they are gathered without a shuffle.
    """
    files = docs.select(
        F.monotonically_increasing_id().alias("file"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), stored(F.col(text_col)).alias("content"),
    )
    named = files.select(
        F.struct("file", "doc_id", "n_bytes", F.octet_length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256")).alias("id"),
        "content")
    return pages(named, "id", "content").mapInArrow(_digests, DIGEST)
