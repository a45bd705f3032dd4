"""Media columns: TIFF. Image directories are walked, strips and tiles decoded, predictors undone; a row per page.

Read: classic TIFF of either byte order; strips and tiles; no compression (1), LZW (5), deflate (8 and 32946),
PackBits (32773); predictor 1 and 2; 8-bit samples, interleaved. A directory that was seen before ends the walk, so
loops of directories end; a page that can't be read becomes a row with its error and no samples.

``store`` writes bytes as RGB rows of 64 pixels in pages of up to ``PAGE_ROWS`` rows, whose compression, predictor
and layout (``WAYS``) follow from the payload's checksum and the page's number, not from its size. The operator's query
does so with texts, and reads them back.

Defined cases: null bytes are empty; an empty text is one blank row; equal texts give equal files; any length fits in
as many pages as needed, one page in memory at a time when read; repeated rows and further columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lamella.llm.common import table

UNIT = 192
WIDTH, SAMPLES = 64, 3
PAGE_ROWS = 512
STRIP_ROWS = 64
TILE_WIDE, TILE_HIGH = 32, 16
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the format: tag numbers and the sizes of the field types.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}


def pack_bits(data: bytes) -> bytes:
    """Runs of two or more equal bytes as (257 - length, byte), all else as (length - 1, bytes); 128 at most each."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    # pieces: maximal runs, where neighbours of length 1 are joined to one literal piece
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    length = np.diff(np.append(edge, len(x)))
    single = length == 1
    begins = ~(single & np.append(False, single[:-1]))
    start, run = edge[begins], ~single[begins]
    size = np.diff(np.append(start, len(x)))
    # cut to 128 bytes each
    pieces = -(-size // 128)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    part = np.arange(len(first)) - first
    size = np.minimum(np.repeat(size, pieces) - part * 128, 128)
    start, run = np.repeat(start, pieces) + part * 128, np.repeat(run, pieces)
    taken = np.where(run, 1, size)
    head = np.cumsum(taken + 1) - (taken + 1)
    out = np.empty(int((taken + 1).sum()), np.uint8)
    out[head] = np.where(run & (size > 1), 257 - size, size - 1)
    at = np.repeat(head + 1 - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
    out[at] = x[np.repeat(start - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))]
    return out.tobytes()


def unpack_bits(data: bytes) -> bytes:
    out, i, end = [], 0, len(data)
    while i < end:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        elif n > 128:
            if i + 1 >= end:
                raise ValueError("PackBits run without its byte")
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
    return b"".join(out)


CLEAR, END, FIRST, FULL = 256, 257, 258, 4094
#: Width of the k-th code after a clear code: 9 to 12 bits, changed one code early, as the format has it.
_K = np.arange(FULL - FIRST + 2)
WIDTHS = 9 + (_K >= 254).astype(np.int64) + (_K >= 766) + (_K >= 1790)
BITS_BEFORE = np.append(0, np.cumsum(WIDTHS))


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW, most significant bit first; the table starts anew when it is full."""
    codes: list[int] = []
    counts: list[int] = []  # codes after each clear code, its successor included
    rest = iter(data)
    code = next(rest, -1)
    while code >= 0:
        begin, following, table = len(codes), FIRST, {}
        find, add = table.get, codes.append
        for byte in rest:
            key = code << 8 | byte
            longer = find(key)
            if longer is not None:
                code = longer
                continue
            add(code)
            table[key] = following
            following += 1
            code = byte
            if following == FULL:
                break
        else:
            add(code)
            code = -1
        add(CLEAR if code >= 0 else END)
        counts.append(len(codes) - begin)
    if not codes:
        codes, counts = [END], [1]
    widths = np.concatenate([[9], *(WIDTHS[:n] for n in counts)])
    values = np.concatenate([[CLEAR], codes]).astype(np.uint32)
    bits = (values[:, None] >> np.arange(11, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(bool)[np.arange(12) >= 12 - widths[:, None]]).tobytes()


def _codes(data: bytes) -> Iterator[list[int]]:
    """The codes between clear codes; ends at the end code or with the data."""
    x = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    at, end = 0, 8 * len(data)
    while at < end:
        places = at + BITS_BEFORE[: len(WIDTHS)]
        n = int(np.searchsorted(places + WIDTHS, end, side="right"))
        places, widths = places[:n], WIDTHS[:n]
        k = places >> 3
        window = x[k] << 16 | x[k + 1] << 8 | x[k + 2]
        codes = (window >> (24 - widths - (places & 7)).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        yield codes[: stop[0]].tolist() if len(stop) else codes.tolist()
        if not len(stop) or codes[stop[0]] == END:
            return
        at += int(BITS_BEFORE[stop[0] + 1])


def lzw_decode(data: bytes) -> bytes:
    """A code of the table is what one earlier code stood for and one byte more, so it is a slice of what is out."""
    whole = bytearray()
    for codes in _codes(data):
        out, starts, lengths, made = bytearray(), [], [], 0
        begin, size = starts.append, lengths.append
        for code in codes:
            begin(made)
            if code < CLEAR:
                out.append(code)
                made += 1
                size(1)
                continue
            k = code - FIRST
            if k >= len(lengths):
                raise ValueError("LZW code ahead of its table")
            a, n = starts[k], lengths[k] + 1
            word = out[a : a + n]
            if len(word) < n:
                word.append(word[0])  # the string that this very code completes ends as it begins
            out += word
            made += n
            size(n)
        whole += out
    return bytes(whole)


PACKERS: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}
UNPACKERS: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def _pieces(image: np.ndarray, tiled: bool) -> list[np.ndarray]:
    if not tiled:
        return [image[y : y + STRIP_ROWS] for y in range(0, len(image), STRIP_ROWS)]
    short = -len(image) % TILE_HIGH
    padded = np.pad(image, ((0, short), (0, 0), (0, 0)))
    return [padded[y : y + TILE_HIGH, x : x + TILE_WIDE] for y in range(0, len(padded), TILE_HIGH) for x in range(0, WIDTH, TILE_WIDE)]


#: The ways to store a page: compression, whether tiled, predictor. PackBits has no predictor in the format.
WAYS = ((LZW, False, 1), (PACKBITS, True, 1), (DEFLATE, False, 1), (LZW, True, 2), (PACKBITS, False, 1), (DEFLATE, True, 2), (LZW, False, 2), (DEFLATE, True, 1), (LZW, True, 1), (DEFLATE, False, 2))


def way_of(key: int, page: int) -> tuple[int, bool, int]:
    """How a page is stored: by the payload's checksum, whatever its size, and in turn from page to page."""
    return WAYS[(key + page) % len(WAYS)]


def store(payload: bytes) -> bytes:
    """payload (a positive multiple of UNIT bytes) as a TIFF file of as many pages as it needs."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    step = PAGE_ROWS * UNIT
    key = zlib.crc32(payload)
    for page, start in enumerate(range(0, len(payload), step)):
        part = payload[start : start + step]
        image = np.frombuffer(part, np.uint8).reshape(-1, WIDTH, SAMPLES)
        compression, tiled, predictor = way_of(key, page)
        offsets, counts = [], []
        for piece in _pieces(image, tiled):
            if predictor == 2:
                piece = np.concatenate([piece[:, :1], np.diff(piece, axis=1)], axis=1)
            packed = PACKERS[compression](np.ascontiguousarray(piece).tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        places = struct.pack(f"<{len(offsets)}I", *offsets), struct.pack(f"<{len(counts)}I", *counts)
        bits_at = len(out)
        out += struct.pack("<3H", 8, 8, 8)
        out += b"\0" * (len(out) % 2)
        at = []
        for x in places:
            at.append(struct.unpack("<I", x)[0] if len(x) == 4 else len(out))
            if len(x) > 4:
                out += x
        n = len(offsets)
        fields = [(IMAGE_WIDTH, 4, 1, WIDTH), (IMAGE_LENGTH, 4, 1, len(image)), (BITS, 3, 3, bits_at), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 2)]
        fields += [] if tiled else [(STRIP_OFFSETS, 4, n, at[0])]
        fields += [(SAMPLES_PER_PIXEL, 3, 1, SAMPLES)]
        fields += [] if tiled else [(ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_COUNTS, 4, n, at[1])]
        fields += [(PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        fields += [(TILE_WIDTH, 4, 1, TILE_WIDE), (TILE_LENGTH, 4, 1, TILE_HIGH), (TILE_OFFSETS, 4, n, at[0]), (TILE_COUNTS, 4, n, at[1])] if tiled else []
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image directory, as the links go."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise ValueError("directory outside the file")
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        fields: dict[int, tuple] = {}
        for i in range(n):
            entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                raise ValueError("directory cut short")
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            size = FIELD_SIZES.get(kind, 0) * count
            if kind not in FIELD_CODES:
                continue
            start = struct.unpack(order + "I", entry[8:])[0]
            raw = entry[8 : 8 + size] if size <= 4 else data[start : start + size]
            if len(raw) < size:
                raise ValueError("field outside the file")
            fields[tag] = struct.unpack(f"{order}{count}{FIELD_CODES[kind]}", raw)
        yield fields
        link = data[at + 2 + 12 * n : at + 6 + 12 * n]
        at = struct.unpack(order + "I", link)[0] if len(link) == 4 else 0


def decode_page(data: bytes, fields: dict[int, tuple]) -> np.ndarray:
    """The samples of one page: rows x columns x samples."""
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples = one(IMAGE_WIDTH, 0), one(IMAGE_LENGTH, 0), one(SAMPLES_PER_PIXEL, 1)
    if any(b != 8 for b in fields.get(BITS, (8,))) or one(PLANAR, 1) != 1 or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only interleaved samples of 8 bits are read")
    unpack = UNPACKERS.get(one(COMPRESSION, 1))
    if unpack is None:
        raise ValueError(f"compression {one(COMPRESSION, 1)} isn't read")
    tiled = TILE_OFFSETS in fields
    if tiled:
        wide, high = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)
        offsets, counts = fields[TILE_OFFSETS], fields[TILE_COUNTS]
    else:
        wide, high = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_COUNTS, ())
    if min(width, height, wide, high, samples) < 1:
        raise ValueError("no extent")
    across = -(-width // wide)
    if len(offsets) < across * -(-height // high) or len(counts) < len(offsets):
        raise ValueError("pieces are missing")
    image = np.zeros((height, width, samples), np.uint8)
    for k in range(across * -(-height // high)):
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        raw = unpack(data[offsets[k] : offsets[k] + counts[k]])
        if len(raw) < rows * wide * samples:
            raise ValueError("a piece is too short")
        piece = np.frombuffer(raw, np.uint8, rows * wide * samples).reshape(rows, wide, samples)
        if one(PREDICTOR, 1) == 2:
            piece = np.cumsum(piece, axis=1, dtype=np.uint8)
        h, w = min(rows, height - y), min(wide, width - x)
        image[y : y + h, x : x + w] = piece[:h, :w]
    return image


def page_feature(image: np.ndarray) -> str:
    """Extent, mean, deviation and an 8 x 8 hash (above the mean or not) of the page's brightness."""
    grey = image.sum(axis=2, dtype=np.int64)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=total[1:, 1:])
    y, x = (np.arange(9) * n // 8 for n in grey.shape)
    corner = total[np.ix_(y, x)]
    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    above = cells * grey.size > int(total[-1, -1]) * np.outer(np.diff(y), np.diff(x))
    bits, mean = int.from_bytes(np.packbits(above).tobytes()), int(total[-1, -1]) / grey.size / image.shape[2]
    return f"{image.shape[1]}x{image.shape[0]}x{image.shape[2]}:{mean:.4f}:{image.std():.4f}:{bits:016x}"


def pages(media: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """A row per page: id, page (from 0), width, height, samples, compression, tiled, pixels, feature, error."""
    schema = f"id {media.schema[id_col].dataType.simpleString()}, page int, width int, height int, samples int, compression int, tiled boolean, pixels binary, feature string, error string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                page, walk = -1, directories(own or b"")
                while True:
                    fields: dict[int, tuple] = {}
                    page += 1
                    try:
                        if (fields := next(walk, None)) is None:
                            break
                        image = decode_page(own, fields)
                        row = [page, image.shape[1], image.shape[0], image.shape[2], fields.get(COMPRESSION, (1,))[0], TILE_OFFSETS in fields, image.tobytes(), page_feature(image), None]
                    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                        row = [page, None, None, None, None, None, None, None, str(e) or type(e).__name__]
                    kinds = [pa.int32()] * 5 + [pa.bool_(), pa.binary(), pa.string(), pa.string()]
                    yield pa.record_batch([pa.array([i.as_py()], batch.column(0).type), *(pa.array([v], k) for v, k in zip(row, kinds, strict=True))], names)
                    if fields == {} or fields is None:
                        break

    return media.select(id_col, bytes_col).mapInArrow(read, schema)


def encode_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text padded with blanks to whole rows, as a TIFF file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, media = [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                lengths.append(len(data))
                media.append(store(data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")))
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = documents.select(documents[id_col].alias("id"), documents[text_col].cast("string").alias("text"))
    return rows.mapInArrow(write, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """What is read back of each file of encode_texts: payload and media digests, and the features of its pages."""
    schema = f"doc_id {media.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column(2).to_pylist():
                sha, size, tail, features = hashlib.sha256(), 0, b"", []
                for fields in directories(own):
                    image = decode_page(own, fields)
                    part = image.tobytes()
                    sha.update(part)
                    size += len(part)
                    tail = part[-16:]
                    features.append(page_feature(image))
                rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(own), hashlib.sha256(own).hexdigest(), ";".join(features)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.mapInArrow(read, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_media_tiff": op2}
SQL: dict[str, str] = {}
