"""TIFF in media columns: one row per page.

`read_pages` walks the chain of image directories, decodes strips or tiles (none,
PackBits, LZW, deflate), undoes the horizontal predictor and returns 8-bit samples.
`write_pages` stores 8-bit grey pages losslessly, in strips or tiles.

Null media give no pages; media that aren't TIFF, are malformed or cut short, or whose
directories loop give one row with `error` and no samples after their good pages. A page
of more than LARGEST bytes, which a cell can't hold, gives an error too. Stored texts:
nulls are empty, rows that repeat are stored one by one, other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from strata.llm.textvec import tidy

# Fixed values of the TIFF 6.0 format: field types' sizes, tags, compressions.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: What an Arrow cell of binary holds.
LARGEST = (1 << 31) - 1


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x (width * samples), uint8


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        else:
            if head > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out)


RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in [*RUN.finditer(data), None]:
        literals = data[at : m.start() if m else len(data)]
        for i in range(0, len(literals), 128):
            piece = literals[i : i + 128]
            out.append(len(piece) - 1)
            out += piece
        if m:
            out += bytes((257 - (m.end() - m.start()), data[m.start()]))
            at = m.end()
    return bytes(out)


CLEAR, END = 256, 257
#: Width of the j-th code after a clear (codes of 9 to 12 bits, the width grows one code early), and bits before it.
WIDTHS = np.repeat([9, 10, 11, 12], [254, 512, 1024, 8192 - 1790])
BEFORE = np.cumsum(WIDTHS) - WIDTHS


def unpack_lzw(data: bytes) -> bytes:
    """High bit first. All codes up to the next clear are taken out at once."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out, at, done, table, last = bytearray(), 0, 0, [*LETTERS], b""
    while True:
        width = WIDTHS[done:] if done < len(WIDTHS) else np.full(len(WIDTHS), 12)
        place = at + np.cumsum(width) - width
        n = int(np.searchsorted(place + width, 8 * len(data), "right"))
        place, width = place[:n], width[:n]
        byte = place >> 3
        codes = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - width - (place & 7))) & ((1 << width) - 1)
        ends = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(ends[0]) if len(ends) else n
        for code in codes[:stop].tolist():
            if last:
                if code > len(table):
                    raise TiffError("bad LZW code")
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            elif code > 255:
                raise TiffError("bad LZW code")
            else:
                entry = table[code]
            out += entry
            last = entry
        if stop == n and not n or stop < n and codes[stop] == END:
            return bytes(out)
        at, done = int(place[min(stop, n - 1)] + width[min(stop, n - 1)]), done + stop
        if stop < n:
            done, table, last = 0, [*LETTERS], b""


LETTERS = [bytes((i,)) for i in range(256)] + [b"", b""]


def pack_lzw(data: bytes) -> bytes:
    """The longest known words' codes; a clear before the table is full."""
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}
    width, following, code = 9, 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        known = table.get(key)
        if known is not None:
            code = known
            continue
        codes.append(code)
        widths.append(width)
        table[key] = following
        following += 1
        if following + 1 > 1 << width:
            width += 1
        if following >= 4094:
            codes.append(CLEAR)
            widths.append(min(width, 12))
            table, width, following = {}, 9, 258
        code = byte
    if code >= 0:
        codes.append(code)
        widths.append(width)
        following += 1
        if following + 1 > 1 << width:
            width += 1
    codes.append(END)
    widths.append(min(width, 12))
    held, size = np.array(codes, dtype=">u2").view(np.uint8), np.array(widths)
    bits = np.unpackbits(held).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - size[:, None]]).tobytes()


def _inflate(data: bytes, most: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise TiffError(f"bad deflate data: {e}") from None


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        fields: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
            if kind not in (1, 3, 4) or count > len(data):
                continue
            where = at + 2 + 12 * k + 8
            if SIZES[kind] * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            fields[tag] = [*struct.unpack_from(f"{order}{count}{'_BHHI'[kind] if kind != 3 else 'H'}", data, where)]
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise TiffError(f"directory at {at}: {e}") from None
    return fields, following


def read_pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("directories loop")
        seen.add(at)
        f, at = _directory(data, at, order)
        yield _page(data, f)


def _page(data: bytes, f: dict[int, list[int]]) -> Page:
    def one(tag: int, default: int = 0) -> int:
        return (f.get(tag) or [default])[0]

    width, height = one(WIDTH), one(HEIGHT)
    if not width or not height:
        raise TiffError("no width or height")
    samples, compression, predictor = one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if any(b != 8 for b in f.get(BITS) or [1]) or not samples or predictor not in (1, 2) or (samples > 1 and one(PLANAR, 1) != 1):
        raise TiffError("only chunky 8-bit samples are read")
    tiled = TILE_OFFSETS in f
    block_w = one(TILE_WIDTH) if tiled else width
    block_h = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
    offsets, counts = (f[TILE_OFFSETS], f.get(TILE_COUNTS)) if tiled else (f.get(STRIP_OFFSETS), f.get(STRIP_COUNTS))
    if not offsets or not counts or not block_w or not block_h:
        raise TiffError("no strips or tiles")
    across, down = -(-width // block_w), -(-height // block_h)
    if len(offsets) < across * down or len(counts) < across * down:
        raise TiffError("too few strips or tiles")
    if max(width * height, block_w * block_h) * samples > LARGEST:
        raise TiffError("larger than a cell holds")
    # what is stored bounds what is allotted: no codec here packs more than this into a byte
    if sum(counts[: across * down]) * 4096 + 4096 < width * height * samples or max(offsets[: across * down]) > len(data):
        raise TiffError("strips or tiles are cut short")
    pixels = np.zeros((height, width * samples), np.uint8)
    for k in range(across * down):
        y, x = k // across * block_h, k % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        need = rows * block_w * samples
        raw = data[offsets[k] : offsets[k] + counts[k]]
        match compression:
            case 1:
                pass
            case 5:
                raw = unpack_lzw(raw)
            case 8 | 32946:
                raw = _inflate(raw, need)
            case 32773:
                raw = unpack_bits(raw)
            case _:
                raise TiffError(f"compression {compression}")
        if len(raw) < need:
            raise TiffError("strip or tile is cut short")
        block = np.frombuffer(raw, np.uint8, need).reshape(rows, block_w * samples)
        if predictor == 2:
            block = np.cumsum(block.reshape(rows, block_w, samples), axis=1, dtype=np.uint8).reshape(rows, block_w * samples)
        h, w = min(rows, height - y), min(block_w, width - x) * samples
        pixels[y : y + h, x * samples : x * samples + w] = block[:h, :w]
    return Page(width, height, samples, compression, predictor, pixels)


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 1024, level: int = 1, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF of grey pages (height x width, uint8), in strips or in tiles of (width, height)."""
    pack = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: pack_bits}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4

    def blocks(page: np.ndarray) -> Iterator[np.ndarray]:
        height, width = page.shape
        if tile is None:
            yield from (page[y : y + strip_rows] for y in range(0, height, strip_rows))
            return
        w, h = tile
        for y in range(0, height, h):
            for x in range(0, width, w):
                full = np.zeros((h, w), np.uint8)
                part = page[y : y + h, x : x + w]
                full[: part.shape[0], : part.shape[1]] = part
                yield full

    for page in pages:
        height, width = page.shape
        packed = [pack((np.diff(x, axis=1, prepend=np.uint8(0)) if predictor == 2 else x).tobytes()) for x in blocks(page)]
        offsets = []
        for s in packed:
            offsets.append(len(out))
            out += s + b"\0" * (len(s) & 1)
        lists = []
        for values in (offsets, [len(s) for s in packed]):
            lists.append(len(out) if len(values) > 1 else values[0])
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        fields = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        if tile is None:
            fields += [(STRIP_OFFSETS, 4, len(packed), lists[0]), (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_COUNTS, 4, len(packed), lists[1])]
        else:
            fields += [(TILE_WIDTH, 4, 1, tile[0]), (TILE_HEIGHT, 4, 1, tile[1]), (TILE_OFFSETS, 4, len(packed), lists[0]), (TILE_COUNTS, 4, len(packed), lists[1])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *x) for x in sorted(fields))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """id, page, width, height, samples, compression, pixels, error: one row per page of each TIFF."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "page", "width", "height", "samples", "compression", "pixels", "error"]
        kinds = [None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            for row, media in enumerate(b.column(1)):
                if not media.is_valid:
                    continue
                at = 0
                try:
                    for p in read_pages(media.as_py()):
                        values = [at, p.width, p.height, p.samples, p.compression, p.pixels.tobytes(), None]
                        at += 1
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), *(pa.array([v], k) for v, k in zip(values, kinds[1:], strict=True))], names)
                except (TiffError, struct.error, IndexError, ValueError) as e:
                    values = [at, None, None, None, None, None, str(e) or type(e).__name__]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), *(pa.array([v], k) for v, k in zip(values, kinds[1:], strict=True))], names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(media_col)).mapInArrow(tidy(apply), f"id {kind}, page int, width int, height int, samples int, compression int, pixels binary, error string")


PAGE_ROWS = 16_384
#: How texts are stored: each form once, chosen by the text's crc32.
FORMS = [(c, p, t) for c in (DEFLATE, PACKBITS, LZW, NONE) for p in (1, 2) for t in (None, (32, 64))]


def store_text(data: bytes, width: int = 64) -> tuple[bytes, bytes]:
    """(payload, TIFF) of bytes: padded with 0 to whole rows, one page for each PAGE_ROWS rows; equal bytes are stored alike."""
    payload = data + b"\0" * (-len(data) % width or (width if not data else 0))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    compression, predictor, tile = FORMS[zlib.crc32(data) % len(FORMS)]
    return payload, write_pages([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], compression, predictor, tile=tile)


def features(pixels: np.ndarray) -> str:
    """Mean, a 16-bin histogram in 1/255, and signs of the differences of 8 x 8 cell means, as text."""
    flat = pixels.ravel()
    bins = np.bincount(flat >> 4, minlength=16)
    cells = np.add.reduceat(pixels.reshape(len(pixels), 8, -1).sum(axis=2, dtype=np.int64), np.arange(8) * len(pixels) // 8, axis=0)
    signs = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"{flat.mean():.4f}:{bytes((bins * 255 // len(flat)).astype(np.uint8)).hex()}:{signs}"


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a TIFF, reads the stored bytes back page by page and describes both."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pages", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                data = (text.as_py() or "").encode()
                _, media = store_text(data)
                pages = [p.pixels for p in read_pages(media)]
                pixels = np.concatenate(pages) if len(pages) > 1 else pages[0]
                back = pixels.tobytes()
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(pages), features(pixels)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(tidy(apply), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pages int, feature string")
