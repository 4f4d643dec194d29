"""TIFF media columns: one row per page.

Reader: walks the chain of image directories (either byte order), collects strips or tiles,
undoes PackBits, LZW or deflate, undoes the horizontal predictor, and puts tiles together.
Only integer samples of 8 or 16 bits are read (one or more per pixel, chunky or planar).
Writer: 8-bit samples, strips or tiles, any of the four forms of storage.

Defined results: bytes that are no TIFF, a loop in the directory chain and sizes that don't
agree give an error text in the page's ``error`` column; other rows go on. Null media give no page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialize, ship

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
# Tags and field types of the format: fixed values.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
_TYPES = {1: "B", 3: "H", 4: "I"}


def unpack_packbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out, at, literal = bytearray(), 0, bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            flush()
            out += bytes((257 - run, data[at]))
        else:
            literal += data[at : at + run]
        at += run
    flush()
    return bytes(out)


_CLEAR, _END = 256, 257


def unpack_lzw(data: bytes) -> bytes:
    """Most significant bit first; the code width grows one code early, as the format asks."""
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out, last = list(single), 9, [], b""
    acc = bits = 0
    for byte in data:
        acc, bits = (acc << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, width, last = list(single), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code beyond its table")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            width = min(12, (len(table) + 1).bit_length())
        last = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}
    following = 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    def reset() -> None:
        nonlocal table, following, width
        put(_CLEAR)
        table, following, width = {bytes((i,)): i for i in range(256)}, 258, 9

    table = {bytes((i,)): i for i in range(256)}
    reset()
    held = b""
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer] = following
        following += 1
        width = min(12, (following).bit_length())
        if following == 4094:
            reset()
        held = data[i : i + 1]
    if held:
        put(table[held])
        following += 1
        width = min(12, following.bit_length())
    put(_END)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_packbits(data, size)
    if compression == LZW:
        return unpack_lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression}")


def pack(data: bytes, compression: int, level: int = 1) -> bytes:
    return {NONE: bytes, PACKBITS: pack_packbits, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, level)}[compression](data)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height, width, samples


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in _TYPES:
            form = f"{order}{count}{_TYPES[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(form, data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _cell(data: bytes, offset: int, count: int, compression: int, predictor: int, shape: tuple[int, int, int], kind: str) -> np.ndarray:
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    raw = unpack(data[offset : offset + count], compression, size)
    if len(raw) < size:
        raise ValueError("a strip or tile is too short")
    cell = np.frombuffer(raw[:size], kind).reshape(shape)
    if predictor == 2:
        cell = np.cumsum(cell, axis=1, dtype=np.dtype(kind).newbyteorder("="))
    elif predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return cell


def pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of their directories."""
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(bytes(data[:4]))
    if order is None:
        raise ValueError("no TIFF header")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        tags, at = _directory(data, order, at)
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        bits, compression, predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if not width or not height or bits not in (8, 16):
            raise ValueError("unsupported size or depth of samples")
        kind = order + ("u1" if bits == 8 else "u2")
        planes, deep = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
        if TILE_OFFSETS in tags:
            cell_w, cell_h, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_COUNTS]
        else:
            cell_w, cell_h, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        across, down = -(-width // cell_w), -(-height // cell_h)
        if len(offsets) < planes * across * down:
            raise ValueError("strips or tiles are missing")
        pixels = np.zeros((height, width, samples), kind[1:])
        for k in range(planes * across * down):
            plane, (y, x) = k // (across * down), divmod(k % (across * down), across)
            rows = cell_h if TILE_OFFSETS in tags else min(cell_h, height - y * cell_h)
            cell = _cell(data, offsets[k], counts[k], compression, predictor, (rows, cell_w, deep), kind)
            put = pixels[y * cell_h : y * cell_h + rows, x * cell_w : x * cell_w + cell_w, plane : plane + deep]
            put[...] = cell[: put.shape[0], : put.shape[1]]
        yield Page(width, height, samples, bits, compression, predictor, pixels)


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of 8-bit images of shape (height, width, samples). ``tile`` is (height, width), in multiples of 16."""
    out = bytearray((b"II*\x00" if order == "<" else b"MM\x00*") + bytes(4))
    link = 4
    for image in images:
        height, width, samples = image.shape
        cells = []
        if tile:
            for y in range(0, height, tile[0]):
                for x in range(0, width, tile[1]):
                    cell = np.zeros((*tile, samples), np.uint8)
                    part = image[y : y + tile[0], x : x + tile[1]]
                    cell[: part.shape[0], : part.shape[1]] = part
                    cells.append(cell)
        else:
            cells = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.concatenate([cell[:, :1], cell[:, 1:] - cell[:, :-1]], axis=1)
            data = pack(np.ascontiguousarray(cell).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\x00" * (len(data) % 2)
        fields = {WIDTH: ("I", [width]), LENGTH: ("I", [height]), BITS: ("H", [8] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [2 if samples == 3 else 1]), SAMPLES: ("H", [samples]), PLANAR: ("H", [1]), PREDICTOR: ("H", [predictor])}
        fields |= {TILE_WIDTH: ("I", [tile[1]]), TILE_LENGTH: ("I", [tile[0]]), TILE_OFFSETS: ("I", offsets), TILE_COUNTS: ("I", counts)} if tile else {ROWS_PER_STRIP: ("I", [rows_per_strip]), STRIP_OFFSETS: ("I", offsets), STRIP_COUNTS: ("I", counts)}
        entries = []
        for tag in sorted(fields):
            form, values = fields[tag]
            raw = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(raw) > 4:
                place = struct.pack(order + "I", len(out))
                out += raw + b"\x00" * (len(raw) % 2)
            else:
                place = raw.ljust(4, b"\x00")
            entries.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(values)) + place)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


# --- DataFrame operators ---

PAGES = "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def read_pages(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row per page; a row with ``error`` where reading stopped. The bytes of the samples are in page order."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, media in zip(b["doc_id"], b["media"]):
                k = 0
                try:
                    for k, p in enumerate(pages(media) if media is not None else ()):
                        rows.append((doc_id, k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels.tobytes(), None))
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    rows.append((doc_id, k, None, None, None, None, None, None, None, str(e) or type(e).__name__))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])
            yield out.astype({c: "Int32" for c in out.columns[1:8]})

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(media_col).alias("media")).mapInPandas(run, PAGES)


_ROW = 576  # bytes in a row of pixels: 192 pixels of three samples


#: (compression, predictor, tile, byte order, pages) of a stored text, chosen by its checksum; most are deflated.
LAYOUTS = [
    (DEFLATE, 1, None, "<", 1), (DEFLATE, 1, None, ">", 2), (DEFLATE, 1, (16, 64), "<", 1), (DEFLATE, 1, None, "<", 3), (DEFLATE, 1, (32, 96), ">", 2), (DEFLATE, 1, None, "<", 1),
    (DEFLATE, 1, None, ">", 1), (DEFLATE, 1, None, "<", 2), (DEFLATE, 1, (16, 192), "<", 3), (DEFLATE, 2, None, "<", 1), (DEFLATE, 2, (16, 64), ">", 2),
    (LZW, 1, None, "<", 2), (LZW, 2, (16, 96), ">", 1), (PACKBITS, 1, None, ">", 2), (PACKBITS, 2, None, "<", 1), (NONE, 1, None, ">", 1),
]


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layouts: list[tuple] | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with 255, as pages of 192 RGB pixels a row.

    Equal texts have equal layouts. A text with fewer rows than its layout has pages gets a page for each row.
    """
    ship(docs.sparkSession)
    forms = layouts or LAYOUTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, media = [], []
            for t in b["text"]:
                data = (t or "").encode("utf-8", "surrogatepass")
                rows = max(1, -(-len(data) // _ROW))
                compression, predictor, tile, order, n = forms[zlib.crc32(data) % len(forms)]
                image = np.frombuffer(data.ljust(rows * _ROW, b"\xff"), np.uint8).reshape(rows, _ROW // 3, 3)
                sizes.append(len(data))
                media.append(write(np.array_split(image, min(n, rows)), compression, predictor, 64, tile, order))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": sizes, "media": media})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each sample in thousandths, and a 64-bit difference hash of the grey image."""
    height, width, _ = pixels.shape
    ys, xs = np.linspace(0, height, 9).astype(int), np.linspace(0, width, 10).astype(int)
    grey = pixels.sum(axis=2, dtype=np.int64)
    sums = np.zeros((height + 1, width + 1), np.int64)
    sums[1:, 1:] = grey.cumsum(0).cumsum(1)
    y0, y1, x0, x1 = ys[:-1], np.maximum(ys[1:], ys[:-1] + 1).clip(max=height), xs[:-1], xs[1:]
    y0 = np.minimum(y0, height - 1)
    cells = (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    means = pixels.reshape(-1, pixels.shape[2]).sum(axis=0, dtype=np.int64) * 1000 // (height * width)
    return f"{width}x{height}:{','.join(map(str, means))}:{int(''.join('1' if x else '0' for x in bits), 2):016x}"


def media_digests(stored: DataFrame) -> DataFrame:
    """Reads (doc_id, n_bytes, media) back and reduces each document's pages to digests."""
    ship(stored.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, n, media in zip(b["doc_id"], b["n_bytes"], b["media"]):
                found = list(pages(media))
                payload = b"".join(p.pixels.tobytes() for p in found)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), ";".join(feature(p.pixels) for p in found)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": b["doc_id"].dtype})

    return stored.select("doc_id", "n_bytes", "media").mapInPandas(run, schema)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the media column to the shared folder, then works on what was read back."""
    return media_digests(materialize(text_images(docs, id_col, text_col), "media"))
