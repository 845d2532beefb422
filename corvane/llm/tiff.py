"""TIFF columns: walk image directories, decode strips and tiles, one row per page.

read_pages() follows the chain of directories of a little- or big-endian file,
decodes PackBits, LZW, deflate or uncompressed strips and tiles, undoes the
horizontal predictor and yields each page's samples, 8 bits each and
interleaved by pixel. write_tiff() makes such files, with each of these codecs.

Defined results: a null file gives no rows; an empty or broken one gives a row
for each page read before the damage and one with ``error`` set; a directory
chain that turns back on itself ends with an error; a page whose size is above
``max_page_bytes`` is an error and is not decoded; repeated files give their
rows each.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, keyed_texts, ship, texts

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, HEIGHT, BITS, CODEC, PHOTO, STRIPS, SAMPLES = 256, 257, 258, 259, 262, 273, 277
STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES = 322, 323, 324, 325
MAX_PAGE = 1 << 28
#: The payload's pixels: 64 of three samples a row, 192 bytes; rows on a page.
ROW, PAGE_ROWS = 192, 1024
PART_ROWS = 64
#: Bytes of pixels in one batch of pages.
OUT_BYTES = 1 << 24


class TiffError(ValueError):
    pass


# codecs


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(k + 128, b)]
            out.append(bytes((len(part) - 1,)) + part)

    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(at, m.start())
        out.append(bytes((257 - (m.end() - m.start()),)) + m[1])
        at = m.end()
    literal(at, len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while at < len(data) and have < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part, at = b"", at + 1
        out.append(part)
        have += len(part)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    single = {bytes((i,)): i for i in range(256)}
    table, nxt, width = dict(single), 258, 9
    acc, bits, out = 256, 9, bytearray()
    prefix = b""
    for k in range(len(data)):
        grown = prefix + data[k : k + 1]
        if grown in table:
            prefix = grown
            continue
        acc, bits = acc << width | table[prefix], bits + width
        table[grown] = nxt
        nxt += 1
        if nxt == 4095:  # start anew before the codes run out
            acc, bits = acc << width | 256, bits + width
            table, nxt, width = dict(single), 258, 9
        elif nxt > (1 << width) - 1:  # one code early, as the format has it
            width += 1
        prefix = grown[-1:]
        if bits > 4096:
            spare = bits & 7
            out += (acc >> spare).to_bytes((bits - spare) // 8, "big")
            acc, bits = acc & ((1 << spare) - 1), spare
    if prefix:
        acc, bits = acc << width | table[prefix], bits + width
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out, have = list(single), 9, [], 0
    acc = bits = at = 0
    old = None
    while have < size:
        while bits < width:
            part = data[at : at + 32]
            if not part:
                return b"".join(out)
            acc, bits, at = acc << 8 * len(part) | int.from_bytes(part, "big"), bits + 8 * len(part), at + len(part)
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, old = list(single), 9, None
            continue
        if old is None:
            if code > 255:
                raise TiffError("LZW: no first code")
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(old + entry[:1])
        elif code == len(table):
            entry = old + old[:1]
            table.append(entry)
        else:
            raise TiffError("LZW: unknown code")
        out.append(entry)
        have += len(entry)
        old = entry
        n = len(table) + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return b"".join(out)


def encode_part(data: bytes, codec: int) -> bytes:
    if codec == LZW:
        return lzw_encode(data)
    if codec == PACKBITS:
        return packbits_encode(data)
    return zlib.compress(data, 6) if codec in (DEFLATE, OLD_DEFLATE) else data


def decode_part(data: bytes, codec: int, size: int) -> bytes:
    if codec == NONE:
        return data[:size]
    if codec == LZW:
        return lzw_decode(data, size)[:size]
    if codec == PACKBITS:
        return packbits_decode(data, size)[:size]
    if codec in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {codec}")


# files


def write_tiff(pages: list[np.ndarray], codec: int = DEFLATE, predictor: int = 1, tile: int = 0, rows: int = PART_ROWS) -> bytes:
    """pages: arrays of height x width x samples, 8 bits; tile: edge of square tiles (a multiple of 16), 0: strips."""
    out = bytearray(b"II*\x00\x00\x00\x00\x00")
    link = 4
    for p in pages:
        h, w, s = p.shape
        parts = []
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, s), dtype=np.uint8)
            full[:h, :w] = p
            areas = [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            areas = [p[y : y + rows] for y in range(0, h, rows)]
        for a in areas:
            if predictor == 2:
                a = np.concatenate([a[:, :1], a[:, 1:] - a[:, :-1]], axis=1)
            data = encode_part(a.tobytes(), codec)
            parts.append((len(out), len(data)))
            out += data
            out += b"\0" * (len(out) & 1)

        def place(kind: str, values: list[int]) -> int:
            at = len(out)
            out.extend(struct.pack(f"<{len(values)}{kind}", *values))
            out.extend(b"\0" * (len(out) & 1))
            return at

        one = len(parts) == 1
        offsets = parts[0][0] if one else place("I", [x[0] for x in parts])
        counts = parts[0][1] if one else place("I", [x[1] for x in parts])
        bits = place("H", [8] * s) if s > 2 else 8 | (8 << 16 if s == 2 else 0)
        tags = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, s, bits), (CODEC, 3, 1, codec), (PHOTO, 3, 1, 2 if s == 3 else 1)]
        tags += [(SAMPLES, 3, 1, s), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        if tile:
            tags += [(TILE_W, 4, 1, tile), (TILE_H, 4, 1, tile), (TILES, 4, len(parts), offsets), (TILE_BYTES, 4, len(parts), counts)]
        else:
            tags += [(STRIPS, 4, len(parts), offsets), (STRIP_ROWS, 4, 1, rows), (STRIP_BYTES, 4, len(parts), counts)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for t in sorted(tags):
            out += struct.pack("<HHII", *t)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, e: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("a directory lies outside the file")
    n = struct.unpack_from(e + "H", data, at)[0]
    if at + 6 + 12 * n > len(data):
        raise TiffError("a directory is cut off")
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        if kind not in KINDS:
            continue
        size, where = SIZES[kind] * count, at + 10 + 12 * k
        if size > 4:
            where = struct.unpack_from(e + "I", data, where)[0]
        if where + size > len(data):
            raise TiffError(f"tag {tag} lies outside the file")
        tags[tag] = struct.unpack_from(f"{e}{count}{KINDS[kind]}", data, where)
    return tags, struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, t: dict[int, tuple], max_page_bytes: int) -> np.ndarray:
    def one(tag: int, default: int | None = None) -> int:
        v = t.get(tag) or (() if default is None else (default,))
        if not v:
            raise TiffError(f"tag {tag} is missing")
        return v[0]

    w, h, s, codec = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(CODEC, 1)
    if not (w > 0 and h > 0 and s > 0) or w * h * s > max_page_bytes:
        raise TiffError(f"a page of {w} x {h} x {s} samples")
    if any(b != 8 for b in t.get(BITS, (1,))):
        raise TiffError("samples are not of 8 bits")
    planes = s if one(PLANAR, 1) == 2 else 1
    per = 1 if planes > 1 else s
    tiled = TILES in t
    pw, ph = (one(TILE_W), one(TILE_H)) if tiled else (w, min(one(STRIP_ROWS, h), h))
    if pw <= 0 or ph <= 0 or pw * ph * per > max_page_bytes:
        raise TiffError("a strip or tile without size, or too large")
    starts, counts = (t.get(TILES, ()), t.get(TILE_BYTES, ())) if tiled else (t.get(STRIPS, ()), t.get(STRIP_BYTES, ()))
    across, down = -(-w // pw), -(-h // ph)
    if min(len(starts), len(counts)) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    out = np.zeros((h, w, s), dtype=np.uint8)
    for k in range(across * down * planes):
        plane, r = divmod(k, across * down)
        y, x = r // across * ph, r % across * pw
        rows = ph if tiled else min(ph, h - y)
        size = rows * pw * per
        if starts[k] + counts[k] > len(data):
            raise TiffError("a strip or tile lies outside the file")
        raw = decode_part(data[starts[k] : starts[k] + counts[k]], codec, size)
        if len(raw) < size:
            raise TiffError("a strip or tile is too short")
        a = np.frombuffer(raw, dtype=np.uint8).reshape(rows, pw, per)
        if one(PREDICTOR, 1) == 2:
            a = np.cumsum(a, axis=1, dtype=np.uint8)
        elif one(PREDICTOR, 1) != 1:
            raise TiffError("another predictor")
        part = a[: min(rows, h - y), : min(pw, w - x)]
        if planes > 1:
            out[y : y + part.shape[0], x : x + part.shape[1], plane] = part[:, :, 0]
        else:
            out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def read_pages(data: bytes, max_page_bytes: int = MAX_PAGE) -> Iterator[tuple[dict[int, tuple], np.ndarray]]:
    """(tags, samples) of each page."""
    if data[:4] not in (b"II*\0", b"MM\0*") or len(data) < 8:
        raise TiffError("not a TIFF file")
    e = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(e + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, e)
        yield tags, _page(data, tags, max_page_bytes)


PAGES = (
    "{key}, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, "
    "n_bytes long, pixels binary, error string"
)


def tiff_pages(files: DataFrame, key: str = "doc_id", content: str = "content", max_page_bytes: int = MAX_PAGE, carry: Sequence[str] = ()) -> DataFrame:
    """One row per page of the TIFF files in column content, a file's pages in order and next to each other; the carried columns go with each page."""
    ship(files.sparkSession)
    rows = files.where(F.col(content).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(content).alias("data"), *carry)
    extra = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.int64(), pa.binary(), pa.string()]
        names = ["doc_id", "page", "width", "height", "samples", "compression", "predictor", "tiled", "n_bytes", "pixels", "error", *carry]

        def made(b: pa.RecordBatch, held: list[list], at: list[int]) -> pa.RecordBatch:
            more = [b.column(c).take(pa.array(at)) for c in range(2, b.num_columns)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)] + more, names=names)

        for b in batches:
            held: list[list] = []
            at: list[int] = []
            size = 0
            for r, (k, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                n, pages = 0, read_pages(bytes(v.as_py()), max_page_bytes)
                while True:
                    try:
                        t, p = next(pages)
                        row = [k, n, p.shape[1], p.shape[0], p.shape[2], t.get(CODEC, (1,))[0], t.get(PREDICTOR, (1,))[0], TILES in t, p.size, p.tobytes(), None]
                    except StopIteration:
                        break
                    except (TiffError, struct.error) as e:
                        row = [k, n, *[None] * 8, str(e)]
                    held.append(row)
                    at.append(r)
                    size += row[8] or 0
                    n += 1
                    if size > OUT_BYTES or len(held) >= ROWS:
                        yield made(b, held, at)
                        held, at, size = [], [], 0
                    if row[-1]:
                        break
            if held:
                yield made(b, held, at)

    return rows.mapInArrow(run, ", ".join([PAGES.format(key="doc_id long"), *extra]))


# texts as pictures

LAYOUTS = ((DEFLATE, 2, 0), (LZW, 1, 0), (PACKBITS, 1, 0), (DEFLATE, 1, 64))


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def store(data: bytes) -> bytes:
    """data (rows of 64 pixels) as a file; its own checksum picks one of four layouts, so that equal data are equal files."""
    codec, predictor, tile = LAYOUTS[zlib.crc32(data) % len(LAYOUTS)]
    a = np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW // 3, 3)
    return write_tiff([a[y : y + PAGE_ROWS] for y in range(0, len(a), PAGE_ROWS)], codec, predictor, tile)


class Features:
    """Pages, rows, mean and spread of the samples, entropy in bits, and a difference hash of all rows, page by page."""

    def __init__(self) -> None:
        self.counts, self.pages = np.zeros(256, dtype=np.int64), 0
        self.grid: list[np.ndarray] = []  # eight sums of each row

    def add(self, page: np.ndarray) -> None:
        self.counts += np.bincount(page.ravel(), minlength=256)
        self.pages += 1
        columns = np.linspace(0, ROW, 9, endpoint=False).astype(int)
        self.grid.append(np.add.reduceat(page.reshape(len(page), -1), columns, axis=1, dtype=np.uint32))

    def said(self) -> str:
        counts, n = self.counts, self.counts.sum()
        mean = (counts * np.arange(256)).sum() / n
        spread = np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / n)
        q = counts[counts > 0] / n
        grid = np.concatenate(self.grid)
        rows = np.array([x.sum(0, dtype=np.int64) for x in np.array_split(grid, min(8, len(grid)))])
        bits = np.packbits((rows[:, 1:] > rows[:, :-1]).ravel()).tobytes().hex()
        return f"pages={self.pages};rows={len(grid)};mean={mean:.4f};spread={spread:.4f};entropy={-(q * np.log2(q)).sum():.4f};hash={bits}"


def features(pages: list[np.ndarray]) -> str:
    f = Features()
    for p in pages:
        f.add(p)
    return f.said()


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text as a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, some in texts(batches, 64):
            made = [(n, store(data)) for n, data in map(payload, some)]
            cols = [pa.array(keys, pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media"])

    return keyed_texts(docs, key, text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def described(pages: DataFrame) -> DataFrame:
    """One row per file from its pages (tiff_pages' rows in their order, with text_bytes, media_bytes and media_sha256): digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        head, out = None, []

        def finished() -> tuple:
            return (head[0], head[1], size, digest.hexdigest(), zlib.crc32(tail), head[2], head[3], feature.said())

        for b in batches:
            for r in range(b.num_rows):
                k, page, height, pixels, error, *more = (b.column(c)[r].as_py() for c in range(b.num_columns))
                if error:
                    raise TiffError(f"the stored file of {k}: {error}")
                if page == 0:
                    if head:
                        out.append(finished())
                    head, size, tail, digest, feature = (k, *more), 0, b"", hashlib.sha256(), Features()
                digest.update(pixels)
                size, tail = size + len(pixels), (tail + pixels[-16:])[-16:]
                feature.add(np.frombuffer(pixels, dtype=np.uint8).reshape(height, -1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if head:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(finished()), kinds)], names=names)

    return pages.select("doc_id", "page", "height", "pixels", "error", "text_bytes", "media_bytes", "media_sha256").mapInArrow(run, DIGESTS)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a TIFF file, that column read again page by page, and the pages described.

    The three steps run in one stage, without a shuffle, so a file's pages stay
    next to each other. A null text is stored as an empty one (one row of
    spaces); texts of any length take as many pages as they need; repeated rows
    and ids give their rows each; an empty table gives none; other columns are
    ignored.
    """
    files = stored(docs, key, text).select("doc_id", F.col("n_bytes").alias("text_bytes"), "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return described(tiff_pages(files, content="media", carry=["text_bytes", "media_bytes", "media_sha256"]))
