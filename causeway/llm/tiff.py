"""TIFF images as table columns: documents to images, images to one row per page.

The reader walks the chain of image directories (either byte order), decodes strips or tiles packed by
PackBits, LZW or deflate, undoes horizontal differencing and puts the parts together.  The writer makes
8-bit grey images of 64 samples a row, in pages of bounded height.  A page's codec, predictor and layout follow from a hash of its
samples: a third of all pages each for PackBits, LZW and deflate, half of them in tiles and half in strips, whatever their size.

Nothing is taken on trust: sizes are checked against the bytes there are before anything is allocated, and decoders stop at the
size that the directory states.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import batched

#: Tags and codes of the TIFF 6.0 specification (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 317, 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
CLEAR, END, FIRST = 256, 257, 258

#: Samples a row; a payload is padded to a positive multiple of it.
ROW = 64
PAGE_ROWS = 1024
STRIP_ROWS = 64
TILE = 64
#: Decoded bytes of a page at most (own pages have 64 KiB); larger ones give an error row.
PAGE_BYTES = 1 << 28
#: Most bytes that one packed byte can stand for, by codec; images that state more are broken.
RATIO = {NONE: 1, LZW: 4096, ADOBE_DEFLATE: 1100, DEFLATE: 1100, PACKBITS: 64}
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(row: bytes) -> bytes:
    """Runs of three or more bytes as a count and the byte, other bytes as they are.  The format packs every row by itself."""
    out, at = bytearray(), 0
    for run in _RUN.finditer(row):
        for a in range(at, run.start(), 128):
            part = row[a : min(a + 128, run.start())]
            out.append(len(part) - 1)
            out += part
        at = run.end()
        out += bytes((257 - (at - run.start()), row[run.start()]))
    for a in range(at, len(row), 128):
        part = row[a : a + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    """At most ``size`` bytes, give or take a packet."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def code_widths() -> np.ndarray:
    """Bits of the codes after a clear code, in their order.

    Writer and reader widen one entry early, as the specification asks; the first code adds no entry.
    """
    entries = FIRST + np.maximum(np.arange(4094 - FIRST + 2) - 1, 0)
    return np.where(entries < 511, 9, np.where(entries < 1023, 10, np.where(entries < 2047, 11, 12)))


_WIDTHS = code_widths()
_SINGLES = [bytes((i,)) for i in range(256)]
#: Codes between two clear codes, so that none needs more than 12 bits.
_CODES = 4094 - FIRST


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; cleared before a code would need more."""
    codes, places, word, place = [CLEAR], [0], b"", 0
    table, following = dict(zip(_SINGLES, range(256), strict=True)), FIRST
    for byte in map(_SINGLES.__getitem__, data):
        more = word + byte
        if more in table:
            word = more
            continue
        codes.append(table[word])
        places.append(place)
        place += 1
        table[more] = following
        following += 1
        word = byte
        if place == _CODES:
            codes.append(CLEAR)
            places.append(place)
            table, following, place = dict(zip(_SINGLES, range(256), strict=True)), FIRST, 0
    if word:
        codes.append(table[word])
        places.append(place)
        place += 1
    codes.append(END)
    places.append(place)
    bit, width = np.arange(11, -1, -1), _WIDTHS[np.array(places)]
    bits = (np.array(codes)[:, None] >> bit) & 1
    return np.packbits(bits[bit < width[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """At most ``size`` bytes, give or take a word.  Widths follow from the number of codes since the last clear code, so a run of codes is cut at once."""
    bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at = 8 * len(data), 0
    ends = np.cumsum(_WIDTHS)
    out: list[bytes] = []
    length = 0
    fresh = False
    while at + 9 <= total and length < size:
        n = int(np.searchsorted(ends, total - at, side="right"))
        starts = at + ends[:n] - _WIDTHS[:n]
        cell = starts >> 3
        word = bits[cell] << 16 | bits[cell + 1] << 8 | bits[cell + 2]
        codes = word >> (24 - (starts & 7) - _WIDTHS[:n]) & ((1 << _WIDTHS[:n]) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        last = int(stop[0]) if stop.size else n
        table, before = None, b""
        for code in codes[:last].tolist():
            if table is None:
                table = [*_SINGLES, b"", b""]
                if code > 255:
                    raise ValueError("LZW code beyond the table")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(before + entry[:1])
            elif code == len(table):
                entry = before + before[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code beyond the table")
            out.append(entry)
            length += len(entry)
            before = entry
            if length >= size:
                break
        if not stop.size or codes[last] == END:
            if not stop.size and n == len(_WIDTHS):
                raise ValueError("LZW table runs over")
            break
        if last == 0 and fresh:
            raise ValueError("LZW clear codes without an end")
        fresh = last == 0
        at += int(ends[last])
    return b"".join(out)


def inflate(data: bytes, size: int) -> bytes:
    """At most ``size`` bytes, whatever the stream would grow to."""
    return zlib.decompressobj().decompress(data, size)


_PACK = {NONE: bytes, LZW: lzw_encode, ADOBE_DEFLATE: lambda d: zlib.compress(d, 1), DEFLATE: lambda d: zlib.compress(d, 1)}
_UNPACK = {NONE: lambda d, n: d, LZW: lzw_decode, ADOBE_DEFLATE: inflate, DEFLATE: inflate, PACKBITS: unpack_bits}


def encode_image(pages: list[np.ndarray], kinds: list[tuple[int, int, bool]], order: str = "<") -> bytes:
    """A TIFF of grey 8-bit pages (rows by samples); ``kinds`` has each page's codec, predictor, and whether it lies in square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page, (compression, predictor, tiled) in zip(pages, kinds, strict=True):
        height, width = page.shape
        if tiled:
            full = np.zeros((-(-height // TILE) * TILE, -(-width // TILE) * TILE), np.uint8)
            full[:height, :width] = page
            parts = [full[y : y + TILE, x : x + TILE] for y in range(0, full.shape[0], TILE) for x in range(0, full.shape[1], TILE)]
        else:
            parts = [page[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1), np.uint8))
            raw, across = np.ascontiguousarray(part, np.uint8).tobytes(), part.shape[1]
            packed = b"".join(pack_bits(raw[a : a + across]) for a in range(0, len(raw), across)) if compression == PACKBITS else _PACK[compression](raw)
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        entries = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        if tiled:
            entries |= {TILE_WIDTH: (4, [TILE]), TILE_HEIGHT: (4, [TILE]), TILE_OFFSETS: (4, offsets), TILE_SIZES: (4, sizes)}
        else:
            entries |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [STRIP_ROWS]), STRIP_SIZES: (4, sizes)}
        directory = bytearray(struct.pack(order + "H", len(entries)))
        for tag in sorted(entries):
            kind, values = entries[tag]
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind][0]}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            directory += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + len(directory)
        out += directory + b"\0\0\0\0"
    return bytes(out)


def walk(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The image directories in their order, each as tag to values.  Raises ``ValueError`` on a bad header or a loop."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF image")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken chain of image directories")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * count > len(data):
            raise ValueError("image directory cut short")
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                code, size = TYPES[kind]
                place = at + 10 + 12 * k
                if n * size > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                if place + n * size > len(data):
                    raise ValueError("values lie outside the file")
                tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, place))
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def decode_page(data: bytes, tags: dict[int, list[int]], page_bytes: int = PAGE_BYTES) -> np.ndarray:
    """Rows by columns by samples of one directory's image, 8 bits a sample.  Raises ``ValueError`` on what it can't or won't decode."""
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    samples, compression = tags.get(SAMPLES, [1])[0], tags.get(COMPRESSION, [NONE])[0]
    predictor = tags.get(PREDICTOR, [1])[0]
    if compression not in _UNPACK or set(tags.get(BITS, [8])) != {8} or predictor not in (1, 2) or tags.get(PLANAR, [1])[0] != 1:
        raise ValueError("unsupported kind of TIFF image")
    tiled = TILE_OFFSETS in tags
    across, down = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(ROWS_PER_STRIP, [height])[0], height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    if min(width, height, samples, across, down) < 1:
        raise ValueError("an image, strip or tile without extent")
    columns = -(-width // across)
    if len(offsets) != len(sizes) or len(offsets) != columns * -(-height // down):
        raise ValueError("wrong number of strips or tiles")
    if max(width * height, across * down) * samples > page_bytes:
        raise ValueError(f"page of more than {page_bytes} bytes")
    if any(at + n > len(data) for at, n in zip(offsets, sizes, strict=True)):
        raise ValueError("strip or tile outside the file")
    heights = [down if tiled else min(down, height - k // columns * down) for k in range(len(offsets))]
    if any(rows * across * samples > RATIO[compression] * (n + 1) for rows, n in zip(heights, sizes, strict=True)):
        raise ValueError("strip or tile cut short")
    out = np.zeros((height, width, samples), np.uint8)
    for k, (at, n, rows) in enumerate(zip(offsets, sizes, heights, strict=True)):
        y, x = k // columns * down, k % columns * across
        size = rows * across * samples
        raw = np.frombuffer(_UNPACK[compression](data[at : at + n], size), np.uint8)
        if raw.size < size:
            raise ValueError("strip or tile cut short")
        part = raw[:size].reshape(rows, across, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        out[y : y + down, x : x + across] = part[: height - y, : width - x]
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8 with zero bytes up to a positive multiple of 64, and its length without them."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\0"), len(raw)


def kind_of(page: bytes) -> tuple[int, int, bool]:
    """Codec, predictor and layout of a page, by a hash of its samples: all kinds get even shares of pages of any size."""
    h = zlib.crc32(page)
    compression = (PACKBITS, LZW, ADOBE_DEFLATE)[h % 3]
    return compression, 1 if compression == PACKBITS else 1 + (h // 3) % 2, bool((h // 6) % 2)


def image_of(payload: bytes) -> bytes:
    """A payload as an image of one or more pages, each of the kind that its samples choose."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    pages = [rows[at : at + PAGE_ROWS] for at in range(0, len(rows), PAGE_ROWS)]
    return encode_image(pages, [kind_of(p.tobytes()) for p in pages])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: every whole text as a TIFF.  A null text counts as empty; equal texts give equal media."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(200, batches):
            made = [(image_of(p), n) for p, n in map(payload_of, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([m for m, _ in made], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")


PAGE_FIELDS = "page int, n_pages int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"


def read_pages(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("id",), page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row per page of every image, with the columns in ``keep``; the page columns' names must not be among them.

    A null image, or one whose header can't be read, gives one row with null page columns and ``error``; a page that can't be
    decoded gives such a row in its place, and what follows it is left out.  Pages of an image follow each other in order.
    """
    kept = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, *(x.split()[0] for x in PAGE_FIELDS.split(", "))]
    if len(set(names)) < len(names):
        raise ValueError(f"columns that pages have too: {sorted({n for n in names if names.count(n) > 1})}")

    def rows_of(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError("no image")
            directories, broken = [], None
            try:
                directories.extend(walk(data))
            except (ValueError, struct.error) as e:
                broken = e
            for n, tags in enumerate(directories):
                image = decode_page(data, tags, page_bytes)
                yield n, len(directories), image.shape[1], image.shape[0], image.shape[2], tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0], image.tobytes(), None
            if broken or not directories:
                raise broken or ValueError("no image directory")
        except (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
            yield (None,) * 8 + (f"{type(e).__name__}: {e}",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 7 + [pa.binary(), pa.string()]

        def made(batch: pa.RecordBatch, rows: list, source: list) -> pa.RecordBatch:
            columns = [c.take(pa.array(source, pa.int32())) for c in batch.columns[: len(keep)]]
            own = list(zip(*rows, strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays(columns + [pa.array(c, t) for c, t in zip(own, types, strict=True)], names=names)

        for batch in batched(200, batches):
            rows, source, size = [], [], 0
            for k in range(batch.num_rows):
                for row in rows_of(batch.column(len(keep))[k].as_py()):
                    rows.append(row)
                    source.append(k)
                    size += len(row[7] or b"")
                    if size > 8 << 20:
                        yield made(batch, rows, source)
                        rows, source, size = [], [], 0
            yield made(batch, rows, source)

    return media.select(*keep, F.col(media_col).alias("_media")).mapInArrow(run, f"{kept}, {PAGE_FIELDS}")


_FOLDED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in their order to one row an image: digests of the samples, and their mean, spread and horizontal contrast."""
    state = None
    for batch in batched(200, batches):
        done = []
        for row in batch.to_pylist():
            if row["error"]:
                raise ValueError(f"document {row['id']}: {row['error']}")
            pixels = np.frombuffer(row["pixels"], np.uint8)
            wide = pixels.reshape(row["height"], -1).astype(np.int64)
            if row["page"] == 0:
                state = [hashlib.sha256(), 0, 0, 0, 0, set()]
            state[0].update(row["pixels"])
            state[1] += pixels.size
            state[5].add(row["compression"])
            state[2] += int(wide.sum())
            state[3] += int((wide * wide).sum())
            state[4] += int(np.abs(np.diff(wide, axis=1)).sum())
            if row["page"] == row["n_pages"] - 1:
                n = state[1]
                mean = state[2] / n
                spread = max(0.0, state[3] / n - mean * mean) ** 0.5
                feature = f"pages={row['n_pages']};codecs={'+'.join(map(str, sorted(state[5])))};mean={mean:.4f};spread={spread:.4f};contrast={state[4] / n:.4f}"
                done.append({"doc_id": row["id"], "n_bytes": row["n_bytes"], "payload_bytes": n, "payload_sha256": state[0].hexdigest(), "tail_crc32": zlib.crc32(row["pixels"][-64:]), "media_bytes": row["media_bytes"], "media_sha256": row["media_sha256"], "feature": feature})
        names = [x.split()[0] for x in _FOLDED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in zip(names, types, strict=True)], names=names)


def document_media(docs: DataFrame) -> DataFrame:
    """The contract's columns: every text stored as a TIFF, read back page by page and folded to a row again."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    stored = store_texts(rows).withColumns({"media_bytes": F.octet_length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)})
    return read_pages(stored, keep=("id", "n_bytes", "media_bytes", "media_sha256")).mapInArrow(_fold, _FOLDED)
