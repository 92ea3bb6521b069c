"""TIFF images in a column: one row per page, with 8-bit samples as they were before packing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, texts

# fixed values of the format: tags, field types' sizes, compressions
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that a stored byte can stand for at most: of LZW's codes, of 9 bits at least and 12 in a
#: full table, one stands for under 3,840 bytes. Deflate has 1,032; the other forms have less.
MOST_PER_BYTE = {LZW: 2600}


class BadTiff(ValueError):
    """Not a TIFF, cut short, or of a kind that is not read here."""


def packbits_encode(raw: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(raw)
    while at < n:
        run = 1
        while run < 128 and at + run < n and raw[at + run] == raw[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, raw[at]])
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and raw[end] == raw[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + raw[at:end]
        at = end
    return bytes(out)


def packbits_decode(packed: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(packed):
            raise BadTiff("PackBits data end early")
        head = packed[at]
        if head < 128:
            out += packed[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += packed[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def lzw_encode(raw: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    bits, held, width, out = 256, 9, 9, bytearray()  # begins with the clear code
    word = b""

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    for at in range(len(raw)):
        longer = word + raw[at : at + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2  # 256 and 257 are the clear and the end code
        if len(table) + 2 == 4095:
            put(256)
            table = {bytes([i]): i for i in range(256)}
            width = 9
        else:
            width = max(9, (len(table) + 2).bit_length())
        word = raw[at : at + 1]
    if word:
        put(table[word])
        width = max(9, (len(table) + 3).bit_length())
    put(257)
    put(0)  # at least fills the last byte
    return bytes(out)


def lzw_decode(packed: bytes, size: int) -> bytes:
    out, width, bits, held = bytearray(), 9, 0, 0
    table: list[bytes] = []
    last = None
    for byte in packed:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            if code >= len(table):
                raise BadTiff("LZW data do not begin with a clear code")
            word = table[code]
        else:
            if code > len(table):
                raise BadTiff("LZW code out of range")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))  # codes get longer one entry early
    if len(out) < size:
        raise BadTiff("LZW data end early")
    return bytes(out[:size])


def unpacked(packed: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = packed[:size]
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            raw = zlib.decompressobj().decompress(packed, size)
        except zlib.error as e:
            raise BadTiff(str(e)) from None
    elif compression == PACKBITS:
        raw = packbits_decode(packed, size)
    elif compression == LZW:
        raw = lzw_decode(packed, size)
    else:
        raise BadTiff(f"compression {compression} is not read")
    if len(raw) < size:
        raise BadTiff("a strip or tile is cut short")
    return raw


def packed_as(raw: bytes, compression: int) -> bytes:
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6), OLD_DEFLATE: lambda b: zlib.compress(b, 6), PACKBITS: packbits_encode}
    return pack[compression](raw)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_bytes: int = 1 << 16, order: str = "<") -> bytes:
    """A TIFF of ``pages`` of 8-bit samples, (height, width, samples) each, in strips of some
    ``strip_bytes`` or in square tiles of ``tile``."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytearray(4)
    link = 4  # where the place of the next directory is to go
    for image in pages:
        height, width, samples = image.shape
        blocks = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile, samples), np.uint8)
                    part = image[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
            layout = {TILE_WIDTH: [tile], TILE_HEIGHT: [tile]}
        else:
            rows = max(1, min(height, strip_bytes // (width * samples)))
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
            layout = {ROWS_PER_STRIP: [rows]}
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            packed = packed_as(np.ascontiguousarray(block).tobytes(), compression)
            places.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        fields |= layout | dict(zip((TILE_OFFSETS, TILE_BYTES) if tile else (STRIP_OFFSETS, STRIP_BYTES), (places, sizes), strict=True))
        entries = []
        for tag in sorted(fields):
            values = fields[tag]
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]] | BadTiff]]:
    """The fields of each image directory, one after the other; for one whose fields lead outside
    the file, what is wrong."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        raise BadTiff("no TIFF")
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen = set()
        while at:
            if at in seen:
                raise BadTiff("directories form a ring")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            fields: dict[int, list[int]] | BadTiff = {}
            try:
                for i in range(n):
                    tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                    if kind not in TYPES or kind == 2:
                        continue
                    size = struct.calcsize("=" + TYPES[kind])
                    place = at + 10 + 12 * i
                    if size * count > 4:
                        (place,) = struct.unpack_from(order + "I", data, place)
                    fields[tag] = list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, place))
            except struct.error:
                fields = BadTiff("a directory is cut short")
            yield order, fields
            end = at + 2 + 12 * n
            if isinstance(fields, BadTiff) and end + 4 > len(data):
                return  # said once
            (at,) = struct.unpack_from(order + "I", data, end)
    except struct.error:
        raise BadTiff("a directory is cut short") from None


def image_of(data: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    """A directory's samples as (height, width, samples)."""

    def one(tag: int, default: int | None = None) -> int:
        value = (fields.get(tag) or [default])[0]
        if not isinstance(value, int) or not 0 < value < 1 << 31:
            raise BadTiff(f"field {tag} is missing or out of bounds")
        return value

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if set(fields.get(BITS) or [1]) != {8}:
        raise BadTiff("only 8-bit samples are read")
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if predictor not in (1, 2):
        raise BadTiff(f"predictor {predictor} is not read")
    tiled = TILE_OFFSETS in fields
    if tiled:
        block_w, block_h, at_, size_ = one(TILE_WIDTH), one(TILE_HEIGHT), TILE_OFFSETS, TILE_BYTES
    else:
        # all ones stands for one strip
        per_strip = height if (fields.get(ROWS_PER_STRIP) or [0])[0] == 0xFFFFFFFF else one(ROWS_PER_STRIP, height)
        block_w, block_h, at_, size_ = width, min(per_strip, height), STRIP_OFFSETS, STRIP_BYTES
    across, down, planes = -(-width // block_w), -(-height // block_h), samples if planar == 2 else 1
    depth = 1 if planar == 2 else samples
    places, sizes = fields.get(at_, []), fields.get(size_, [])
    if min(len(places), len(sizes)) < across * down * planes:
        raise BadTiff("strips or tiles are missing")
    if any(not isinstance(x, int) or x < 0 for x in (*places, *sizes)):
        raise BadTiff("strips or tiles lie outside the file")
    # a field may claim any size
    if max(width * height * samples, block_w * block_h * depth) > max(1 << 16, MOST_PER_BYTE.get(compression, 1100) * len(data)):
        raise BadTiff("the image is larger than its data can be")
    out = np.empty((height, width, samples), np.uint8)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * block_h, cell % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        raw = unpacked(data[places[k] : places[k] + sizes[k]], compression, rows * block_w * depth)
        block = np.frombuffer(raw, np.uint8).reshape(rows, block_w, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        block = block[: height - y, : width - x]
        if planar == 2:
            out[y : y + block.shape[0], x : x + block.shape[1], plane] = block[:, :, 0]
        else:
            out[y : y + block.shape[0], x : x + block.shape[1]] = block
    return out


def feature(image: np.ndarray) -> str:
    """Mean, spread, and an average hash: a bit for each of 8 by 8 fields, 1 if lighter than all."""
    grey = image.mean(axis=2)
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in grey.shape)
    fields = [grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for a, b in zip(rows, rows[1:], strict=False) for c, d in zip(cols, cols[1:], strict=False)]
    bits = np.packbits(np.array(fields) > grey.mean()).tobytes().hex()
    return f"{image.shape[1]}x{image.shape[0]}x{image.shape[2]};mean={grey.mean():.4f};std={grey.std():.4f};ahash={bits}"


PAGE = "page int, width int, height int, samples_per_pixel int, compression int, samples binary, feature string, error string"


def read_pages(df: DataFrame, id_col: str = "doc_id", data_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of the TIFF in ``data_col``: doc_id, page (from 0), width, height,
    samples_per_pixel, compression, samples (rows from the top, samples of a pixel together),
    feature, error, and the columns of ``df`` named in ``carry``, which may not have these names.

    Strips and tiles, plain, PackBits, LZW or deflate, with or without the horizontal
    predictor, of either byte order, are read. A null, a value that is no TIFF, each page that cannot be
    read and a chain of pages that leads outside the file give one row with ``error`` set and no
    samples; the pages before and after it stay. A null id
    stays null, repeated rows come out as often as they come in, and an empty table gives no
    rows. Other columns of ``df`` are not read. An image is worked through by one task.
    """
    kinds = [("doc_id", pa.int64()), *((n, pa.int32()) for n in ("page", "width", "height", "samples_per_pixel", "compression")), ("samples", pa.binary()), ("feature", pa.string()), ("error", pa.string())]
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(data_col).alias("image_"), *carry)

    def pages_of(data: bytes | None) -> Iterator[tuple]:
        page = 0
        try:
            if data is None:
                raise BadTiff("null")
            for _, fields in directories(data):
                try:
                    if isinstance(fields, BadTiff):
                        raise fields
                    image = image_of(data, fields)
                except BadTiff as e:
                    yield page, None, None, None, None, None, None, str(e)
                else:
                    yield page, image.shape[1], image.shape[0], image.shape[2], (fields.get(COMPRESSION) or [1])[0], image.tobytes(), feature(image), None
                page += 1
            if not page:
                raise BadTiff("no page")
        except BadTiff as e:
            yield page, None, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                rows = list(pages_of(one["image_"][0].as_py()))
                same = pa.array([0] * len(rows), pa.int32())
                columns = [one["doc_id"].take(same), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds[1:])), *(one[c].take(same) for c in carry)]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in kinds] + list(carry))

    carried = "".join(f", {c} {slim.schema[c].dataType.simpleString()}" for c in carry)
    return slim.mapInArrow(run, f"doc_id bigint, {PAGE}{carried}")


def text_images(df: DataFrame, row_bytes: int = 192, compression: int = DEFLATE, predictor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with spaces to whole rows of
    ``row_bytes``, one at least, as the grey samples of a one-page TIFF. A null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def make():
        def media(raw: bytes) -> bytes:
            full = raw.ljust(max(1, -(-len(raw) // row_bytes)) * row_bytes)
            return write_tiff([np.frombuffer(full, np.uint8).reshape(-1, row_bytes, 1)], compression, predictor)

        def work(batch: pa.RecordBatch) -> dict:
            raw = [t.encode() for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "n_bytes": list(map(len, raw)), "media": list(map(media, raw))}

        return work

    return texts(df, id_col, text_col).mapInArrow(per_batch(make, schema, rows=64), "doc_id bigint, n_bytes bigint, media binary")
