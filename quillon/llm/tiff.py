"""TIFF columns: write bytes as grey pages, and read a baseline file's pages back, but for CCITT compression.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that are raw, PackBits, LZW or
deflate, undoes the horizontal predictor of 8-bit samples and emits one row a page, with a byte for each sample of 1, 2, 4 or 8 bits. The writer lays a payload out as pages of 96 pixels a row;
the payload's own hash picks each page's layout and compression, so that equal payloads give equal files and a corpus uses all
of them.

Defined cases: a null file gives no rows; a page that cannot be decoded gives a row with `error` set and no pixels, and the pages
after it are read; where the chain of directories is damaged, one such row is the file's last; a chain that returns to itself is
damage, an entry whose values lie outside the file counts as missing, and pages of 2 GB or more are not read; an empty table gives
no rows; a null text is stored like an empty one; repeated rows give repeated rows; columns other than those named are ignored.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

UNIT, WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 576, 96, 384, 96, 48
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Pages in sixteen that are written with LZW and with PackBits; the others use deflate.
_LZW_SHARE, _PACKBITS_SHARE = 1, 1

_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(upto: int) -> None:
        for i in range(at, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUNS.finditer(data):
        literal(m.start())
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, most: int | None = None) -> bytes:
    """The runs of data, or as many as give `most` bytes."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


_CLEAR, _END = 256, 257
_SINGLE = [bytes((i,)) for i in range(256)]


def lzw(data: bytes) -> bytes:
    """Codes from the high bit on, of 9 to 12 bits, widened one code early as the format has it."""
    known = {s: i for i, s in enumerate(_SINGLE)}
    bits, filled, width, free = _CLEAR, 9, 9, 258
    out = bytearray()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        bits, filled = bits << width | known[word], filled + width
        known[longer] = free
        free += 1
        if free == 4094:
            bits, filled = bits << width | _CLEAR, filled + width
            known, free, width = {s: i for i, s in enumerate(_SINGLE)}, 258, 9
        elif free == 1 << width:
            width += 1
        word = data[i : i + 1]
        if filled >= 512:
            out += (bits >> (filled & 7)).to_bytes(filled >> 3, "big")
            bits, filled = bits & ((1 << (filled & 7)) - 1), filled & 7
    if word:
        bits, filled = bits << width | known[word], filled + width
        free += 1
        width += free == 1 << width
    bits, filled = bits << width | _END, filled + width
    fill = -filled % 8
    return bytes(out) + (bits << fill).to_bytes((filled + fill) // 8, "big")


def unlzw(data: bytes, most: int | None = None) -> bytes:
    """What the codes stand for, or as many of them as give `most` bytes; without a first clear code the table starts plain."""
    out: list[bytes] = []
    known: list[bytes] = [*_SINGLE, b"", b""]
    bits, filled, width, at, size = 0, 0, 9, 0, 0
    last = b""
    while most is None or size < most:
        while filled < width:
            if at >= len(data):
                return b"".join(out)
            part = data[at : at + 32]
            bits, filled, at = (bits & ((1 << filled) - 1)) << 8 * len(part) | int.from_bytes(part, "big"), filled + 8 * len(part), at + 32
        filled -= width
        code = bits >> filled & ((1 << width) - 1)
        if code == _END:
            return b"".join(out)
        if code == _CLEAR:
            known, width, last = [*_SINGLE, b"", b""], 9, b""
            continue
        if code < len(known):
            word = known[code]
        elif code == len(known) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code without meaning")
        out.append(word)
        size += len(word)
        if last and len(known) < 4096:
            known.append(last + word[:1])
            if len(known) == (1 << width) - 1 and width < 12:
                width += 1
        last = word
    return b"".join(out)


def _pack(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
    data = block.tobytes()
    return {RAW: bytes, LZW: lzw, PACKBITS: packbits, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def write_tiff(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS) -> bytes:
    """A little-endian file whose pages' pixels, page after page, are the payload; its length is a multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for at in range(0, len(rows), page_rows):
        page = rows[at : at + page_rows]
        pick = zlib.crc32(page)
        kind = pick & 15
        compression = LZW if kind < _LZW_SHARE else PACKBITS if kind < _LZW_SHARE + _PACKBITS_SHARE else DEFLATE
        predictor, tiled = 1 + (pick >> 4 & 1 if compression != PACKBITS else 0), pick >> 5 & 3 == 0
        if tiled:
            down = -(-len(page) // TILE)
            padded = np.zeros((down * TILE, width), np.uint8)
            padded[: len(page)] = page
            blocks = [padded[y : y + TILE, x : x + TILE] for y in range(0, down * TILE, TILE) for x in range(0, width, TILE)]
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        offsets, lengths = [], []
        for block in blocks:
            data = _pack(block, compression, predictor)
            offsets.append(len(out))
            lengths.append(len(data))
            out += data
        tags: list[tuple[int, int, list[int]]] = [(256, 4, [width]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [TILE]), (323, 4, [TILE]), (324, 4, offsets), (325, 4, lengths)] if tiled else [(273, 4, offsets), (278, 4, [STRIP_ROWS]), (279, 4, lengths)]
        entries = b""
        for tag, kind, values in sorted(tags):
            if len(values) * (2 if kind == 3 else 4) > 4:
                where = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
                entries += struct.pack("<HHII", tag, kind, len(values), where)
            else:
                entries += struct.pack("<HHI", tag, kind, len(values)) + struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values).ljust(4, b"\0")
        out += b"\0" * (len(out) & 1)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


_TYPES = {1: "B", 3: "H", 4: "I"}


def read_tiff(data: bytes) -> Iterator[Page | ValueError]:
    """The file's pages, in the order of their directories; what is wrong with a page that cannot be decoded stands in its place."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories in a circle")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(f"{order}H", data, at)
            if at + 6 + 12 * n > len(data):
                raise ValueError("directory outside the file")
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
                if kind in _TYPES:
                    form = f"{order}{count}{_TYPES[kind]}"
                    where = at + 10 + 12 * i
                    if struct.calcsize(form) > 4:
                        (where,) = struct.unpack_from(f"{order}I", data, where)
                    if where + struct.calcsize(form) <= len(data):  # else the entry is damaged and counts as missing
                        tags[tag] = struct.unpack_from(form, data, where)
            (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
        except struct.error as e:
            raise ValueError("directory outside the file") from e
        try:
            page = _page(data, tags)
        except ValueError as e:
            page = e
        except MemoryError:
            page = ValueError("page too large for memory")
        yield page
        at = following


def _page(data: bytes, tags: dict[int, tuple]) -> Page:
    def one(tag: int, default: int) -> int:
        return (tags.get(tag) or (default,))[0]

    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    compression, predictor, tiled = one(259, RAW), one(317, 1), 324 in tags
    bits = one(258, 1)
    known = set(tags.get(258, (1,))) == {bits} and (bits == 8 or (bits in (1, 2, 4) and predictor == 1 and one(266, 1) == 1))
    if not width or not height or not samples or not known or predictor not in (1, 2) or one(284, 1) != 1:
        raise ValueError("page of a kind that isn't read")
    if width * height * samples >= 1 << 31:  # what a binary column holds
        raise ValueError("page larger than a value can be")
    across, down = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    if not across or not down:
        raise ValueError("tiles without a size")
    offsets, lengths = tags.get(324 if tiled else 273, ()), tags.get(325 if tiled else 279, ())
    columns = -(-width // across)
    if len(offsets) != len(lengths) or len(offsets) < columns * -(-height // down):
        raise ValueError("page with missing parts")
    page = np.zeros((height, width, samples), np.uint8)
    for i in range(columns * -(-height // down)):
        y, x = i // columns * down, i % columns * across
        rows = down if tiled else min(down, height - y)
        line = -(-across * samples * bits // 8)
        block = _unpack(data[offsets[i] : offsets[i] + lengths[i]], compression, rows * line)
        if len(block) < rows * line:
            raise ValueError("part that ends early")
        block = np.frombuffer(block, np.uint8, rows * line).reshape(rows, line)
        if bits < 8:  # each line begins with a byte of its own
            block = (block[:, :, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint8) & ((1 << bits) - 1)).reshape(rows, -1)[:, : across * samples]
        block = block.reshape(rows, across, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        page[y : y + rows, x : x + across] = block[: height - y, : width - x]
    return Page(width, height, samples, compression, predictor, tiled, page.tobytes())


def _unpack(data: bytes, compression: int, most: int) -> bytes:
    """At least the first `most` bytes, where there are so many."""
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, most)
        except zlib.error as e:
            raise ValueError("damaged deflate data") from e
    if compression == LZW:
        return unlzw(data, most)
    if compression == PACKBITS:
        return unpackbits(data, most)
    if compression == RAW:
        return data
    raise ValueError("unknown compression")


def payload_of(text: bytes) -> bytes:
    """The bytes with 255s up to a positive multiple of UNIT."""
    return text + b"\xff" * ((-len(text) % UNIT) if text else UNIT)


_OUT_BYTES = 8 << 20


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the TIFF file `media` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, files, held, at = [], [], [], 0, 0
            for text in batch.column(1):
                raw = text.as_py().encode() if text.is_valid else b""
                files.append(write_tiff(payload_of(raw)))
                size.append(len(raw))
                held += len(files[-1])
                at += 1
                if held > _OUT_BYTES or at == batch.num_rows:
                    ids = batch.column(0).slice(at - len(files), len(files))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                    size, files, held = [], [], 0

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, media binary")


_PAGE = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
PAGE_SCHEMA = "doc_id bigint, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def _page_rows(doc_id: int | None, media: bytes) -> Iterator[tuple]:
    page = 0
    try:
        for p in read_tiff(media):
            if isinstance(p, ValueError):
                yield doc_id, page, None, None, None, None, None, None, None, str(p)
                page += 1
                continue
            yield doc_id, page, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels, None
            page += 1
    except ValueError as e:
        yield doc_id, page, None, None, None, None, None, None, None, str(e)


def read_pages(media: DataFrame) -> DataFrame:
    """One row a page of every file in `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGE, strict=True)], schema=_PAGE)

        for batch in batches:
            rows, held = [], 0
            for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _page_rows(doc_id, media.as_py()) if media.is_valid else ():
                    rows.append(row)
                    held += len(row[8] or b"")
                    if held > _OUT_BYTES:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    return media.select("doc_id", "media").mapInArrow(lean(run), PAGE_SCHEMA)


def media_digest(media: DataFrame) -> DataFrame:
    """Per file what its pages, read back, hold: digests and a feature string of page count, kinds and grey levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, size, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                file = file.as_py()
                digest, length, tail = hashlib.sha256(), 0, b""
                levels, kinds, total, edges = np.zeros(8, np.int64), [], 0, 0
                for _, _, width, _, _, compression, predictor, tiled, pixels, error in _page_rows(doc_id, file):
                    if error:
                        raise ValueError(f"document {doc_id}: {error}")
                    digest.update(pixels)
                    length, tail = length + len(pixels), (tail + pixels)[-32:]
                    grey = np.frombuffer(pixels, np.uint8)
                    levels += np.bincount(grey >> 5, minlength=8)
                    total += int(grey.sum())
                    edges += int(np.abs(np.diff(grey.reshape(-1, width).astype(np.int16), axis=1)).sum())
                    kinds.append(f"{compression}.{predictor}.{int(tiled)}")
                feature = f"pages={len(kinds)};kinds={'+'.join(sorted(set(kinds)))};mean={total / length:.4f};edges={edges / length:.4f};levels={','.join(map(str, levels))}"
                rows.append((doc_id, size, length, digest.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), feature))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _DIGEST]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)], schema=_DIGEST)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), schema)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through TIFF files and back."""
    return media_digest(write_media(table(spark, sf_dir, "documents")))
