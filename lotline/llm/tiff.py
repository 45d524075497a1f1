"""TIFF as a media column: encode 8-bit samples, walk image directories, decode strips and tiles.

decode() follows the directories of a file of either byte order and gives one page a directory:
uncompressed, PackBits, LZW and deflate data, in strips or tiles, with horizontal differencing undone.
encode() writes what the decoder reads; the unit of the stored samples is 8 bits.
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
from pyspark.sql.types import StructType

from lotline.llm.common import small_batches

# Tags, compressions and type sizes of TIFF 6.0 and its supplements
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257

#: Bytes of a row: 64 pixels of three samples.
ROW = 192
#: Rows of a page; a longer payload has more pages.
PAGE_ROWS = 32


_RUN = re.compile(rb"(?s)(.)\1\1+")


def packbits_encode(data: bytes) -> bytes:
    """Runs of three equal bytes or more as a count and the byte, all else copied; 128 at a time."""
    out, done = bytearray(), 0

    def copied(stop: int) -> None:
        for at in range(done, stop, 128):
            n = min(128, stop - at)
            out.append(n - 1)
            out.extend(data[at : at + n])

    for run in _RUN.finditer(data):
        copied(run.start())
        done, stop = run.start(), run.end()
        while stop - done >= 3:
            n = min(128, stop - done)
            out.extend((257 - n, data[done]))
            done += n
    copied(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        k = data[at]
        if k < 128:
            out += data[at + 1 : at + 2 + k]
            at += 2 + k
        else:
            if k > 128:
                out += data[at + 1 : at + 2] * (257 - k)
                at += 2
            else:
                at += 1
    return bytes(out)


#: Bits of the n-th code after a clear code: a code is read when the table has 258 + n entries at most.
_WIDTHS = np.searchsorted([512, 1024, 2048], np.arange(258, 4097), side="right") + 9


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths grow one code early."""
    codes, widths, table, size = [CLEAR], [_WIDTHS[:1]], {}, 258
    if data:
        since, prefix = 1, data[0]
        for b in data[1:]:
            longer = prefix << 8 | b
            known = table.get(longer)
            if known is not None:
                prefix = known
                continue
            codes.append(prefix)
            table[longer] = size
            size += 1
            prefix = b
            if size == 4094:
                codes.append(CLEAR)
                widths.append(_WIDTHS[: len(codes) - since])
                table, size, since = {}, 258, len(codes)
        codes += [prefix, END]
        widths.append(_WIDTHS[: len(codes) - since])
    else:
        codes, widths = [CLEAR, END], [_WIDTHS[:2]]
    bits = np.arange(11, -1, -1)
    each = np.array(codes, np.uint16)[:, None] >> bits.astype(np.uint16) & 1
    return np.packbits(each[bits < np.concatenate(widths)[:, None]].astype(np.uint8)).tobytes()


def _lzw_codes(data: np.ndarray, at: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes from bit ``at`` on, ``since`` codes after a clear code, with the bit at which each ends."""
    room = (len(data) - 4) * 8 - at
    widths = _WIDTHS[np.minimum(np.arange(since, since + min(4096, max(room, 0) // 9)), len(_WIDTHS) - 1)]
    ends = at + np.cumsum(widths)
    widths, ends = widths[ends <= at + room], ends[ends <= at + room]
    byte = (ends - widths) >> 3
    window = data[byte].astype(np.int64) << 16 | data[byte + 1].astype(np.int64) << 8 | data[byte + 2]
    return window >> 24 - ((ends - widths) & 7) - widths & (1 << widths) - 1, ends


def lzw_decode(data: bytes) -> bytes:
    """The bytes up to the end code, or to the last whole code where there is none."""
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    at = since = 0
    last, out = b"", []
    while True:
        codes, ends = _lzw_codes(padded, at, since)
        if not len(codes):
            return b"".join(out)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stops[0]) if len(stops) else len(codes)
        for code in codes[:n].tolist():
            if not last:
                last = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
                last = entry
            out.append(last)
        if n == len(codes):
            at, since = int(ends[-1]), since + n
        elif codes[n] == END:
            return b"".join(out)
        else:
            at, since, last = int(ends[n]), 0, b""
            del table[258:]


def _compress(data: bytes, how: int) -> bytes:
    if how == DEFLATE:
        return zlib.compress(data, 1)
    return {LZW: lzw_encode, PACKBITS: packbits_encode, NONE: bytes}[how](data)


def _expand(data: bytes, how: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if how not in (NONE, LZW, PACKBITS):
        raise ValueError(f"TIFF compression {how} is not supported")
    return {LZW: lzw_decode, PACKBITS: packbits_decode, NONE: bytes}[how](data)


def encode(pages: list[np.ndarray], how: int = DEFLATE, predictor: int = 1, strip_rows: int = 64, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF of ``pages``, arrays (height, width, samples) of uint8. ``tile``: edge of square tiles,
    a multiple of 16; 0 for strips of ``strip_rows`` rows. ``predictor`` 2: horizontal differences."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for px in pages:
        height, width, samples = px.shape
        blocks = []
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, samples), np.uint8)
            full[:height, :width] = px
            cuts = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        else:
            cuts = [px[y : y + strip_rows] for y in range(0, height, strip_rows)]
        for c in cuts:
            if predictor == 2:
                c = np.concatenate([c[:, :1], c[:, 1:] - c[:, :-1]], axis=1)
            blocks.append(_compress(np.ascontiguousarray(c).tobytes(), how))
        offsets, counts = [], []
        for b in blocks:
            offsets.append(len(out))
            counts.append(len(b))
            out += b + b"\0" * (len(b) % 2)
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, counts)]
        fields = []
        for tag, kind, values in sorted(entries):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                data, at = struct.pack(order + "I", len(out)), data
                out += at + b"\0" * (len(at) % 2)
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The integer fields of each directory, first to last; a directory met twice ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        fields = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            where = at + 10 + 12 * i
            if TYPE_SIZE.get(kind, 1) * n > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if kind in (1, 3, 4):
                fields[tag] = list(struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, where))
        yield fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]


def decode(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF of 8-bit, interleaved samples, as arrays (height, width, samples)."""
    for d in directories(data):
        width, height, samples = d[WIDTH][0], d[HEIGHT][0], d.get(SAMPLES, [1])[0]
        if set(d.get(BITS, [1])) != {8}:
            raise ValueError("only 8-bit samples are supported")
        how, predictor = d.get(COMPRESSION, [NONE])[0], d.get(PREDICTOR, [1])[0]
        px = np.zeros((height, width, samples), np.uint8)
        if TILE_OFFSETS in d:
            tw, th = d[TILE_WIDTH][0], d[TILE_HEIGHT][0]
            across = -(-width // tw)
            places = [(i // across * th, i % across * tw, th, tw, o, c) for i, (o, c) in enumerate(zip(d[TILE_OFFSETS], d[TILE_COUNTS]))]
        else:
            rows = min(d.get(ROWS_PER_STRIP, [height])[0], height)
            places = [(i * rows, 0, min(rows, height - i * rows), width, o, c) for i, (o, c) in enumerate(zip(d[STRIP_OFFSETS], d[STRIP_COUNTS]))]
        for y, x, h, w, offset, count in places:
            block = np.frombuffer(_expand(data[offset : offset + count], how), np.uint8)[: h * w * samples].reshape(h, w, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            px[y : y + h, x : x + w] = block[: height - y, : width - x]
        yield px


def store(payload: bytes) -> bytes:
    """``payload``, a positive multiple of ROW bytes, as a TIFF of rows of 64 RGB pixels.

    A checksum of the payload chooses compression, predictor, strips or tiles and byte order, so texts
    of every length use all of them and equal ones are stored alike.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    pages = [rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)]
    mark = zlib.crc32(payload)
    pick = lambda shift, choices: choices[(mark >> shift) % len(choices)]
    return encode(pages, pick(16, (LZW, PACKBITS, DEFLATE)), pick(0, (1, 2)), strip_rows=PAGE_ROWS // 2, tile=pick(1, (0, 16)), order=pick(2, "<>"))


ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(kept: DataFrame, more: str) -> StructType:
    return StructType(kept.schema.fields + StructType.fromDDL(more).fields)


def _batch(kept: pa.RecordBatch, columns: list[list], schema: StructType) -> pa.RecordBatch:
    """The columns of ``kept``, as they are (ids stay whole numbers beside nulls), and further ones."""
    types = [ARROW[f.dataType.simpleString()] for f in schema.fields[kept.num_columns :]]
    return pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, t) for c, t in zip(columns, types)]], names=schema.names)


def stored(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` (text and ``keep``) with its text stored as a TIFF: keep, n_bytes, media.

    The UTF-8 bytes (null: none) are followed by blanks up to a positive multiple of ROW.
    """
    schema = _schema(docs.select(*keep), "n_bytes long, media binary")
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()]
            media = [store(b.ljust(max(-(-len(b) // ROW), 1) * ROW)) for b in data]
            yield _batch(batch.select(range(batch.num_columns - 1)), [[len(b) for b in data], media], schema)

    return docs.select(*keep, "text").mapInArrow(make, schema)


PAGE = "page int, pages int, width int, height int, samples int, data binary"


def pages(media: DataFrame, *keep: str) -> DataFrame:
    """One row per page of each file in ``media`` (media and ``keep``): see PAGE; ``data`` has the
    samples row by row. The pages of a file follow one another. A null file has no pages."""
    schema = _schema(media.select(*keep), PAGE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, file in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = list(decode(file)) if file is not None else []
                which += [i] * len(found)
                rows += [(k, len(found), p.shape[1], p.shape[0], p.shape[2], p.tobytes()) for k, p in enumerate(found)]
            if rows:
                yield _batch(batch.select(range(batch.num_columns - 1)).take(pa.array(which)), list(zip(*rows)), schema)

    return media.select(*keep, "media").mapInArrow(read, schema)


FILE = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pages int, feature string"


def summaries(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): stored as TIFF, read back page by page, and summed up.

    feature: pages, height, and of the samples of all pages the mean, deviation and entropy (bits) and
    the mean step between rows, to four digits. Equal texts give equal values. Null and empty texts
    are one row of blanks; a text of any length is one file. Rows with equal or null ids are kept, a
    row each; ids of any size come back as they are. Other columns are not read.
    """
    rows = stored(docs, "doc_id")
    rows = rows.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    schema = _schema(docs.select("doc_id"), FILE)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pages of a file stand together and in order, but may be cut by a batch
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                held.append(row)
                if row["page"] + 1 == row["pages"]:
                    out.append((row["doc_id"], *summary(held)))
                    held = []
            if out:
                ids, *rest = zip(*out)
                kept = pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type)], names=["doc_id"])
                yield _batch(kept, rest, schema)

    return pages(rows, *keep).mapInArrow(fold, schema)


def summary(rows: list[dict]) -> tuple:
    """What FILE says of a file, from the rows of its pages."""
    sha, counts, steps, n_steps, size, height, tail = hashlib.sha256(), np.zeros(256, np.int64), 0, 0, 0, 0, b""
    for r in rows:
        sha.update(r["data"])
        px = np.frombuffer(r["data"], np.uint8)
        counts += np.bincount(px, minlength=256)
        lines = px.reshape(r["height"], -1).astype(np.int16)
        steps += int(np.abs(np.diff(lines, axis=0)).sum())
        n_steps += (r["height"] - 1) * lines.shape[1]
        size, height, tail = size + len(px), height + r["height"], (tail + r["data"][-16:])[-16:]
    p = counts[counts > 0] / size
    mean = float((counts * np.arange(256)).sum() / size)
    var = float((counts * (np.arange(256) - mean) ** 2).sum() / size)
    feature = f"pages={len(rows)};height={height};mean={mean:.4f};deviation={var**0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={steps / n_steps if n_steps else 0:.4f}"
    first = rows[0]
    return first["n_bytes"], size, sha.hexdigest(), zlib.crc32(tail), first["media_bytes"], first["media_sha256"], len(rows), feature
