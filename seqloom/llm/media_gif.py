"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

`encode_texts` stores bytes as 8-bit samples of 64-pixel rows in GIF frames with an identity grey
palette; `decode` reads any GIF back: it splits the blocks, decodes the LZW streams, composes every
frame on the canvas by its palette, transparent index and the disposal of the frame before, and gives
timed frames with colour-histogram columns.

Null and empty texts make one row of 64 zero samples. A null medium decodes to no frames; a broken
one to the frames read before the fault, with `error` set. Equal bytes make equal media, so repeated rows are
alike. Very long texts are several frames of bounded height. An empty table gives no rows. Other columns than id,
text and those named in `carry` aren't read, so their names can't clash.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

WIDTH = 64
#: Rows of a frame: a longer payload goes on in the next frame.
FRAME_ROWS = 4096
#: Hundredths of a second that each frame of a stored text stays.
DELAY = 10
MAX_CODES = 4096


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """Greedy LZW code stream of the samples; the table is cleared when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, cuts = [clear], []
    if data:
        put = codes.append
        table, free = {}, end + 1  # from a string's code and the next sample to the longer string's code
        look = table.get
        code = data[0]
        for sample in data[1:]:
            key = code << 8 | sample
            found = look(key)
            if found is not None:
                code = found
                continue
            put(code)
            code = sample
            if free < MAX_CODES:
                table[key] = free
                free += 1
            else:
                cuts.append(len(codes))
                put(clear)
                table.clear()
                free = end + 1
        put(code)
    codes.append(end)
    return pack_codes(np.array(codes, dtype=np.uint16), [0, *cuts], bits)


def literal_encode(data: bytes, bits: int = 8) -> bytes:
    """A code stream of single samples, cleared before the codes would widen: no compression, one numpy pass."""
    run = (1 << bits) - 2
    clear = 1 << bits
    raw = np.frombuffer(data, dtype=np.uint8)
    rows = max(1, -(-len(raw) // run))
    codes = np.full((rows, run + 1), clear, dtype=np.uint16)
    filled = np.zeros(rows * run, dtype=np.uint16)
    filled[: len(raw)] = raw
    codes[:, 1:] = filled.reshape(rows, run)
    flat = codes.ravel()[: len(raw) + rows]
    flat = np.append(flat, np.uint16(clear + 1))
    each = np.empty((len(flat), bits + 1), dtype=np.uint8)
    for k in range(bits + 1):
        each[:, k] = flat >> k & 1
    return np.packbits(each, bitorder="little").tobytes()


@cache
def widths(count: int, bits: int) -> np.ndarray:
    """Bits of each code after a clear: the decoder's table has one entry less than codes read."""
    known = np.arange(count) + (1 << bits) + 1
    return np.clip(np.ceil(np.log2(known + 0.5)).astype(np.int64), bits + 1, 12)


_BIT = np.arange(12, dtype=np.uint16)


def pack_codes(codes: np.ndarray, clears: list[int], bits: int) -> bytes:
    width = np.empty(len(codes), dtype=np.int64)
    width[0] = bits + 1
    edges = [*clears, len(codes) - 1]
    table = widths(MAX_CODES + 2, bits)
    for a, b in zip(edges, edges[1:]):
        width[a + 1 : b + 1] = table[: b - a]
    each = (codes[:, None] >> _BIT) & 1
    return np.packbits(each[_BIT < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def literal_run(raw: np.ndarray, at: int, total: int, bits: int) -> tuple[bytes, int, bool]:
    """Samples of the stretch from a clear on that has narrow codes of single samples and clears alone, where it stops, and whether the stream ends there.

    Codes stay narrow as long as clears are less than 2**bits codes apart. Only whole stretches
    between clears count, so nothing is taken that later codes of a stretch refer to.
    """
    wide, clear = bits + 1, 1 << bits
    n = (total - at) // wide
    begin = at + wide * np.arange(n)
    byte = begin >> 3
    word = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << 8 | raw[byte + 2].astype(np.uint32) << 16
    codes = word >> (begin & 7).astype(np.uint32) & np.uint32((1 << wide) - 1)
    stops = np.flatnonzero(codes >= clear)
    if not len(stops):
        return b"", at, False
    wrong = (np.diff(stops, prepend=-1) > clear - 1) | (codes[stops] > clear + 1)
    good = int(np.argmax(wrong)) if wrong.any() else len(stops)
    ends = np.flatnonzero(codes[stops[:good]] == clear + 1)
    if len(ends):
        good = int(ends[0]) + 1
    if not good:
        return b"", at, False
    upto = int(stops[good - 1])
    kept = codes[:upto]
    return kept[kept < clear].astype(np.uint8).tobytes(), at + wide * (upto + 1), bool(len(ends))


@cache
def schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    plan = widths(MAX_CODES + 2, bits)
    return plan, np.concatenate([[0], np.cumsum(plan)])


_SINGLE = [bytes((i,)) for i in range(256)]


def base_table(bits: int) -> list[bytes]:
    return _SINGLE[: 1 << bits] + [b"", b""]


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Samples of an LZW code stream, at most `most`; a code that can't exist ends the stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    total = 8 * len(stream)
    plan, steps = schedule(bits)
    out: list[bytes] = []
    size, at = 0, 0
    table, before, put = base_table(bits), b"", out.append
    add = table.append
    read = 0  # codes since the last clear
    while at < total and size < most:
        if not read:
            literal, at, ended = literal_run(raw, at, total, bits)
            out.append(literal)
            size += len(literal)
            if ended:
                break
            if literal:
                continue
        # All codes up to the next clear have known widths, so they are unpacked at once.
        ahead = steps[read:] - steps[read] if read < len(plan) else np.arange(MAX_CODES + 1) * 12
        wide = plan[read:] if read < len(plan) else np.full(MAX_CODES, 12)
        n = int(np.searchsorted(at + ahead[1:], total, side="right"))
        if not n:
            break
        begin = at + ahead[:n]
        byte = begin >> 3
        word = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << 8 | raw[byte + 2].astype(np.uint32) << 16
        codes = (word >> (begin & 7).astype(np.uint32)) & ((1 << wide[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stops[0]) if len(stops) else n
        known = len(table)
        for code in codes[:used].tolist():
            if code < known:
                piece = table[code]
                if before and known < MAX_CODES:
                    add(before + piece[:1])
                    known += 1
            elif before and code == known < MAX_CODES:
                piece = before + before[:1]
                add(piece)
                known += 1
            else:
                return b"".join(out)[:most]
            put(piece)
            before = piece
        size = sum(map(len, out)) if used == n else size
        if not len(stops):
            read += n
            at = int(begin[-1] + wide[n - 1])
            continue
        at = int(begin[used] + wide[used])
        if codes[used] == end:
            break
        table, before, read = base_table(bits), b"", 0
        add = table.append
    return b"".join(out)[:most]


def blocks(data: bytes) -> bytes:
    """Data sub-blocks of at most 255 bytes and the terminator."""
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(x for i in range(256) for x in (i, i, i))


def encode_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY, compress: bool = False) -> bytes:
    """A GIF whose frames hold the samples row by row, index i being grey i; len(samples) is a multiple of width.

    `compress` makes greedy LZW codes (about 3/4 of prose, 0.5 us a byte); else single-sample codes (9/8, 0.05 us).
    """
    codes = lzw_encode if compress else literal_encode
    rows = len(samples) // width
    step = width * frame_rows
    out = [b"GIF89a" + struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0) + GREY]
    for a in range(0, len(samples), step):
        part = samples[a : a + step]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + blocks(codes(part)))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    start: int
    canvas: np.ndarray  # height x width x RGBA of the whole screen, after this frame


class Broken(ValueError):
    """What was read is no whole GIF."""


def read_gif(data: bytes):
    """Yields the composed frames of a GIF in order; raises Broken at a fault."""
    if len(data) < 13 or data[:4] != b"GIF8":
        raise Broken("no GIF header")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data[at : at + n].ljust(n, b"\0"), dtype=np.uint8).reshape(-1, 3)
        at += n
    canvas = np.zeros((height, width), dtype="<u4")
    delay, disposal, clear_index, clock = 0, 0, -1, 0
    while True:
        if at >= len(data):
            raise Broken("no trailer")
        kind, at = data[at], at + 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else -1
            body, at = sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if kind != 0x2C or at + 9 > len(data):
            raise Broken("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at : at + 9])
        at += 9
        colours = shared
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            colours = np.frombuffer(data[at : at + n].ljust(n, b"\0"), dtype=np.uint8).reshape(-1, 3)
            at += n
        if at >= len(data):
            raise Broken("no image data")
        bits, at = data[at], at + 1
        if not 1 <= bits <= 8:
            raise Broken("bad code size")
        stream, at = sub_blocks(data, at)
        samples = lzw_decode(stream, bits, w * h)
        short = len(samples) < w * h
        pixels = np.frombuffer(samples.ljust(w * h, b"\0"), dtype=np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: rows come in four passes
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(pixels)
            plain[order] = pixels
            pixels = plain
        kept = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        shown = pixels[: part.shape[0], : part.shape[1]]
        palette = np.zeros((256, 4), dtype=np.uint8)
        if colours is not None:
            palette[: len(colours), :3] = colours
        palette[:, 3] = 255
        painted = palette.view("<u4")[:, 0][shown]
        part[...] = painted if clear_index < 0 else np.where(shown == clear_index, part, painted)
        yield Frame(left, top, w, h, delay, disposal, clock, canvas.copy().view(np.uint8).reshape(height, width, 4))
        if short:
            raise Broken("image data ends early")
        clock += delay
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif kept is not None:
            canvas = kept
        delay, disposal, clear_index = 0, 0, -1


def sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise Broken("sub-blocks end early")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def histogram(canvas: np.ndarray, bins: int) -> list[list[int]]:
    """Opaque pixels by red, green and blue, in `bins` equal ranges each."""
    opaque = canvas[..., 3] > 0
    seen = canvas if opaque.all() else canvas[opaque]
    return [np.bincount(seen[..., c].ravel(), minlength=256).reshape(bins, -1).sum(axis=1).tolist() for c in range(3)]


FRAMES = "array<struct<frame:int,start_cs:long,delay_cs:int,left:int,top:int,width:int,height:int,disposal:int,rgba:binary,red:array<long>,green:array<long>,blue:array<long>>>"
_LONGS = pa.list_(pa.int64())
_FRAME = pa.struct([("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("rgba", pa.binary()), ("red", _LONGS), ("green", _LONGS), ("blue", _LONGS)])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compress: bool = True) -> DataFrame:
    """Rows of id, n_bytes and media: each text's UTF-8 bytes, padded by zeros to rows of 64, as a GIF."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        media = [encode_gif(x.ljust(WIDTH * max(1, -(-len(x) // WIDTH)), b"\0"), compress=compress) for x in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), kernel, f"id {kind}, n_bytes long, media binary", "text").withColumnRenamed("id", id_col)


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", bins: int = 8, channels: str = "RGBA", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of id, the carried columns, the timed frames and `error`.

    Each frame has its rectangle of the composed canvas as bytes of the chosen channels, and the
    histogram columns of the whole canvas. Explode `frames` for one row per frame.
    """
    picked = ["RGBA".index(c) for c in channels]
    cols = [id_col, *carry, media_col]
    kinds = dict(media.select(*cols).dtypes)

    def one(data: bytes | None) -> tuple[list[dict], str | None]:
        out: list[dict] = []
        try:
            for k, f in enumerate(read_gif(data) if data is not None else ()):
                red, green, blue = histogram(f.canvas, bins)
                part = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width][..., picked]
                out.append({"frame": k, "start_cs": f.start, "delay_cs": f.delay, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "rgba": np.ascontiguousarray(part).tobytes(), "red": red, "green": green, "blue": blue})
        except Broken as fault:
            return out, str(fault)
        return out, None

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [one(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([f for f, _ in found], pa.list_(_FRAME)), pa.array([e for _, e in found], pa.string())],
            names=[*cols[:-1], "frames", "error"],
        )

    return map_arrow(media.select(*cols), kernel, ", ".join(f"`{c}` {kinds[c]}" for c in cols[:-1]) + f", frames {FRAMES}, error string", media_col)
