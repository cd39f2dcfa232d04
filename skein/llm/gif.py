"""Media columns of GIF files: timed frames, composed and counted by colour.

decode() reads a file: blocks, LZW code streams, local and global palettes, interlace, transparency and disposal. encode() writes one, which
the query uses to store texts as 8-bit samples. Files are handled one at a time inside tasks; there is no shuffle.

Defined results: a null file gives null columns; a broken file gives its error's text and no frames; a null text counts as empty; very long
texts are more frames; null ids stay null, and ids may be of any type; repeated rows get equal results, one each; other columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 4096  # codes that a table can hold
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # (height, width) of palette places, as stored
    palette: np.ndarray  # (n, 3)
    delay: int  # hundredths of a second
    disposal: int
    clear: int | None  # the transparent place


@lru_cache(maxsize=16)
def _widths(first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each code after a clear code until the table is full, the bit where each starts, and the end)."""
    n = TOP - first + 2
    held = first + np.maximum(np.arange(n) - 1, 0) + 1  # entries once code k has been read, and one more
    widths = np.clip(np.frexp(held - 0.5)[1], size + 1, 12).astype(np.int64)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def _read(buf: np.ndarray, at: np.ndarray, width) -> np.ndarray:
    """The codes that start at the bits `at`; buf ends with three spare bytes."""
    k = at >> 3
    return (buf[k] | buf[k + 1] << 8 | buf[k + 2] << 16) >> (at & 7) & ((1 << width) - 1)


def lzw_codes(data: bytes, size: int) -> Iterator[list[int]]:
    """Runs of codes between clear codes, up to the end code or the end of the data.

    Where each code of a run stands does not depend on the codes before it, so a run is read in pieces of many codes.
    """
    buf = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    stop, bits = 1 << size, 8 * len(data)
    widths, places = _widths(stop + 2, size)
    at = 0
    while at + size + 1 <= bits:
        parts, k, end = [], 0, None
        while end is None:
            if k < len(widths):
                where, wide = places[k : k + 1024] + at, widths[k : k + 1024]
                where = where[: len(wide)]
            else:  # a full table keeps its width until it is cleared
                where, wide = at + places[-1] + 12 * (k - len(widths) + np.arange(1024)), np.full(1024, 12)
            fits = where + wide <= bits
            where, wide = where[fits], wide[fits]
            if not len(where):
                break
            codes = _read(buf, where, wide)
            hit = np.flatnonzero((codes == stop) | (codes == stop + 1))
            if len(hit):
                end = int(where[hit[0]] + wide[hit[0]])
                last = int(codes[hit[0]])
                codes = codes[: hit[0]]
            parts.append(codes)
            k += len(where)
        yield np.concatenate(parts).tolist() if parts else []
        if end is None or last == stop + 1:
            return
        at = end


def lzw_decode(data: bytes, size: int) -> bytes:
    """The samples of a code stream."""
    base, room = [bytes([k]) for k in range(1 << size)] + [b"", b""], TOP - (1 << size) - 2
    out: list[bytes] = []
    put = out.append
    for codes in lzw_codes(data, size):
        if not codes:
            continue
        if codes[0] >= 1 << size:
            raise ValueError("a run starts with an unknown code")
        table = base.copy()
        add = table.append
        last = table[codes[0]]
        put(last)
        for code in codes[1 : room + 1]:
            try:
                now = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("a code is beyond the table") from None
                now = last + last[:1]
            add(last + now[:1])
            put(now)
            last = now
        out.extend(map(table.__getitem__, codes[room + 1 :]))
    return b"".join(out)


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """A code stream that starts over with a clear code whenever its table is full."""
    stop, first = 1 << size, (1 << size) + 2
    widths, places = _widths(first, size)
    runs: list[list[int]] = []
    table: dict[int, int] = {}
    codes: list[int] = []
    get, put, n = table.get, codes.append, first
    rest = iter(samples)
    code = next(rest, None)
    for b in rest:
        key = code << 8 | b
        known = get(key)
        if known is not None:
            code = known
            continue
        put(code)
        code = b
        if n < TOP - 1:
            table[key] = n
            n += 1
        else:
            put(stop)
            runs.append(codes)
            table, codes, n = {}, [], first
            get, put = table.get, codes.append
    if code is not None:
        put(code)
    put(stop + 1)
    runs.append(codes)
    value, where, at = [np.array([stop])], [np.array([0])], size + 1
    for codes in runs:
        value.append(np.array(codes))
        where.append(places[: len(codes)] + at)
        at += int(places[len(codes)])
    value_, where_ = np.concatenate(value), np.concatenate(where)
    shifted, byte, n = value_ << (where_ & 7), where_ >> 3, (at + 7) // 8 + 3
    # bits of different codes never meet, so sums are unions
    total = sum(np.bincount(byte + k, shifted >> 8 * k & 255, n) for k in range(3))
    return total.astype(np.uint8)[: (at + 7) // 8].tobytes()


def encode(frames: list[Frame], width: int, height: int, palette: np.ndarray = GREY) -> bytes:
    """A GIF89a file; frames whose palette is the file's have no own."""

    def table(p: np.ndarray) -> tuple[int, bytes]:
        k = max(1, (len(p) - 1).bit_length())
        return k - 1, p.astype(np.uint8).tobytes() + bytes(3 * ((1 << k) - len(p)))

    k, colours = table(palette)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes([0x80 | 0x70 | k, 0, 0]), colours]
    for f in frames:
        out.append(b"\x21\xf9\x04" + bytes([f.disposal << 2 | (f.clear is not None)]) + f.delay.to_bytes(2, "little") + bytes([f.clear or 0, 0]))
        h, w = f.samples.shape
        own = f.palette is not palette and not np.array_equal(f.palette, palette)
        j, local = table(f.palette)
        out.append(b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (f.left, f.top, w, h)) + bytes([(0x80 | j) if own else 0]) + local * own)
        size = max(2, (j if own else k) + 1)
        codes = lzw_encode(f.samples.astype(np.uint8).tobytes(), size)
        out.append(bytes([size]) + b"".join(bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)) + b"\0")
    return b"".join(out) + b"\x3b"


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """(width, height, frames as stored) of a GIF file."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    short = lambda k: int.from_bytes(data[k : k + 2], "little")
    width, height, flags, at = short(6), short(8), data[10], 13

    def table(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        n = 2 << (flags & 7) if flags & 0x80 else 0
        return (np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3) if n else None), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    shared, at = table(flags, at)
    frames, control = [], (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                control = (int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
        elif data[at] == 0x2C:
            left, top, w, h, own = short(at + 1), short(at + 3), short(at + 5), short(at + 7), data[at + 9]
            palette, at = table(own, at + 10)
            size = data[at]
            body, at = blocks(at + 1)
            samples = np.frombuffer(lzw_decode(body, size), np.uint8)
            if len(samples) < w * h:
                raise ValueError("a frame lacks samples")
            samples = samples[: w * h].reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples = samples[np.argsort(order)]
            palette = palette if palette is not None else shared if shared is not None else GREY
            delay, disposal, clear = control
            frames.append(Frame(left, top, samples, palette, delay, disposal, clear))
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")
    return width, height, frames


def compose(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA) as shown with each frame."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        h, w = f.samples.shape
        h, w = min(h, max(0, height - f.top)), min(w, max(0, width - f.left))
        spot = (slice(f.top, f.top + h), slice(f.left, f.left + w))
        before, samples = canvas.copy() if f.disposal == 3 else None, f.samples[:h, :w]
        colour = np.zeros((256, 4), np.uint8)
        colour[: len(f.palette), :3] = f.palette
        colour[:, 3] = 255
        shown = np.ones(samples.shape, bool) if f.clear is None else samples != f.clear
        canvas[spot][shown] = colour[samples[shown]]
        yield canvas.copy()
        if f.disposal == 2:
            canvas[spot] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by the two high bits of red, green and blue; transparent ones are not counted."""
    rgb = canvas[..., :3][canvas[..., 3] > 0] >> 6
    return np.bincount(rgb[:, 0] * 16 + rgb[:, 1] * 4 + rgb[:, 2], minlength=64)


FRAMES = "array<struct<delay_ms:int,disposal:int,histogram:array<long>>>"
FRAME_LIST = pa.list_(pa.struct([("delay_ms", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
AT_ONCE = 500  # rows of a batch


def _shown(f: Frame, canvas: np.ndarray) -> dict:
    return {"delay_ms": f.delay * 10, "disposal": f.disposal, "histogram": histogram(canvas).tolist()}


def media_columns(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", most_pixels: int = 1 << 24) -> DataFrame:
    """(doc_id, width, height, frames array<struct<delay_ms, disposal, histogram>>, error), one row per file.

    A file's canvas is as large as its head says, whatever follows: one of more than most_pixels is an error, and is not composed.
    """
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, width int, height int, frames {FRAMES}, error string"

    def one(key, data: bytes | None) -> dict:
        out = {"doc_id": key, "width": None, "height": None, "frames": None, "error": None}
        if data is None:
            return out
        try:
            w, h, frames = decode(data)
            if w * h > most_pixels:
                raise ValueError(f"a canvas of {w} x {h} pixels is too large")
            shown = [_shown(f, c) for f, c in zip(frames, compose(w, h, frames))]
            return out | {"width": w, "height": h, "frames": shown}
        except (ValueError, IndexError) as e:
            return out | {"error": str(e) or "broken"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(k.as_py(), m.as_py()) for k, m in zip(b.column(0), b.column(1))]
            cols = [b.column(0), *(pa.array([m[n] for m in made], t) for n, t in (("width", pa.int32()), ("height", pa.int32()), ("frames", FRAME_LIST), ("error", pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "width", "height", "frames", "error"])

    return rows.mapInArrow(run, schema)


ROW = 64  # samples in a row of a stored text
ROWS = 64  # in a frame
TURN = 101  # by which a frame's palette is turned against the one before
DISPOSALS = (1, 3, 2)  # of the frames in turn: stay, back to what was there, cleared
DELAY = 10


def store(text: bytes) -> bytes:
    """A text as a GIF: its bytes, padded with zeros to a positive multiple of ROW, are grey pixels, row by row and frame by frame.

    From the second frame on, palettes are turned greys, and a pixel that is shown already is stored as the transparent place, if there is one
    to spare. The frames are disposed of in turn by each rule. So the text comes back only through the composed pictures.
    """
    padded = text + bytes(-len(text) % ROW if text else ROW)
    pixels = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    shown = np.full((min(ROWS, len(pixels)), ROW), -1, np.int16)  # no colour
    frames = []
    for k in range(-(-len(pixels) // ROWS)):
        part = pixels[k * ROWS : (k + 1) * ROWS]
        turn, disposal, clear = TURN * k & 255, DISPOSALS[k % len(DISPOSALS)], None
        samples, same = part - np.uint8(turn), shown[: len(part)] == part
        spare = np.flatnonzero(np.bincount(samples.ravel(), minlength=256) == 0)
        if same.any() and len(spare):
            clear = int(spare[0])
            samples = np.where(same, np.uint8(clear), samples)
        frames.append(Frame(0, 0, samples, np.roll(GREY, -turn, 0) if turn else GREY, DELAY, disposal, clear))
        if disposal != 3:
            shown[: len(part)] = part if disposal == 1 else -1
    return encode(frames, ROW, len(shown))


def read_back(media: bytes) -> tuple[bytes, list[dict]]:
    """(the payload of a stored text, its frames as media_columns() has them), from the composed pictures."""
    width, height, frames = decode(media)
    payload, out = [], []
    for f, canvas in zip(frames, compose(width, height, frames)):
        payload.append(canvas[: len(f.samples), :, 0].tobytes())
        out.append(_shown(f, canvas))
    return b"".join(payload), out


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the timed frames; the feature is the frames' number, and the pixels of each colour over all of them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {FRAMES}"

    def one(text: str) -> tuple:
        raw = text.encode("utf-8")
        media = store(raw)
        payload, frames = read_back(media)
        counts = np.sum([f["histogram"] for f in frames], axis=0)
        feature = f"{len(frames)}:" + ",".join(f"{k}={counts[k]}" for k in np.flatnonzero(counts))
        return len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), feature, frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), FRAME_LIST]
        for b in batches:
            for first in range(0, b.num_rows, AT_ONCE):
                made = [one(t.as_py()) for t in b.column(1).slice(first, AT_ONCE)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, AT_ONCE), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    return rows.mapInArrow(run, schema)
