"""GIF decoding: round trips, a known file, and the rules of composition."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from skein.llm import gif


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5_000, 90_000])
@pytest.mark.parametrize("kind", ["same", "text", "noise"])
def test_lzw_round_trip(n, kind):
    rng = np.random.default_rng(n)
    data = {"same": b"a" * n, "text": (b"the cat sat on the mat. " * (n // 24 + 1))[:n], "noise": rng.integers(0, 256, n, np.uint8).tobytes()}[kind]
    assert gif.lzw_decode(gif.lzw_encode(data), 8) == data
    assert gif.read_back(gif.store(data))[0].rstrip(b"\0") == data.rstrip(b"\0")


def test_a_known_file():
    # a well-known 10 x 10 example: four colours, two bits a code
    stream = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01")
    rows = gif.lzw_decode(stream, 2)
    assert len(rows) == 100 and rows[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) and set(rows) == {0, 1, 2}


def test_disposal_and_transparency():
    p = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    full = lambda v, h=4, w=4: np.full((h, w), v, np.uint8)
    part = np.array([[1, 3], [3, 1]], np.uint8)
    frames = [gif.Frame(0, 0, full(0), p, 5, 1, None), gif.Frame(1, 1, part, p, 7, 3, 3), gif.Frame(0, 0, full(2, 2, 2), p, 9, 2, None), gif.Frame(3, 3, full(1, 1, 1), p, 1, 0, None)]
    w, h, back = gif.decode(gif.encode(frames, 4, 4, p))
    assert (w, h, [f.delay for f in back], back[1].clear) == (4, 4, [5, 7, 9, 1], 3)
    a, b, c, d = gif.compose(w, h, back)
    assert (a[..., 0] == 255).all()
    assert b[1, 1].tolist() == [0, 255, 0, 255] and b[1, 2].tolist() == [255, 0, 0, 255]  # clear places show what was there
    assert c[1, 1].tolist() == [0, 0, 255, 255] and c[2, 2].tolist() == [255, 0, 0, 255]  # the second frame was taken back
    assert d[0, 0].tolist() == [0, 0, 0, 0] and d[3, 3].tolist() == [0, 255, 0, 255]  # the third was cleared
    assert gif.histogram(a)[48] == 16


def test_media_columns(spark):
    good = gif.store(b"hello")
    r = {x.doc_id: x for x in gif.media_columns(spark.createDataFrame([(1, good), (2, b"GIF89a"), (3, None), (4, good[:-20])], "doc_id long, media binary")).collect()}
    assert r[1].frames[0].delay_ms == 100 and sum(r[1].frames[0].histogram) == 64
    assert r[2].error and r[3].error is None and r[3].frames is None and r[4].error


def plain_decode(data):
    """A second reader, code by code and pixel by pixel: (frames' delays, disposals, the canvases as lists of (r, g, b) or None)."""
    w, h, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, shared = 13, None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        shared, at = data[at : at + n], at + n
    canvas, out, control = [[None] * w for _ in range(h)], [], None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            control, at = data[at + 3 : at + 7], at + 8
            continue
        left, top, fw, fh = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        own, at = data[at + 9], at + 10
        palette = shared
        if own & 0x80:
            n = 3 * (2 << (own & 7))
            palette, at = data[at : at + n], at + n
        size, at = data[at], at + 1
        stream = b""
        while data[at]:
            stream, at = stream + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        bits, place, width, stop = int.from_bytes(stream, "little"), 0, size + 1, 1 << size
        table, last, pixels = None, None, []
        while True:
            code = bits >> place & ((1 << width) - 1)
            place += width
            if code == stop:
                table, width, last = [[k] for k in range(stop)] + [None, None], size + 1, None
                continue
            if code == stop + 1:
                break
            now = table[code] if code < len(table) else [*last, last[0]]
            pixels += now
            if last is not None and len(table) < 4096:
                table.append([*last, now[0]])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = now
        before = [list(r) for r in canvas]
        for k, p in enumerate(pixels):
            if not (control[0] & 1 and p == control[3]):
                canvas[top + k // fw][left + k % fw] = tuple(palette[3 * p : 3 * p + 3])
        disposal = control[0] >> 2 & 7
        out.append((int.from_bytes(control[1:3], "little"), disposal, [list(r) for r in canvas], fh))
        if disposal == 3:
            canvas = before
        elif disposal == 2:
            for y in range(fh):
                for x in range(fw):
                    canvas[top + y][left + x] = None
    return out


@pytest.mark.parametrize("text", [b"", b"plain", b"the cat sat on the mat. " * 900, bytes(range(256)) * 60, b"same line of it\n" * 1200])
def test_stored_texts_are_files_that_another_reader_shows(text):
    media = gif.store(text)
    back, frames = gif.read_back(media)
    shown = plain_decode(media)
    pixels = b"".join(bytes(p[0] for row in c[:fh] for p in row) for _, _, c, fh in shown)
    assert pixels == back == text + bytes(-len(text) % 64 if text else 64)
    assert [(f["delay_ms"], f["disposal"]) for f in frames] == [(10 * d, k) for d, k, _, _ in shown]
    for f, (_, _, canvas, _) in zip(frames, shown):
        own = [0] * 64
        for p in (p for row in canvas for p in row if p):
            own[(p[0] >> 6) * 16 + (p[1] >> 6) * 4 + (p[2] >> 6)] += 1
        assert f["histogram"] == own
    if len(text) > 15_000:
        assert {1, 2, 3} == {k for _, k, _, _ in shown}


def test_transparency_and_palettes_carry_stored_texts():
    frames = gif.decode(gif.store(b"the cat sat on the mat. " * 900))[2]
    assert any(f.clear is not None and (f.samples == f.clear).any() for f in frames) and len({f.palette.tobytes() for f in frames}) > 2


def test_digest(docs, none):
    for r, t in zip(gif.digest(docs).collect(), docs.select("doc_id", "text").collect()):
        raw = (t.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = gif.store(raw)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (t.doc_id, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest()) and [f.delay_ms for f in r.frames] == [100] * -(-len(payload) // 4096)
    assert gif.digest(none).count() == 0


def test_canvas_that_only_its_head_makes_large(spark):
    from skein.llm import gif

    small = gif.store(b"some text")
    huge = small[:6] + (30_000).to_bytes(2, "little") * 2 + small[10:]
    rows = spark.createDataFrame([(1, huge), (2, small), (3, huge[:35])], "doc_id long, media binary")
    out = {r.doc_id: r for r in gif.media_columns(rows).collect()}
    assert "too large" in out[1].error and out[1].frames is None and out[2].error is None and out[2].frames
    assert out[3].error and "too large" in gif.media_columns(rows.where("doc_id = 2"), most_pixels=10).first().error
