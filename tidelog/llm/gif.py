"""Media columns, GIF: frames of animations as rows, and texts stored as frames.

``parse`` reads a file's structure, ``lzw_decode`` its code streams and ``frames``
composes the canvas: palettes (global or of the frame), transparency, interlacing and
the disposal of the frame before (kept, background, previous).  ``frame_rows`` makes a
table of timed frames with their colour histograms.  ``encode`` is the writer: it packs
indices with a palette, one code stream a frame.

In LZW the width of a code depends only on how many codes came since the last clear
code, so codes are cut out of the bits (and put into them) in bulk by numpy; the loops
in Python are over codes when reading and over pixels when writing.

A text is stored as a payload of UTF-8 bytes, one pixel each, in frames of ``WIDTH`` by
at most ``ROWS`` pixels.  Pixel values are indices into a palette of 256 different
colours (3 bits of red, 3 of green, 2 of blue), so the composed canvas gives the bytes
back; the text's own length is in a comment.

Cases: a null or empty text is a payload of blanks; equal texts have equal files; a
media value that is null or no GIF gives ``error`` and no frames; a damaged file gives
the frames before the damage and ``error``; so does one with a canvas or frame of more than
``MOST_PIXELS``, which is not decoded (a canvas: no frames); ids are whole numbers; ties and repeated rows are rows of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, materialise, whole_id

UNIT, WIDTH, ROWS, DELAY_CS = 192, 192, 256, 10
CLEAR, END, FIRST, LIMIT = 256, 257, 258, 4096

_INDEX = np.arange(256)
#: Colour of each byte: 3 bits of red, 3 of green, 2 of blue, spread over 0 to 255.
PALETTE = np.stack([(_INDEX >> 5) * 255 // 7, (_INDEX >> 2 & 7) * 255 // 7, (_INDEX & 3) * 85], 1).astype(np.uint8)
#: Histogram bin of a channel's value: its upper 2 bits, 64 bins a frame.
BINS = 64
#: Pixels of a canvas or frame at most (4 bytes each, and a second canvas where a frame is undone): what a header claims is not allocated beyond.
MOST_PIXELS = 1 << 24


def _widths(first_bits: int) -> np.ndarray:
    """The width of the i-th code after a clear code."""
    free = (1 << (first_bits - 1)) + 2
    i = np.arange(LIMIT + 1)
    need = np.array([int(x).bit_length() for x in free + i - 1])
    return np.clip(need, first_bits, 12)


_W = {b: _widths(b) for b in range(2, 10)}
_CUM = {b: np.concatenate([[0], np.cumsum(w)]) for b, w in _W.items()}
_SINGLES = [bytes([i]) for i in range(256)]


def lzw_encode(pixels: bytes) -> bytes:
    """The code stream (minimum code size 8) of index bytes."""
    codes, starts = [CLEAR], [0]
    put = codes.append
    table: dict[int, int] = {}
    get, free = table.get, FIRST
    it = iter(pixels)
    now = next(it, None)
    if now is not None:
        for b in it:
            key = now << 8 | b
            found = get(key)
            if found is not None:
                now = found
                continue
            put(now)
            table[key] = free
            free += 1
            now = b
            if free == LIMIT:
                starts.append(len(codes))
                put(CLEAR)
                table.clear()
                free = FIRST
        put(now)
    put(END)
    c = np.array(codes, np.int64)
    at = np.arange(len(c))
    origin = np.zeros(len(c), np.int64)
    origin[starts] = starts
    since = at - np.maximum.accumulate(origin) - 1  # codes since the last clear code
    since[starts] = np.concatenate([[0], np.diff(starts) - 1])  # a clear code has the width that is due where it stands
    width = _W[9][since]
    width[0] = 9
    bit = np.concatenate([[0], np.cumsum(width)])
    total = -(-int(bit[-1]) // 8)
    byte, spread = bit[:-1] >> 3, c << (bit[:-1] & 7)
    # Codes have bits of their own, so sums of bytes are their union.
    out = sum(np.bincount(byte + k, spread >> 8 * k & 255, total + 3) for k in range(3))
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, least_bits: int, want: int) -> bytes:
    """The first ``want`` indices of a code stream; fewer if it ends before or is damaged."""
    first, clear = least_bits + 1, 1 << least_bits
    width, cum = _W[first], _CUM[first]
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bits, at, out, held = 8 * len(data), 0, [], 0
    singles = [*_SINGLES[:clear], b"", b""]
    table, prev, done = list(singles), b"", 0
    while held < want:
        # All codes that can follow under the widths that are due.
        n = int(np.searchsorted(cum, cum[min(done, LIMIT)] + bits - at, "right")) - 1 - min(done, LIMIT)
        if done >= LIMIT:
            n = (bits - at) // 12
        if n <= 0:
            break
        if done >= LIMIT:
            offset, w = at + 12 * np.arange(n), np.full(n, 12)
        else:
            offset, w = at + cum[done : done + n] - cum[done], width[done : done + n]
        byte = offset >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        k = int(stop[0]) if len(stop) else n
        listed = codes[:k].tolist()
        put, grow = out.append, table.append
        if listed and not prev:
            c = listed[0]
            if c >= clear:
                return b"".join(out)[:want]
            prev = table[c]
            put(prev)
            held += 1
            listed = listed[1:]
        for c in listed:
            size = len(table)
            if c < size:
                s = table[c]
            elif c == size:
                s = prev + prev[:1]
            else:
                return b"".join(out)[:want]
            if size < LIMIT:
                grow(prev + s[:1])
            put(s)
            held += len(s)
            prev = s
        if len(stop):
            at = int(offset[k] + w[k])
            if codes[k] == clear + 1:
                break
            table, prev, done = list(singles), b"", 0
        else:
            at, done = int(offset[-1] + w[-1]), done + n
    return b"".join(out)[:want]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    interlaced: bool
    palette: np.ndarray | None
    least_bits: int
    data: bytes

    def indices(self) -> np.ndarray:
        """Rows of indices, from top to bottom; a damaged stream is filled with 0."""
        n = self.width * self.height
        got = lzw_decode(self.data, self.least_bits, n)
        flat = np.zeros(n, np.uint8)
        flat[: len(got)] = np.frombuffer(got, np.uint8)
        rows = flat.reshape(self.height, self.width)
        if not self.interlaced:
            return rows
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, self.height, step)]
        out = np.empty_like(rows)
        out[order] = rows
        return out


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    background: int
    comments: list[bytes] = field(default_factory=list)
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)
    error: str | None = None


def _colours(flags: int, raw: bytes, at: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    if at + 3 * n > len(raw):
        raise ValueError("palette is cut off")
    return np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(raw):
            raise ValueError("data is cut off")
        n = raw[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(raw):
            raise ValueError("data is cut off")
        parts.append(raw[at + 1 : at + 1 + n])
        at += 1 + n


def _check_size(what: str, width: int, height: int) -> None:
    if width * height > MOST_PIXELS:
        raise ValueError(f"{what} of {width} x {height} is larger than {MOST_PIXELS} pixels")


def parse(raw: bytes | None) -> Gif:
    """The structure of a file; what is damaged ends it and is told in ``error``."""
    if not raw or raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        return Gif(0, 0, None, 0, error="not a GIF")
    two = lambda i: raw[i] | raw[i + 1] << 8
    gif = Gif(two(6), two(8), None, raw[11])
    delay, disposal, transparent = 0, 0, None
    try:
        _check_size("canvas", gif.width, gif.height)
        gif.palette, at = _colours(raw[10], raw, 13)
        while True:
            kind = raw[at]
            if kind == 0x3B:
                return gif
            if kind == 0x21:
                label, start = raw[at + 1], at + 2
                body, at = _blocks(raw, start)
                if label == 0xF9 and len(body) >= 4:
                    delay, disposal = body[1] | body[2] << 8, body[0] >> 2 & 7
                    transparent = body[3] if body[0] & 1 else None
                elif label == 0xFE:
                    gif.comments.append(body)
                elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                    gif.loops = body[12] | body[13] << 8
            elif kind == 0x2C:
                left, top, width, height, flags = two(at + 1), two(at + 3), two(at + 5), two(at + 7), raw[at + 9]
                _check_size("frame", width, height)
                palette, at = _colours(flags, raw, at + 10)
                least = raw[at]
                if not 1 <= least <= 8:
                    raise ValueError(f"code size {least}")
                data, at = _blocks(raw, at + 1)
                gif.frames.append(Frame(left, top, width, height, delay, disposal, transparent, bool(flags & 0x40), palette, least, data))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError(f"unknown block {kind}")
    except (IndexError, ValueError) as e:
        gif.error = str(e) or "data is cut off"
    return gif


def frames(gif: Gif) -> Iterator[tuple[Frame, np.ndarray, np.ndarray]]:
    """Each frame with its indices and the composed canvas (height, width, RGBA) at its time.

    The canvas is one array that later frames change.
    """
    if not gif.frames:
        return
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        kept = canvas.copy() if f.disposal == 3 else None
        palette = f.palette if f.palette is not None else gif.palette if gif.palette is not None else PALETTE
        index = f.indices()
        shown = index[: max(0, gif.height - f.top), : max(0, gif.width - f.left)]
        area = canvas[f.top : f.top + shown.shape[0], f.left : f.left + shown.shape[1]]
        colour = palette[np.minimum(shown, len(palette) - 1)]
        if f.transparent is None:
            area[..., :3], area[..., 3] = colour, 255
        else:
            opaque = shown != f.transparent
            area[opaque, :3], area[opaque, 3] = colour[opaque], 255
        yield f, index, canvas
        if f.disposal == 2:
            area[...] = 0
        elif f.disposal == 3:
            canvas = kept


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in 64 bins: the upper 2 bits of red, green and blue."""
    flat = canvas.reshape(-1, 4)
    flat = flat[flat[:, 3] > 0]
    r, g, b = (flat[:, k].astype(np.int64) >> 6 for k in range(3))
    return np.bincount(r << 4 | g << 2 | b, minlength=BINS)


def _sub_blocks(data: bytes) -> bytes:
    out = [bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))]
    return b"".join(out) + b"\0"


def encode(images: list[np.ndarray], palette: np.ndarray = PALETTE, delay_cs: int = DELAY_CS, comment: bytes = b"", disposal: int = 1) -> bytes:
    """A GIF89a of images of indices (rows, columns), each at the top left of the canvas."""
    height, width = max(i.shape[0] for i in images), max(i.shape[1] for i in images)
    two = lambda n: n.to_bytes(2, "little")
    out = [b"GIF89a", two(width), two(height), b"\xf7\0\0", palette.astype(np.uint8).tobytes()]
    if comment:
        out += [b"\x21\xfe", _sub_blocks(comment)]
    for i in images:
        out += [b"\x21\xf9\x04", bytes([disposal << 2]), two(delay_cs), b"\0\0", b"\x2c", two(0), two(0), two(i.shape[1]), two(i.shape[0]), b"\0\x08", _sub_blocks(lzw_encode(i.tobytes()))]
    return b"".join([*out, b"\x3b"])


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def text_to_gif(text: str | None) -> bytes:
    n, payload = payload_of(text)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode([rows[i : i + ROWS] for i in range(0, len(rows), ROWS)], comment=str(n).encode())


#: Byte of each colour: what PALETTE undoes.
_BYTE = {tuple(c): i for i, c in enumerate(PALETTE.tolist())}
_R = np.zeros(256, np.uint8)
_G = np.zeros(256, np.uint8)
_B = np.zeros(256, np.uint8)
for _c, _i in _BYTE.items():
    _R[_c[0]], _G[_c[1]], _B[_c[2]] = _i & 0xE0, _i & 0x1C, _i & 3


def gif_to_payload(raw: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """The text's length, the payload from the composed canvases, the histogram of all frames and their number."""
    gif = parse(raw)
    if gif.error:
        raise ValueError(gif.error)
    parts, total = [], np.zeros(BINS, np.int64)
    for f, _, canvas in frames(gif):
        shown = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        parts.append((_R[shown[..., 0]] | _G[shown[..., 1]] | _B[shown[..., 2]]).tobytes())
        total += histogram(shown)
    return int(gif.comments[0]), b"".join(parts), total, len(gif.frames)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and media (the GIF) of each row."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch({"doc": b.column(0), "media": pa.array(map(text_to_gif, b.column(1).to_pylist()), pa.binary())})

        return f

    return map_arrow(docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).alias("text")), make, "doc long, media binary", rows=128)


def frame_rows(media: DataFrame, id_col: str = "doc", media_col: str = "media") -> DataFrame:
    """A row for each frame: id, frame, start_cs, delay_cs, place and size, and the canvas' histogram (64 bins).

    A value without a frame has one row with frame null and ``error``.
    """
    schema = "id long, frame int, start_cs long, delay_cs int, left int, top int, width int, height int, histogram array<long>, error string"

    def make():
        def rows(i: int, raw: bytes | None) -> Iterator[tuple]:
            gif, at = parse(raw), 0
            for k, (f, _, canvas) in enumerate(frames(gif)):
                yield i, k, at, f.delay_cs, f.left, f.top, f.width, f.height, histogram(canvas).tolist(), gif.error
                at += f.delay_cs
            if not gif.frames:
                yield i, None, None, None, None, None, None, None, None, gif.error or "no frames"

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [r for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(i, m)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.list_(pa.int64()), pa.string()]
            names = ["id", "frame", "start_cs", "delay_cs", "left", "top", "width", "height", "histogram", "error"]
            return pa.record_batch([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names)

        return f

    out = map_arrow(media.select(whole_id(media, id_col).alias("id"), F.col(media_col).alias("media")), make, schema, rows=32)
    return out.withColumnRenamed("id", id_col)


def payload_digests(media: DataFrame) -> DataFrame:
    """doc and what the stored bytes give: lengths, digests, and a feature of frames and colours."""
    schema = "doc long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make():
        def one(raw: bytes) -> tuple:
            n, payload, bins, count = gif_to_payload(raw)
            feature = f"frames={count};ms={10 * DELAY_CS * count};colours=" + ",".join(f"{k}:{v}" for k, v in enumerate(bins.tolist()) if v)
            return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = list(zip(*map(one, b.column(1).to_pylist()), strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.record_batch({"doc": b.column(0)} | {n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})

        return f

    return map_arrow(media, make, schema, rows=128)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return payload_digests(stored).withColumnRenamed("doc", "doc_id")
