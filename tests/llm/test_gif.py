import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from tidelog.llm.gif import PALETTE, UNIT, encode, frame_rows, frames, gif_to_payload, histogram, lzw_decode, lzw_encode, op8, parse, payload_digests, payload_of, store_texts, text_to_gif

#: A published sample file of 10 by 10 pixels in 4 colours, and its indices.
SAMPLE = bytes.fromhex("474946383961 0a000a00910000 ffffff ff0000 0000ff 000000 21f9040000000000 2c000000000a000a0000 0216 8c2d99872a1cdc33a00275ec95faa8de608c04914c01 00 3b")
ROWS = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3


def test_published_sample():
    (f, index, canvas), *rest = frames(parse(SAMPLE))
    assert not rest and ["".join(map(str, r)) for r in index.tolist()] == ROWS
    assert canvas[0, 0].tolist() == [255, 0, 0, 255] and canvas[0, 9].tolist() == [0, 0, 255, 255] and canvas[4, 5].tolist() == [255] * 4


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.binary(min_size=1, max_size=3).map(lambda b: b * 4000)))
def test_code_streams(data):
    assert lzw_decode(lzw_encode(data), 8, len(data)) == data


def test_long_code_streams():
    rng = np.random.default_rng(3)
    for data in (rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes(), rng.integers(97, 102, 200_000, dtype=np.uint8).tobytes(), bytes(300_000), cases.LONG.encode()):
        assert lzw_decode(lzw_encode(data), 8, len(data)) == data


def plain_decode(data, least, want):
    """Code by code, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, at, w, table, prev, out = 1 << least, 0, least + 1, [], None, b""
    while at + w <= len(bits) and len(out) < want:
        c = int(bits[at : at + w][::-1], 2)
        at += w
        if c == clear:
            table, w, prev = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, None
            continue
        if c == clear + 1:
            break
        if prev is None:
            s = table[c]
        else:
            s = table[c] if c < len(table) else prev + prev[:1]
            if len(table) < 4096:
                table.append(prev + s[:1])
            if len(table) == 1 << w and w < 12:
                w += 1
        out, prev = out + s, s
    return out[:want]


def test_deferred_clear_and_small_codes():
    """A stream that goes on with a full table, and one of 2 bits a pixel."""
    rng = np.random.default_rng(9)
    data = rng.integers(0, 4, 30_000, dtype=np.uint8).tobytes()
    table, codes, now = {bytes([i]): i for i in range(4)}, [4], b""
    free = 6
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        codes.append(table[now])
        if free < 4096:
            table[now + bytes([b])] = free
            free += 1
        now = bytes([b])
    codes += [table[now], 5]
    bits, w, size = "", 3, 5  # the reader adds an entry from the second code on
    for c in codes:
        bits += f"{c:0{w}b}"[::-1]
        size += c != 4
        if size == 1 << w and w < 12:
            w += 1
    raw = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert plain_decode(raw, 2, len(data)) == data
    assert lzw_decode(raw, 2, len(data)) == data


def test_damaged_streams():
    good = lzw_encode(b"abcabcabcabc" * 50)
    for k in range(0, len(good), 7):
        cut = lzw_decode(good[:k], 8, 600)
        assert (b"abcabcabcabc" * 50).startswith(cut)
        bad = bytearray(good)
        bad[k] ^= 0xFF
        assert len(lzw_decode(bytes(bad), 8, 600)) <= 600


def animation(disposals, transparent=None, interlace=False):
    """3 frames: a full one of colour 1, then single pixels of colour 2 and 3 at (1, 1) and (2, 2)."""
    two = lambda n: n.to_bytes(2, "little")
    out = [b"GIF89a", two(4), two(4), b"\xf7\0\0", PALETTE.tobytes()]
    for k, (place, index) in enumerate((((0, 0, 4, 4), np.full((4, 4), 1, np.uint8)), ((1, 1, 2, 1), np.array([[2, 9]], np.uint8)), ((2, 2, 1, 1), np.array([[3]], np.uint8)))):
        flag = disposals[k] << 2 | (transparent is not None and k > 0)
        data = lzw_encode(index.tobytes())
        out += [b"\x21\xf9\x04", bytes([flag]), two(5 * (k + 1)), bytes([transparent or 0]), b"\0\x2c", *map(two, place), b"\0\x08", bytes([len(data)]), data, b"\0"]
    return b"".join([*out, b"\x3b"])


def colours(canvas):
    known = {tuple(c): i for i, c in enumerate(PALETTE.tolist())}
    return [[known[tuple(p[:3].tolist())] if p[3] else None for p in row] for row in canvas]


@pytest.mark.parametrize(("disposals", "second", "third"), [((0, 1, 0), [2, 9], [2, 9]), ((1, 2, 0), [2, 9], [None, None]), ((1, 3, 0), [2, 9], [1, 1])])
def test_disposal(disposals, second, third):
    got = [colours(c) for _, _, c in frames(parse(animation(disposals)))]
    assert got[0] == [[1] * 4] * 4 and got[1][1][1:3] == second and got[2][1][1:3] == third and got[2][2][2] == 3


def test_transparency():
    got = [colours(c) for _, _, c in frames(parse(animation((0, 0, 0), transparent=9)))]
    assert got[1][1][1:3] == [2, 1]


def test_interlace_and_local_palette():
    rows = np.arange(10, dtype=np.uint8)[:, None].repeat(3, 1)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    data = lzw_encode(rows[order].tobytes())
    two = lambda n: n.to_bytes(2, "little")
    raw = b"GIF87a" + two(3) + two(10) + b"\0\0\0" + b"\x2c" + two(0) + two(0) + two(3) + two(10) + b"\xc7" + PALETTE.tobytes() + b"\x08" + bytes([len(data)]) + data + b"\0\x3b"
    (_, index, canvas), = frames(parse(raw))
    assert index.tolist() == rows.tolist() and histogram(canvas).sum() == 30


def test_frame_rows(spark):
    rows = [(1, animation((0, 0, 0))), (2, None), (3, b"no image"), (4, SAMPLE[:-5]), (5, SAMPLE), (None, SAMPLE)]
    got = frame_rows(spark.createDataFrame(rows, "doc long, media binary").withColumn("frame", F.lit("x"))).orderBy("doc", "frame").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc"], []).append(r)
    assert [(r["frame"], r["start_cs"], r["delay_cs"], sum(r["histogram"])) for r in by[1]] == [(0, 0, 5, 16), (1, 5, 10, 16), (2, 15, 15, 16)]
    assert by[2][0]["error"] == by[3][0]["error"] == "not a GIF" and by[2][0]["frame"] is None
    assert by[4][0]["error"] and by[5][0]["error"] is None and by[None][0]["width"] == 10
    assert frame_rows(spark.createDataFrame([], "doc long, media binary")).count() == 0


def test_texts():
    for text in (None, "", "a", "b" * 192, "c" * 193, "é" * 200_000):
        n, payload, bins, count = gif_to_payload(text_to_gif(text))
        raw = (text or "").encode()
        assert n == len(raw) and payload == raw + b" " * (-len(raw) % UNIT or (UNIT if not raw else 0))
        assert bins.sum() == len(payload) and count == -(-len(payload) // (192 * 256))


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8(spark, sf).collect():
        n, payload = payload_of(texts[r["doc_id"]])
        media = text_to_gif(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_cases(spark):
    got = payload_digests(store_texts(cases.clashing(spark))).collect()
    assert len(got) == len(cases.ROWS)
    by_text = {}
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: (r["n_bytes"], r["doc"] or 0)), sorted(cases.ROWS, key=lambda x: (len((x[1] or "").encode()), x[0] or 0)), strict=True):
        assert r["n_bytes"] == len((text or "").encode())
        assert by_text.setdefault(text or "", r["media_sha256"]) == r["media_sha256"]
    assert payload_digests(store_texts(cases.empty(spark))).count() == 0


def test_delays():
    gif = parse(encode([np.zeros((1, 1), np.uint8)] * 3, delay_cs=7, comment=b"x" * 300))
    assert [f.delay_cs for f in gif.frames] == [7, 7, 7] and gif.comments == [b"x" * 300] and gif.error is None


def claims(width, height, frame=None):
    """A small valid file whose header claims a size."""
    two = lambda n: n.to_bytes(2, "little")
    raw = bytearray(encode([np.zeros((2, 2), np.uint8)]))
    at = raw.index(b"\x2c\0\0\0\0\x02\0\x02\0")
    if frame:
        raw[at + 5 : at + 9] = two(frame[0]) + two(frame[1])
    raw[6:10] = two(width) + two(height)
    return bytes(raw)


def test_sizes_that_headers_claim_are_not_allocated(spark):
    huge, wide, fine = claims(60_000, 60_000), claims(2, 2, (65_535, 65_535)), claims(4, 4)
    for raw, what in ((huge, "canvas"), (wide, "frame")):
        gif = parse(raw)
        assert what in gif.error and "60000 x 60000" in gif.error or "65535 x 65535" in gif.error
        assert list(frames(gif)) == []
    rows = frame_rows(spark.createDataFrame([(1, huge), (2, wide), (3, fine), (4, b"GIF89a"), (5, None)], "doc long, media binary")).orderBy("doc").collect()
    assert [(r["doc"], r["frame"], r["error"] is not None) for r in rows] == [(1, None, True), (2, None, True), (3, 0, False), (4, None, True), (5, None, True)]


def test_query_equals_brute_force(spark, sf):
    """Lengths and digests from the text itself; pixels by the plain decoder; colours counted one by one."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op8(spark, sf).collect()
    assert len(got) == len(texts)
    for k, r in enumerate(got):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        bins, count = [0] * 64, -(-len(payload) // (192 * 256))
        for b in payload:
            red, green, blue = (b >> 5) * 255 // 7, (b >> 2 & 7) * 255 // 7, (b & 3) * 85
            bins[(red // 64) * 16 + (green // 64) * 4 + blue // 64] += 1
        assert r["feature"] == f"frames={count};ms={100 * count};colours=" + ",".join(f"{i}:{n}" for i, n in enumerate(bins) if n)
        if k % 20 == 0:
            media = text_to_gif(texts[r["doc_id"]])
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
            assert b"".join(plain_decode(f.data, f.least_bits, f.width * f.height) for f in parse(media).frames) == payload
