import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.compare import duck, same
from tests.llm import cases
from tidelog.llm.warc import FRAME, OP10_SQL, SKIPPABLE, ArchiveWriter, Record, digest, op10, parse, plan_records, read_archive, read_records, sample_pieces, write_archives


def brute(rows, least=0):
    best = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            best[body] = max(best.get(body, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        top = best.get(body)
        again = top is not None and i != top and len(body) >= least
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def test_query(spark, sf):
    same(op10(spark, sf), duck(sf), OP10_SQL)


@pytest.mark.parametrize("least", [0, 5])
def test_cases(spark, tmp_path, least):
    pages = cases.pages(spark).withColumns({c: F.lit(1) for c in ("id", "type", "body", "sha", "best", "n")})
    manifest = write_archives(plan_records(pages, least), str(tmp_path / "w"))
    got = read_records(manifest, with_payload=True)
    assert cases.rows(got.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == brute(cases.PAGE_ROWS, least)
    bodies = {html or "" for _, _, html in cases.PAGE_ROWS}
    assert {r["payload"].decode() for r in got.collect() if r["record_type"] == "response"} == bodies
    assert {r["uri"] for r in got.collect()} == {None if u is None else u.replace("\n", "%0A") for _, u, _ in cases.PAGE_ROWS}
    assert manifest.agg(F.sum("records")).first()[0] == len(cases.PAGE_ROWS)


def test_empty(spark, tmp_path):
    manifest = write_archives(plan_records(cases.pages(spark).limit(0)), str(tmp_path / "w"))
    assert read_records(manifest).count() == 0


def records(n):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(300)]
    for k in range(n):
        body = (f"<html><head><title>{k}</title></head><body class='page'>" + " ".join(rng.choices(words, k=120)) + "</body></html>").encode()
        yield Record(str(k), "response", f"http://x/{k}", None, digest(body), len(body), body)


def test_dictionary_is_embedded_and_records_stand_alone(tmp_path):
    out = ArchiveWriter(str(tmp_path), "a.warc.zst", sample_bytes=100_000)
    all_ = list(records(300))
    for r in all_:
        out.add(r.whole)
    out.close()
    raw = (tmp_path / "a.warc.zst").read_bytes()
    assert raw[:4] == SKIPPABLE
    size = int.from_bytes(raw[4:8], "little")
    body = raw[8 : 8 + size]
    assert body[:4] == FRAME
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body))
    assert known.dict_id() != 0 and out.dictionary == len(known.as_bytes())
    # The second record is read without the first.
    frame = raw[8 + size :]
    one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
    one.decompress(frame)
    assert parse(zstandard.ZstdDecompressor(dict_data=known).decompress(one.unused_data)) == all_[1]
    assert [parse(r) for r in read_archive(str(tmp_path / "a.warc.zst"))] == all_
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r.whole)) for r in all_)
    assert len(raw) - 8 - size < 0.8 * plain


def test_too_little_for_a_dictionary(tmp_path):
    out = ArchiveWriter(str(tmp_path), "a.warc.zst")
    one = next(records(1))
    out.add(one.whole)
    out.close()
    assert (tmp_path / "a.warc.zst").read_bytes()[:4] == FRAME
    assert [parse(r) for r in read_archive(str(tmp_path / "a.warc.zst"))] == [one]


def test_damage(tmp_path):
    one = next(records(1))
    with pytest.raises(ValueError, match="damaged"):
        parse(one.whole.replace(b"word1", b"WORD1"))
    with pytest.raises(ValueError, match="not a WARC"):
        parse(b"x" + one.whole)
    (tmp_path / "cut").write_bytes(zstandard.ZstdCompressor().compress(one.whole)[:-9])
    with pytest.raises(ValueError, match="cut off"):
        list(read_archive(str(tmp_path / "cut")))


def test_payload_with_blank_lines():
    body = b"a\r\n\r\nb: c\r\nContent-Length: 7\r\n\r\n"
    r = Record("1", "response", None, None, digest(body), len(body), body)
    assert parse(r.whole) == r
    again = Record("2", "revisit", "http://x: y", "1", digest(body), len(body), b"")
    assert parse(again.whole) == again


def test_every_archive_has_the_dictionary_of_all_records(spark, tmp_path):
    """It is sampled from all payloads, also for archives of a record, and read back."""
    pages = spark.createDataFrame([(int(r.id), r.uri, r.payload.decode()) for r in records(60)], "page_id long, url string, html string")
    manifest = write_archives(plan_records(pages).repartition(60), str(tmp_path / "w"))
    rows = manifest.collect()
    assert len(rows) > 20 and all(r["dictionary"] > 0 and r["note"] is None for r in rows)
    assert {r["payload"].decode() for r in read_records(manifest, with_payload=True).collect()} == {r["html"] for r in pages.collect()}


def test_why_there_is_no_dictionary(spark, tmp_path):
    one = cases.pages(spark).where("page_id = 7")
    row = write_archives(plan_records(one), str(tmp_path / "w")).first()
    assert row["dictionary"] == 0 and "too few" in row["note"]


def test_sample_covers_whole_records(spark):
    """Pieces come from all records and all their parts, near the bound, and the same ones each time."""
    long = "".join(f"{k:04d}" for k in range(100_000))
    pages = spark.createDataFrame([(k, "u", long if k == 3 else f"short {k}") for k in range(40)], "page_id long, url string, html string")
    got = sample_pieces(pages, "html", ["page_id", "url"], 100_000)
    assert 50_000 < sum(map(len, got)) < 150_000 and got == sample_pieces(pages.repartition(7), "html", ["page_id", "url"], 100_000)
    at = [long.index(p.decode()) for p in got if not p.startswith(b"short")]
    assert min(at) < 100_000 and max(at) > 300_000
    assert sample_pieces(pages, "html", ["page_id", "url"], 1 << 30) == sorted([f"short {k}".encode() for k in range(40) if k != 3] + [long[i : i + 4096].encode() for i in range(0, len(long), 4096)])
    assert sample_pieces(pages.limit(0), "html", ["page_id"]) == []
