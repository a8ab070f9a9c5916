"""WARC archives with a Zstandard dictionary: written, indexed by digests, read back.

An archive (.warc.zst) begins with a skippable frame that holds its dictionary (itself
compressed), and every record is a frame of its own, so a record can be read alone.
Each task writes one archive, record by record.  The dictionary is learned before, from a
sample of all payloads that are to be archived: of their pieces of ``PIECE`` characters
each is taken by a hash of record and place, at a rate that gives about ``SAMPLE_BYTES``,
so every part of every record has the same chance, whatever its length and place.  Each
archive embeds the dictionary, and the manifest tells its size.  Too few or too small
pieces (under ``LEAST_PIECES``) train none; then the frame is left out and the manifest
tells why.  (An ``ArchiveWriter`` that is used alone, without a dictionary, learns one
from the records up to ``sample_bytes`` that it is given first.)

Of records with equal payloads (by SHA-1) of at least ``least`` bytes the one with the
largest id is a ``response``; the others are ``revisit`` records that name it, with the
HTTP head but no payload.  The largest id of each digest comes from a partially
aggregated group; it is joined back by digest, where AQE splits a hot one.

Cases: ids are whole numbers; a null payload is empty; a null id counts as smaller than all and is written as
``none``; rows with equal id and payload are all responses; a null URL is written
without target; an empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import AtomicFile, filesystem, in_arrow, materialise, scratch_path, text_batches, whole_id

SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 4 << 20, 64 << 10, 3
#: Characters of a piece of a payload, and pieces that a dictionary needs.
PIECE, LEAST_PIECES = 4096, 8
#: The magic numbers of a dictionary's skippable frame and of a compressed frame.
SKIPPABLE, FRAME = bytes.fromhex("5d2a4d18"), bytes.fromhex("28b52ffd")
CRLF = b"\r\n"
_READ = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Record:
    id: str
    type: str
    uri: str | None
    refers_to: str | None
    digest: str
    length: int
    payload: bytes

    @property
    def whole(self) -> bytes:
        """The record in WARC/1.1 form; a revisit has the head of the HTTP answer only."""
        http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {self.length}".encode(), b"", b""])
        block = http + (self.payload if self.type == "response" else b"")
        head = ["WARC/1.1", f"WARC-Type: {self.type}", f"WARC-Record-ID: <urn:x-page:{self.id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
        head += [f"WARC-Target-URI: {self.uri}"] * (self.uri is not None)
        head += [f"WARC-Payload-Digest: sha1:{self.digest}"]
        if self.type == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{self.refers_to}>"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(head).encode() + block + CRLF + CRLF


def parse(raw: bytes) -> Record:
    """The record of a frame; a response whose payload is not that of its digest is an error."""
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    length = next(int(x.split(b": ")[1]) for x in http.split(CRLF) if x.startswith(b"Content-Length: "))
    name = lambda k: fields[k][len("<urn:x-page:") : -1] if k in fields else None
    out = Record(name("WARC-Record-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"), name("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), length, payload)
    if out.type == "response" and (len(payload) != length or digest(payload) != out.digest):
        raise ValueError(f"the payload of record {out.id} is damaged")
    return out


def learn_dictionary(samples: list[bytes]) -> tuple[bytes | None, str | None]:
    """A dictionary of the samples, or why there is none."""
    import zstandard as z

    pieces = [x[i : i + PIECE] for x in samples for i in range(0, len(x), PIECE)]
    if len(pieces) < LEAST_PIECES:
        return None, f"{len(pieces)} pieces are too few for a dictionary"
    try:
        return z.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes(), None
    except z.ZstdError as e:
        return None, f"too little for a dictionary: {e}"


class ArchiveWriter:
    """One archive; ``add`` records, then ``close``.  dictionary: what ``learn_dictionary`` gave."""

    def __init__(self, folder: str, name: str, sample_bytes: int = SAMPLE_BYTES, dictionary: tuple[bytes | None, str | None] | None = None):
        self.file, self.sample_bytes = AtomicFile(folder, name), sample_bytes
        self.held: list[bytes] = []
        self.size, self.records, self.dictionary, self.note, self.packer = 0, 0, 0, None, None
        if dictionary is not None:
            self._begin(*dictionary)

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.packer is None:
            self.held.append(raw)
            self.size += len(raw)
            if self.size >= self.sample_bytes:
                self._begin(*learn_dictionary(self.held))
            return
        self.file.write(self.packer.compress(raw))

    def _begin(self, known: bytes | None, note: str | None) -> None:
        import zstandard as z

        self.note = note
        if known is not None:
            body = z.ZstdCompressor(level=19).compress(known)
            self.file.write(SKIPPABLE + len(body).to_bytes(4, "little") + body)
            self.dictionary = len(known)
        self.packer = z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(known)) if known else z.ZstdCompressor(level=LEVEL)
        for raw in self.held:
            self.file.write(self.packer.compress(raw))
        self.held = []

    def close(self) -> None:
        if self.packer is None:
            self._begin(*learn_dictionary(self.held))
        self.file.close()


def sample_pieces(pages: DataFrame, body_col: str, key: list[str], sample_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """About ``sample_bytes`` of all payloads, as pieces chosen by a hash of ``key`` and place."""
    total = pages.agg(F.sum(F.octet_length(body_col))).first()[0] or 0
    if not total:
        return []
    scale = 1 << 30
    rate = min(scale, -(-sample_bytes * scale // total))
    places = F.sequence(F.lit(0), F.floor((F.length(body_col) - 1) / F.lit(PIECE)).cast("int"))
    taken = F.filter(places, lambda k: F.pmod(F.xxhash64(*key, k), F.lit(scale)) < F.lit(rate))
    pieces = pages.where(F.length(body_col) > 0).select(F.col(body_col).alias("body"), F.explode(taken).alias("k"))
    # Ordered, so that the dictionary doesn't depend on the layout of a run.
    return sorted(r[0].encode() for r in pieces.select(F.col("body").substr(F.col("k") * F.lit(PIECE) + 1, F.lit(PIECE))).collect())


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; holds one record at a time."""
    import zstandard as z

    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None, buffer_size=0) as f:
        ahead = f.read(8)
        known = None
        if ahead[:4] == SKIPPABLE:
            body = f.read(int.from_bytes(ahead[4:8], "little"))
            known = z.ZstdCompressionDict(z.ZstdDecompressor().decompress(body) if body[:4] == FRAME else body)
            ahead = b""
        unpacker = z.ZstdDecompressor(dict_data=known) if known else z.ZstdDecompressor()
        while True:
            if not ahead and not (ahead := f.read(_READ)):
                return
            one, parts = unpacker.decompressobj(), []
            while True:
                parts.append(one.decompress(ahead))
                if one.eof:
                    break
                if not (ahead := f.read(_READ)):
                    raise ValueError(f"{path} is cut off")
            ahead = one.unused_data
            yield b"".join(parts)


def plan_records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """id, url, body, and the record's type and refers_to of each row."""
    rows = pages.select(whole_id(pages, id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    sha = F.unhex(F.sha1("body"))
    best = rows.where(F.octet_length("body") >= least).groupBy(sha.alias("sha")).agg(F.max("id").alias("best"), F.count("*").alias("n"))
    # Groups of one need no join partner: what has none is a response.
    best = best.where((F.col("n") > 1) & F.col("best").isNotNull()).drop("n")
    joined = rows.withColumn("sha", sha).join(best, "sha", "left")
    again = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best")) & (F.octet_length("body") >= least)
    return joined.select("id", "url", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("type"), F.when(again, F.col("best")).alias("refers_to"), "body")


def write_archives(planned: DataFrame, folder: str, samples: list[bytes] | None = None) -> DataFrame:
    """Write the folder; returns its manifest: path, records, bytes, dictionary (bytes of it) and note (why there is none).

    samples: what the dictionary is learned from; else it is sampled from the records to write.
    """
    dictionary = learn_dictionary(sample_pieces(planned.where("type = 'response'"), "body", ["id", "url"]) if samples is None else samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, out = f"part-{TaskContext.get().partitionId():05d}.warc.zst", None
        for b in text_batches(batches):
            out = out or ArchiveWriter(folder, name, dictionary=dictionary)
            for i, url, kind, refers, body in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                payload = body.encode()
                uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                out.add(Record("none" if i is None else str(i), kind, uri, None if refers is None else str(refers), digest(payload), len(payload), payload).whole)
        if out:
            out.close()
            yield pa.record_batch({"path": [f"{folder}/{name}"], "records": pa.array([out.records], pa.int64()), "bytes": pa.array([out.file.size], pa.int64()), "dictionary": pa.array([out.dictionary], pa.int64()), "note": pa.array([out.note], pa.string())})

    return materialise(in_arrow(planned, run, "path string, records long, bytes long, dictionary long, note string"), "warc-manifest")


def read_records(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record: id, payload_bytes, payload_digest, record_type, refers_to (and uri, payload)."""
    schema = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", uri string, payload binary" * with_payload

    def batch(rows: list[Record]) -> pa.RecordBatch:
        number = lambda x: None if x in (None, "none") else int(x)
        cols = {"id": pa.array([number(r.id) for r in rows], pa.int64()), "payload_bytes": pa.array([r.length for r in rows], pa.int64()), "payload_digest": [r.digest for r in rows], "record_type": [r.type for r in rows], "refers_to": pa.array([number(r.refers_to) for r in rows], pa.int64())}
        return pa.record_batch(cols | ({"uri": pa.array([r.uri for r in rows], pa.string()), "payload": pa.array([r.payload if r.type == "response" else None for r in rows], pa.binary())} if with_payload else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held: list[Record] = []
                size = 0
                for raw in read_archive(path):
                    held.append(parse(raw))
                    size += len(raw) if with_payload else 200
                    if size > 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return in_arrow(manifest.select("path").repartition(max(1, manifest.count())), run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # Sampled before the plan of records, which is then run once.
    manifest = write_archives(plan_records(pages), scratch_path(spark, "warc"), sample_pieces(pages, "html", ["page_id", "url"]))
    return read_records(manifest).withColumnRenamed("id", "page_id")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, unhex(sha1(b)) AS s FROM p),
bits AS (SELECT page_id, n, s, array_to_string(list_transform(range(0, 20), lambda i: lpad(bin(('0x' || hex(s)[2 * i + 1:2 * i + 2])::INTEGER), 8, '0')), '') AS bs FROM d),
e AS (SELECT page_id, n, s, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bs, 5 * i + j + 1, 1) AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) AS INTEGER) + 1, 1)), '') AS b32 FROM bits),
m AS (SELECT s, max(page_id) AS best FROM e GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM e JOIN m USING (s)
"""
