"""Token-id output: frequency-ranked ids in a byte-aligned code with control bytes apart.

Texts are encoded once with the ``tokenizers`` library and an end id is added.
Ids are counted over all documents, renumbered by falling frequency, and written
in id order of the documents as files of blocks; in a block the ids are coded in
1 to 4 bytes each, and the lengths, 2 bits an id, fill control bytes of their own.
Small ranks are the frequent ones, so most ids take one byte.  Decoding looks the
control bytes up in a numpy table and gathers; there is no loop over ids.

A folder holds ``ranks.bin`` (the id of every rank, uint32) and ``part-00000.tok``,
``part-00001.tok``, ... in ascending document order.  A file is ``MAGIC`` and then
blocks of: 4 int64 (documents, ids, control bytes, data bytes), the document
numbers (int64), a null flag each (uint8), the ids of each document (int64),
control bytes, data bytes.  Blocks hold about ``BLOCK_IDS`` ids or one longer
document, so memory is bounded by the longest text.  The number of files grows with
the ids that were counted (``FILE_IDS``), so a task's share doesn't grow with the corpus.

Words are encoded by the library once and remembered: ``WordMemo`` splits texts at
white space, which no match of this tokenizer's pattern crosses, and learns the chunks
by that pattern, but only in texts made of characters whose class, case and composition
are the same in all Unicode versions; all other texts go through the library whole.
Between the steps an id takes 2 bytes if the vocabulary allows it, else 4.

Cases: ids are whole numbers; a null or empty text has the end id only; equal document numbers are
ordered by their ids; a null document number comes first and stays null; an
empty table writes ``ranks.bin`` alone; other columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import AtomicFile, Memo, filesystem, in_arrow, map_arrow, materialise, prefix_sums, scratch_path, text_batches, whole_id

MAGIC = b"TLTOKEN1"
BLOCK_IDS = 1 << 20
#: Ids in a file, about: where the session's shuffle partitions would make larger ones, more files are written.
FILE_IDS = 1 << 27
#: Words that a Python worker remembers (some 200 bytes each), and words in a line that the library gets.
MEMO_WORDS, LINE_WORDS = 800_000, 50

STABLE = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC]))


def code_of(vocab: int) -> str:
    """The type of ids between the steps."""
    return "<u2" if vocab <= 1 << 16 else "<u4"


class WordMemo:
    """``ids(texts)``: the library's ids of each text, as little-endian bytes of type ``code``."""

    def __init__(self, path: str, code: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.code, self.size = code, np.dtype(code).itemsize
        self.memo = Memo(self._learn, MEMO_WORDS)
        kinds = {c: unicodedata.category(c)[0] for c in STABLE + STABLE.lower()}
        cls = lambda *k: "".join(re.escape(c) for c, x in sorted(kinds.items()) if x in k)
        letters, numbers, spaces = cls("L"), cls("N"), re.escape("\t\n\r \xa0")
        self.stable = re.compile(f"[{re.escape(STABLE)}]*")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        self.fits = self._is_word_split()
        self.ends_word = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        self.ends_word[[i for w, i in self.tok.get_vocab().items() if w.endswith("</w>")]] = True

    def _is_word_split(self) -> bool:
        """Whether the file describes the tokenizer that the pattern above is for."""
        import json

        t = json.loads(self.tok.to_str())
        norm = t.get("normalizer") or {}
        pre = t.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        # White space becomes one blank, and nothing else is replaced.
        replaces = [x for x in norm.get("normalizers", []) if x["type"] == "Replace"]
        blanks = all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in replaces)
        split = next((x for x in pre.get("pretokenizers", []) if x["type"] == "Split"), {})
        return kinds == ["NFC", "Replace", "Lowercase"] and blanks and split.get("invert") is True and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and split.get("behavior") == "Removed" and t["model"].get("end_of_word_suffix") == "</w>"

    def _learn(self, chunks: list[str]) -> Iterator[bytes]:
        """The words of all chunks go to the library in lines; a word ends where a token with the end mark does."""
        if not chunks:
            return iter(())
        words = [self.words.findall(c) for c in chunks]
        if not all(words):  # the ends of a text that begins or ends with white space
            full = dict(zip(filter(None, chunks), self._learn([c for c in chunks if c]), strict=True))
            return (full.get(c, b"") for c in chunks)
        # Chunks share words, and the marks at their ends even more.
        flat = list(dict.fromkeys(chain.from_iterable(words)))
        # Short texts: the library takes longer for a word in a long one.
        lines = [" ".join(flat[i : i + LINE_WORDS]) for i in range(0, len(flat), LINE_WORDS)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)), self.code)
        raw, at = ids.tobytes(), (self.size * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        known = dict(zip(flat, (raw[i:j] for i, j in pairwise([0, *at])), strict=True)).__getitem__
        return (known(w[0]) if len(w) == 1 else b"".join(map(known, w)) for w in words)

    def ids(self, texts: list[str]) -> list[bytes]:
        by_chunk = [self.fits and self.stable.fullmatch(t) is not None and "<|" not in t for t in texts]
        lower = pa.array([t.lower() for t, c in zip(texts, by_chunk, strict=True) if c], pa.string())
        joined = iter(self.memo.gather(pc.utf8_split_whitespace(lower), self.code))
        return [next(joined) if c else np.array(self.tok.encode(t, add_special_tokens=False).ids, self.code).tobytes() for t, c in zip(texts, by_chunk, strict=True)]


@lru_cache(1)
def word_memo(path: str, code: str) -> WordMemo:
    """One for each Python worker: what a task has learned serves the next."""
    return WordMemo(path, code)


def encode_ids(docs: DataFrame, path: str, end_id: int, code: str = "<u4", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, ids (binary: little-endian integers of type code, the end id last) of each row."""

    def make():
        memo, end = word_memo(path, code), np.array([end_id], code).tobytes()

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = memo.ids([t or "" for t in b.column(1).to_pylist()])
            return pa.record_batch({"doc": b.column(0), "ids": pa.array([i + end for i in ids], pa.binary())})

        return f

    return map_arrow(docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).alias("text")), make, "doc long, ids binary", rows=4096)


def count_ids(encoded: DataFrame, code: str = "<u4") -> DataFrame:
    """id and n over all documents; at most a row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in text_batches(batches):
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), code))
            if len(got) > len(total):
                got, total = total, got.astype(np.int64)
            total[: len(got)] += got
        found = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    return in_arrow(encoded.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (2 bits an id: its bytes less 1, lowest bits first) and data bytes."""
    width = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = width
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= width[:, None]]
    return control.tobytes(), data.tobytes()


#: The byte counts of the four ids of a control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths > k)
        if not len(at):
            break
        out[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    docs, ids, held = [], [], 0
    for b in text_batches(batches):
        for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            docs.append(d)
            ids.append(i)
            held += len(i) // size
            if held >= BLOCK_IDS:
                yield docs, ids
                docs, ids, held = [], [], 0
    if docs:
        yield docs, ids


def write_files(encoded: DataFrame, folder: str, vocab: int, partitions: int) -> DataFrame:
    """Write the folder, in ``partitions`` files or more; returns its manifest: part, path, docs, n_ids, bytes.

    The ids are of type ``code_of(vocab)``.
    """
    spark, code = encoded.sparkSession, code_of(vocab)
    size = np.dtype(code).itemsize
    # Bounded by the vocabulary, whatever the corpus.
    counted = count_ids(encoded, code).orderBy(F.desc("n"), "id").limit(vocab).toPandas()
    id_of = np.concatenate([counted["id"].to_numpy(np.int64), np.setdiff1d(np.arange(vocab), counted["id"].to_numpy(np.int64))]).astype("<u4")
    out = AtomicFile(folder, "ranks.bin")
    out.write(id_of.tobytes())
    out.close()
    rank_of = np.empty(len(id_of), np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ranks, file, docs_n, ids_n = TaskContext.get().partitionId(), shared.value, None, 0, 0
        for docs, ids in _blocks(batches, size):
            if file is None:
                file = AtomicFile(folder, f"part-{part:05d}.tok")
                file.write(MAGIC)
            flat = np.frombuffer(b"".join(ids), code)
            control, data = encode_block(ranks[flat])
            for x in (np.array([len(docs), len(flat), len(control), len(data)]), np.array([d or 0 for d in docs]), np.array([d is None for d in docs], np.uint8), np.array([len(i) // size for i in ids])):
                file.write(x.astype("<i8" if x.dtype != np.uint8 else np.uint8).tobytes())
            file.write(control)
            file.write(data)
            docs_n, ids_n = docs_n + len(docs), ids_n + len(flat)
        if file:
            file.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:05d}.tok"], "docs": pa.array([docs_n], pa.int64()), "n_ids": pa.array([ids_n], pa.int64()), "bytes": pa.array([file.size], pa.int64())})

    files = max(partitions, -(-int(counted["n"].sum()) // FILE_IDS))
    laid = encoded.repartitionByRange(files, "doc").sortWithinPartitions("doc", "ids")
    return materialise(in_arrow(laid, run, "part int, path string, docs long, n_ids long, bytes long"), "token-manifest")


@lru_cache(2)
def _ranks(folder: str) -> np.ndarray:
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/ranks.bin", compression=None) as f:
        return np.frombuffer(f.read(), "<u4")


def read_blocks(path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document numbers, id counts and ids of each block of a file."""
    id_of = _ranks(path.rsplit("/", 1)[0])
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        while head := f.read(32):
            docs_n, ids_n, control_n, data_n = map(int, np.frombuffer(head, "<i8"))
            docs = np.frombuffer(f.read(8 * docs_n), "<i8").tolist()
            null = np.frombuffer(f.read(docs_n), np.uint8)
            counts = np.frombuffer(f.read(8 * docs_n), "<i8")
            ids = id_of[decode_block(f.read(control_n), f.read(data_n), ids_n)]
            yield [None if x else d for d, x in zip(docs, null, strict=True)], counts, ids


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc, start, n_tokens, ids_crc32 (and ids) of each document, from the files."""
    schema = "doc long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for docs, counts, ids in read_blocks(path):
                    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                    cut = [raw[4 * (e - n) : 4 * e] for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                    cols = {"doc": pa.array(docs, pa.int64()), "start": pa.array(start + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64())}
                    yield pa.record_batch(cols | ({"ids": pa.array([bytes(c) for c in cut], pa.binary())} if with_ids else {}))
                    start += int(ends[-1])

    parts = max(1, manifest.count())
    return in_arrow(prefix_sums(manifest, "part", "n_ids", "start").select("path", "start").repartition(parts), run, schema)


def tokenise_to_files(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write the folder, return its manifest."""
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_files(materialise(encode_ids(docs, path, end_id, code_of(vocab), id_col, text_col), "ids"), folder, vocab, partitions)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = tokenise_to_files(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens"), 1)
    return read_files(manifest).withColumnRenamed("doc", "doc_id")
