"""SentencePiece encoding and decoding with byte spans of the original text.

Normalisation follows the model's compiled character map: at each position the
longest prefix in its double-array trie is replaced, else one character is kept,
and for every normalised byte the source bytes are recorded.  The pieces that the
library returns tile the normalised text, so the running sum of their lengths
points into that record and gives each piece's span in the original bytes.

Ids are the library's.  If no piece of the model has a word mark behind another
character, merges never cross a word mark, so a text's ids are those of its marked
words one after the other; these are remembered (``PieceMemo``).  Models for which
that can't be shown encode each text whole.

A model with an empty character map (as ``piece_bpe_32k.model``) replaces nothing but blanks,
so the walk through the trie isn't run for it; the alignment is then that of the bytes.

Cases: ids of documents are whole numbers; null counts as the empty text, which has no ids; the dummy prefix has an
empty span at 0; a character that falls back to bytes gives each byte piece its own
byte; texts are never cut; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Memo, map_arrow, whole_id

MARK = "▁"
#: Marked words that a Python worker remembers.
MEMO_WORDS = 400_000


class CharMap:
    """The model's normaliser: its compiled character map and white-space rules."""

    def __init__(self, blob: bytes, dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True):
        self.dummy_prefix, self.remove_extra, self.space = dummy_prefix, remove_extra, MARK.encode() if escape else b" "
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of text[at:] in the trie."""
        if not self.units:
            return None
        units, found, node = self.units, None, 0
        offset = lambda u: u >> 10 << ((u & 1 << 9) >> 6)
        node ^= offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= offset(units[node])
            if leaf:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes, and for each the begin and end of its source."""
        if not self.units and not self.remove_extra:
            return self._identity(text)
        out, begin, end, at = bytearray(), [], [], 0

        def put(b: bytes, s: int, e: int) -> None:
            out.extend(b)
            begin.extend([s] * len(b))
            end.extend([e] * len(b))

        def step(at: int) -> tuple[int, bytes]:
            if got := self.longest(text, at):
                return got
            n = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
            return n, text[at : at + n]

        while self.remove_extra and at < len(text):
            n, b = step(at)
            if b != b" ":
                break
            at += n
        if at == len(text):
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.dummy_prefix:
            put(self.space, at, at)
        was_space = self.remove_extra
        while at < len(text):
            n, b = step(at)
            while was_space and b.startswith(b" "):
                b = b[1:]
            if b:
                if b == text[at : at + n] and b != b" ":  # kept: each byte is its own source
                    out.extend(b)
                    begin.extend(range(at, at + n))
                    end.extend(range(at + 1, at + n + 1))
                else:
                    put(b.replace(b" ", self.space), at, at + n)
                was_space = self.remove_extra and b.endswith(b" ")
            at += n
        while self.remove_extra and out.endswith(self.space):
            del out[-len(self.space) :], begin[-len(self.space) :], end[-len(self.space) :]
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    def _identity(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        if not text:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = len(self.space) * self.dummy_prefix
        source = np.arange(len(text))
        if len(self.space) > 1:
            source = np.repeat(source, np.where(np.frombuffer(text, np.uint8) == 32, len(self.space), 1))
        begin, end = np.zeros(lead + len(source), np.int64), np.zeros(lead + len(source), np.int64)
        begin[lead:], end[lead:] = source, source + 1
        return self.space * self.dummy_prefix + text.replace(b" ", self.space), begin, end


class PieceMemo:
    """The library's ids of whole texts, and the spans of their pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(self.sp.serialized_model_proto())
        norm = m.normalizer_spec
        self.map = CharMap(norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces)
        self.bytes_of = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in m.pieces], np.int64)
        self.by_word = m.trainer_spec.model_type == m.trainer_spec.BPE and m.trainer_spec.byte_fallback and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
        self.by_word &= all(p.type in (p.NORMAL, p.BYTE, p.CONTROL, p.UNKNOWN) and not re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces)
        self.marks, self.memo = re.compile(f"{MARK}+[^{MARK}]*"), Memo(self._learn, MEMO_WORDS)
        self.marked = np.array([p.piece.startswith(MARK) for p in m.pieces])
        self.mark_id = next((k for k, p in enumerate(m.pieces) if p.piece == MARK), None)
        self.by_word &= self.mark_id is not None

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and MARK not in text:  # no two marks meet
            return text.split(" ")
        return [w[1:] for w in self.marks.findall(MARK + text.replace(" ", MARK))]

    def _learn(self, words: list[str]) -> Iterator[bytes]:
        """Words of one mark go to the library in one text: a word begins where a piece with a mark does."""
        one = [w for w in words if w and w[0] != MARK]
        ids = np.array(self.sp.encode(" ".join(one), num_threads=1), "<u4")
        raw, at = ids.tobytes(), (4 * np.flatnonzero(self.marked[ids])).tolist()
        cut = (raw[i:j] for i, j in pairwise([*at, len(raw)]))
        if len(one) == len(words):
            return cut
        found = {"": np.array([self.mark_id], "<u4").tobytes()}
        found |= zip(one, cut, strict=True)
        # The library puts a mark before what it gets.
        return (found[w] if w in found else np.array(self.sp.encode(w), "<u4").tobytes() for w in words)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(i, "<u4") for i in self.sp.encode(texts, num_threads=1)]
        return [np.frombuffer(i, "<u4") for i in self.memo.join([self.words(t) for t in texts])]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the UTF-8 bytes of the text."""
        _, begin, end = self.map.normalise(text.encode())
        ends = np.cumsum(self.bytes_of[ids])
        if not len(ids):
            return ends, ends
        return begin[ends - self.bytes_of[ids]], end[ends - 1]


@lru_cache(1)
def piece_memo(path: str) -> PieceMemo:
    """One for each Python worker: what a task has learned serves the next."""
    return PieceMemo(path)


def encode_spans(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids, begins and ends (arrays) and the decoded text of each row."""

    def make():
        memo = piece_memo(path)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = memo.ids(texts)
            spans = [memo.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            lists = lambda xs: pa.array([x.tolist() for x in xs], pa.list_(pa.int32()))
            return pa.record_batch({"doc": b.column(0), "ids": lists(ids), "begins": lists([s[0] for s in spans]), "ends": lists([s[1] for s in spans]), "decoded": memo.sp.decode([i.tolist() for i in ids], num_threads=1)})

        return f

    out = map_arrow(docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).alias("text")), make, "doc long, ids array<int>, begins array<int>, ends array<int>, decoded string", rows=64)
    return out.withColumnRenamed("doc", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """n_tokens, and digests of ids, decoded text and spans: what ``encode_spans`` gives, in fixed size (and the ids)."""

    def make():
        memo = piece_memo(path)
        number = [str(i) for i in range(memo.sp.get_piece_size())]

        def one(text: str, ids: np.ndarray) -> tuple:
            begin, end = memo.spans(text, ids)
            listed = ids.tolist()
            return (len(listed), hashlib.sha256(",".join(map(number.__getitem__, listed)).encode()).hexdigest(), hashlib.sha256(memo.sp.decode(listed).encode()).hexdigest() if listed else hashlib.sha256(b"").hexdigest(), zlib.crc32(end.astype("<i8"), zlib.crc32(begin.astype("<i8"))))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = memo.ids(texts)
            rows = [one(t, i) for t, i in zip(texts, found, strict=True)]
            n, ids, decoded, spans = zip(*rows, strict=True)
            return pa.record_batch({"doc": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids, "decoded_sha256": decoded, "spans_crc32": pa.array(spans, pa.int64())} | ({"ids": pa.array([i.astype(np.int32) for i in found], pa.list_(pa.int32()))} if with_ids else {}))

        return f

    out = map_arrow(docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).alias("text")), make, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long" + ", ids array<int>" * with_ids, rows=128)
    return out.withColumnRenamed("doc", id_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
