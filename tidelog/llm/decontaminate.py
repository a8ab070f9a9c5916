"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Items and documents are normalised alike: A-Z lower-cased, words are runs of
ASCII letters, digits and everything beyond ASCII.  A window is 10 consecutive
words of an item (an item of fewer words is one window).  The automaton holds
each different window once, with blanks around it, so that only whole words
match; a document is scanned once, and every window that ends at a character is
reported, also one inside another.  Normalising maps each byte to one byte, so
word offsets in the scanned text point to bytes of the original.

A benchmark of up to ``BLOCK_BYTES`` of text (different items; some 20,000 questions) is
one automaton and one scan.  The driver gets the items of a block at a time, which it
sends to the executors.  Of a larger benchmark, whose automaton would not fit beside a
task, each block has an automaton of its own: the texts are scanned once for each, and
the hits are merged.  The result is the same and memory doesn't grow with the benchmark,
but time does, by a scan for each block.  An item longer than a block is a block.

Cases: a null or empty text has no words and no hits; items with null text have
no window; windows of items with a null id hit words but aren't counted as items;
repeated items are taken once; ids of documents are whole numbers; an empty benchmark or table gives no hits; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import union
from .shared import filter_rows, map_arrow, materialise, whole_id

WINDOW = 10
#: UTF-8 bytes of benchmark text in one automaton: about 100 times that in memory.
BLOCK_BYTES = 2 << 20

#: To lower case, and all ASCII but letters and digits to blanks.
FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """The automaton of some (item id, text) pairs."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(w, set()).update(() if item is None else (item,))
        self.auto = ahocorasick.Automaton()
        for w, who in owners.items():
            key = f" {w.decode('latin-1')} "
            self.auto.add_word(key, (len(key), w.count(b" ") + 1, frozenset(who)))
        self.empty = not owners
        if owners:
            self.auto.make_automaton()

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int, frozenset]]]:
        """The number of words, and (first word, words, items) of each window found."""
        words = words_of(text)
        if not words or self.empty:
            return len(words), []
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.auto.iter(line))
        if not found:
            return len(words), []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        ends = np.searchsorted(blanks, [e for e, _ in found])  # words before the blank that ends the match
        return len(words), [(int(e) - n, n, who) for e, (_, (_, n, who)) in zip(ends, found, strict=True)]


def byte_spans(text: str, hits: list[tuple[int, int, frozenset]]) -> list[tuple[int, int]]:
    """The original UTF-8 bytes of runs of words: [begin, end)."""
    blank = np.frombuffer(text.encode().translate(FOLD), np.uint8) == 32
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return [(int(begin[w]), int(end[w + n - 1])) for w, n, _ in hits]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in lists of about block_bytes at most, one list at a time on the driver."""
    # Each item once, so that repeated rows neither fill a block nor count towards the blocks.
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        yield [tuple(r) for r in items.collect()]
        return
    # Even by hash, at half the size, so that a block stays near the bound.
    block = F.pmod(F.xxhash64("item", "text"), F.lit(2 * blocks))
    items = materialise(items.withColumn("block", block).repartition(2 * blocks, "block"), "items")
    for k in range(2 * blocks):
        yield [tuple(r) for r in items.where(F.col("block") == k).select("item", "text").collect()]


def _merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: id, n_words, n_hit, items (array of strings, sorted) and spans.

    spans: the byte ranges [begin, end) of the original text that windows cover, merged.
    """
    spark: SparkSession = docs.sparkSession
    schema = "doc long, n_words long, items array<string>, runs array<struct<a:long,b:long>>, spans array<struct<begin:long,end:long>>"
    source = docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text, block_bytes)
    first = next(blocks)
    more = next(blocks, None)
    if more is not None:  # a row number, to merge what the blocks find
        source = materialise(source.withColumn("row", F.monotonically_increasing_id()), "docs")
        schema += ", row long"

    def scanned(items: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def make():
            scanner = Scanner(shared.value, size)

            def one(text: str | None) -> tuple:
                n, hits = scanner.hits(text)
                if not hits:
                    return n, [], [], []
                who = sorted({str(i) for _, _, items in hits for i in items})
                runs = _merge_runs([(w, w + k) for w, k, _ in hits])
                spans = _merge_runs(byte_spans(text, [(a, b - a, frozenset()) for a, b in runs]))
                return n, who, [{"a": a, "b": b} for a, b in runs], [{"begin": a, "end": b} for a, b in spans]

            def f(b: pa.RecordBatch) -> pa.RecordBatch:
                n, items, runs, spans = zip(*map(one, b.column(1).to_pylist()), strict=True)
                pair = lambda x, y: pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())]))
                cols = {"doc": b.column(0), "n_words": pa.array(n, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "runs": pa.array(runs, pair("a", "b")), "spans": pa.array(spans, pair("begin", "end"))}
                return pa.record_batch(cols | ({"row": b.column(2)} if b.num_columns > 2 else {}))

            return f

        return map_arrow(source, make, schema)

    out = scanned(first)
    while more is not None:
        found = scanned(more)
        both = union(out, found)
        # Equal row numbers are the same document, once from each side.
        out = materialise(both.groupBy("row").agg(F.first("doc").alias("doc"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("spans")).alias("spans")), "scanned")
        more = next(blocks, None)
    runs = F.array_sort("runs")
    covered = F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["to"], r["a"]))).cast("long").alias("n"), F.greatest(s["to"], r["b"]).alias("to")), lambda s: s["n"])
    return out.select(F.col("doc").alias(id_col), "n_words", covered.alias("n_hit"), "items", "spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, in which no window of an item occurs."""
    spark = docs.sparkSession
    out = docs
    for k, items in enumerate(item_blocks(benchmark, item_col, item_text, block_bytes)):
        shared = spark.sparkContext.broadcast(items)

        def make(shared=shared):
            scanner = Scanner(shared.value, size)
            return lambda texts: [not scanner.hits(t)[1] for t in texts]

        # One automaton at a time in memory: a further block scans what the ones before have left.
        out = filter_rows(out if not k else materialise(out, "clean"), make, text_col)
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT k FROM win),
di AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM di, sizes WHERE i + k - 1 <= len(w)),
hit AS (SELECT r, i, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
cover AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
who AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(who.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(who.s, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN who USING (r)
"""
