"""Language ID by bit-sliced Bloom filters of character n-grams.

For each language the most frequent n-grams (2 to 4 characters; words, which are runs of
letters and combining marks, are marked with blanks) of a bounded training sample go into one table: slot by slot a mask with a
bit for each language, so one lookup (the AND of the n-gram's slots) returns all
languages that contain it.  A text is scored by the number of its n-grams that each
language contains, corrected for the false positives that the filling of its bits
makes: of n n-grams about n * f are found by chance, so c hits stand for
(c - n * f) / (1 - f) members.  The language with most members wins; the score is its
share among all languages' members.

Training reads text and lang only; of each language at most about ``train_docs``
different texts are taken (by a hash of the text, so the sample does not depend on
layout or ids; the rate follows the number of different texts, so copies thin nothing
out).  Counting is distributed; the driver gets ``top`` n-grams a language.
The number of languages is bounded by ``MAX_LANGUAGES``, which is checked.

``top`` n-grams are nearly all of a language with a small alphabet, but far from all of
one with thousands of characters.  So how much of a text its language has to contain is
learned too: for each text of the sample the share that the language's kept n-grams
would contain without that text is taken, and the bound of the language is ``MARGIN`` of
the low end (``LOW``) of these shares, ``COVERED`` at most and ``LEAST_COVERED`` at least.
Texts that are labelled with another language than they are judged to be have no say.
A language of fewer than ``FEW`` such texts takes the shares with the text itself.

Cases: a null text or one without a letter is ``und`` with score 0; if no n-gram is
known, the most frequent language of the training rows is taken with score 0; ties go
to the more frequent language, then by name; rows without lang train nothing; without
any training row everything is ``und`` and ``keep_identified`` keeps every text with a
letter; texts are read whole; other columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filter_rows, in_arrow, map_arrow, materialise, text_batches

SIZES = (2, 3, 4)
#: Parameters of the fit: the sample of each language, and the n-grams kept of it.
TRAIN_DOCS, TOP = 2000, 6000
SLOT_BITS, PROBES, MAX_LANGUAGES = 17, 2, 4096
UND = "und"
#: Share of its n-grams that a text's language has to contain at most; what texts of another script have by chance is below the least.
COVERED, LEAST_COVERED = 0.5, 0.05
#: A language's bound is MARGIN of the quantile LOW of what its own texts have; with FEW texts or more, of each by what the others have.
MARGIN, LOW, FEW = 0.6, 0.01, 10


def in_word(c: str) -> bool:
    """Letters, and the marks that many scripts write vowels and tones with."""
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Mc")


#: Lower-cased code points below this are looked up; the others are kept as they are.
_LOW = 0x600
_FOLD = np.arange(_LOW, dtype=np.uint32)
for _c in range(_LOW):
    _low = chr(_c).lower()
    _FOLD[_c] = (ord(_low) if len(_low) == 1 else _c) if in_word(chr(_c)) else 32
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fold(text: str) -> np.ndarray:
    """Code points with what isn't part of a word as blanks, of which one is left between words and at the ends."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) and c.max() >= _LOW:
        high = c >= _LOW
        out = np.where(high, 32, _FOLD[np.where(high, 32, c)])
        kinds = {x: ord(low) if len(low := chr(x).lower()) == 1 else x for x in np.unique(c[high]).tolist() if in_word(chr(x))}
        for x, low in kinds.items():
            out[c == x] = low
    else:
        out = _FOLD[c]
    out = np.concatenate([[32], out, [32]]).astype(np.uint32)
    blank = out == 32
    return out[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram that doesn't cross a word."""
    x, blank = c.astype(np.uint64), c == 32
    out = []
    for n in SIZES:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * _M[0]
            h ^= h >> np.uint64(29)
        if n > 2:  # a blank may stand at an end only
            inside = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                inside |= blank[k : len(x) - n + 1 + k]
            h = h[~inside]
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Filters:
    """Bit-sliced Bloom filters: for each slot the languages that set it."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        #: Whether there is any n-gram to judge by.
        self.learned = any(map(len, members))
        #: The share of its n-grams that a text of each language has to have.
        self.bounds = dict.fromkeys(languages, COVERED)
        self.width = -(-len(languages) // 8) or 1
        self.table = np.zeros((1 << SLOT_BITS, self.width), np.uint8)
        for k, hashes in enumerate(members):
            for at in self._slots(hashes):
                self.table[at, k // 8] |= np.uint8(1 << k % 8)
        bits = np.unpackbits(self.table, axis=1, bitorder="little")[:, : len(languages)]
        self.false = bits.mean(axis=0) ** PROBES
        self.bits = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)

    @staticmethod
    def _slots(h: np.ndarray) -> list[np.ndarray]:
        return [(h * _M[1] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)][:PROBES]

    def members(self, h: np.ndarray) -> np.ndarray:
        """For each language, the corrected number of n-grams that it contains."""
        at, *rest = self._slots(h)
        out = np.zeros(self.width * 8, np.int64)
        for w in range(self.width):
            mask = self.table[at, w]
            for other in rest:
                mask &= self.table[other, w]
            out[8 * w : 8 * w + 8] = np.bincount(mask, minlength=256) @ self.bits
        hit = out[: len(self.languages)]
        return np.maximum(0.0, (hit - len(h) * self.false) / (1 - self.false + 1e-9))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the share of the text's n-grams that the language contains."""
        if not text or not self.languages or not has_letter(text):
            return UND, 0.0, 0.0
        h = grams(fold(text))
        found = self.members(h)
        best, total = int(np.argmax(found)), float(found.sum())
        return self.languages[best], float(found[best]) / total if total > 0 else 0.0, min(1.0, float(found[best]) / max(1, len(h)))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def keeps(self, text: str | None, covered: float = COVERED) -> bool:
        """Whether the text is in a learned language: it has the language's bound, or ``covered`` where that is less.

        Where nothing was learned there is nothing to judge by, and every text with a letter is kept.
        """
        if not self.learned:
            return has_letter(text or "")
        lang, _, share = self.judge(text)
        return lang != UND and share >= min(covered, self.bounds[lang])


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2


def learn_bounds(sample: DataFrame, model: Filters, kept: dict[str, tuple[np.ndarray, np.ndarray]], top: int) -> dict[str, float]:
    """The bound of each language from the texts of the sample; kept has n-grams and their counts."""
    known = {}
    for lang, (h, n) in kept.items():
        order = np.argsort(h)
        # How often an n-gram may be left out until it is no longer kept.
        spare = n[order] - (n.min() if len(n) >= top else 1)
        known[lang] = h[order], np.minimum(spare, 0xFFFF).astype(np.uint16)
    shared = sample.sparkSession.sparkContext.broadcast((model, known))

    def make():
        judge, parts = shared.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = grams(fold(text))
                if not len(h) or lang not in parts or judge.languages[int(np.argmax(judge.members(h)))] != lang:
                    continue
                own, spare = parts[lang]
                u, n = np.unique(h, return_counts=True)
                at = np.minimum(np.searchsorted(own, u), len(own) - 1)
                hit = own[at] == u
                out.append((lang, n[hit].sum() / len(h), n[hit & (n <= spare[at])].sum() / len(h)))
            return pa.record_batch({"lang": pa.array([x[0] for x in out], pa.string()), "whole": pa.array([x[1] for x in out], pa.float64()), "others": pa.array([x[2] for x in out], pa.float64())})

        return f

    low = lambda c: F.percentile(c, F.lit(LOW))
    found = map_arrow(sample.select("lang", "text"), make, "lang string, whole double, others double").groupBy("lang").agg(F.when(F.count("*") >= FEW, low("others")).otherwise(low("whole")).alias("low"))
    return {r["lang"]: max(LEAST_COVERED, min(COVERED, MARGIN * r["low"])) for r in found.collect()}


def fit(rows: DataFrame, train_docs: int = TRAIN_DOCS, top: int = TOP, bounds: bool = True) -> Filters:
    """From rows with text and lang; those with a null in either are left out.  Bounds are for ``keep_identified``."""
    rows = rows.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    hashed = F.xxhash64("text")
    texts = rows.groupBy("lang", hashed.alias("text_hash")).agg(F.count("*").alias("n"))
    counts = texts.groupBy("lang").agg(F.sum("n").alias("count"), F.count("*").alias("texts")).orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in lang")
    if not counts:
        return Filters([], [])
    scale = 1 << 24
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(scale, -(-train_docs * scale // r["texts"]))))])
    draw = F.pmod(hashed, F.lit(scale))
    # Copies are drawn together, so of each text one stays: a large group can't break the bound.
    sample = rows.where(draw < F.element_at(rate, F.col("lang"))).select("lang", "text").distinct()
    if bounds:  # it is read twice
        sample = materialise(sample, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 4096, 1 << 19):  # the n-grams of a text take some 70 times its bytes
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(fold(text)))
            for lang, parts in by.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(h), pa.string()), "gram": pa.array(h.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    from pyspark.sql import Window

    summed = in_arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = summed.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).select("lang", "gram", "n").toPandas()
    languages = [r["lang"] for r in counts]
    by = {k: (g["gram"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(np.int64)) for k, g in kept.groupby("lang")}
    model = Filters(languages, [by[k][0] if k in by else np.zeros(0, np.uint64) for k in languages])
    if bounds:
        model.bounds |= learn_bounds(sample, model, by, top)
    return model


def identify(docs: DataFrame, filters: Filters, columns: list[str]) -> DataFrame:
    """The named columns of docs (not read by the model), lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    source = docs.select(F.col("text").alias("_t"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    schema = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(source.schema.fields[1:])) + "lang_pred string, score double"

    def make():
        model = shared.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            pred, score = zip(*map(model.predict, b.column(0).to_pylist()), strict=True)
            return pa.record_batch({f"c{k}": b.column(k + 1) for k in range(len(columns))} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

        return f

    out = map_arrow(source, make, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "lang_pred", "score")


def keep_identified(docs: DataFrame, filters: Filters, covered: float = COVERED) -> DataFrame:
    """The rows of docs, all columns as they are, that are in a learned language.

    What has no letter goes, and what is in another language or none: then the likeliest
    language contains less of the text's n-grams than its bound, which is at most ``covered``.
    If nothing was learned (lang is null in every row), every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        model = shared.value
        return lambda texts: [model.keeps(t, covered) for t in texts]

    return filter_rows(docs, make)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"))
    model = fit(docs.where(F.coalesce(~out, F.lit(True))), bounds=False)
    return identify(docs, model, ["doc_id"]).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")
