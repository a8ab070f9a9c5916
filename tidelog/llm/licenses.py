"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates become runs of words (A-Z lower-cased; ASCII letters, digits and
all beyond ASCII), and each 5 consecutive words a shingle.  A template belongs to the
smallest window class that surely holds it: windows of 8, 16, 32 or 64 words at every
8th of their length (longer templates are cut into pieces of PIECE words that overlap by
half).  Such a window contains the whole template somewhere, so the Jaccard similarity
of their shingle sets is at least 1/4, and with ``BANDS`` bands of ``BAND_ROWS`` minimal
hashes a template is missed with a chance of at most (1 - (1/4)^BAND_ROWS)^BANDS, which
is 1e-8 (``miss_bound``).

A band can only be shared if a shingle of the text is one of those that are minimal in
a template's bands, so texts without such a shingle are done after one lookup; the
others get all their windows' MinHashes.  Retrieved templates are verified: in a stretch
of text of at most twice the template's words, at least ``CONTAINED`` of the template's
shingles occur.  Stretches that pass are reported with containment and byte offsets; of
those that overlap, the one with most shingles found stays, then that with the greater
containment, then the shorter, then the first.

With bands of one hash (``BAND_ROWS``) a band is one minimal hash: that bound is for whole
templates in the text; edited ones are found down to the containment with the chances that
their remaining windows give, which a test compares with a search without bands.

Built in are notices, short licences and the headers of long ones (``TEMPLATES``), and some
long ones in full (``whole_licenses``).  Templates are a parameter (name to text), sent to executors up to ``TEMPLATE_BYTES``,
which is checked.

A template of fewer than 5 words is one short shingle.  Texts are hashed in the lengths
that such templates have too, and each run of exactly its words is a match; where these
overlap each other the longer stays, then the first, and none stays in the words of a
match of a longer template.

Cases: ids are whole numbers; null and empty texts, and texts without a word, have no match; an empty template
is left out; of equal templates the first name is told;
repeated rows are rows of their own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES, whole_licenses
from .shared import GOLDEN, map_arrow, mix, run_hashes, whole_id, word_shingles

SHINGLE, CONTAINED = 5, 0.8
CLASSES = (8, 16, 32, 64)
PIECE = 48
BANDS, BAND_ROWS = 64, 1
TEMPLATE_BYTES = 64 << 20

#: A-Z lower-cased, and all ASCII but letters and digits as blanks.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_BLANK = np.arange(256) == 32
_P, _mix = GOLDEN, mix
_PART = 1 << 20


def miss_bound(similarity: float, bands: int = BANDS, rows: int = BAND_ROWS) -> float:
    """The chance that no band of two sets of a similarity is equal."""
    return (1 - similarity**rows) ** bands


def words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (bytes of the original) of each word; in parts that end at a blank."""
    raw = (text or "").encode().translate(_FOLD)
    hashes, begins, ends, at = [], [], [], 0
    while at < len(raw):
        to = len(raw)
        if at + _PART < to:
            to = raw.find(b" ", at + _PART)
            to = len(raw) if to < 0 else to
        h, begin, end = run_hashes(raw[at:to], _BLANK)
        if len(h):
            hashes.append(h)
            begins.append(begin + at)
            ends.append(end + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of each run of ``size`` words, in order; of fewer words, one of all."""
    return word_shingles(w, size)


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)


def minhash(values: np.ndarray, starts: np.ndarray, length: int, seeds: np.ndarray) -> np.ndarray:
    """(windows, hashes): the least of each hash function over values[start : start + length]."""
    out = np.empty((len(starts), len(seeds)), np.uint64)
    for j, s in enumerate(seeds):
        h = _mix(values * s)
        low, span = h, 1
        while span * 2 <= length:  # least of runs of 1, 2, 4, ... values
            low = np.minimum(low[:-span], low[span:]) if len(low) > span else low
            span *= 2
        last = np.minimum(starts + length - span, len(low) - 1)
        out[:, j] = np.minimum(low[np.minimum(starts, len(low) - 1)], low[np.maximum(last, 0)])
    return out


def bands_of(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(windows, bands): a key for each band of minimal hashes."""
    key = np.tile(np.arange(bands, dtype=np.uint64) * np.uint64(_P), (len(mins), 1))
    for r in range(rows):
        key = _mix(key * np.uint64(_P) + mins[:, r::rows][:, :bands])
    return key


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, which is sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class SortedSpans:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """Add [a, b] unless it overlaps one that is there."""
        at = bisect_right(self.begins, b)
        if at and self.ends[at - 1] >= a:
            return False
        self.begins.insert(at, a)
        self.ends.insert(at, b)
        return True


class Scanner:
    """Templates, their bands by window class, and the scan of a text."""

    def __init__(self, templates: Mapping[str, str], bands: int = BANDS, rows: int = BAND_ROWS, contained: float = CONTAINED):
        self.bands, self.rows, self.contained = bands, rows, contained
        self.seeds = _seeds(bands * rows)
        self.names, self.sets, self.sizes = [], [], []
        by_class: dict[int, list[tuple[np.ndarray, int]]] = {c: [] for c in CLASSES}
        #: Templates of fewer words than a shingle has: by their number of words, names by hash.
        self.short: dict[int, dict[int, str]] = {}
        for name, text in sorted(templates.items()):
            w, _, _ = words(text)
            if not len(w):
                continue
            if len(w) < SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(int(shingles(w)[0]), name)
                continue
            k = len(self.names)
            self.names.append(name)
            self.sets.append(np.unique(shingles(w)))
            self.sizes.append(len(w))
            cut = [w] if len(w) <= self.holds(CLASSES[-1]) else [w[min(i, len(w) - PIECE) :][:PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
            for piece in cut:
                c = next(c for c in CLASSES if len(piece) <= self.holds(c))
                by_class[c].append((shingles(piece), k))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        minimal = []
        for c, pieces in by_class.items():
            if not pieces:
                continue
            keys, owners = [], []
            for s, k in pieces:
                mins = minhash(s, np.zeros(1, np.int64), len(s), self.seeds)
                keys.append(bands_of(mins, bands, rows)[0])
                owners.append(np.full(bands, k))
                minimal += [s[np.argmin(_mix(s * seed))] for seed in self.seeds]
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            self.tables[c] = keys[order], owners[order]
        self.minimal = np.unique(np.array(minimal, np.uint64))
        # A table by the first bits of the hash, of which few are set, so that most texts are done with one gather.
        bits = max(16, (128 * len(self.minimal)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.minimal >> self.shift).astype(np.int64)] = True

    @staticmethod
    def holds(window: int) -> int:
        """Words that some window of the class surely contains, wherever they stand."""
        return window - max(1, window // 8) + 1

    def candidates(self, s: np.ndarray) -> list[int]:
        """Templates that share a band with a window of a text's shingles."""
        found = s[self.seen[(s >> self.shift).astype(np.int64)]]
        if not len(found) or not among(found, self.minimal).any():
            return []
        out: set[int] = set()
        for c, (keys, owners) in self.tables.items():
            length, step = max(1, c - SHINGLE + 1), max(1, c // 8)
            starts = np.arange(0, max(1, len(s) - length + step), step)
            for at in range(0, len(starts), 4096):  # memory stays bounded for long texts
                part = starts[at : at + 4096]
                own = s[part[0] : part[-1] + length]
                got = bands_of(minhash(own, part - part[0], min(length, len(own)), self.seeds), self.bands, self.rows).ravel()
                lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    out.update(owners[a:b].tolist())
        return sorted(out)

    def stretches(self, s: np.ndarray, k: int) -> list[tuple[int, float, int, int]]:
        """(shingles found, containment, first shingle, last shingle) of each stretch that holds enough of template k."""
        own, span = self.sets[k], 2 * self.sizes[k]
        need = int(np.ceil(self.contained * len(own) - 1e-9))
        at = np.flatnonzero(among(s, own))
        which = np.searchsorted(own, s[at]).tolist()
        at = at.tolist()
        count, distinct, left, found = {}, 0, 0, []
        for right, (p, w) in enumerate(zip(at, which, strict=True)):
            count[w] = count.get(w, 0) + 1
            distinct += count[w] == 1
            while p - at[left] >= span or count[which[left]] > 1:  # as short as it can be
                count[which[left]] -= 1
                distinct -= count[which[left]] == 0
                left += 1
            if distinct >= need:
                found.append((distinct, at[left], p))
        return [(n, n / len(own), a, b) for n, a, b in found]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(name, containment, begin byte, end byte) of each match."""
        w, begin, end = words(text)
        if not len(w):
            return []
        s = shingles(w)
        run = min(SHINGLE, len(w))
        found = [(-n, -c, b - a, a, b, self.names[k]) for k in self.candidates(s) for n, c, a, b in self.stretches(s, k)]
        kept = SortedSpans()
        whole = [(name, -c, a, b + run) for _, c, _, a, b, name in sorted(found) if kept.add(a, b)]
        whole += self.short_matches(w, whole)
        return sorted(((name, c, int(begin[a]), int(end[b - 1])) for name, c, a, b in whole), key=lambda x: x[2])

    def short_matches(self, w: np.ndarray, others: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        """(name, 1.0, first word, word behind the last) of each short template outside the words of other matches."""
        out, taken = [], None
        for n, names in sorted(self.short.items(), reverse=True):
            if n > len(w):
                continue
            s = shingles(w, n)
            for a in np.flatnonzero(np.isin(s, np.array(list(names), np.uint64))).tolist():
                if taken is None:
                    taken = np.zeros(len(w), bool)
                    for _, _, x, y in others:
                        taken[x:y] = True
                if not taken[a : a + n].any():
                    taken[a : a + n] = True
                    out.append((names[int(s[a])], 1.0, a, a + n))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``matches`` (name, containment, begin, end in bytes of the text) of each row."""
    if sum(map(len, templates.values())) > TEMPLATE_BYTES:
        raise ValueError(f"more than {TEMPLATE_BYTES} characters of templates")
    # Made once; its size is bounded by that of the templates.
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates))

    def make():
        scanner = shared.value
        match = pa.list_(pa.struct([("name", pa.string()), ("containment", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"name": n, "containment": c, "begin": x, "end": y} for n, c, x, y in scanner.scan(t)] for t in b.column(1).to_pylist()]
            return pa.record_batch({"doc": b.column(0), "matches": pa.array(found, match)})

        return f

    out = map_arrow(docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).alias("text")), make, "doc long, matches array<struct<name:string,containment:double,begin:long,end:long>>")
    return out.withColumnRenamed("doc", id_col)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the licences found, their number, and where."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEMPLATES | whole_licenses())
    m = F.col("matches")
    spans = F.transform(m, lambda x: F.concat(x["name"], F.lit(":"), x["begin"], F.lit("-"), x["end"]))
    return found.select("doc_id", F.size(m).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(m["name"])), ",").alias("licenses"), F.coalesce(F.array_max(m["containment"]), F.lit(0.0)).alias("containment"), F.array_join(spans, " ").alias("spans"))
