"""MinHash near-dedup by HyperMinHash registers.

A document is the set of its distinct word shingles.  Each shingle is hashed once;
one part of the hash chooses one of ``REGISTERS`` buckets, and a bucket keeps only its
least hash, stored as the count of leading zeros and ``MANTISSA`` bits behind the first
one (16 bits in all).  ``BAND`` registers from all over the document make a band; in
bands an empty bucket stands for the first one in an order of its own that isn't, so the
bands of short texts are as selective as those of long ones.  Bands are as long as they
are because unrelated texts share their frequent shingles: what they share by chance
has to stay rare among very many documents.  Documents that share a band are
candidates.  A pair's Jaccard similarity is estimated from ``KEPT`` registers, less the
agreements that compressed registers have by chance, and what stays well below the
threshold goes no further; the others are verified on their full shingle sets.

How groups stay cheap, however large:

* Documents with equal shingle sets are one class; only its least id goes on.
* Buckets with the same members count once (near copies share many bands).
* In each bucket one member is the hub; every document is paired with the hub that it
  shares most buckets with (a star), so a group of near copies falls into one component
  at a pair a document.  Pairs are verified in groups around the hub, of ``CHUNK``
  members at most: each group gets the hub's text once and each member's text once.
* What stays open are buckets with members of several components.  Those that aren't in
  the bucket's largest component are compared with each other and with that component,
  in blocks of ``BLOCK`` members; members of the largest component are not compared with
  each other.  A block first estimates by registers, then compares sets (32 bits a
  shingle), and only pairs that may link two components become rows, which are verified
  like the others.
* As long as these comparisons would be more than ``CHEAP`` a membership, another round
  of stars with other hubs comes first (``TURNS`` at most), as a round costs one pair a
  document and takes what it links out of the comparisons.

Which of these a group meets changes the cost only; the links are the same.

A link of similarity 0.8 is missed if no band agrees, about (1 - 0.8^7)^64 = 3e-7.
Nothing is capped or dropped; components are found by joins, in tables written to
the shared folder at each step and removed at the end, and nothing grows on the driver.

Cases: a null or blank text has no shingles, is linked with nothing and keeps its
own id; fewer words than a shingle has are one shingle; repeated rows are one class;
rows of a repeated id with different texts are labelled each by its own text; a row
with a null id is kept, with a null component, and links nothing; an empty table gives
an empty result; other columns are not read; ids are whole numbers (another type is an
error).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_scope
from ..session import union
from .shared import GOLDEN, in_arrow, map_arrow, materialise, mix, powers, run_hashes, whole_id, word_shingles

BAND, BANDS, MANTISSA, ZERO_BITS = 7, 64, 10, 6
REGISTERS = BAND * BANDS
#: Registers that are kept for estimates.
KEPT = 128
#: Rounds of stars at most, and the comparisons a membership that end them.
TURNS, CHEAP = 8, 1024
#: Members of a bucket that are compared with another such block at a time.
BLOCK = 1024
#: Pairs around a hub that are verified together at most.
CHUNK = 256
#: Rows (48 bytes each) that are broadcast to fetch the texts they name at most; more are joined by a shuffle of the texts.
WANTED = 500_000
#: A pair goes to verification if its estimate is at most so many standard deviations below the threshold.
SIGMAS = 5.0

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_P = GOLDEN
_PIECE = 1 << 20
_mix, _powers = mix, powers


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    return run_hashes(raw, _SPACE)[0]


def text_words(text: str | None) -> np.ndarray:
    """The word hashes of a whole text, taken in pieces that end at a blank so that memory stays small."""
    raw = (text or "").encode().translate(_LOWER)
    if len(raw) <= _PIECE:
        return word_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        to = at + _PIECE
        while to < len(raw) and not _SPACE[raw[to]]:
            to += 1
        out.append(word_hashes(raw[at:to]))
        at = to
    return np.concatenate(out)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = text_words(text)
    if not len(w):
        return w
    return np.unique(word_shingles(w, size))


def registers(h: np.ndarray) -> np.ndarray:
    """HyperMinHash: for each bucket, leading zeros and mantissa of the least hash; 0 if it is empty."""
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64), _mix(h))
    used = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    # frexp gives the position of the first one; 53 bits of a double hold it and the mantissa.
    _, e = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - e, (1 << ZERO_BITS) - 2)
    body = least << (zeros + 1).astype(np.uint64) >> np.uint64(64 - MANTISSA)
    return np.where(used, ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA)) | body, 0).astype(np.uint16)


_AT = np.arange(REGISTERS)
#: Where an empty bucket looks in turn; it tries itself first.
_STEPS = (0, 8, 32, 96, 224, REGISTERS)
#: The registers of each band, from all over the document.
_DEALT = np.argsort(_mix(_AT.astype(np.uint64) + np.uint64(1))).reshape(BANDS, BAND)


@lru_cache(1)
def _probes() -> np.ndarray:
    """For each bucket an order of all buckets that begins with itself."""
    keys = _mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS)
    keys[_AT, _AT] = 0
    return np.argsort(keys, axis=1)


def sources(regs: np.ndarray) -> np.ndarray:
    """For each bucket the one that stands for it: the first that isn't empty in its order."""
    probes, full = _probes(), regs != 0
    out, left = np.zeros(REGISTERS, np.int64), _AT
    for a, b in zip(_STEPS, _STEPS[1:], strict=False):
        hit = full[probes[left, a:b]]
        first = hit.argmax(1)
        found = hit[np.arange(len(left)), first]
        out[left[found]] = probes[left[found], a + first[found]]
        left = left[~found]
        if not len(left):
            break
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a document's registers, not all of which are empty."""
    source = sources(regs)
    value = _mix(regs[source].astype(np.uint64) << np.uint64(16) | source.astype(np.uint64))[_DEALT]
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = _mix(key * np.uint64(_P) + value[:, k])
    return key


@lru_cache(4096)
def chance(n: int, m: int) -> float:
    """The expected number of equal registers of two disjoint sets of 2^(n/2) and 2^(m/2) members."""
    a, b = 2 ** (n / 2) / REGISTERS, 2 ** (m / 2) / REGISTERS
    i = np.arange(1, 40)[:, None]
    j = np.arange(1 << MANTISSA)[None, :]
    low = 2.0**-i + j * 2.0 ** -(i + MANTISSA)
    high = low + 2.0 ** -(i + MANTISSA)
    # The least of Poisson many hashes falls into a register's value.
    p = (np.exp(-a * low) - np.exp(-a * high)) * (np.exp(-b * low) - np.exp(-b * high))
    return float(KEPT * p.sum())


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``chance`` for pairs of set sizes."""
    size = lambda v: np.round(2 * np.log2(np.maximum(v, 1))).astype(np.int64)
    kinds, at = np.unique(size(n) << 8 | size(m), return_inverse=True)
    return np.array([chance(k >> 8, k & 255) for k in kinds.tolist()])[at]


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows, and the registers that each rests on."""
    used = ((x != 0) | (y != 0)).sum(1)
    equal = ((x == y) & (x != 0)).sum(1)
    expected = by_chance(n, m)
    rest = np.maximum(used - expected, 1)
    return np.clip((equal - expected) / rest, 0, 1), used


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """Whether the estimate of each pair leaves a link possible."""
    j, used = estimate(x, y, n, m)
    return j >= share - SIGMAS * np.sqrt(share * (1 - share) / np.maximum(used, 1))


def set_digest(h: np.ndarray) -> bytes | None:
    """A digest of a set of shingle hashes; none of the empty set."""
    import hashlib

    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def sketch(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc, n (set size), digest (of the set), regs (kept registers) and keys (of bands) of each row."""

    def make():
        def one(text: str | None) -> tuple:
            h = shingles(text, size)
            if not len(h):
                return 0, None, None, None
            regs = registers(h)
            return len(h), set_digest(h), regs[:KEPT].tobytes(), bands(regs).view(np.int64)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, regs, keys = zip(*map(one, b.column(1).to_pylist()), strict=True)
            return pa.record_batch({"doc": b.column(0), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "regs": pa.array(regs, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

        return f

    return map_arrow(docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).alias("text")), make, "doc long, n long, digest binary, regs binary, keys array<long>")


def band_members(sets: DataFrame) -> DataFrame:
    """rep and key of each bucket with several members; of buckets with the same members one."""
    keyed = sets.select("rep", F.xxhash64("digest").alias("h"), F.xxhash64("digest", F.lit(1)).alias("g"), F.explode("keys").alias("key"))
    # A class is in a bucket once, so equal members have equal sums (128 bits).
    full = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where("n > 1")
    once = full.groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key")
    return keyed.select("rep", "key").join(once, "key")


def likely(pairs: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """Of the pairs (a, b, ca, cb), those whose estimate does not rule a link out."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("na") >= share * F.col("nb") - 1e-9) & (F.col("nb") >= share * F.col("na") - 1e-9))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = lambda name: np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint16).reshape(-1, KEPT)
            keep = pa.array(may_link(rows("ra"), rows("rb"), b.column("na").to_numpy(), b.column("nb").to_numpy(), share))
            return pa.record_batch({x: b.column(x).filter(keep) for x in ("a", "b", "ca", "cb")})

        return f

    return map_arrow(joined.select("a", "b", "ca", "cb", "na", "nb", "ra", "rb"), make, "a long, b long, ca long, cb long", rows=4096)


def fetch(texts: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """texts joined with a table of reps; up to WANTED rows of it go to each executor, so that texts stay where they are."""
    return texts.join(F.broadcast(wanted) if wanted.count() <= WANTED else wanted, "rep", how)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, ca, cb; a table), those linked by their full shingle sets; texts has rep and text.

    Pairs come in groups around ``a``, of some CHUNK at most: a row with the text of a for
    each group, and a row with the text of b for each pair.  Texts are joined once.
    """
    # Only hubs of more than one group are listed, a CHUNK-th of the pairs at most.
    large = materialise(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("a", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("groups")), "large")
    told = pairs.join(large, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"), F.lit(0)))
    member = told.select(F.col("b").alias("rep"), "a", "part", F.lit(True).alias("member"), "ca", "cb")
    hub = told.select("a", "part").distinct().select(F.col("a").alias("rep"), "a", "part", F.lit(False).alias("member"), F.lit(None).cast("long").alias("ca"), F.lit(None).cast("long").alias("cb"))
    wanted = materialise(union(member, hub), "wanted")
    rows = fetch(texts, wanted).select("a", "part", "member", "rep", "ca", "cb", "text").repartition("a", "part").sortWithinPartitions("a", "part", "member", "rep")

    def run(batches):
        at, hubs = None, []  # of a repeated id several texts

        def linked(x: np.ndarray, y: np.ndarray) -> bool:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        for b in batches:
            out = []
            for a, part, is_member, rep, ca, cb, text in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (a, part) != at:
                    at, hubs = (a, part), []
                h = shingles(text, size)
                if not is_member:
                    hubs.append(h)
                elif any(linked(x, h) for x in hubs):
                    out.append((a, rep, ca, cb))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["a", "b", "ca", "cb"])

    return in_arrow(rows, run, "a long, b long, ca long, cb long")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node that it reaches) of each node of an edge (a, b).

    Alternating large-star and small-star steps: each ends as a table, their number
    grows with the logarithm of the longest chain.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = union(edges, edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Small star: smaller neighbours and the node itself go to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = union(large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), down.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return union(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")), edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        seen = state


def label(frame: DataFrame, comps: DataFrame, column: str, out: str) -> DataFrame:
    """frame with ``out``: the component of ``column``, or itself where it has none."""
    named = comps.select(F.col("node").alias(column), F.col("comp").alias("_c"))
    return frame.join(named, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")


def open_buckets(members: DataFrame) -> DataFrame:
    """The members (rep, key, comp) of buckets that hold several components.

    With ``minor`` (not in the bucket's largest component), and the numbers of members that are and are not (n_major, n_minor).
    """
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    stats = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("n_major"), (F.sum("n") - F.max("n")).alias("n_minor")).where("n_minor > 0")
    # As a table the few open keys are a plain side of the join, so a bucket with very many members is split.
    open_ = materialise(stats, "stats")
    return materialise(members.select("rep", "key", "comp").join(open_, "key").select("rep", "key", "comp", (F.col("comp") != F.col("major")).alias("minor"), "n_major", "n_minor"), "open")


def stars(members: DataFrame, turn: int) -> DataFrame:
    """A pair (a, b) for each member that isn't in the component of all its hubs: a is the one it shares most buckets with.

    The hub of a bucket is its least id in turn 0, then by a hash of id and turn; ca and
    cb are the components of a and b.
    """
    order = F.col("rep") if not turn else F.xxhash64("rep", F.lit(turn))
    hubs = members.groupBy("key").agg(F.min_by(F.struct("rep", "comp"), order).alias("h")).select("key", F.col("h.rep").alias("hub"), F.col("h.comp").alias("hub_comp"))
    met = members.select("rep", "comp", "key").join(materialise(hubs, "hubs"), "key").where(F.col("comp") != F.col("hub_comp"))
    shared = met.groupBy("rep", "comp", "hub", "hub_comp").agg(F.count("*").alias("n"))
    best = shared.groupBy("rep").agg(F.max_by(F.struct("hub", "hub_comp", "comp"), F.struct("n", -F.col("hub"))).alias("h"))
    return best.select(F.col("h.hub").alias("a"), F.col("rep").alias("b"), F.col("h.hub_comp").alias("ca"), F.col("h.comp").alias("cb"))


def short_sets(texts: DataFrame, size: int) -> DataFrame:
    """rep, set (the lowest 32 bits of each shingle hash), n (its shingles) and regs."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [shingles(t, size) for t in b.column(1).to_pylist()]
            return pa.record_batch({"rep": b.column(0), "set": pa.array([np.unique(h.astype(np.uint32)).tobytes() for h in hashes], pa.binary()), "n": pa.array(list(map(len, hashes)), pa.int64()), "regs": pa.array([registers(h)[:KEPT].tobytes() for h in hashes], pa.binary())})

        return f

    return map_arrow(texts.select("rep", "text"), make, "rep long, set binary, n long, regs binary")


def block_links(comp: np.ndarray, own: np.ndarray, sets: list[np.ndarray], cross: bool, percent: int, regs: np.ndarray | None = None, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Of the members of a block, pairs that link its components as far as their short sets tell.

    cross: only pairs with different ``own``.  With registers and sizes of the whole sets,
    pairs that their estimate rules out aren't compared.  Pairs that are surely linked are
    told as far as they join components; those at the threshold are told all.  Of u shingles
    about u * u / 2^33 fall together in 32 bits (a Poisson number, so six deviations and
    two more are allowed for, or one where the mean is below 1e-5): by as many the counts
    of a pair can be off.
    """
    m, share = len(sets), percent / 100
    n = np.array([len(x) for x in sets], np.int64)
    others: list[np.ndarray] = []
    for i in range(m):
        apart = comp[i + 1 :] != comp[i]
        if cross:
            apart &= own[i + 1 :] != own[i]
        j = i + 1 + np.flatnonzero(apart)
        if regs is not None and len(j):
            j = j[(sizes[j] >= share * sizes[i] - 1e-9) & (sizes[i] >= share * sizes[j] - 1e-9)]
            if len(j):
                j = j[may_link(regs[i][None], regs[j], np.full(len(j), sizes[i]), sizes[j], share)]
        others.append(j)
    if not any(map(len, others)):
        return []
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(m), n)
    more = np.bincount(at, minlength=len(values))[at] > 1  # what only one member has is in no intersection
    _, at = np.unique(at[more], return_inverse=True)
    who = who[more]
    both = [np.zeros(len(j), np.int64) for j in others]
    wide = max(64, (1 << 25) // m // 64 * 64)
    for low in range(0, int(at.max()) + 1 if len(at) else 0, wide):
        part = (at >= low) & (at < low + wide)
        has = np.zeros((m, min(wide, -(-(int(at.max()) + 1 - low) // 64) * 64)), bool)
        has[who[part], at[part] - low] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        for i, j in enumerate(others):
            if len(j):
                both[i] += np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
    sure, near = [], []
    for i, (j, shared) in enumerate(zip(others, both, strict=True)):
        rest = n[i] + n[j] - shared
        fall = rest.astype(np.float64) ** 2 / 2.0**33
        off = np.where(fall < 1e-5, 1, 2 + (fall + 6 * np.sqrt(fall)).astype(np.int64))
        close = 100 * (shared + off) >= percent * (rest - off)
        certain = close & (100 * (shared - off) >= percent * (rest + off))
        sure += [(i, k) for k in j[certain].tolist()]
        near += [(i, k) for k in j[close & ~certain].tolist()]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for i, j in sure:
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            root[a] = b
            out.append((i, j))
    return out + near


def between(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b, ca, cb) that may link the components of a bucket (see ``open_buckets``).

    Each block of members outside the largest component meets each other such block and
    each block of that component, so no task holds more than two blocks and no pair
    becomes a row unless it links.
    """
    wanted = materialise(members.select("rep").distinct(), "wanted")
    sets = materialise(short_sets(fetch(texts, wanted, "left_semi"), size), "sets")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(BLOCK))).cast("int")
    minors, majors = blocks("n_minor"), blocks("n_major")
    # Blocks outside the largest component have the numbers from 0, those of it the numbers behind.
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("rep"), minors)).otherwise(minors + F.pmod(F.xxhash64("rep"), majors)).cast("int")
    meets = F.when(F.col("minor"), F.sequence(F.lit(0), minors + majors - 1)).otherwise(F.sequence(F.lit(0), minors - 1))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(meets))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), (F.col("own") != F.col("other")).alias("cross"), "own", "rep", "comp")
    rows = dealt.join(sets, "rep").select("block", "cross", "own", "rep", "comp", "n", "regs", "set").repartition("block").sortWithinPartitions("block", "own", "rep")

    def run(batches):
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            cross, own, reps, comp, n, regs, sets = list(zip(*held, strict=True))[1:]
            pairs = block_links(np.array(comp), np.array(own), [np.frombuffer(x, np.uint32) for x in sets], any(cross), percent, np.frombuffer(b"".join(regs), np.uint16).reshape(-1, KEPT), np.array(n))
            ends = [(i, j) if reps[i] < reps[j] else (j, i) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array([x[e[k]] for e in ends], pa.int64()) for x in (reps, comp) for k in (0, 1)], ["a", "b", "ca", "cb"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if held and row[0] != held[0][0]:
                    yield found()
                    held = []
                held.append(row)
        if held:
            yield found()

    return in_arrow(rows, run, "a long, b long, ca long, cb long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept and class_id (the least id with the same shingle set) of each row."""
    result: list[DataFrame] = []
    with scratch_scope(lambda: result):
        result.append(materialise(_near_duplicates(docs, shingle_words, percent, id_col, text_col), "components"))
    return result[0]


def _near_duplicates(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    share = percent / 100
    sketches = materialise(sketch(docs, shingle_words, id_col, text_col), "sketches")
    some = sketches.where("doc is not null and n > 0")
    sets = materialise(some.groupBy("digest").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys")), "classes")
    reps = sets.drop("keys")
    members = materialise(band_members(sets).withColumn("comp", F.col("rep")), "bands")
    texts = docs.select(whole_id(docs, id_col).alias("rep"), F.col(text_col).alias("text"))
    classes = reps.select("digest", "rep").withColumn("component_id", F.col("rep"))

    def merge(pairs: DataFrame) -> DataFrame:
        """Join the components of linked pairs; returns the new component of each that was joined."""
        nonlocal classes
        links = verify(materialise(pairs, "pairs"), texts, shingle_words, percent)
        comps = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        classes = label(classes, comps, "component_id", "component_id")
        return comps

    # Stars around changing hubs join most of what belongs together at a pair a document ...
    for turn in range(TURNS):
        members = open_buckets(label(members, merge(likely(stars(members, turn), reps, share)), "comp", "comp"))
        n, work = members.agg(F.count("*"), F.sum(F.when(F.col("minor"), F.col("n_major") + F.col("n_minor")))).first()
        if (work or 0) <= CHEAP * n:
            break
    else:
        members = open_buckets(members)
    # ... so that what is left between components is compared in blocks.
    merge(between(members, texts, shingle_words, percent))

    named = some.select("doc", "n", "digest").join(classes, "digest").drop("digest")
    alone = sketches.where("doc is null or n = 0").select("doc", "n", F.col("doc").alias("rep"), F.col("doc").alias("component_id"))
    out = union(named.select("doc", "n", "rep", "component_id"), alone)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("rep").alias("class_id"))


def one_of_equals(rows: DataFrame, size: int, text_col: str) -> DataFrame:
    """The rows, all columns as they are, but of those with equal shingle sets one; what has no shingles stays."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    names, at = rows.columns, rows.columns.index(text_col)
    plain = rows.toDF(*[f"c{k}" for k in range(len(names))])
    plain_names = plain.columns
    schema = StructType([*plain.schema.fields, StructField("digest", BinaryType())])

    def make():
        return lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array([set_digest(shingles(t, size)) for t in b.column(at).to_pylist()], pa.binary())], [*plain_names, "digest"])

    told = map_arrow(plain, make, schema)
    order = F.struct(*[f"c{names.index(c)}" for c in (text_col, "lang", "source", "n_chars") if c in names])
    # Taken by partial aggregates, so many copies of one text don't meet in one task.
    once = told.where("digest is not null").groupBy("digest").agg(F.min_by(F.struct(*plain_names), order).alias("r")).select("r.*")
    return union(once, told.where("digest is null").drop("digest")).toDF(*names)


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, of the one document that stays of each component.

    Rows of one id stay or go together, but of those with equal text one stays.  Rows
    with a null id are compared by their shingle sets with each other only: of those with
    equal sets one stays, also where a row with an id is equal to it.

    Texts aren't moved where the ids that go and those that repeat are few enough to be
    broadcast (Spark's own threshold).
    """
    from pyspark.sql import Window

    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = lambda c: f"c{names.index(c)}"
    found = near_duplicates(docs, shingle_words, percent, id_col, text_col).where(F.col(id_col).isNotNull())
    told = materialise(found.groupBy(F.col(id_col).alias("id")).agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays"), "told")
    id_ = whole_id(plain, at(id_col))
    there = plain.where(F.col(at(id_col)).isNotNull())
    once = there.join(told, id_ == F.col("id"), "left_anti")
    # Equal hashes first, so that texts are compared with those that may be equal only.
    same = Window.partitionBy(at(id_col), F.xxhash64(at(text_col)), at(text_col)).orderBy(*[at(c) for c in ("lang", "source", "n_chars") if c in names] or [at(id_col)])
    repeated = there.join(told.where("stays"), id_ == F.col("id"), "left_semi").withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    return union(once, repeated, one_of_equals(docs.where(F.col(id_col).isNull()), shingle_words, text_col).toDF(*plain.columns)).toDF(*names)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2).drop("class_id")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.doc_id WHERE reach.c < e.b),
comp AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
