"""Sharding by Hilbert order [native]: cut runs of a space-filling curve.

Several metadata columns are quantised to ``2**bits`` cells each, the cells are
numbered along a Hilbert curve, rows are sorted by that number, and the sorted
run is cut into shards of equal row counts.  Neighbours on the curve are
neighbours in every dimension, so each shard covers a small box and readers skip
shards on any of the dimensions (``shard_manifest`` and ``prune``).

A ``Grid`` has the bounds of the cells, in the order of the values: of a number,
quantiles; of a category, all its values if there are no more than cells, else values
that cut the rows evenly (from counts of each value, in tables).  A manifest tells for each
shard the least and greatest value and the set of cells of each dimension, as bits.

Rows of equal texts are a group: all of it takes the least place (of its categories) on
the curve and is sorted by a hash of the text, so only a cut between shards divides it.

Everything is DataFrame expressions.  The curve is a finite automaton over
(entry corner, direction), tabulated once on the driver (``2**d * d`` states), so
an index costs ``bits`` lookups in two constant arrays.

The global position of a row takes no single-task window: rows are range
partitioned by (index, text hash, id), numbered inside their partition, written
once (which fixes the sampled bounds), and shifted by the counts of the
partitions before, one tiny row each.

Cases: a null category lies in the first cell; null text has size 16 and CRC 0 and the lowest cell; a null id sorts
first; repeated rows are numbered one after the other; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import running_total
from .shared import materialise, prefix_sums


@lru_cache
def curve_table(dims: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """For state * 2**dims + cell: the digit of the index, and the next state.

    A state is (entry corner e, direction d) as e * dims + d; cell has one bit of
    each coordinate.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def rotl(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask

    def gray_inverse(g: int) -> int:
        x = 0
        while g:
            x ^= g
            g >>= 1
        return x

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def trailing_ones(i: int) -> int:
        n = 0
        while i & 1:
            n, i = n + 1, i >> 1
        return n

    def direction(i: int) -> int:
        return 0 if i == 0 else trailing_ones(i - 1 if i % 2 == 0 else i) % dims

    digits, following = [], []
    for e in range(size):
        for d in range(dims):
            for cell in range(size):
                w = gray_inverse(rotl(cell ^ e, dims - (d + 1) % dims))
                digits.append(w)
                following.append((e ^ rotl(entry(w), d + 1)) * dims + (d + direction(w) + 1) % dims)
    return tuple(digits), tuple(following)


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """The position on the curve of integer coordinates in [0, 2**bits)."""
    dims = len(coords)
    digits, following = curve_table(dims)
    digit, nxt = F.array(*map(F.lit, digits)), F.array(*map(F.lit, following))
    # One cell number a level, from the highest bit; each coordinate is used as often as there are bits.
    cells = F.array(*[sum((F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, c in enumerate(coords)), F.lit(0)) for b in reversed(range(bits))])
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))

    def step(acc: Column, cell: Column) -> Column:
        at = acc["s"] * F.lit(1 << dims) + cell
        return F.struct(F.get(nxt, at).alias("s"), (acc["h"] * F.lit(1 << dims) + F.get(digit, at)).cast("long").alias("h"))

    return F.aggregate(cells, start, step, lambda acc: acc["h"])


@dataclass(frozen=True)
class Grid:
    """The lower bounds of the cells of each dimension, in order."""

    bits: int
    bounds: Mapping[str, tuple]

    def index(self, name: str, value: Column) -> Column:
        """The number of the bound at or below a value; null and what lies below all is 0."""
        if not self.bounds[name]:
            return F.lit(0)
        below = F.size(F.filter(F.array(*map(F.lit, self.bounds[name])), lambda b: b <= value))
        return F.coalesce(F.greatest(below - 1, F.lit(0)), F.lit(0)).cast("int")

    def cell(self, name: str, value: Column) -> Column:
        """The bounds spread over all cells of the curve."""
        return F.floor(self.index(name, value) * F.lit((1 << self.bits) / max(1, len(self.bounds[name])))).cast("int")


def rank_bounds(df: DataFrame, c: str, cells: int, accuracy: int = 10_000) -> tuple:
    """For numbers: the least value and quantiles of the whole column (a sketch of bounded size)."""
    cuts = [i / cells for i in range(1, cells)]
    low, found = df.agg(F.min(c), F.percentile_approx(c, cuts, accuracy)).first()
    return () if low is None else tuple(sorted({low, *(found or [])}))


def value_bounds(df: DataFrame, c: str, cells: int) -> tuple:
    """For categories: all values, or of more than ``cells`` those at which a further share of the rows begins."""
    values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    few = values.select("value").limit(cells + 1).collect()
    if len(few) <= cells:
        return tuple(sorted(r[0] for r in few))
    summed = running_total(values, "value", "n", "before")
    total = summed.agg(F.sum("n")).first()[0]
    starts = summed.groupBy(F.floor(F.col("before") * F.lit(cells) / F.lit(total)).alias("cell")).agg(F.min("value").alias("value"))
    return tuple(sorted(r["value"] for r in starts.select("value").collect()))


def fit_grid(df: DataFrame, rank: tuple[str, ...], categories: tuple[str, ...], bits: int = 6) -> Grid:
    return Grid(bits, {c: rank_bounds(df, c, 1 << bits) for c in rank} | {c: value_bounds(df, c, 1 << bits) for c in categories})


def position(df: DataFrame, order: list[Column], partitions: int) -> tuple[DataFrame, int]:
    """df with ``pos``: its gapless position from 0 in ``order``; and the row count."""
    shift, mask = 33, (1 << 33) - 1
    laid = materialise(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", shift)
    counts = materialise(laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    before = prefix_sums(counts, "_part", "_n", "_before").select("_part", "_before")
    # One row a partition: broadcast is bounded by the number of partitions.
    out = laid.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("pos", F.col("_before") + F.col("_at").bitwiseAND(F.lit(mask))).drop("_part", "_before", "_at"), total


def cut_rows(pos: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position if shards are runs whose counts differ by one at most."""
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)  # the first `larger` shards have one row more
    if not small:
        return pos.cast("int"), F.lit(0).cast("long")
    shard = F.when(pos < edge, F.floor(pos / F.lit(small + 1))).otherwise(F.lit(larger) + F.floor((pos - edge) / F.lit(small)))
    slot = F.when(pos < edge, pos % F.lit(small + 1)).otherwise((pos - edge) % F.lit(small))
    return shard.cast("int"), slot.cast("long")


def measured(docs: DataFrame, columns: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32, the other columns, and a hash of the text."""
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    return docs.select(F.col(id_col), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"), F.xxhash64(text).alias("_text"), *[c for c in dict.fromkeys(columns) if c not in ("size", id_col)])


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 6, rank: tuple[str, ...] = ("size",), categories: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, grid: Grid | None = None) -> DataFrame:
    """id, size, text_crc32, the dimensions, hilbert, pos, shard and slot of each row.

    rank: numeric dimensions; ``size`` is the UTF-8 length of the text plus 16.
    categories: dimensions by value.  grid: cells that are known, else they are fitted.
    """
    narrow = measured(docs, (*rank, *categories), id_col, text_col)
    grid = grid or fit_grid(narrow, rank, categories, bits)
    place = hilbert_index([grid.cell(c, F.col(c)) for c in (*rank, *categories)], grid.bits)
    keyed = narrow.withColumn("hilbert", place)
    # Texts whose rows lie in several places, as a table: a plain side of a join, so that a text of very many rows is split.
    spread = keyed.groupBy("_text").agg(F.min("hilbert").alias("_least"), F.max("hilbert").alias("_most")).where("_least < _most").select("_text", "_least")
    keyed = keyed.join(materialise(spread, "spread"), "_text", "left").withColumn("hilbert", F.coalesce("_least", "hilbert")).drop("_least")
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, total = position(keyed, [F.col("hilbert"), F.col("_text"), F.col(id_col)], partitions)
    shard, slot = cut_rows(F.col("pos"), total, shards)
    return out.withColumn("shard", shard).withColumn("slot", slot).drop("_text")


def shard_manifest(sharded: DataFrame, dims: tuple[str, ...], grid: Grid | None = None) -> DataFrame:
    """What a reader needs to skip shards: the least and greatest value of each dimension.

    With the grid also ``cells_`` (a bit for each bound's cell that occurs) and ``bounds_``.
    """
    aggs = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    known = [c for c in dims if grid and grid.bounds.get(c)]
    aggs += [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), grid.index(c, F.col(c)))).alias(f"cells_{c}") for c in known]
    found = sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *aggs)
    return found.select("*", *[F.array(*map(F.lit, grid.bounds[c])).alias(f"bounds_{c}") for c in known])


def prune(manifest: DataFrame, **ranges: tuple) -> DataFrame:
    """The shards that can hold rows with every named dimension in [low, high]."""
    for c, (low, high) in ranges.items():
        manifest = manifest.where((F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high)))
        if f"cells_{c}" in manifest.columns:
            at = lambda v: F.greatest(F.size(F.filter(f"bounds_{c}", lambda b: b <= F.lit(v))) - 1, F.lit(0))  # noqa: B023, E731
            manifest = manifest.where(F.exists(F.sequence(at(low), at(high)), lambda k: F.call_function("getbit", F.col(f"cells_{c}"), k) == 1))  # noqa: B023
    return manifest.select("shard")


def write_shards(sharded: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents as one file a shard, in slot order (ids must be unique)."""
    place = sharded.select(id_col, "shard", "slot")
    n = place.agg(F.max("shard")).first()[0]
    docs.join(place, id_col).repartition((n or 0) + 1, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = hilbert_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
