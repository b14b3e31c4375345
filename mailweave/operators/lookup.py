"""Rows of a wide table by key, in one scan and without moving them.

A look-up of pages by URL must not shuffle their HTML. Few keys are broadcast. For many, a Bloom filter over the
keys is tested in the scan. It lets some other rows pass; which ones is known in advance, since the table's key column
can be read by itself. They make a second filter, the keys that pass this one by mistake a third, and so on: each is a
hundred times smaller than the one two before, and the last is a short list. Such a cascade is exact for every row of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Keys that are broadcast as they are, some 20 MB
FEW = 200_000
#: Bits and hash functions for each key: about one row in a hundred passes by mistake
BITS_PER_KEY, HASHES = 10, 6
#: A filter has at most so many bits (32 MB, for 26 million keys); more keys go in several scans
MOST_BITS = 1 << 28
#: A cascade ends with a list of at most so many keys
LISTED = 64
_KEY = "_lookup_key"


@dataclass(frozen=True)
class Bloom:
    """Bits as one array of longs, in a one-row DataFrame; a power of two of them."""

    bits: DataFrame
    size: int

    def holds(self, key: Column) -> Column:
        """Never false for a key of the filter. The bits are a scalar subquery: evaluated once, sent with the tasks."""
        array, out = self.bits.scalar(), None
        for p in _positions(key, self.size):
            is_set = F.getbit(F.get(array, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = is_set if out is None else out & is_set
        return out


def _positions(key: Column, size: int) -> list[Column]:
    """Places of a key's bits, from two halves of its hash."""
    first = F.xxhash64(F.lit(1), key).bitwiseAND(F.lit(0x7FFFFFFF))
    second = F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 33)
    return [(first + second * i).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)]


def bloom(keys: DataFrame, n: int) -> Bloom:
    """A filter over the column ``_lookup_key`` of ``n`` rows; its words are put together by an aggregate."""
    size = min(1 << max(10, (n * BITS_PER_KEY - 1).bit_length()), MOST_BITS)
    spark = keys.sparkSession
    places = keys.select(F.explode(F.array(*_positions(F.col(_KEY), size))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = places.groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = spark.range(size >> 6).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    # one array of bounded length, whatever the number of keys
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda w: w["bits"])
    return Bloom(cut_lineage(every.agg(in_order.alias("bits"))), size)


def rows_among(table: DataFrame, keys: DataFrame, column: str, few: int = FEW) -> DataFrame:
    """The rows of ``table`` whose ``column`` is among ``keys`` (a DataFrame with a column of that name).

    The distinct keys are written down and counted. Up to ``few`` they are broadcast; beyond that a cascade of filters
    decides, made from the table's key column alone. Either way the table's other columns are read once and go through
    no exchange. Null keys match nothing.
    """
    keys = cut_lineage(keys.select(F.col(column).alias(_KEY)).filter(F.col(_KEY).isNotNull()).distinct())
    n = keys.count()
    if n <= few:
        return table.join(F.broadcast(keys.withColumnRenamed(_KEY, column)), column, "left_semi").select(*table.columns)
    blocks = -(-n * BITS_PER_KEY // MOST_BITS)
    out = None
    for block in range(blocks):
        some = keys if blocks == 1 else keys.filter(F.pmod(F.xxhash64(_KEY), F.lit(blocks)) == block)
        found = table.filter(_cascade(table.select(F.col(column).alias(_KEY)), some, F.col(column)))
        out = found if out is None else out.unionByName(found)
    return out


def _cascade(universe: DataFrame, keys: DataFrame, column: Column) -> Column:
    """A predicate that is exact for all values of ``universe``: ``column`` is among ``keys``."""
    universe = cut_lineage(universe.filter(F.col(_KEY).isNotNull()).distinct())
    inside = cut_lineage(universe.join(keys, _KEY, "left_semi"))
    outside = universe.join(inside, _KEY, "left_anti")
    filters: list[Bloom] = []
    left = inside.count()
    while left > LISTED:
        filters.append(bloom(inside, left))
        # what passes by mistake is to be kept out by the next filter, which may be wrong about what is inside
        wrong = cut_lineage(outside.filter(filters[-1].holds(F.col(_KEY))))
        inside, outside = wrong, inside
        left = inside.count()
    listed = inside.agg(F.collect_set(_KEY).alias("keys")).scalar()
    decided = F.array_contains(listed, column)
    for level in reversed(filters):
        decided = level.holds(column) & ~decided
    return decided
