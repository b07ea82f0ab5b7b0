"""Sharding by best-fit-decreasing bin packing.

A group is all documents of equal text, and is never divided. Groups enter by decreasing size the bin with
the least remaining capacity that holds them, found in a balanced tree. Groups of one size are alike, so the
packer works on the number of groups of each size, which is at most the square root of twice the bytes, and
hands out intervals of ranks; the groups find their bin by their rank among those of their size.

Defined cases: a null text has no bytes and is equal to an empty one; null and repeated ids are rows like any
other; with fewer groups than shards some shards are empty; a group larger than a fair share takes a shard of
its own, and the others share the rest equally; other columns are not read, and written as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged, width

SHARDS, ROW_BYTES = 40, 16


class Tree:
    """Keys in order, as a treap: the priorities are hashes of the keys."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _split(node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Keys below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], high = Tree._split(node[2], key)
            return node, high
        low, node[1] = Tree._split(node[1], key)
        return low, node

    @staticmethod
    def _join(low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[3] > high[3]:
            low[2] = Tree._join(low[2], high)
            return low
        high[1] = Tree._join(low, high[1])
        return high

    def add(self, key: tuple) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, None, None, zlib.crc32(repr(key).encode())]), high)

    def pop_at_least(self, key: tuple) -> tuple | None:
        """Take out the least key that is not below key."""
        low, high = self._split(self.root, key)
        found, parent = high, None
        while found is not None and found[1] is not None:
            parent, found = found, found[1]
        if found is not None:
            if parent is None:
                high = found[2]
            else:
                parent[1] = found[2]
        self.root = self._join(low, high)
        return found and found[0]


def pack_bins(sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit of (size, number of items), largest size first -> (size, bin, items); None if over most bins are needed.

    Items of one size that fit the same bin enter it together: the bin stays the tightest while they do.
    """
    tree, out, bins = Tree(), [], 0
    for size, number in sizes:
        if size > capacity:
            return None
        while number:
            at = tree.pop_at_least((size, -1))
            if at is None:
                if bins == most:
                    return None
                at, bins = (capacity, bins), bins + 1
            room, k = at
            n = min(number, room // size) if size else number
            out.append((size, k, n))
            number -= n
            tree.add((room - n * size, k))
    return out


def near_equal(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """The packing of the least capacity whose best fit needs no more than shards bins; larger groups apart."""
    rest, out, alone = sorted(sizes, reverse=True), [], 0
    total = sum(s * n for s, n in rest)
    while rest and alone < shards - 1 and rest[0][0] * (shards - alone) > total:
        size, number = rest[0]
        out.append((size, alone, 1))
        alone, total = alone + 1, total - size
        rest = [(size, number - 1), *rest[1:]] if number > 1 else rest[1:]
    if not rest:
        return out
    low, high = max(rest[0][0], -(-total // (shards - alone))), max(1, total)
    step = max(1, low // 1000)
    best = None
    while best is None:  # the least capacity is near the mean: look close to it first
        at = min(high, low + step)
        best = pack_bins(rest, at, shards - alone)
        low, high, step = (at + 1, high, step * 4) if best is None else (low, at, step)
    while low < high:
        middle = (low + high) // 2
        if found := pack_bins(rest, middle, shards - alone):
            best, high = found, middle
        else:
            low = middle + 1
    return out + [(s, k + alone, n) for s, k, n in best]


def _measures() -> list[Column]:
    """The size, checksum and hash of a text."""
    text = F.coalesce("text", F.lit(""))
    return [(F.octet_length(text) + ROW_BYTES).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("__same")]


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows (__same, __size) -> __same and __shard of each distinct text."""
    spark = rows.sparkSession
    cell = F.pmod(F.xxhash64("__same"), F.lit(width(spark))).cast("int")
    groups = staged(rows.groupBy("__same").agg(F.sum("__size").alias("bytes")).withColumn("cell", cell), "groups")
    cells = groups.groupBy("bytes", "cell").agg(F.count("*").alias("n"))
    found = near_equal([(r.bytes, r.n) for r in cells.groupBy("bytes").agg(F.sum("n").alias("n")).collect()], shards)
    # Ranks from 0 among the groups of a size: within a cell by their own order, after the cells before.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("__same")) - 1)
    ranked = ranked.join(cells.select("bytes", "cell", before.alias("before")), ["bytes", "cell"]).select("__same", "bytes", (F.col("rank") + F.col("before")).alias("rank"))
    intervals, at = [], {}
    for size, k, n in found:
        intervals.append((size, k, at.get(size, 0), at.get(size, 0) + n))
        at[size] = at.get(size, 0) + n
    dealt = spark.createDataFrame(intervals, "bytes long, __shard int, low long, high long")
    return ranked.join(dealt, "bytes").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("__same", "__shard")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null)."""
    spark = docs.sparkSession
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_measures()), "sizes")
    # Rows are told apart by a number too, so that many of one id and text do not meet in one part.
    part = F.pmod(F.xxhash64("doc_id", "__same", "number"), F.lit(width(spark))).cast("int").alias("part")
    out = staged(rows.join(placed(rows, shards), "__same").select("*", F.monotonically_increasing_id().alias("number")).select("*", part), "placed")
    # Slots the same way: by parts of a shard, so that no task sorts a whole one.
    parts = out.groupBy("__shard", "part").agg(F.count("*").alias("n"))
    skip = F.coalesce(F.sum("n").over(Window.partitionBy("__shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = out.withColumn("own", F.row_number().over(Window.partitionBy("__shard", "part").orderBy("doc_id", "__same")) - 1)
    slots = slots.join(parts.select("__shard", "part", skip.alias("skip")), ["__shard", "part"])
    return slots.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), (F.col("own") + F.col("skip")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> str:
    """Write docs, with all their columns, to a folder `__shard=k` for each shard; the name of the column that has k.

    It has more underscores before it where docs have a column of that name.
    """
    name = free_name(docs.columns, "__shard")
    where = placed(staged(docs.select(*_measures()).select("__same", "__size"), "sizes"), shards)
    rows = docs.select(F.struct("*").alias("row"), _measures()[-1]).join(where, "__same")
    rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("__shard").alias(name)).write.mode("overwrite").partitionBy(name).parquet(folder)
    return name
