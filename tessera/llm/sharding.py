"""Minimax contiguous sharding with DataFrame operations only.

Equal texts form atomic groups, ordered by the SHA-256 of the text. A distributed prefix sum gives each group its end
in bytes and rows. The smallest shard capacity is found by binary search: a capacity is feasible if cutting greedily,
each shard as full as it may be, needs no more shards than there are. The greedy check needs only the prefix sums next
to a cut, so the driver holds a bounded index of them: each round reads at most ``index_rows`` of them from the ranges
where cuts can still fall, until the cuts are exact.

Defined results: a null text weighs its row's constant alone, has the crc32 of no bytes and is a group of its own,
apart from empty texts; repeated rows are separate rows of one group; an empty table gives an empty result; shards may
stay empty when there are fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


class PrefixIndex:
    """Some of the ordered groups' prefix sums, with the number of groups up to each."""

    def __init__(self) -> None:
        self.ends, self.ranks = [0], [0]

    def merge(self, rows: list[tuple[int, int]]) -> None:
        known = dict(zip(self.ends, self.ranks)) | dict(rows)
        self.ends = sorted(known)
        self.ranks = [known[e] for e in self.ends]

    def below(self, x: int) -> tuple[int, bool]:
        """The largest known end up to ``x``, and whether no unknown one can lie between."""
        i = bisect_right(self.ends, x) - 1
        exact = i + 1 == len(self.ends) or self.ranks[i + 1] == self.ranks[i] + 1
        return self.ends[i], exact or self.ends[i] == x

    def cuts(self, capacity: int, shards: int, total: int, sure: bool) -> list[int]:
        """Ends of the shards when each is filled greedily; not ``sure``: as far as unknown ends could allow."""
        made, at = [], 0
        for _ in range(shards):
            x = min(at + capacity, total)
            end, exact = self.below(x)
            at = end if sure or exact else x
            made.append(at)
        return made

    def smallest(self, low: int, high: int, shards: int, total: int, sure: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, total, sure)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


def prefix_sums(groups: DataFrame, block_bits: int = 12) -> DataFrame:
    """``groups`` (key hex string, bytes, n) with ends of running sums by key: end_bytes, end_rows, rank.

    Blocks are ranges of the uniformly spread key. Sums of the blocks (at most 2 ** block_bits rows) are accumulated
    in one small window, sums inside a block in a window per block.
    """
    digits = block_bits // 4
    inner = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = groups.withColumn("block", F.substring("key", 1, digits))
    sums = blocked.groupBy("block").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"), F.count("*").alias("g"))
    base = sums.select("block", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"base_{c}") for c in "brg"])
    local = blocked.select("key", "bytes", "n", "block", F.sum("bytes").over(inner).alias("b"), F.sum("n").over(inner).alias("r"), F.row_number().over(inner).alias("g"))
    joined = local.join(F.broadcast(base), "block")
    return joined.select("key", "bytes", "n", *[(F.col(c) + F.col(f"base_{c}")).alias(to) for c, to in (("b", "end_bytes"), ("r", "end_rows"), ("g", "rank"))])


def minimax_cuts(sums: DataFrame, shards: int, index_rows: int = 16_384) -> list[int]:
    """Ends in bytes of the shards under the smallest feasible capacity; ``sums`` must be cheap to read again."""
    total, largest = sums.agg(F.max("end_bytes"), F.max("bytes")).first()
    if total is None:
        return [0] * shards
    index, windows = PrefixIndex(), [(0, total)]
    low, high = max(largest, -(-total // shards)), total
    index.merge([(total, sums.agg(F.max("rank")).first()[0])])
    while True:
        width = max(1, sum(b - a for a, b in windows) // index_rows)
        inside: Column = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("end_bytes").between(a, b)
        rows = sums.filter(inside).groupBy(F.floor(F.col("end_bytes") / width)).agg(F.max("end_bytes"), F.max("rank"), F.min("end_bytes"), F.min("rank")).collect()
        index.merge([p for r in rows for p in ((r[1], r[2]), (r[3], r[4]))])
        # the first end beyond each window tells that the last one known inside it is its last
        beyond = sums.agg(*[F.min(F.when(F.col("end_bytes") > b, F.struct("end_bytes", "rank"))).alias(f"w{i}") for i, (_, b) in enumerate(windows)]).first()
        index.merge([(x[0], x[1]) for x in beyond if x is not None])
        low, high = index.smallest(low, high, shards, total, False), index.smallest(low, high, shards, total, True)
        early, late = index.cuts(low, shards, total, True), index.cuts(high, shards, total, False)
        if low == high and index.cuts(high, shards, total, True) == late:
            return late
        windows = [(a, b) for a, b in zip(early, late) if a < b]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 8, salts: int = 64) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row. A group of copies is ranked in salted parts."""
    data = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(row_bytes)).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.sha2(data, 256), F.lit("0" * 64 + "-")).alias("key"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
    )
    rows = cut(rows)
    parts = rows.groupBy("key", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    sums = cut(prefix_sums(parts.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))))
    ends = minimax_cuts(sums, shards)
    firsts = {e: k for k, e in reversed(list(enumerate(ends)))}  # the first shard that ends there
    number: Column = F.lit(shards - 1)
    for e, k in sorted(firsts.items(), reverse=True):
        number = F.when(F.col("end_bytes") <= e, F.lit(k)).otherwise(number)
    placed = sums.select("key", number.cast("int").alias("shard"), (F.col("end_rows") - F.col("n")).alias("before"))
    starts = placed.groupBy("shard").agg(F.min("before").alias("first"))  # one row a shard
    placed = placed.join(F.broadcast(starts), "shard").select("key", "shard", (F.col("before") - F.col("first")).alias("slot0"))
    earlier = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("key", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_salt")).join(placed, "key")
    within = Window.partitionBy("key", "salt").orderBy(id_col)
    ranked = rows.withColumn("r", F.row_number().over(within))
    return ranked.join(offsets, ["key", "salt"]).select(id_col, "size", "text_crc32", "shard", (F.col("slot0") + F.col("before_salt") + F.col("r") - 1).alias("slot"))
