"""Shards of near-equal size: best-fit decreasing over indivisible groups.

Groups are rows with one key (here: one text). Groups larger than a fixed share of the total are
items of their own; there are at most ``1 / share`` of them. All others are gathered by hash into a
fixed number of bundles, which are items too. So the packing sees a bounded number of items
whatever the input, while no group is ever split. Slots inside a shard come from counts of cells
(an item, or a hash part of a large one), so no shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import cut, doc_order, text_or_empty

#: Bundles of small groups, and the most large groups: bounds of what the driver packs.
BUNDLES = 32_768
LARGE_GROUPS = 16_384
#: Cells that the slots are counted by, beside one for each item.
CELLS = 65_536


class RemainderTree:
    """AA tree of (remaining capacity, bin), for the tightest bin that still holds an item."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t[1] and t[1][3] == t[3]:
            left = t[1]
            t[1], left[2] = left[2], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[2] and t[2][2] and t[2][2][3] == t[3]:
            right = t[2]
            t[2], right[1] = right[1], t
            right[3] += 1
            return right
        return t

    def insert(self, key) -> None:
        def put(t):
            if t is None:
                return [key, None, None, 1]
            t[1 if key < t[0] else 2] = put(t[1 if key < t[0] else 2])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def level(t):
            return t[3] if t else 0

        def take(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[1] = take(t[1], key)
            elif key > t[0]:
                t[2] = take(t[2], key)
            elif t[1] is None:
                return t[2]
            else:
                before = t[1]
                while before[2]:
                    before = before[2]
                t[0] = before[0]
                t[1] = take(t[1], before[0])
            if level(t[1]) < t[3] - 1 or level(t[2]) < t[3] - 1:
                t[3] -= 1
                if level(t[2]) > t[3]:
                    t[2][3] = t[3]
                t = self._skew(t)
                if t[2]:
                    t[2] = self._skew(t[2])
                    if t[2][2]:
                        t[2][2] = self._skew(t[2][2])
                t = self._split(t)
                if t[2]:
                    t[2] = self._split(t[2])
            return t

        self.root = take(self.root, key)

    def tightest(self, size):
        """The smallest key whose remainder is at least size."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[1]
            else:
                t = t[2]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item: the fullest one that still holds it, else a new one.

    Items go by falling size, then position. None if some item is over capacity or more than
    ``most`` bins would be needed.
    """
    tree, bins, where = RemainderTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] > capacity:
            return None
        if best := tree.tightest(sizes[i]):
            tree.remove(best)
        else:
            if most is not None and bins >= most:
                return None
            best, bins = (capacity, bins), bins + 1
        tree.insert((best[0] - sizes[i], best[1]))
        where[i] = best[1]
    return where


def fill_shards(sizes: list[int], shards: int) -> list[int]:
    """The smallest capacity, by bisection, at which best-fit decreasing needs at most ``shards`` bins; the bins it then gives."""
    total, largest = sum(sizes), max(sizes, default=0)
    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    best = best_fit_decreasing(sizes, low, shards)
    if best is not None:
        return best
    while (best := best_fit_decreasing(sizes, high, shards)) is None:
        high *= 2
    while high - low > max(1, total // shards // 100_000):
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, shards)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    return best


def shard(rows: DataFrame, shards: int) -> DataFrame:
    """Shard and slot of rows(doc_id, size long >= 0, group string; more columns pass through).

    Rows of one group share a shard. Shard sizes are near equal, as far as groups allow. Slots run
    from 0 without gaps inside each shard. Rows may repeat; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(BUNDLES)).cast("string"))
    large = F.col("size") > F.lit((total["size"] or 0) // LARGE_GROUPS)
    groups = cut(groups.withColumn("large", large))
    found = (
        groups.groupBy(F.when(F.col("large"), F.concat(F.lit("g"), "group")).otherwise(bundle).alias("item"))
        .agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        .orderBy("item")
        .collect()  # at most BUNDLES + LARGE_GROUPS rows
    )
    where = fill_shards([r["size"] for r in found], shards)
    per_cell = max(1, -(-(total["n"] or 0) // CELLS))
    items = [(r["item"], where[i], -(-r["n"] // per_cell)) for i, r in enumerate(found)]
    items = spark.createDataFrame(items, "item string, shard int, parts long")
    names = groups.where("large").select("group", F.lit(True).alias("large"))  # at most LARGE_GROUPS rows
    placed = (
        rows.join(F.broadcast(names), "group", "left")
        .withColumn("item", F.when(F.col("large"), F.concat(F.lit("g"), "group")).otherwise(bundle))
        .join(F.broadcast(items), "item")
        .withColumn("cell", F.pmod(F.xxhash64("doc_id"), "parts"))
    )
    counts = placed.groupBy("shard", "item", "cell").agg(F.count("*").alias("n")).orderBy("shard", "item", "cell").collect()  # at most items + CELLS rows, up to chance
    starts, offset, last = [], 0, None
    for r in counts:
        offset = 0 if r["shard"] != last else offset
        starts.append((r["item"], r["cell"], offset))
        offset, last = offset + r["n"], r["shard"]
    starts = spark.createDataFrame(starts, "item string, cell long, start long")
    in_cell = Window.partitionBy("item", "cell").orderBy(doc_order("size", "group"))
    return (
        placed.join(F.broadcast(starts), ["item", "cell"])
        .withColumn("slot", F.col("start") + F.row_number().over(in_cell) - 1)
        .drop("item", "cell", "parts", "start", "large")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shards 0 to shards - 1 of near-equal bytes; equal texts stay together.

    Size: UTF-8 bytes of the text plus 1; a null text counts as empty, and so goes with empty ones. Texts count whole, however
    long. Rows that repeat are rows of their own. An empty table gives an empty result. Other columns are ignored.
    Columns: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law is not 'key').
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group"),
    )
    return shard(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
