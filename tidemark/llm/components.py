"""Connected components by contraction inside tasks and alternating stars, without collecting links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Links that one task contracts (16 bytes each).
TASK_LINKS = 2_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def least_of_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end of links (a, b) that is not the least of its component, that end and the least."""
    ends, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    least = np.arange(len(ends))
    while (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        for at in (least[x], least[y]):
            np.minimum.at(least, at, low)
        while (least[least] != least).any():
            least = least[least]
    other = least != np.arange(len(ends))
    return ends[other], ends[least[other]]


def _contracted(batches):
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    a, b = (np.concatenate([np.empty(0, np.int64), *[h[i] for h in held]]) for i in (0, 1))
    member, root = least_of_components(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(root)], names=["a", "b"])


def components(edges: DataFrame, most: int, task_links: int = TASK_LINKS) -> DataFrame:
    """edges(a long, b long) -> (member, root): for each end of an edge that is not the least of its component, that least one.

    Each task first contracts the links it gets, however they are dealt, to one for each end. If one task is enough
    for all, that is the result; else stars of least neighbours go on until nothing changes. most: about how many links
    there are at most, for the number of files.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct(), most)
    while True:
        count = edges.count()
        parts = -(-count // task_links) or 1
        after = cut(edges.repartition(parts).mapInArrow(_contracted, "a long, b long"))
        if parts == 1:
            return after.select(F.col("a").alias("member"), F.col("b").alias("root"))
        fewer = after.count()
        edges = after
        if -(-fewer // task_links) == parts:
            break
    last = None
    while True:
        edges = cut(_small_star(_large_star(edges)), most)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == last:
            return edges.select(F.col("a").alias("member"), F.col("b").alias("root"))
        last = now
