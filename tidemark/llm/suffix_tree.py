"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes that may repeat are split by a prefix: the words of their window's anchor, and for frequent ones longer
prefixes, up to the whole window (see ``repeats``). The suffixes of a group of prefixes fit into
memory. Their tree is held as the sorted suffixes with the prefix lengths that neighbours share: its internal nodes are
the intervals of neighbours that share at least the node's depth. Suffixes are sorted by doubling: the rank at
depth 1, 2, 4, 8 and 16, each made from pairs of the one before. A node of depth WINDOW or more is a repeat; all its
leaves but the earliest are removed, and consecutive ones of a text make up a maximal repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import join_one

WINDOW = 20
#: Segments whose subtrees are built together.
GROUP = 100_000


def _symbols(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh64_intdigest

    h = np.array([xxh64_intdigest(w) for w in raw.split()], np.uint64)
    return h, (h >> np.uint64(32)).astype(np.uint32)


def _kept(raw: bytes, mask: np.ndarray) -> bytes:
    words = raw.split()
    return b" ".join([words[i] for i in np.flatnonzero(mask).tolist()])


KIND = repeats.Kind(WINDOW, 5, _symbols, lambda raw: b" ".join(raw.split()), _kept, 4)


def subtree(values: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of values at ``starts``, to ``depth`` values each: their order, and what each shares with the one before it.

    Equal suffixes keep the order of starts. Each start must have ``depth`` values behind it.
    """
    levels = [np.unique(values, return_inverse=True)[1].astype(np.int64)]
    while 2 << (len(levels) - 1) <= depth and len(levels[-1]) > 1 << (len(levels) - 1):
        width = 1 << (len(levels) - 1)
        level = levels[-1]
        levels.append(np.unique(level[:-width] << np.int64(32) | level[width:], return_inverse=True)[1].astype(np.int64))
    # The rank to the depth: the longest power, then what is left.
    rank, done = np.zeros(len(starts), np.int64), 0
    for k in range(len(levels) - 1, -1, -1):
        if depth - done >= 1 << k:
            rank = np.unique(rank << np.int64(32) | levels[k][starts + done], return_inverse=True)[1].astype(np.int64)
            done += 1 << k
    order = np.argsort(rank, kind="stable")
    before, after = starts[order[:-1]], starts[order[1:]]
    shared = np.zeros(len(before), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(shared + (1 << k) <= depth)
        same = levels[k][before[fits] + shared[fits]] == levels[k][after[fits] + shared[fits]]
        shared[fits[same]] += 1 << k
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), shared])


def deep_nodes(shared: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each sorted suffix, the number of the internal node of at least that depth over it; neighbours share a node if they share so much."""
    return np.cumsum(shared < depth)


def later_windows(table: pa.Table) -> pa.RecordBatch:
    """Segments of whole groups -> runs of windows that also start earlier."""
    lengths = table.column("windows").to_numpy().astype(np.int64)
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint32)
    sizes = lengths + WINDOW - 1
    begin = np.cumsum(sizes) - sizes
    segment = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sorted_, shared = subtree(values, begin[segment] + inside)
    node = np.empty(len(segment), np.int64)
    node[sorted_] = deep_nodes(shared)
    rank, row, start = (table.column(c).to_numpy().astype(np.int64)[segment] for c in ("rank", "row_id", "start"))
    start = start + inside
    order = np.lexsort((start, row, rank, node))
    later = np.empty(len(order), bool)
    later[order] = np.concatenate([[False], node[order][1:] == node[order][:-1]])
    return _runs(row, start, segment, later)


def _runs(row: np.ndarray, start: np.ndarray, segment: np.ndarray, marked: np.ndarray) -> pa.RecordBatch:
    """Marked windows, consecutive ones of a segment together."""
    row, start, segment = row[marked], start[marked], segment[marked]
    new = np.concatenate([[True], (segment[1:] != segment[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.empty(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(row)]])) if len(row) else at
    return pa.RecordBatch.from_arrays([pa.array(row[at], pa.int64()), pa.array(start[at].astype(np.int32)), pa.array(counts.astype(np.int32))], names=["row_id", "start", "windows"])


def _kernel(batches):
    """Segments sorted by group -> marks."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < GROUP:
            continue
        grams = held.column("gram").to_numpy()
        done = np.flatnonzero(grams != grams[-1])
        if len(done):
            yield later_windows(held.slice(0, int(done[-1]) + 1))
            held = held.slice(int(done[-1]) + 1)
    if held is not None and held.num_rows:
        yield later_windows(held)


def substring_dedup(docs: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Words of docs(doc_id, text) that repeat an earlier run of WINDOW words: doc_id, n_words, n_removed, kept_sha256.

    A word goes when a window of WINDOW consecutive words covers it whose words also start earlier:
    at a smaller doc_id, or before in the same text. Rows without doc_id come last, rows of one doc_id in
    an order of the run's own. Windows are judged on the input. A null text has no words; shorter
    texts lose none. Windows are compared by 32 bits of each word's hash and 64 of the anchor's. Empty
    table: empty result. Other columns are ignored, whatever their names. group_rows: segments of one prefix
    beyond which it is lengthened.
    """
    rows, classes = repeats.describe(docs, KIND)
    found = repeats.suspects(docs, KIND, rows, classes)
    groups, windows, marks = repeats.grouped(KIND, found, mark_first=False, group_rows=group_rows)
    for _, segments in groups:
        marks = marks.unionByName(segments.repartition("gram").sortWithinPartitions("gram").mapInArrow(_kernel, repeats.MARK_SQL))
    if windows is not None:
        # Nodes that are one window each: only their earliest leaf is looked for.
        place = F.struct("rank", "row_id", "start")
        nodes = windows.groupBy("values").agg(F.min(place).alias("earliest"), F.count("*").alias("n"))
        marks = marks.unionByName(join_one(windows, nodes, "values", "n", windows.count()).where(place > F.col("earliest")).select("row_id", "start", "windows"))
    changed = repeats.removed(KIND, found, marks)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing. Fixed value.
    described = rows.select("row_id", "doc_id", "size", "key", "whole_sha256")
    whole = join_one(described, classes, "key", "copies", rows.count()).withColumn("copy", F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row_id")))
    return whole.join(changed, "row_id", "left").select(
        "doc_id",
        F.col("size").alias("n_words"),
        F.when(F.col("copy"), F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
