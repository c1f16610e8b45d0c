"""Substring dedup over bytes by a common-prefix-aware distributed merge sort of suffixes.

The suffixes that are sorted start at anchors of windows that may repeat (see ``repeats``), so one
stands for all windows around it. Owners are ranges of the suffixes' order, cut by splitters from a sample. Each
task sorts its suffixes, cuts them at the splitters into one run for each owner, and front-codes the runs: the
length shared with the suffix before, then the rest. An owner merges its runs with a loser tree that carries, for
the head of each run, the prefix length shared with the last suffix put out; a comparison starts behind the
known prefix, and most need none. Splitters are as long as the suffixes' common prefixes, so no group of suffixes that
share one is cut. The merged order comes with its common prefixes, from which windows around equal anchors are compared:
to the right by the common prefixes, to the left by 64-bit hashes of the bytes before the anchor.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import join_one, shuffle_partitions

WINDOW, GRAM = 200, 32
#: Bytes of segments for each owner, about, and the most owners; with more bytes each gets more.
OWNER_BYTES, MOST_OWNERS = 12 << 20, 65_536
#: Sampled suffixes for each owner, about, from which its splitter is taken: two million in all, at most.
SAMPLES = 32
#: Bytes of segments that a task sorts together, about: a task of more sends several runs to an owner.
RUN_BYTES = 48 << 20


def _symbols(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(raw, np.uint8)
    return values.astype(np.uint64) + np.uint64(1), values


KIND = repeats.Kind(WINDOW, GRAM, _symbols, lambda raw: raw, lambda raw, mask: np.frombuffer(raw, np.uint8)[mask].tobytes(), 1)


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least start."""
    n = min(len(a), len(b))
    at = start
    while at < n:
        step = min(32, n - at)
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            return at + next(i for i in range(step) if x[i] != y[i])
        at += step
    return n


def front_code(run: list[bytes]) -> bytes:
    """Ascending strings as pairs of shared length and rest, each with 16-bit lengths."""
    out, last = [], b""
    for s in run:
        k = shared_prefix(last, s)
        out.append(k.to_bytes(2, "little") + (len(s) - k).to_bytes(2, "little") + s[k:])
        last = s
    return b"".join(out)


def front_decode(coded: bytes) -> tuple[list[bytes], list[int]]:
    """Strings of a front-coded run, and the length each shares with the one before."""
    out, shared, last, at = [], [], b"", 0
    while at < len(coded):
        k, n = int.from_bytes(coded[at : at + 2], "little"), int.from_bytes(coded[at + 2 : at + 4], "little")
        last = last[:k] + coded[at + 4 : at + 4 + n]
        out.append(last)
        shared.append(k)
        at += 4 + n
    return out, shared


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings, lengths shared with the string before) by a loser tree.

    Returns (run, place) in order, equal strings by run, and the length each shares with the one before it in the
    merged order.
    """
    k = max(1, len(runs))
    size = 1 << (k - 1).bit_length()
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    known = [0] * size  # of each head, the length shared with the last string put out
    places = [0] * size
    losers = [0] * size

    def first_wins(i: int, j: int) -> bool:
        """Whether head i comes before head j; the loser then knows what it shares with the winner."""
        a, b = heads[i], heads[j]
        if b is None:
            return True
        if a is None:
            return False
        if known[i] != known[j]:
            # Both are not below the last output: the one that shares more with it is smaller.
            return known[i] > known[j]
        h = shared_prefix(a, b, known[i])
        before = a[h:] <= b[h:] if h == len(a) or h == len(b) else a[h] < b[h]
        if a == b:
            before = i < j
        known[j if before else i] = h
        return before

    winner = list(range(size)) if size > 1 else [0]
    level = winner
    at = size // 2
    while at >= 1:
        nxt = []
        for x in range(at):
            i, j = level[2 * x], level[2 * x + 1]
            won = first_wins(i, j)
            nxt.append(i if won else j)
            losers[at + x] = j if won else i
        level, at = nxt, at // 2
    best = level[0]
    order, shared = [], []
    while heads[best] is not None:
        run, p = best, places[best]
        order.append((run, p))
        shared.append(known[run])
        p += 1
        places[run] = p
        strings, inner = runs[run]
        if p < len(strings):
            heads[run], known[run] = strings[p], inner[p]
        else:
            heads[run] = None
        node = (run + size) >> 1
        while node >= 1:
            other = losers[node]
            if not first_wins(best, other):
                losers[node], best = best, other
            node >>= 1
    return order, shared


def repeated_windows(right: list[bytes], shared: list[int], left: list[bytes], least: np.ndarray, most: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which windows around anchors occur more than once.

    right: ascending suffixes from each anchor, with the lengths shared by neighbours; left: the bytes before it; windows
    of entry i start least[i] to most[i] bytes before the anchor. Result: a row for each entry, a column for each such
    distance.
    """
    n, width = len(right), int(most.max()) + 1
    common = np.array(shared, np.int64)
    before = np.zeros((n, width), np.uint8)
    for i, s in enumerate(left):
        if s:
            before[i, 1 : len(s) + 1] = np.frombuffer(s, np.uint8)[::-1]
    marked = np.zeros((n, width), bool)
    hashes = np.zeros(n, np.uint64)
    for o in range(width):
        if o:
            hashes = (hashes + before[:, o].astype(np.uint64) + np.uint64(1)) * repeats.STEP
            hashes ^= hashes >> np.uint64(31)
        some = np.flatnonzero((least <= o) & (o <= most))
        if len(some) < 2:
            continue
        block = np.cumsum(common < window - o).astype(np.uint64)
        key = repeats.mixed(hashes[some] + block[some] * repeats.MIX)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        marked[some[order], o] = twice
    return marked


RUN_SQL = "owner int, coded binary, lefts binary, entries binary"
#: Numbers that go with each suffix: row, start of its first window, distance of the anchor from it, windows.
ENTRY = np.dtype([("row_id", "<i8"), ("start", "<i4"), ("anchor", "<i4"), ("windows", "<i4")])


def splitters(segments: DataFrame, prefix: int, owners: int) -> list[bytes]:
    """Up to owners - 1 prefixes that cut the suffixes of segments into ranges of about equal numbers."""
    rows = segments.count()
    drawn = F.pmod(F.xxhash64("row_id", "start", "anchor"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, owners * SAMPLES / max(1, rows)))
    sample = sorted(bytes(r[0]) for r in segments.where(drawn).select(F.expr(f"substring(values, anchor + 1, {prefix})")).collect())
    return sorted({sample[k * len(sample) // owners] for k in range(1, owners)}) if sample else []


def _sorted_runs(cuts: list[bytes]):
    """Segments -> for each task its sorted suffixes, as one front-coded run for each owner."""

    def coded(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        suffixes = [x[0] for x in held]
        rows = {"owner": [], "coded": [], "lefts": [], "entries": []}
        at, owner = 0, 0
        while at < len(held):
            owner = bisect.bisect_right(cuts, suffixes[at], lo=owner)
            end = bisect.bisect_left(suffixes, cuts[owner], lo=at) if owner < len(cuts) else len(held)
            rows["owner"].append(owner)
            rows["coded"].append(front_code(suffixes[at:end]))
            rows["lefts"].append(b"".join(x[1] for x in held[at:end]))
            rows["entries"].append(np.array([x[2:] for x in held[at:end]], ENTRY).tobytes())
            at = end
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("owner", pa.int32()), ("coded", pa.binary()), ("lefts", pa.binary()), ("entries", pa.binary())]))

    def run(batches):
        held, volume = [], 0
        for batch in batches:
            for values, *entry in zip(*(batch.column(c).to_pylist() for c in ("values", "row_id", "start", "anchor", "windows")), strict=True):
                anchor = entry[2]
                held.append((values[anchor:], values[:anchor], *entry))
                volume += len(values)
            if volume > RUN_BYTES:
                yield coded(held)
                held, volume = [], 0
        if held:
            yield coded(held)

    return run


def _marks(row, start, windows) -> pd.DataFrame:
    return pd.DataFrame({"row_id": np.asarray(row, np.int64), "start": np.asarray(start, np.int32), "windows": np.asarray(windows, np.int32)})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One owner: merge its runs and mark the repeated windows."""
    out, coded = [_marks([], [], [])], pdf
    runs = [front_decode(c) for c in coded["coded"]]
    entries = [np.frombuffer(e, ENTRY) for e in coded["entries"]]
    lefts = []
    for e, raw in zip(entries, coded["lefts"], strict=True):
        ends = np.cumsum(e["anchor"]).tolist()
        lefts.append([raw[b - a : b] for a, b in zip(e["anchor"].tolist(), ends, strict=True)])
    order, shared = merge_runs(runs)
    # Anchors that no other suffix shares are done.
    common = np.array(shared)
    grouped = common >= GRAM
    grouped |= np.concatenate([grouped[1:], [False]])
    keep = np.flatnonzero(grouped)
    for lo in range(0, len(keep), 200_000):
        # Cut between groups only.
        a = lo
        while a and a < len(keep) and common[keep[a]] >= GRAM:
            a += 1
        b = min(lo + 200_000, len(keep))
        while b < len(keep) and common[keep[b]] >= GRAM:
            b += 1
        part = keep[a:b]
        if not len(part):
            continue
        picked = [order[i] for i in part.tolist()]
        e = np.array([entries[r][p] for r, p in picked], ENTRY)
        most = e["anchor"].astype(np.int64)
        least = most - e["windows"] + 1
        found = repeated_windows([runs[r][0][p] for r, p in picked], [shared[i] for i in part.tolist()], [lefts[r][p] for r, p in picked], least, most)
        i, o = np.nonzero(found[:, ::-1])
        # Columns reversed: ascending starts within an entry.
        start = e["start"][i] + (most[i] - (found.shape[1] - 1 - o)).astype(np.int32)
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (start[1:] != start[:-1] + 1)]) if len(i) else np.empty(0, bool)
        at = np.flatnonzero(new)
        out.append(_marks(e["row_id"][i[at]], start[at], np.diff(np.concatenate([at, [len(i)]])) if len(i) else at))
    return pd.concat(out, ignore_index=True)


def _repeats(segments: DataFrame, prefix: int, least_owners: int) -> DataFrame:
    """Marks of the repeated windows of segments whose suffixes share ``prefix`` bytes if they belong together."""
    volume = segments.agg(F.sum(F.octet_length("values"))).first()[0] or 0
    owners = min(MOST_OWNERS, max(least_owners, volume // OWNER_BYTES + 1))
    runs = segments.mapInArrow(_sorted_runs(splitters(segments, prefix, owners)), RUN_SQL)
    return runs.groupBy("owner").applyInPandas(_merged, repeats.MARK_SQL)


def byte_dedup(docs: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Bytes of docs(doc_id, text) inside a run of WINDOW bytes that occurs elsewhere too: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes, a null text is empty. A byte goes when a run of WINDOW bytes of its
    text covers it that starts anywhere else as well, in any text or its own; all occurrences go.
    Runs are judged on the input and don't cross texts. n_spans: maximal removed stretches. Rows that repeat are texts of their own.
    Empty table: empty result. Other columns are ignored, whatever their names. group_rows: segments of one prefix
    beyond which it is lengthened.
    """
    rows, classes = repeats.describe(docs, KIND)
    found = repeats.suspects(docs, KIND, rows, classes)
    groups, windows, marks = repeats.grouped(KIND, found, mark_first=True, group_rows=group_rows)
    for prefix, segments in groups:
        marks = marks.unionByName(_repeats(segments, prefix, shuffle_partitions(docs)))
    if windows is not None:
        # Prefixes that are whole windows: equal suffixes, of which only the number is looked for.
        often = windows.groupBy("values").agg(F.count("*").alias("n")).where("n > 1").withColumn("often", F.lit(True))
        marks = marks.unionByName(join_one(windows, often, "values", "n", windows.count()).where("often").select("row_id", "start", "windows"))
    changed = repeats.removed(KIND, found, marks)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing. Fixed value.
    described = rows.select("row_id", "doc_id", "size", "key", "whole_sha256")
    all_rows = join_one(described, classes.where("copies > 1").select("key", "copies", F.lit(True).alias("copied")), "key", "copies", rows.count())
    copied = F.col("copied").isNotNull()
    return all_rows.join(changed, "row_id", "left").select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        F.when(copied, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
