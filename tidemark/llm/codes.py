"""Product quantisation of vectors by Lloyd's algorithm with Yinyang bounds, on integers.

Components become integers, vectors are cut into parts, and each part position has a codebook. The entries of a codebook
are clustered into groups once. Every part of a vector keeps its entry and, for each group, a lower bound on the distance to the group's
other entries. After a codebook has moved, a group's bound falls by the farthest that one of its entries went; only
groups whose bound doesn't exceed the distance to the own entry are scanned. Distances are exact integers and bounds are rounded
down, so a tie is always scanned and goes to the lower index.

A round is one pass over the vectors, which writes entries and bounds beside them, and a second over what it wrote, which sums the parts
of each entry. The driver holds codebooks and their sums only: parts x entries x components numbers.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_table, join_one

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Groups of a codebook's entries, at most.
GROUPS = 16
#: Rows that a task works on at once.
ROWS = 4096


def largest(width: int) -> int:
    """Largest size of an integer component for which squared distances of ``width`` components stay below 2**62."""
    return isqrt(2**62 // max(1, width)) // 2


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x from each row of c, as int64; by floats where these are exact."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if most * most * x.shape[1] < 2**52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - c[None, :, k]) ** 2
    return out


def groups_of(c: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """A group for each entry of a codebook: a few rounds of Lloyd's algorithm from entries far from each other."""
    k = min(most, len(c))
    seeds, far = [0], distances(c, c[:1])[:, 0]
    while len(seeds) < k:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, distances(c, c[seeds[-1:]])[:, 0])
    centers = c[seeds]
    for _ in range(5):
        own = distances(c, centers).argmin(axis=1)
        centers = np.stack([c[own == g].mean(axis=0).astype(np.int64) if (own == g).any() else centers[g] for g in range(k)])
    return distances(c, centers).argmin(axis=1)


def _below(x: np.ndarray) -> np.ndarray:
    """x as 16-bit floats that are not larger."""
    small = np.minimum(x, 65504.0).astype(np.float16)
    return np.where(small.astype(np.float64) > x, np.nextafter(small, np.float16(-np.inf)), small)


def first_scan(x: np.ndarray, c: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x: nearest entry (the lower index on ties), its squared distance, and the least distance to each group's other entries."""
    d = distances(x, c)
    rows = np.arange(len(x))
    own = d.argmin(axis=1)
    error = d[rows, own]
    d[rows, own] = np.iinfo(np.int64).max
    lows = np.stack([d[:, group == g].min(axis=1, initial=np.iinfo(np.int64).max) for g in range(groups)], axis=1)
    return own, error, np.sqrt(lows.astype(np.float64))


def bounded_scan(x: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray, own: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``first_scan``, from the entries and bounds before the codebook moved; drift: how far each group's entries went at most.

    Also returns how many distances were computed.
    """
    lows = lows - drift
    start, rows = own, np.arange(len(x))
    moved = x - c[start]
    error = (moved * moved).sum(axis=1)
    at_start = np.sqrt(error.astype(np.float64)) * (1 + 1e-12)
    best, own = error.copy(), start.copy()
    scans, scanned = [], len(x)
    top = np.iinfo(np.int64).max
    for g in range(lows.shape[1]):
        members = np.flatnonzero(group == g)
        need = np.flatnonzero(lows[:, g] <= at_start)
        if not len(need) or not len(members):
            continue
        d = distances(x[need], c[members])
        scanned += d.size
        r = np.arange(len(need))
        place = d.argmin(axis=1)
        least = d[r, place]
        d[r, place] = top
        second = d.min(axis=1)
        index = members[place]
        scans.append((g, need, index, least, second))
        better = (least < best[need]) | ((least == best[need]) & (index < own[need]))
        best[need[better]], own[need[better]] = least[better], index[better]
    # The entry left behind is now one of its group's others.
    gone = np.flatnonzero(own != start)
    held = group[start[gone]]
    lows[gone, held] = np.minimum(lows[gone, held], np.sqrt(error[gone].astype(np.float64)))
    for g, need, index, least, second in scans:
        lows[need, g] = np.sqrt(np.where(own[need] == index, second, least).astype(np.float64))
    return own, best, lows, scanned


def finite(vector: Column) -> Column:
    """Whether a vector has components and none is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def _integers(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of components -> integers, PARTS * width a row, filled up with zeros."""
    most = largest(width)
    x = np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)
    return np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1])))


def _coded(size: int, width: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column("vector").flatten().to_numpy().reshape(-1, size), width)
                kind = np.int16 if np.abs(x).max() < 2**15 else np.int64
                raw = [r.tobytes() for r in x.astype(kind)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), pa.array(raw, pa.binary())], names=["vec_id", "label_key", "parts"])

    return run


def _parts(column, width: int) -> np.ndarray:
    """(rows, PARTS, width) from binaries of 2 or 8 bytes a component."""
    raw = column.to_pylist()
    narrow = PARTS * width * 2
    if all(len(r) == narrow for r in raw):
        return np.frombuffer(b"".join(raw), np.int16).astype(np.int64).reshape(-1, PARTS, width)
    return np.stack([np.frombuffer(r, np.int16 if len(r) == narrow else np.int64).astype(np.int64) for r in raw]).reshape(-1, PARTS, width)


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _assigned(books: np.ndarray, groups: np.ndarray, drift: np.ndarray | None, state: bool):
    """A pass over the vectors: with drift None all entries are looked at; with state entries and bounds come out, else codes and errors."""
    n_groups, width = int(groups.max()) + 1, books.shape[2]

    def run(batches):
        for batch in _pieces(batches):
            x, n = _parts(batch.column("parts"), width), batch.num_rows
            if not n:
                continue
            if drift is not None:
                old = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
                bounds = np.frombuffer(b"".join(batch.column("lows").to_pylist()), np.float16).reshape(n, PARTS, n_groups).astype(np.float64)
            own, lows, error = np.empty((n, PARTS), np.int64), np.empty((n, PARTS, n_groups)), np.zeros(n, np.int64)
            for p in range(PARTS):
                if drift is None:
                    own[:, p], e, lows[:, p] = first_scan(x[:, p], books[p], groups[p], n_groups)
                else:
                    own[:, p], e, lows[:, p], _ = bounded_scan(x[:, p], books[p], groups[p], drift[p], old[:, p], bounds[:, p])
                error += e
            codes = own.astype(np.uint8)
            if state:
                low = _below(lows)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), batch.column("parts"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())], names=["vec_id", "label_key", "parts", "own", "lows"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), pa.array([r.tobytes().hex() for r in codes]), pa.array(error)], names=["vec_id", "label_key", "code", "error"])

    return run


def _summed(entries: int, width: int):
    """Sums of each entry's parts over a task: (part, entry, place, total); place -1 has their number."""

    def run(batches):
        sums, counts = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in _pieces(batches):
            if batch.num_rows:
                x = _parts(batch.column("parts"), width)
                own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(-1, PARTS)
                for p in range(PARTS):
                    np.add.at(sums[p], own[:, p], x[:, p])
                    counts[p] += np.bincount(own[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        both = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1)
        place = np.tile(np.arange(-1, width), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, width + 1).astype(np.int32)), pa.array(np.repeat(entry, width + 1).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(both.ravel())], names=["part", "entry", "place", "total"])

    return run


def moved(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """Codebooks whose entries are the floors of their parts' means; unused entries stay."""
    _, entries, width = books.shape
    found = state.select("parts", "own").mapInArrow(_summed(entries, width), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    totals = np.zeros((PARTS, entries, width + 1), np.int64)
    for part, entry, place, total in found.collect():  # PARTS * ENTRIES * (width + 1) rows at most
        totals[part, entry, place + 1] = total
    counts = totals[:, :, :1]
    return np.where(counts > 0, totals[:, :, 1:] // np.maximum(counts, 1), books)


def drifts(before: np.ndarray, after: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """How far the entries of each group went at most, for each part, not rounded down."""
    went = np.sqrt(((after - before) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-12)
    return np.stack([[went[p][groups[p] == g].max(initial=0.0) for g in range(int(groups.max()) + 1)] for p in range(len(before))])


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Codes of vectors under codebooks learned from all of them: vec_id, code, error, label_error, codebooks_sha256.

    Dropped: vectors that are null or empty, hold null or non-finite components, or are longer or shorter than the
    vector of the smallest vec_id. Codebooks begin as the parts of the ENTRIES smallest vec_ids (all, if there are fewer; null is the
    largest; ties in the order of the vectors) and take ROUNDS rounds. A length that PARTS doesn't divide is
    filled up with zeros. Integers are held to ``largest``, about 2**28 for 16 components a part, so that sums are exact. code:
    two hexadecimal digits for each part; error: squared distances of all parts; label_error: errors of all
    rows of the label, rows without a label together. Rows that repeat are rows of their own. Empty table, or no vector
    left: empty result. Other columns are ignored, whatever their names.
    """
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    place = [F.col("vec_id").isNull(), "vec_id", "vector"]
    head = kept.orderBy(*place).select(F.size("vector").alias("size")).first()
    if head is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    size = head["size"]
    width = -(-size // PARTS)
    even = kept.where(F.size("vector") == size)
    firsts = np.array([r["vector"] for r in even.orderBy(*place).limit(ENTRIES).select("vector").collect()])
    books = _integers(firsts, width).reshape(-1, PARTS, width).transpose(1, 0, 2).copy()
    groups = np.stack([groups_of(b) for b in books])
    # Labels as keys without null.
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))
    kind = vectors.schema[vec_id].dataType.simpleString()
    table = cut(even.select("vec_id", key.alias("label_key"), "vector").mapInArrow(_coded(size, width), f"vec_id {kind}, label_key string, parts binary"))
    drift = None
    for _ in range(ROUNDS):
        state = cut(table.mapInArrow(_assigned(books, groups, drift, True), f"vec_id {kind}, label_key string, parts binary, own binary, lows binary"))
        drop_table(table)  # what was written just now has all that is needed of it
        after = moved(books, state)
        drift, books, table = drifts(books, after, groups), after, state
    coded = cut(table.mapInArrow(_assigned(books, groups, drift, False), f"vec_id {kind}, label_key string, code string, error long"))
    drop_table(table)
    sums = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return join_one(coded, sums, "label_key", "n", coded.count()).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
