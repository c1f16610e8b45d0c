"""Stationary block bootstrap of whole tables: geometric, circular blocks, drawn by hashes, without one task for a sample or a series.

Rows in time order are cut into units of a few rows. A sample lays blocks of consecutive units over the places of the series;
where a block begins, and which unit it begins with, are hashes of (seed, sample, place), so that any task draws the same. A block goes
on with a chance of 1 - unit / length, and ends at the latest where a stretch of STRETCH units does; a block that runs over the end goes on at the start.
With units of one row this is the stationary bootstrap; larger ones save work in proportion and keep the mean length.

Two kinds of samples are made of the same draws:

* ``jointly``: rows are taken as they are. All that is asked of a sample are sums, so each unit is its sums.
* ``apart``: the predictors are taken by blocks and laid beside targets that stay in place. It keeps what each series remembers of
  itself and breaks what holds between them: the null hypothesis of no link.

Blocks are drawn as runs (place, source, units); no row for each unit of a sample is made. For ``jointly`` a task counts how often runs take each
unit of one chunk. For ``apart`` a task has one chunk of targets and one of predictors, as codes, and draws the runs that take the second to the
first by itself: series are sent once for each chunk of the other side, not once for each sample, and runs are not sent.

Sample -1 is the series itself.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.ranking import FEW_GROUPS, mean_rank, placed, with_place
from tidemark.tables import small_batches, unneeded, written

#: Units of a stretch; at its end a block ends too, so a sample's blocks are laid by many tasks.
STRETCH = 4096
#: Units of a chunk whose sums a task of ``jointly`` holds.
CHUNK = 65_536
#: Rows of a piece of a packed column.
PIECE = 1 << 16
#: Rows of a chunk of targets in ``apart``, over all targets; bytes a row that the predictors of a task may have as codes, about, and rows of a chunk of so many bytes.
TARGET_ROWS, PREDICTORS, PREDICTOR_ROWS = 1 << 22, 4, 1 << 24
#: Partitions of tiles, at most.
MOST_TILES = 1000
#: Chunks of targets of a series that are small enough; runs, and products of numbers, that a task of ``apart`` holds at a time.
TILES, RUNS, PRODUCTS = 16, 1 << 20, 1 << 18
#: Hashes taken at a time; the constants of MD5.
HASHED = 8192
_STATE = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def drawn(part: int, *names: Column) -> Column:
    """A number in [0, 1) from a hash of what names it; parts 0 to 3 of one name are drawn together."""
    digest = F.md5(F.concat_ws("|", *[n.cast("string") for n in names]))
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("double") / float(1 << 32)


def unit_of(length: float, unit: int | None) -> int:
    """Rows of a unit: an eighth of the blocks' mean length if none is given."""
    return max(1, int(length) // 8) if unit is None else unit


def _hashed(prefix: bytes, low: int, high: int) -> np.ndarray:
    """The first two words of md5(prefix + place), as hex digits read, of places low to high - 1: many at a time, in a block of 64 bytes."""
    out = np.empty((high - low, 2), np.uint32)
    at = low
    while at < high:
        width = len(str(at))
        upto, length = min(high, 10**width, at + HASHED), len(prefix) + width
        if length > 55:
            out[at - low : upto - low] = np.frombuffer(b"".join([md5(prefix + b"%d" % p).digest()[:8] for p in range(at, upto)]), ">u4").reshape(-1, 2)
            at = upto
            continue
        text, place = np.zeros((upto - at, 64), np.uint8), np.arange(at, upto)
        text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
        for i in range(width):
            text[:, length - 1 - i] = 48 + place // 10**i % 10
        text[:, length] = 128
        words = np.ascontiguousarray(text.view("<u4").T)
        words[14] = 8 * length
        same = [w[0] if i < len(prefix) // 4 or i > length // 4 else w for i, w in enumerate(words)]
        a, b, c, d = (np.full(upto - at, v, np.uint32) for v in _STATE)
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += same[g]
            f += _SINES[i]
            left = _TURNS[i // 16][i % 4]
            a, d, c, b = d, c, b, b + ((f << np.uint32(left)) | (f >> np.uint32(32 - left)))
        out[at - low : upto - low, 0], out[at - low : upto - low, 1] = (a + _STATE[0]).byteswap(), (b + _STATE[1]).byteswap()
        at = upto
    return out


def _drawn(units: int, low: int, high: int, sample: int, seed: int, chance: float, stretch: int, cut: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, source, n of the runs that a sample has at places low (where a stretch begins) to high - 1. No run goes over the end of a stretch, of the series, or of a chunk of ``cut`` sources."""
    if sample < 0:
        at = np.arange(low, high, cut or high - low)
        source = at.copy()
    else:
        u = _hashed(f"{seed}|{sample}|".encode(), low, high)
        begins = np.flatnonzero((np.arange(low, high) % stretch == 0) | (u[:, 0] / float(1 << 32) < chance))
        at, source = begins + low, np.floor(u[begins, 1] / float(1 << 32) * units).astype(np.int64)
    n = np.diff(np.append(at, high))
    while (n > (room := np.minimum(units, (source // cut + 1) * cut if cut else units) - source)).any():
        over = n > room
        at, source, n = np.concatenate([at, (at + room)[over]]), np.concatenate([source, (source + room)[over] % units]), np.concatenate([np.minimum(n, room), (n - room)[over]])
    return at, source, n


def runs(series: DataFrame, by: Sequence[str], length: float, unit: int, samples: int, seed: int, cut: int | None = None) -> DataFrame:
    """series(by, units) -> (by, sample, place, source, n): the units source, source + 1, ... that each sample has at place, place + 1, ..., and the series itself as sample -1.

    No run goes over the end of a stretch of places, of the series, or of a chunk of ``cut`` sources.
    """
    stretch, chance = STRETCH, min(1.0, unit / length)
    each = series.select(*by, "units", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("units") - 1) / stretch))).alias("_s")).withColumn("sample", F.explode(F.sequence(F.lit(-1), F.lit(samples - 1))))
    dealt = each.repartition(max(16, min(1000, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "_s", "sample")

    def drawn_runs(batches):
        for batch in batches:
            for i, (units, s, sample) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("units", "_s", "sample")), strict=True)):
                at, source, n = _drawn(units, s * stretch, min(units, (s + 1) * stretch), sample, seed, chance, stretch, cut)
                of_group = [batch.column(c).take(pa.array(np.full(len(at), i))) for c in by]
                yield pa.RecordBatch.from_arrays([*of_group, pa.array(np.full(len(at), sample), pa.int32()), *(pa.array(v, pa.int64()) for v in (at, source, n))], names=[*by, "sample", "place", "source", "n"])

    return dealt.mapInArrow(drawn_runs, f"{_keys(series, by)}sample int, place long, source long, n long")


def _keys(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def laid(series: DataFrame, by: Sequence[str], length: float, unit: int, samples: int, seed: int) -> DataFrame:
    """series(by, units) -> (by, sample, place, source): which unit each sample has at each place, and the series itself as sample -1."""
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i")
    return runs(series, by, length, unit, samples, seed).select(*by, "sample", "place", "source", step).select(*by, "sample", (F.col("place") + F.col("_i")).alias("place"), (F.col("source") + F.col("_i")).alias("source"))


def _numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str], unit: int, columns: dict[str, Column]) -> DataFrame:
    """rows -> by, unit, place and the columns as doubles, numbered in order (by its first column, then the others)."""
    ordered = {f"_o{i}": F.col(c) for i, c in enumerate(order)}
    kept = rows.select(*by, *[c.alias(n) for n, c in ordered.items()], *[c.cast("double").alias(f"_{n}") for n, c in columns.items()]).dropna(subset=[f"_{n}" for n in columns])
    head, *ties = ordered
    placed = with_place(kept, head, ties or [head], by)
    return placed.select(*by, F.floor(F.col("place") / unit).alias("unit"), "place", *[F.col(f"_{n}") for n in columns])


def _matched(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """a joined with b on pairs of columns, null with null; b's key columns are dropped."""
    on = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}")) for x, y in pairs]
    named = {y for _, y in pairs}
    return a.alias("a").join(b.alias("b"), on).select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in named])


def jointly(rows: DataFrame, order: Sequence[str], moments: dict[str, Column], length: float, samples: int, by: Sequence[str] = (), unit: int | None = None, seed: int = 0) -> DataFrame:
    """Sums of each moment over every sample of whole rows: by, sample, moments. Rows where a moment is null are no part of the series."""
    unit = unit_of(length, unit)
    sums = written(_numbered(rows, order, by, unit, moments).groupBy(*by, "unit").agg(*[F.sum(f"_{n}").alias(n) for n in moments]), "units")
    series = sums.groupBy(*by).agg((F.max("unit") + 1).alias("units"))
    # How often a sample has a unit is all that counts.
    cut, names, keys = CHUNK, list(moments), [*by, "_chunk"]
    asked = runs(series, by, length, unit, samples, seed, cut).select(*by, F.floor(F.col("source") / cut).alias("_chunk"), "sample", "source", "n")
    chunks = sums.withColumn("_chunk", F.floor(F.col("unit") / cut))

    def counted(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * cut
        values = np.zeros((cut, len(names)))
        values[held["unit"].to_numpy() - first] = held[names].to_numpy(float)
        out = []
        for sample, r in asked.groupby("sample"):
            at = r["source"].to_numpy() - first
            often = np.cumsum(np.bincount(at, minlength=cut + 1) - np.bincount(at + r["n"].to_numpy(), minlength=cut + 1))[:cut]
            out.append((*key[:-1], sample, *(often @ values)))
        return pd.DataFrame(out, columns=[*by, "sample", *names])

    met = asked.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInPandas(counted, f"{_keys(sums, by)}sample int, {', '.join(f'`{n}` double' for n in names)}")
    return met.groupBy(*by, "sample").agg(*[F.sum(n).alias(n) for n in moments])


def _coded(v: np.ndarray) -> tuple[int, bytes, np.ndarray]:
    """Numbers as codes of 1, 2, 4, 8 or 16 bits with their distinct values, or as they are (64 bits, no values): bits, codes, values."""
    values, codes = np.unique(v, return_inverse=True)
    if len(values) > 256 and (4 * len(values) > 3 * len(v) or len(values) > 1 << 16):
        return 64, v.tobytes(), values[:0]
    return packed_codes(codes, values)


def packed_codes(codes: np.ndarray, values: np.ndarray) -> tuple[int, bytes, np.ndarray]:
    """Numbers that are values[codes], as ``_coded`` gives them."""
    bits = bits_of(len(values))
    if bits == 16:
        return bits, codes.astype(np.uint16).tobytes(), values
    each = np.append(codes.astype(np.uint8), np.zeros(-len(codes) % (8 // bits), np.uint8)).reshape(-1, 8 // bits)
    return bits, np.bitwise_or.reduce(each << np.arange(0, 8, bits, dtype=np.uint8), axis=1).tobytes(), values


def bits_of(values: int) -> int:
    """Bits of a code of so many values."""
    return next(w for w in (1, 2, 4, 8, 16) if values <= 1 << w)


def _codes(bits: int, codes: bytes, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(codes, np.uint16)
    return ((np.frombuffer(codes, np.uint8)[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)) & np.uint8((1 << bits) - 1)).ravel()[:n]


def _decoded(bits: int, codes: bytes, values: np.ndarray, n: int) -> np.ndarray:
    return np.frombuffer(codes, float) if bits == 64 else values[_codes(bits, codes, n)]


#: Columns of a table of pieces, beside those of the group: the next n rows, from the __at-th one that the group has in the range on.
PIECES = "__range long, __at long, __n int, __columns array<struct<__name string, __bits int, __codes binary, __values array<double>>>"


def in_pieces(rows: DataFrame, order: Sequence[str], by: Sequence[str], columns: dict[str, Column], missing: bool = False, at_once: int | None = None) -> DataFrame:
    """Columns as doubles in pieces of up to PIECE rows in order: by and PIECES. Rows where a column is null or no number are left out; if ``missing``, they stay, and null is no number.

    Rows are sorted by ranges and packed where they are sorted; only the pieces are written. About at_once rows are sorted at a time, if it is given and the
    first column of the order is a number or a time: rows are read again for each such part, and the shuffle files are those of one part.
    """
    numbers, names, size = [c.cast("double") for c in columns.values()], list(columns), min(PIECE, max(1024, (1 << 23) // len(columns)))
    head, spark = F.col(order[0]), rows.sparkSession
    known = rows.where(head.isNotNull())
    for c in [] if missing else numbers:
        known = known.where(c.isNotNull() & ~F.isnan(c))
    shape = f"{_keys(rows, by)}{PIECES}"
    schema = pa.schema([*((c, to_arrow_type(rows.schema[c].dataType)) for c in by), ("__range", pa.int64()), ("__at", pa.int64()), ("__n", pa.int32()), ("__columns", pa.list_(pa.struct([("__name", pa.string()), ("__bits", pa.int32()), ("__codes", pa.binary()), ("__values", pa.list_(pa.float64()))])))])

    def packed(part: int):
        def of_range(batches):
            here, group, first, at, held, count = (part << 32) + TaskContext.get().partitionId(), None, None, 0, [], 0

            def flushed(n: int):
                nonlocal held, at, count
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                told = [dict(zip(("__name", "__bits", "__codes", "__values"), (name, *_coded(c[:n])), strict=True)) for name, c in zip(names, whole, strict=True)]
                piece = pa.RecordBatch.from_arrays([*(pa.array([v.as_py()], schema.field(c).type) for c, v in zip(by, first, strict=True)), *(pa.array([v], schema.field(c).type) for c, v in (("__range", here), ("__at", at), ("__n", n), ("__columns", told)))], schema=schema)
                held, count, at = [[c[n:] for c in whole]], count - n, at + n
                return piece

            for batch in batches:
                changes = [np.flatnonzero(np.diff(batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False))) + 1 for c in by]
                ends = [*np.unique(np.concatenate(changes)).tolist(), batch.num_rows] if by else [batch.num_rows]
                for low, high in zip([0, *ends], ends):
                    if low == high:
                        continue
                    of_row = [batch.column(c)[low] for c in by]
                    key = tuple("nan" if v != v else v for v in (s.as_py() for s in of_row))
                    if key != group:
                        if count:
                            yield flushed(count)
                        group, first, at, held, count = key, of_row, 0, [], 0
                    held.append([batch.column(f"__{i}")[low:high].to_numpy(zero_copy_only=False) for i in range(len(names))])
                    count += high - low
                    while count >= size:
                        yield flushed(size)
            if count:
                yield flushed(count)

        return of_range

    found = []
    for part, some in enumerate(_in_parts(known, order[0], at_once)):
        ordered = some.orderBy(*dict.fromkeys([*by, *order])).select(*by, *[c.alias(f"__{i}") for i, c in enumerate(numbers)])
        found.append(written(ordered.mapInArrow(packed(part), shape), "pieces"))
        unneeded(spark)
    return functools.reduce(DataFrame.unionAll, found)


def _in_parts(rows: DataFrame, head: str, at_once: int | None) -> list[DataFrame]:
    """rows in parts of about at_once rows, by ranges of head."""
    kind = rows.schema[head].dataType
    if at_once is None or not isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return [rows]
    parts = -(-rows.count() // at_once)
    if parts < 2:
        return [rows]
    # Wherever they lie, each row is in one part.
    marks = rows.agg(F.percentile_approx(head, [k / parts for k in range(1, parts)], 1000)).first()[0]
    marks = [F.lit(m).cast(kind) for m in dict.fromkeys(marks) if m == m]
    after, upto = (lambda m: F.col(head) > m), (lambda m: F.col(head) <= m)
    return [rows.where((after(low) if low is not None else F.lit(True)) & (upto(high) if high is not None else F.lit(True))) for low, high in zip([None, *marks], [*marks, None], strict=True)]


def opened(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int, pa.Buffer, np.ndarray]]]:
    """Of each piece: name, bits, codes and values of its columns."""
    column = batch.column("__columns")
    ends, flat = column.offsets.to_pylist(), column.values
    names, bits, codes, values = (flat.field(i) for i in range(4))
    for low, high in zip(ends, ends[1:]):
        yield [(names[k].as_py(), bits[k].as_py(), codes[k].as_buffer(), values[k].values.to_numpy(zero_copy_only=False)) for k in range(low, high)]


def with_first(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pieces with __first, the place of their first row in the group, and __rows, those of the whole group."""
    counts = pieces.groupBy(*by, "__range").agg(F.sum("__n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("__start"), F.sum("_n").over(Window.partitionBy(*by)).alias("__rows"))
    met = _matched(pieces, F.broadcast(starts) if starts.count() <= FEW_GROUPS else starts, [(c, c) for c in [*by, "__range"]])
    return met.withColumn("__first", F.col("__start") + F.col("__at")).drop("__start")


def apart(rows: DataFrame, order: Sequence[str], predictors: dict[str, Column], targets: dict[str, Column], length: float, samples: int, by: Sequence[str] = (), unit: int | None = None, seed: int = 0) -> DataFrame:
    """Sums over every sample in which predictors are moved by blocks against targets that stay: by, feature, sample, n, sx, sxx, and for each target y s_y, ss_y, sx_y.

    Rows where any column is null are no part of the series. Where a shorter last unit meets a full one, the rows they have in common count.
    """
    x, y = ({f"{side}{n}": c for n, c in columns.items()} for side, columns in (("x", predictors), ("y", targets)))
    pieces = in_pieces(rows, order, by, x | y)
    sizes = pieces.groupBy(*by).agg(F.sum("__n").alias("__rows")).where("__rows > 0")
    placed = with_first(pieces, by).select(*by, "__first", "__n", F.inline("__columns"))
    width = {r["__name"]: r["bits"] for r in placed.groupBy("__name").agg(F.max("__bits").alias("bits")).collect()}
    return moved(placed, sizes, by, list(predictors), list(targets), length, samples, unit, seed, width)


def moved(placed: DataFrame, sizes: DataFrame, by: Sequence[str], predictors: Sequence[str], targets: Sequence[str], length: float, samples: int, unit: int | None, seed: int, width: dict[str, int]) -> DataFrame:
    """The sums of ``apart`` from pieces: by, __first (place of the first row), __n, __name (x or y and the column's name), __bits, __codes, __values. sizes: by, __rows of each series. width: the most bits of each name.

    A tile is a chunk of targets and one of predictors; its task draws the runs that take the second to the first by itself, for some samples at a time, and goes
    through the predictors piece by piece, so it holds targets as numbers, predictors as codes, and runs. The tiles of one chunk of predictors are
    sent at a time, so the shuffle files are those of one such chunk and all targets. Each tile has a partition of its own, up to MOST_TILES; with more they are sorted.
    """
    names = ["n", "sx", "sxx", *[f"{s}_{t}" for t in targets for s in ("s", "ss", "sx")]]
    shape = f"{_keys(placed, by)}feature string, sample int, {', '.join(f'`{c}` double' for c in names)}"
    if not predictors:
        return placed.sparkSession.createDataFrame([], shape)
    unit, stretch, most = unit_of(length, unit), STRETCH, RUNS
    chance, block = min(1.0, unit / length), math.gcd(stretch, 1 << max(0, (PIECE // unit).bit_length() - 1))
    # As many predictors go to a task, and so many rows of them, as their codes have room.
    upto = np.cumsum([0, *[width.get(f"x{c}", 1) for c in predictors]]).tolist()
    part = {f"x{c}": at // (8 * PREDICTORS) for c, at in zip(predictors, upto, strict=False)}
    bits = [sum(width.get(c, 1) for c in part if part[c] == p) for p in sorted(set(part.values()))]
    part = {c: sorted(set(part.values())).index(p) for c, p in part.items()}
    wide = [max(1, PREDICTOR_ROWS * PREDICTORS * 8 // b // (stretch * unit)) for b in bits]
    stretches = F.ceil(F.col("__rows") / (stretch * unit))
    tall = F.greatest(F.lit(1), F.least(F.lit(TARGET_ROWS // (stretch * unit * len(targets))), F.ceil(stretches / TILES))).cast("long")
    last = lambda size: F.floor((stretches - 1) / size)
    chunks = lambda size: F.sequence(F.floor(F.col("__first") / (size * stretch * unit)), F.floor((F.col("__first") + F.col("__n") - 1) / (size * stretch * unit)))
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long"))
    wide_of = F.element_at(F.array(*[F.lit(w) for w in wide]), F.col("__part") + 1)
    part_of = F.element_at(F.create_map(*[F.lit(v) for c in part.items() for v in c]), F.col("__name"))
    tiles = F.ceil(stretches / tall) * len(wide)
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) if by else Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.withColumns({"__tall": tall, "__tile": F.coalesce(F.sum(tiles).over(before), F.lit(0))}), "sizes")
    series, most_rows, count = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("__rows"), F.lit(0)), F.coalesce(F.sum(F.ceil(stretches / F.col("__tall"))), F.lit(0)) * len(wide)).first()
    few = F.broadcast(sizes) if series <= FEW_GROUPS else sizes
    sized = _matched(placed, few, [(c, c) for c in by]) if by else placed.crossJoin(few)
    kept = [*by, "__rows", "__tall", "__first", "__n", "__name", "__bits", "__codes", "__values", "__tile", "__part"]
    xs = sized.where("__name LIKE 'x%'").withColumn("__part", part_of).select(*kept, F.explode(all_of(last(F.col("__tall")))).alias("__y"), wide_of.alias("__wide")).withColumn("__x", F.explode(chunks(F.col("__wide")))).drop("__wide")
    ys = sized.where("__name LIKE 'y%'").withColumn("__part", F.explode(F.array(*[F.lit(p) for p in range(len(wide))]))).select(*kept, F.explode(chunks(F.col("__tall"))).alias("__y"), wide_of.alias("__wide"))
    ys = ys.withColumn("__x", F.explode(all_of(last(F.col("__wide"))))).drop("__wide")
    # Numbered without __x, of which there is one at a time.
    all_tiles = xs.unionByName(ys).withColumn("__tile", F.col("__tile") + F.col("__part") * F.ceil(stretches / F.col("__tall")) + F.col("__y"))
    kinds, spots = [placed.schema[c].dataType for c in by], {f"y{c}": i for i, c in enumerate(targets)}

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = tile = group = pieces = None

        def summed():
            for low in range(-1, samples, step := max(1, int(most / (tile.units * chance + tile.units / stretch + tile.units / block)))):
                for name, sums in tile.sums(range(low, min(samples, low + step)), seed, chance, block, pieces).items():
                    count = sums.shape[1]
                    of_group = [pa.array([v] * count, to_arrow_type(kind)) for v, kind in zip(group, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*of_group, pa.array([name] * count), pa.array(np.arange(low, low + count), pa.int32()), *(pa.array(v, pa.float64()) for v in sums)], names=[*by, "feature", "sample", *names])

        for batch in batches:
            numbers = batch.select(["__tile", "__rows", "__tall", "__first", "__n", "__name", "__bits", "__part", "__y", "__x"]).to_pydict()
            for i, (here, total, tall, first, n, name, bits, p, yi, xi) in enumerate(zip(*numbers.values(), strict=True)):
                if here != at:
                    if tile is not None:
                        yield from summed()
                    at, pieces, group = here, {}, [batch.column(c)[i].as_py() for c in by]
                    tile = _Tile(total, unit, stretch, yi * tall * stretch, tall * stretch, xi * wide[p] * stretch, wide[p] * stretch, len(targets))
                codes, values = batch.column("__codes")[i], batch.column("__values")[i].values.to_numpy(zero_copy_only=False)
                if name in spots:
                    tile.stays(spots[name], first, _decoded(bits, codes.as_buffer(), values, n))
                else:
                    pieces.setdefault((first, n), []).append((name[1:], bits, codes.as_py(), values.copy()))
        if tile is not None:
            yield from summed()

    rounds, spread, found = -(-most_rows // (min(wide) * stretch * unit)), min(count, MOST_TILES), []
    for i in range(rounds):
        dealt = all_tiles.where(F.col("__x") == i).repartitionById(spread, (F.col("__tile") % spread).cast("int"))
        with small_batches(placed.sparkSession):
            found.append(written((dealt if count <= spread else dealt.sortWithinPartitions("__tile")).mapInArrow(met, shape), "sums"))
        unneeded(placed.sparkSession)
    sums = functools.reduce(DataFrame.unionAll, found) if found else placed.sparkSession.createDataFrame([], shape)
    return sums.groupBy(*by, "feature", "sample").agg(*[F.sum(c).alias(c) for c in names])


class _Tile:
    """Sums of samples that take units of predictors from source on to units of targets from place on. Rows of a shorter last unit are filled up with zeros."""

    def __init__(self, rows: int, unit: int, stretch: int, place: int, places: int, source: int, sources: int, targets: int):
        self.all, self.unit, self.stretch, self.place, self.source = -(-rows // unit), unit, stretch, place, source
        self.units, self.sources = min(places, self.all - place), min(sources, self.all - source)
        #: Rows of the last unit, which are all that it has in common with others.
        self.short = rows - (self.all - 1) * unit
        self.targets = [np.zeros(self.units * unit) for _ in range(targets)]

    def stays(self, target: int, first: int, v: np.ndarray) -> None:
        _put(self.targets[target], first - self.place * self.unit, v)

    def sums(self, samples: range, seed: int, chance: float, block: int, pieces: dict) -> dict[str, np.ndarray]:
        """Of each predictor: n, sx, sxx, and s, ss, sx of each target, by sample."""
        if not pieces:
            return {}
        unit, short, last = self.unit, self.short, self.all - 1
        drawn = []
        for i, sample in enumerate(samples):
            at, source, n = _drawn(self.all, self.place, self.place + self.units, sample, seed, chance, self.stretch, block)
            mine = (source >= self.source) & (source < self.source + self.sources)
            drawn.append([v.astype(np.int32) for v in (at[mine] - self.place, source[mine] - self.source, n[mine], np.full(mine.sum(), i))])
        at, source, n, of = (np.concatenate(v) for v in zip(*drawn, strict=True))
        del drawn
        blocks = source // block
        order = np.argsort(blocks, kind="stable")
        at, source, n, of = (v[order] for v in (at, source, n, of))
        begins = np.searchsorted(blocks[order], np.arange(-(-self.sources // block) + 1))
        del blocks, order
        by_sample = lambda of, v: np.bincount(of, v, len(samples))
        # Runs with the last unit as a source, or at its place, if that is shorter.
        whole = short == unit
        from_last = np.flatnonzero(source + n == last + 1 - self.source) if not whole else np.zeros(0, int)
        to_last = at + n == last + 1 - self.place if not whole else np.zeros(len(at), bool)
        # The place that the last unit is taken to, and the source that is taken to the last place.
        taken_to = at[from_last] + n[from_last] - 1
        both = to_last[from_last]
        count = by_sample(of, n * float(unit)) - (unit - short) * (by_sample(of[from_last], (~both).astype(float)) + by_sample(of[to_last], np.ones(to_last.sum())))
        staying = []
        for y in self.targets:
            y = y.reshape(-1, unit)
            for v in (y, y * y):
                units = v.sum(axis=1)
                upto = np.append(0, np.cumsum(units))
                staying.append(by_sample(of, upto[at + n] - upto[at]) - by_sample(of[from_last], v[taken_to, short:].sum(axis=1)))
        out = {}
        for (first, rows), columns in pieces.items():
            first = first - self.source * unit
            low, high = max(0, first // unit), min(self.sources, -(-(first + rows) // unit))
            some = slice(begins[low // block], begins[(high - 1) // block + 1])
            a, b = np.maximum(source[some], low), np.minimum(source[some] + n[some], high)
            met = np.flatnonzero(b > a)
            a, b, to, sample, ends = a[met], b[met], (at[some] + np.maximum(source[some], low) - source[some])[met], of[some][met], to_last[some][met]
            # The source that a run takes to the last place is its last one.
            ends &= b == (source[some] + n[some])[met]
            moving = []
            for name, *coded in columns:
                v = np.zeros((high - low) * unit)
                _put(v, first - low * unit, _decoded(*coded, rows))
                v = v.reshape(-1, unit)
                sums = out.setdefault(name, np.zeros((3 + 3 * len(self.targets), len(samples))))
                for i, w in ((1, v), (2, v * v)):
                    upto = np.append(0, np.cumsum(w.sum(axis=1)))
                    sums[i] += by_sample(sample, upto[b - low] - upto[a - low]) - by_sample(sample[ends], w[b[ends] - 1 - low, short:].sum(axis=1))
                moving.append((v, sums))
            upto = np.cumsum(b - a)
            for cut in np.split(np.arange(len(a)), np.flatnonzero(np.diff(upto // max(1, PRODUCTS // unit))) + 1):
                q, p, s = _one_by_one(a[cut] - low, (b - a)[cut]), _one_by_one(to[cut], (b - a)[cut]), np.repeat(sample[cut], (b - a)[cut])
                for t, y in enumerate(self.targets):
                    beside = y.reshape(-1, unit)[p]
                    for v, sums in moving:
                        sums[5 + 3 * t] += by_sample(s, np.einsum("ij,ij->i", v[q], beside))
        for sums in out.values():
            sums[0] = count
            for t in range(len(self.targets)):
                sums[3 + 3 * t], sums[4 + 3 * t] = staying[2 * t], staying[2 * t + 1]
        return out


def _put(into: np.ndarray, at: int, v: np.ndarray) -> None:
    """v from at on, as far as there is room."""
    low, high = max(0, at), min(len(into), at + len(v))
    into[low:high] = v[low - at : high - at]


def _one_by_one(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n numbers, for each run."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def correlation(n: Column, sx: Column, sxx: Column, sy: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; null if a side doesn't vary."""
    var = (sxx - sx * sx / n) * (syy - sy * sy / n)
    return F.when((sxx - sx * sx / n > 1e-9 * sxx) & (syy - sy * sy / n > 1e-9 * syy), (sxy - sx * sy / n) / F.sqrt(var))


def of_target(statistic, y: str) -> Column:
    """A statistic of (n, sx, sxx, sy, syy, sxy) on the sums that ``apart`` gives for a target."""
    return statistic(*[F.col(c) for c in ("n", "sx", "sxx", f"s_{y}", f"ss_{y}", f"sx_{y}")])


def difference(n: Column, sx: Column, sxx: Column, sy: Column, syy: Column, sxy: Column) -> Column:
    """Mean of y where the 0/1 flag x is set, less its mean elsewhere; null if one side is empty."""
    return F.when((sx > 0) & (sx < n), sxy / sx - (sy - sxy) / (n - sx))


def trend_z(n: Column, sx: Column, sxx: Column, sy: Column, syy: Column, sxy: Column) -> Column:
    """Cochran-Armitage z of y over ordered groups x, for any y: with 0/1 outcomes its variance is that of a share."""
    spread = (syy / n - sy * sy / (n * n)) * (sxx - sx * sx / n)
    return F.when((sxx - sx * sx / n > 1e-9 * sxx) & (syy - sy * sy / n > 1e-9 * syy), (sxy - sx * sy / n) / F.sqrt(spread))


def tested(found: DataFrame, by: Sequence[str], one_sided: bool = False) -> DataFrame:
    """found(by, sample, stat) -> by, stat (of the series itself), p, usable samples.

    p: the share of samples whose statistic is at least as large (in size, if not one-sided), counting the series itself as one;
    samples without a statistic don't count. 1 if there is none, or the series has none.
    """
    own = found.where("sample = -1").select(*by, F.col("stat").alias("_own"))
    met = _matched(found.where("sample >= 0"), own, [(c, c) for c in by]) if by else found.where("sample >= 0").crossJoin(F.broadcast(own))
    size = (lambda c: F.col(c)) if one_sided else (lambda c: F.abs(F.col(c)))
    counts = met.groupBy(*by).agg(F.first("_own").alias("stat"), F.count(F.when(size("stat") >= size("_own"), 1)).alias("_k"), F.count("stat").alias("usable"))
    p = F.when(F.col("stat").isNull() | (F.col("usable") == 0), 1.0).otherwise((1 + F.col("_k")) / (1 + F.col("usable")))
    return counts.select(*by, "stat", p.alias("p"), "usable")


def intervals(rows: DataFrame, order: Sequence[str], value: Column, by: Sequence[str], length: float, samples: int = 300, level: float = 0.95, unit: int | None = None, seed: int = 0) -> DataFrame:
    """Mean of value in each group with the ends of its bootstrap interval: by, mean, low, high."""
    sums = jointly(rows, order, {"s": value, "c": F.when(value.isNotNull(), 1.0)}, length, samples, by, unit, seed).select(*by, "sample", (F.col("s") / F.col("c")).alias("m"))
    drawn_means = F.when(F.col("sample") >= 0, F.col("m"))
    low, high = (F.percentile(drawn_means, F.lit(q)) for q in ((1 - level) / 2, (1 + level) / 2))
    return sums.groupBy(*by).agg(F.max(F.when(F.col("sample") < 0, F.col("m"))).alias("mean"), low.alias("low"), high.alias("high"))


def ranked(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows with the mean rank of each column (in its group) in place of its values; ranked by ranges of values."""
    original = rows
    for c in columns:
        spots = placed(original, c, by).select(*by, F.col(c).alias("_v"), mean_rank(F.col("before"), F.col("ties")).alias("_rank"))
        met = _matched(rows, spots, [*((b, b) for b in by), (c, "_v")])
        rows = met.withColumn(c, F.col("_rank")).drop("_rank")
    return rows


def rank_links(rows: DataFrame, order: Sequence[str], predictors: Sequence[str], target: str, length: float, samples: int, by: Sequence[str] = (), unit: int | None = None, seed: int = 0) -> DataFrame:
    """Spearman's rho of each predictor with the target, and its p when predictors are moved by blocks: by, feature, rho, p, usable."""
    known = rows.select(*by, *order, *predictors, target).dropna(subset=[*predictors, target])
    r = ranked(known, [*predictors, target], by)
    sums = apart(r, order, {p: F.col(p) for p in predictors}, {"y": F.col(target)}, length, samples, by, unit, seed)
    return tested(sums.select(*by, "feature", "sample", of_target(correlation, "y").alias("stat")), [*by, "feature"]).withColumnRenamed("stat", "rho")


def stronger(rows: DataFrame, order: Sequence[str], a: str, b: str, target: str, length: float, samples: int, by: Sequence[str] = (), unit: int | None = None, seed: int = 0) -> DataFrame:
    """Whether a is linked with the target more than b, both under the same samples of whole rows: by, rho_a, rho_b, p.

    p: the share of samples in which a's rho isn't larger in size, counting the series itself as one; samples without both count against a.
    """
    r = ranked(rows.select(*by, *order, a, b, target).dropna(subset=[a, b, target]), [a, b, target], by)
    x, z, y = (F.col(c) for c in (a, b, target))
    moments = {"n": F.lit(1.0), "sa": x, "saa": x * x, "sb": z, "sbb": z * z, "sy": y, "syy": y * y, "say": x * y, "sby": z * y}
    sums = jointly(r, order, moments, length, samples, by, unit, seed)
    rho = lambda s: correlation(*[F.col(c) for c in ("n", f"s{s}", f"s{s}{s}", "sy", "syy", f"s{s}y")])
    found = sums.select(*by, "sample", rho("a").alias("ra"), rho("b").alias("rb"))
    against = F.col("ra").isNull() | F.col("rb").isNull() | (F.abs("ra") <= F.abs("rb"))
    drawn_here = F.col("sample") >= 0
    own = lambda c: F.max(F.when(~drawn_here, F.col(c)))
    p = (1 + F.count(F.when(drawn_here & against, 1))) / (1 + F.count(F.when(drawn_here, 1)))
    return found.groupBy(*by).agg(own("ra").alias("rho_a"), own("rb").alias("rho_b"), p.alias("p"))


def added(rows: DataFrame, order: Sequence[str], predictor: str, benchmark: str, target: str, length: float, samples: int, by: Sequence[str] = (), unit: int | None = None, seed: int = 0) -> DataFrame:
    """What the predictor adds to the benchmark, on ranks: by, r2_base, r2_full, partial, p.

    p is one-sided: the predictor alone is moved by blocks, so its links with target and benchmark both break.
    """
    r = ranked(rows.select(*by, *order, predictor, benchmark, target).dropna(subset=[predictor, benchmark, target]), [predictor, benchmark, target], by)
    sums = apart(r, order, {"p": F.col(predictor)}, {"y": F.col(target), "b": F.col(benchmark)}, length, samples, by, unit, seed)
    fixed = r.groupBy(*by).agg(F.corr(benchmark, target).alias("_yb"))
    links = sums.select(*by, "sample", of_target(correlation, "y").alias("yp"), of_target(correlation, "b").alias("bp"))
    met = _matched(links, fixed, [(c, c) for c in by]) if by else links.crossJoin(F.broadcast(fixed))
    full = F.expr("(_yb * _yb + yp * yp - 2 * _yb * yp * bp) / nullif(1 - bp * bp, 0)")
    each = met.withColumns({"full": full, "stat": full - F.col("_yb") * F.col("_yb")})
    partial = F.expr("(yp - _yb * bp) / sqrt(greatest((1 - _yb * _yb) * (1 - bp * bp), 1e-12))")
    own = each.where("sample = -1").select(*by, (F.col("_yb") * F.col("_yb")).alias("r2_base"), F.col("full").alias("r2_full"), partial.alias("partial"))
    p = tested(each.select(*by, "sample", "stat"), by, one_sided=True).select(*by, "p")
    return _matched(own, p, [(c, c) for c in by]) if by else own.crossJoin(F.broadcast(p))


#: Different atoms that ``lift_by_atom`` tells apart, at most: each is a column of the series.
MOST_ATOMS = 1_000


def lift_by_atom(rows: DataFrame, atoms: str, metric: str, order: Sequence[str], length: float, train: float = 0.7, samples: int = 300, unit: int | None = None, seed: int = 0) -> DataFrame:
    """Mean of the metric with an atom against without it, in training and hold-out rows: atom, n, train_gap, test_gap, p, usable, confirmed.

    p: atoms are moved by blocks against the metric, in the training rows. confirmed: both differences have one sign and the second is
    between half and twice the first. More than MOST_ATOMS different atoms are an error.
    """
    names = sorted(r[0] for r in rows.select(F.explode(atoms).alias("a")).where("a IS NOT NULL").distinct().limit(MOST_ATOMS + 1).collect())
    if len(names) > MOST_ATOMS:
        raise ValueError(f"more than {MOST_ATOMS} different atoms")
    head, *ties = order
    ranked_rows = with_place(rows.where(F.col(metric).isNotNull()).select(*order, metric, atoms), head, ties or [head])
    cut = ranked_rows.agg(F.floor(F.count(F.lit(1)) * train).alias("_cut"))
    known = ranked_rows.crossJoin(F.broadcast(cut)).withColumn("_train", F.col("place") < F.col("_cut"))
    # Sums of each (side, atom) come from the rows that carry it.
    x = F.col(metric)
    whole = known.groupBy("_train").agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    marked = known.select("_train", x, F.explode(F.array_distinct(atoms)).alias("atom")).groupBy("atom", "_train").agg(F.sum(metric).alias("s"), F.count(metric).alias("c"))
    gap = F.expr("s / nullif(c, 0) - (_s - s) / nullif(_c - c, 0)")
    gaps = marked.join(F.broadcast(whole), "_train").groupBy("atom").agg(F.sum("c").alias("n"), F.max(F.when(F.col("_train"), gap)).alias("train_gap"), F.max(F.when(~F.col("_train"), gap)).alias("test_gap"))
    ratio = F.col("test_gap") / F.nullif("train_gap", F.lit(0.0))
    confirmed = F.coalesce(ratio.between(0.5, 2), F.lit(False))
    if not names:
        return gaps.select("atom", "n", "train_gap", "test_gap", F.lit(1.0).alias("p"), F.lit(0).cast("long").alias("usable"), confirmed.alias("confirmed"))
    flags = {f"f{i}": F.array_contains(atoms, a).cast("double") for i, a in enumerate(names)}
    sums = apart(known.where("_train"), ["place"], flags, {"y": x}, length, samples, (), unit, seed)
    p = tested(sums.select("feature", "sample", of_target(difference, "y").alias("stat")), ["feature"])
    named = rows.sparkSession.createDataFrame([(f"f{i}", a) for i, a in enumerate(names)], "feature string, atom string")
    return gaps.join(p.join(F.broadcast(named), "feature"), "atom", "left").select("atom", "n", "train_gap", "test_gap", F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("usable", F.lit(0)).alias("usable"), confirmed.alias("confirmed"))
