"""What the two substring operators share: anchors of windows, prefixes of any length, and the tables around their kernels.

Every window of WINDOW symbols (words or bytes) has an anchor: the run of GRAM symbols inside it with
the least hash, the leftmost on ties. Equal windows have equal anchors at equal places, so a window
can only repeat if its anchor does. Consecutive windows with one anchor form a segment, and what stands from
the anchor on is the suffix that represents them. The steps:

1. Each row gives its anchors' hashes; equal texts are one class, of which only the first goes on.
2. Hashes that occur more than once are found by counting, and the rows that have them.
3. The segments of those anchors are grouped by a prefix of their suffixes, at first the anchor itself.
   Equal segments of one batch are sent once. A prefix that gathers more than GROUP_ROWS segments is lengthened: its
   segments split by their windows' distance from the anchor, so that the windows of a part have more
   symbols in common, up to the whole window, where a group is one repeat and needs no kernel.
4. The kernels say which windows of a group repeat.
5. The repeated windows of a row come together and its text is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import cut, doc_order, join_one, narrow_batches, row_key, row_print, shuffle_partitions

#: Segments of one prefix that a kernel gets together; a prefix with more of them is lengthened.
GROUP_ROWS = 20_000
#: By how much the windows of one part become fewer when a prefix is lengthened.
FEWER = 4
#: Rows of 8 bytes that are broadcast at most: doc_ids that pick texts before these are shuffled, and prefixes.
BROADCAST_ROWS = 1_000_000
LOW = np.uint64(0xFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of n values of the uint64 array x, by doubling."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    done, h, out, width = 0, x, None, 1
    power = STEP
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                if out is None:
                    out, done = h, width
                else:
                    # The run so far, then one of this width.
                    out = out[: len(x) - done - width + 1] * power + h[done : done + len(x) - done - width + 1]
                    done += width
            if done == n:
                return mixed(out)
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2


def minimizers(g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows over span gram hashes: place, first and last window of each."""
    n = len(g) - span + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    m = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: n], m[span - width : span - width + n])
    change = np.flatnonzero(m[1:] != m[:-1]) + 1
    lo, hi = np.concatenate([[0], change]), np.concatenate([change, [n]]) - 1
    return (m[lo] & LOW).astype(np.int64), lo, hi


@dataclass(frozen=True)
class Kind:
    """How texts are read: symbols as uint64 hashes, the values that kernels get, and the parts that are kept."""

    window: int
    gram: int
    symbols: Callable[[bytes], tuple[np.ndarray, np.ndarray]]  # text -> hashes of its symbols, compact values of them
    whole: Callable[[bytes], bytes]  # text -> what is kept when nothing is removed
    kept: Callable[[bytes, np.ndarray], bytes]  # text, mask of kept symbols -> what is kept
    value_bytes: int  # bytes of a symbol's value

    def anchors(self, hashes: np.ndarray):
        g = rolling(hashes, self.gram)
        a, lo, hi = minimizers(g, self.window - self.gram + 1)
        return g[a], a, lo, hi


def _described(kind: Kind):
    def describe(batches):
        for batch in batches:
            sizes, keys, sums, grams = [], [], [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                hashes, values = kind.symbols(raw)
                g, *_ = kind.anchors(hashes)
                whole = kind.whole(raw)
                sizes.append(len(hashes))
                keys.append(hashlib.blake2b(whole, digest_size=16).digest())
                sums.append(hashlib.sha256(whole).hexdigest())
                grams.append(g.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sums, pa.string()), pa.array(grams, pa.binary())],
                names=["doc_id", "print", "size", "key", "whole_sha256", "grams"],
            )

    return describe


def _unrolled(batches):
    for batch in batches:
        raw = batch.column("grams").to_pylist()
        ids = np.repeat(batch.column("row_id").to_numpy(), [len(r) // 8 for r in raw])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["row_id", "gram"])


#: Rows that go to the kernels; without values: windows that are known to repeat.
SEGMENT = pa.schema([("gram", pa.int64()), ("rank", pa.int64()), ("row_id", pa.int64()), ("start", pa.int32()), ("anchor", pa.int32()), ("windows", pa.int32()), ("values", pa.binary())])
SEGMENT_SQL = "gram long, rank long, row_id long, start int, anchor int, windows int, values binary"
MARK_SQL = "row_id long, start int, windows int"


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _binary(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Arrow binaries of runs of values; null where not valid."""
    lengths = np.where(valid, lengths, 0)
    data = values[_ragged(starts, lengths)]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * values.itemsize
    bits = np.packbits(valid, bitorder="little")
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [pa.py_buffer(bits), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _run_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of symbols, from sums of powers."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), STEP)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), np.uint64(pow(int(STEP), -1, 1 << 64)))]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes) * powers[:-1])])
    return mixed((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64) * MIX)


def _sent_once(gram, rank, row, start, anchor, windows, same, values: np.ndarray, at: np.ndarray, sizes: np.ndarray, mark_first: bool) -> pa.RecordBatch:
    """Segments of a batch, with runs of values from ``at`` on; equal ones (by the hash ``same``) once, the earliest.

    The others come out as marks (values null), and with mark_first the earliest of several too.
    """
    key = mixed(same ^ mixed(gram + anchor.astype(np.uint64)))
    order = np.lexsort((start, row, rank, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.empty(0, bool)
    later = np.empty(len(order), bool)
    later[order] = ~new
    take, plain = np.arange(len(order)), ~later
    if mark_first and len(order):
        several = order[new][np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])) > 1]
        take, plain = np.concatenate([take, several]), np.concatenate([plain, np.zeros(len(several), bool)])
    ints = [pa.array(x[take].astype(np.int32)) for x in (start, anchor, windows)]
    return pa.RecordBatch.from_arrays([pa.array(gram[take].view(np.int64)), pa.array(rank[take]), pa.array(row[take]), *ints, _binary(values, at[take], sizes[take], plain)], schema=SEGMENT)


def segments_of(kind: Kind, mark_first: bool):
    """Rows (row_id, rank, text, grams array) -> segments of the named anchors, equal ones of a batch once."""

    def run(batches):
        for batch in batches:
            offsets = batch.column("grams").offsets.to_numpy()
            grams = batch.column("grams").values.to_numpy().view(np.uint64)
            parts, texts, base = [], [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes, values = kind.symbols(text.encode("utf-8", "surrogatepass"))
                g, a, lo, hi = kind.anchors(hashes)
                named = np.unique(grams[offsets[i] : offsets[i + 1]])
                k = np.flatnonzero(named[np.minimum(np.searchsorted(named, g), len(named) - 1)] == g)
                windows = hi[k] - lo[k] + 1
                parts.append((np.full(len(k), i), g[k], lo[k], a[k] - lo[k], windows, _run_hashes(hashes, lo[k], windows + (kind.window - 1)), base + lo[k]))
                texts.append(values)
                base += len(values)
            if parts:
                doc, g, start, anchor, windows, same, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                rank, row = batch.column("rank").to_numpy()[doc], batch.column("row_id").to_numpy()[doc]
                yield _sent_once(g, rank, row, start, anchor, windows, same, np.concatenate(texts), at, windows + (kind.window - 1), mark_first)

    return run


def spans(kind: Kind) -> list[int]:
    """Most windows of a segment under each length of prefixes, from the anchor to the whole window."""
    out = [kind.window - kind.gram + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // FEWER))
    return out


def lengthened(kind: Kind, span: int, mark_first: bool):
    """Segments -> their parts of at most ``span`` windows, by distance from the anchor, with an anchor that all windows of the part hold.

    The part's prefix begins at that anchor and has window - span + 1 symbols.
    """
    from xxhash import xxh64_intdigest

    width = kind.value_bytes
    common = (kind.window - span + 1) * width

    def run(batches):
        for batch in batches:
            rows, texts, base = [], [], 0
            for i, (start, anchor, windows, values) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "anchor", "windows", "values")), strict=True)):
                texts.append(values)
                # Window w begins anchor - w symbols before the anchor.
                for j in range((anchor - windows + 1) // span, anchor // span + 1):
                    first, last = max(0, anchor - (j + 1) * span + 1), min(windows - 1, anchor - j * span)
                    moved = anchor - j * span - first
                    part = values[first * width : (last + kind.window) * width]
                    key = xxh64_intdigest(part[moved * width : moved * width + common], j)
                    rows.append((i, start + first, moved, last - first + 1, xxh64_intdigest(part), base // width + first, key))
                base += len(values)
            if rows:
                i, start, anchor, windows, same, at = (np.array(x, np.uint64 if k == 4 else np.int64) for k, x in enumerate(list(zip(*rows, strict=True))[:6]))
                gram = mixed(batch.column("gram").to_numpy()[i].view(np.uint64) ^ np.array([r[6] for r in rows], np.uint64))
                values = np.frombuffer(b"".join(texts), f"u{width}")
                yield _sent_once(gram, batch.column("rank").to_numpy()[i], batch.column("row_id").to_numpy()[i], start, anchor, windows, same, values, at, windows + (kind.window - 1), mark_first)

    return run


def grouped(kind: Kind, found: DataFrame, mark_first: bool, group_rows: int | None = None) -> tuple[list[tuple[int, DataFrame]], DataFrame | None, DataFrame]:
    """Segments of found rows in groups (column gram) of at most group_rows.

    Result: for each length of prefixes in use, that length and its groups; windows whose prefix is the window itself
    and which are too many for a kernel, if there are any; marks of windows that are known to repeat.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    segments = cut(found.mapInArrow(segments_of(kind, mark_first), SEGMENT_SQL))
    marks, out, levels = segments.where("values IS NULL"), [], spans(kind)
    for level, span in enumerate(levels):
        rows = segments.where("values IS NOT NULL")
        sizes = rows.groupBy("gram").agg(F.count("*").alias("n"))
        # As many rows as all segments through the limit, at most.
        large = cut(sizes.where(F.col("n") > limit).withColumn("in_group", F.col("n")))
        number = large.count()
        if not number:
            return [*out, (kind.window - span + 1, rows)], None, marks.select("row_id", "start", "windows")
        if number <= BROADCAST_ROWS:
            small, hot = (rows.join(F.broadcast(large.select("gram")), "gram", how).select(SEGMENT.names) for how in ("left_anti", "left_semi"))
        else:
            met = join_one(rows, large, "gram", "n", rows.count())
            small, hot = met.where("in_group IS NULL").drop("in_group"), met.where("in_group IS NOT NULL").drop("in_group")
        out.append((kind.window - span + 1, small))
        if span == 1:
            return out, hot, marks.select("row_id", "start", "windows")
        segments = cut(hot.mapInArrow(lengthened(kind, levels[level + 1], mark_first), SEGMENT_SQL))
        marks = marks.unionByName(segments.where("values IS NULL"))
    raise AssertionError("the last prefix is the window")


def describe(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """All rows with row_id, and classes of equal content with their first row by doc_id, those without one last."""
    narrow_batches(docs)
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_print().alias("print"), "text").mapInArrow(_described(kind), f"doc_id {key}, print long, size long, key binary, whole_sha256 string, grams binary")
    rows = cut(rows.withColumn("row_id", F.monotonically_increasing_id()))
    classes = cut(rows.where(F.col("size") >= kind.window).groupBy("key").agg(F.min(doc_order("row_id")).alias("first"), F.count("*").alias("copies")).select("key", F.col("first.row_id").alias("first_row"), "copies"))
    return rows, classes


def suspects(docs: DataFrame, kind: Kind, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """First rows of classes that have an anchor that occurs again: row_id, rank, text, and those anchors' hashes."""
    first = rows.join(classes.select(F.col("first_row").alias("row_id")), "row_id", "left_semi")
    grams = first.select("row_id", "grams").mapInArrow(_unrolled, "row_id long, gram long")
    counts = cut(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").withColumn("often", F.lit(True)))
    known = counts.agg(F.count("*").alias("grams"), F.sum("n").alias("rows")).first()
    if known["grams"] <= BROADCAST_ROWS:
        met = grams.join(F.broadcast(counts.select("gram")), "gram")
    else:
        met = join_one(grams, counts, "gram", "n", known["rows"]).where("often")
    hits = met.groupBy("row_id").agg(F.collect_list("gram").alias("grams"))
    named = cut(hits.join(rows.select("row_id", "doc_id", "print", row_key().alias("key")), "row_id"))
    texts = docs.select(row_key().alias("key"), row_print().alias("print"), "text")
    if named.count() <= BROADCAST_ROWS:
        # Only texts that are wanted are shuffled. Beyond that many the join alone picks them.
        texts = texts.join(F.broadcast(named.select("key", "print")), ["key", "print"], "left_semi")
    # A row is known by its doc_id and text together. Rows alike in both become one before they are shuffled.
    once = texts.groupBy("key", "print").agg(F.first("text").alias("text"))
    return cut(once.join(_ranked(named), ["key", "print"]).select("row_id", "rank", "text", "grams"))


def _ranked(named: DataFrame) -> DataFrame:
    """named(row_id, doc_id, ...) with rank, a number that orders rows by doc_id, those without one last."""
    if isinstance(named.schema["doc_id"].dataType, IntegralType):
        return named.withColumn("rank", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    # Ranges of the order, each in order: numbers that grow with the range and within it.
    place = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id")]
    ordered = named.select("row_id", "doc_id").repartitionByRange(shuffle_partitions(named), *place).sortWithinPartitions(*place)
    return named.join(cut(ordered.select("row_id", F.monotonically_increasing_id().alias("rank"))), "row_id")


def removed(kind: Kind, found: DataFrame, marks: DataFrame) -> DataFrame:
    """For each row with repeated windows: row_id, n_removed, n_spans, kept_sha256."""

    def apply(batches):
        for batch in batches:
            ids, counts, spans, sums = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("row_id", "text", "starts", "lengths"))
            for row_id, text, starts, lengths in zip(*columns, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n = len(kind.symbols(raw)[0])
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, np.array(starts, np.int64), 1)
                np.add.at(steps, np.array(starts, np.int64) + np.array(lengths, np.int64) + (kind.window - 1), -1)
                gone = np.cumsum(steps)[:n] > 0
                ids.append(row_id)
                counts.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                sums.append(hashlib.sha256(kind.kept(raw, ~gone)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())], names=["row_id", "n_removed", "n_spans", "kept_sha256"])

    # Runs of one row that touch or repeat are many only where texts repeat themselves; each is two numbers.
    by_row = marks.distinct().groupBy("row_id").agg(F.collect_list(F.struct("start", "windows")).alias("m")).select("row_id", F.col("m.start").alias("starts"), F.col("m.windows").alias("lengths"))
    return found.select("row_id", "text").join(by_row, "row_id").mapInArrow(apply, "row_id long, n_removed long, n_spans long, kept_sha256 string")
