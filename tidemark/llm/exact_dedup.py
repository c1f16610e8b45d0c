"""Exact duplicates by a Golomb-coded exchange of fingerprints.

Every task sorts the distinct 64-bit fingerprints of the rows it reads, cuts them into one range for
each owner and sends each range as a Golomb-Rice coded list of differences. An owner decodes what
it gets, counts every fingerprint over all lists and answers each list with a bitmap over it. A
list's sender and owner name it, and its answer is applied to that list itself, so it doesn't
matter how rows are split into tasks. Fingerprints whose bit is set are suspects; only their
texts are shuffled, and there the bytes themselves are grouped.

A fingerprint travels once per task however often the task reads it, so a text that makes up a
third of all rows costs one entry per task; the byte check groups with map-side combining, and what is
known of such a text comes back to its rows by broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, cut, doc_order, join_one, row_print, shuffle_partitions, text_or_empty

#: Up to this many duplicated fingerprints (8 bytes each) are broadcast to find the suspects' texts; beyond it they are joined.
BROADCAST_ROWS = 200_000


def golomb_encode(values: np.ndarray) -> bytes:
    """Rice code of ascending distinct uint64 values, relative to the first.

    Layout: count (8 bytes), first value (8), remainder width (1), length of the unary part in
    bytes (8), unary quotients, fixed-width remainders.
    """
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values) - np.uint64(1)
    mean = float(gaps.mean()) if n > 1 else 0.0
    width = max(0, int(np.log2(mean * 0.6931 + 1e-9))) if mean >= 2 else 0
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ones = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    unary[ones] = 1
    unary_bytes = np.packbits(unary).tobytes()
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    remainders = np.packbits(((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()
    head = np.array([n, int(values[0])], np.uint64).tobytes() + bytes([width]) + np.uint64(len(unary_bytes)).tobytes()
    return head + unary_bytes + remainders


def golomb_decode(payload: bytes) -> np.ndarray:
    """Inverse of golomb_encode."""
    if not payload:
        return np.empty(0, np.uint64)
    n, first = np.frombuffer(payload, np.uint64, 2)
    n, width = int(n), payload[16]
    size = int(np.frombuffer(payload[17:25], np.uint64)[0])
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(payload, np.uint8, size, 25)))[: n - 1]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(width)
    if width and n > 1:
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, offset=25 + size))[: (n - 1) * width].reshape(n - 1, width)
        shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
        gaps += (bits.astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    out = np.empty(n, np.uint64)
    out[0] = first
    np.cumsum(gaps + np.uint64(1), out=out[1:])
    out[1:] += first
    return out


def bitmaps_of(payloads: list[bytes], repeated: list[bytes]) -> list[bytes]:
    """What an owner answers: for each list, a bit for every fingerprint that occurs more than once over all lists.

    repeated: for each list, the bits of the fingerprints that its block holds more than once.
    """
    lists = [golomb_decode(p) for p in payloads]
    flags = [np.unpackbits(np.frombuffer(r, np.uint8))[: len(x)].astype(bool) for r, x in zip(repeated, lists, strict=True)]
    values, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    many = counts > 1
    np.logical_or.at(many, back, np.concatenate(flags))
    ends = np.cumsum([len(x) for x in lists])
    return [np.packbits(many[part]).tobytes() for part in np.split(back, ends[:-1])]


def _sent(owners: int):
    """For rows of (fp): one coded list for each owner, named by the task and the owner."""
    edges = np.array([(k << 64) // owners for k in range(1, owners)], dtype=np.uint64)

    def send(batches):
        held = [batch.column(0).to_numpy().view(np.uint64) for batch in batches]
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
        cuts = np.searchsorted(values, edges, side="left")
        rows = [(k, x, c) for k, (x, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts), strict=True)) if len(x)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in rows], pa.int32()),
                pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()),
                pa.array([golomb_encode(x) for _, x, _ in rows], pa.binary()),
                pa.array([np.packbits(c > 1).tobytes() for _, _, c in rows], pa.binary()),
            ],
            names=["owner", "sender", "payload", "repeated"],
        )

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One owner: a bitmap for every list it got."""
    return pd.DataFrame({"owner": pdf["owner"], "sender": pdf["sender"], "bits": bitmaps_of(list(pdf["payload"]), list(pdf["repeated"]))})


def _marked(batches):
    """Lists with their bitmaps: the fingerprints whose bit is set."""
    for batch in batches:
        for payload, bits in zip(batch.column("payload").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            values = golomb_decode(payload)
            many = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(values)].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64))], names=["fp"])


def duplicated_fingerprints(prints: DataFrame, total: int, owners: int | None = None) -> DataFrame:
    """Distinct fp values of prints(fp long), of ``total`` rows, that more than one row has."""
    # An owner decodes what it gets: about a million fingerprints at most.
    owners = owners or max(shuffle_partitions(prints), total // 1_000_000 + 1)
    sent = cut(prints.select("fp").mapInArrow(_sent(owners), "owner int, sender int, payload binary, repeated binary"))
    answers = sent.groupBy("owner").applyInPandas(_answer, "owner int, sender int, bits binary")
    return sent.select("owner", "sender", "payload").join(answers, ["owner", "sender"]).mapInArrow(_marked, "fp long").distinct()


def normalised(name: str = "text") -> Column:
    """The text with each run of blanks and control characters 9 to 13 as one blank."""
    return F.regexp_replace(text_or_empty(name), SPACES, " ")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after ``normalised``; a null text counts as empty. Of equal
    texts the row with the smallest doc_id stays (rows without doc_id last); when that doc_id has
    several such rows exactly one of them stays. Other columns are ignored. An empty table gives an
    empty result. The column print, with doc_id, names a row by its text.
    """
    norm = docs.select("doc_id", row_print().alias("print"), normalised().alias("norm")).select("doc_id", "print", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"), "norm")
    rows = cut(norm.drop("norm").select("*", F.monotonically_increasing_id().alias("row_id")))
    total = rows.count()
    suspect_prints = cut(duplicated_fingerprints(rows, total), total)
    small = suspect_prints.count() <= BROADCAST_ROWS
    suspects = F.broadcast(suspect_prints) if small else suspect_prints
    # The bytes themselves are grouped; two texts of one SHA-256 would stop the run.
    verified = (
        norm.select("fp", "text_sha256", "norm")
        .join(suspects, "fp", "left_semi")
        .groupBy("text_sha256", "norm")
        .agg(F.count("*").alias("n"))
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("group_size"), F.count("*").alias("texts"))
        .where(F.assert_true(F.col("texts") == 1, "two texts have one SHA-256").isNull())
        .where("group_size > 1")
        .select("text_sha256", "group_size")
    )
    groups = rows.join(suspects, "fp", "left_semi").groupBy("text_sha256").agg(F.min(doc_order("row_id")).alias("first"))
    keep = cut(groups.join(verified, "text_sha256").select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"), "group_size", F.col("group_size").alias("n")), total)
    return join_one(rows, keep, "text_sha256", "n", total).select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row_id"))).alias("kept"),
        "text_sha256",
        "print",
    )
