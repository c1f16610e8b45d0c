"""Writers: typed records into keyed stores, JSON lines, and row sinks in chunks with a way out for rows that fail."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.stores import Store, upserted


@dataclass(frozen=True)
class Kind:
    """A kind of record: its key, and the columns it must have with their types; more columns are kept."""

    key: tuple[str, ...]
    columns: Mapping[str, str]


KINDS = {
    "bars": Kind(("symbol", "t"), {"symbol": "string", "t": "bigint", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double"}),
    "features": Kind(("symbol", "t", "version"), {"symbol": "string", "t": "bigint", "version": "string", "vector": "array<double>"}),
    "events": Kind(("symbol", "t"), {"symbol": "string", "t": "bigint", "mask": "bigint", "context_mask": "bigint", "event_block_id": "string"}),
    "event_blocks": Kind(("symbol", "event_block_id"), {"symbol": "string", "event_block_id": "string", "total_rows": "bigint", "row_share": "double", "rarity": "string"}),
    "bar_states": Kind(("symbol", "t", "run_id"), {"symbol": "string", "t": "bigint", "run_id": "bigint", "group_id": "string", "state_seq": "bigint"}),
    "outcomes": Kind(("symbol", "t"), {"symbol": "string", "t": "bigint", "ret_pct": "double", "mfe_pct": "double", "mae_pct": "double", "valid": "boolean"}),
    "groups": Kind(("run_id", "group_id"), {"run_id": "bigint", "group_id": "string", "size": "bigint", "share": "double", "dominant_bias": "string", "up_share": "double", "avg_ret": "double", "centroid": "array<double>", "top_features": "map<string,double>", "name": "string"}),
    "transitions": Kind(("run_id", "transition_id"), {"run_id": "bigint", "transition_id": "string", "n": "bigint", "share": "double", "rarity": "string", "avg_ret": "double", "up_share": "double"}),
    "state_models": Kind(("symbol", "run_id"), {"symbol": "string", "run_id": "bigint", "version": "string", "model": "string"}),
    "range_models": Kind(("symbol", "run_id", "horizon"), {"symbol": "string", "run_id": "bigint", "horizon": "string", "accepted": "boolean", "model": "string"}),
    "evaluations": Kind(("candidate_id", "profile"), {"candidate_id": "string", "profile": "string", "symbol": "string", "t": "bigint", "score": "double", "rating": "string", "embedding": "array<double>"}),
    "candidates": Kind(("candidate_id",), {"candidate_id": "string", "symbol": "string", "t": "bigint", "research_score": "double"}),
}


def save(store: Store, kind: str, rows: DataFrame) -> None:
    """Upsert rows of a kind by its key. Columns are cast to the kind's types; one that is missing or a null in the key is an error."""
    spec = KINDS[kind]
    missing = [c for c in spec.columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{kind} lack {missing}")
    typed = rows.withColumns({c: F.col(c).cast(t) for c, t in spec.columns.items()})
    whole = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{kind}: null in {c}")).cast(spec.columns[c])).otherwise(F.col(c)).alias(c) if c in spec.key else F.col(c) for c in typed.columns]
    store.write(upserted(store.read(), typed.select(whole).dropDuplicates(list(spec.key)), list(spec.key)))


def payload_lines(rows: DataFrame) -> DataFrame:
    """value: one JSON object for each row, its columns under payload; names that begin with an underscore are left out."""
    return rows.select(F.to_json(F.struct(F.struct(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")]).alias("payload"))).alias("value"))


def dump_lines(rows: DataFrame, path: str) -> None:
    payload_lines(rows).write.text(path)


class NotRetryable(Exception):
    """A failure that comes again however often the row is sent."""


FAILURES = "sink string, attempts int, error string, row string"


def delivered(rows: DataFrame, sinks: Mapping[str, Callable[[list[dict]], None]], chunk: int = 500, tries: int = 3, pause: float = 0.0) -> DataFrame:
    """Send rows to every sink in chunks where they lie; the rows that a sink can't take: sink, attempts, error, row as JSON.

    A chunk that fails is sent again, then row by row; a row that fails with NotRetryable, or ``tries`` times, is a failure (a
    dead letter), and the others go on. Sinks must bear rows that come twice, as a lost executor's work is repeated. The
    result is lazy: writing it does the sending.
    """

    def attempt(sink: Callable, part: list[dict], times: int) -> tuple[int, str | None]:
        error = None
        for k in range(times):
            try:
                sink(part)
                return k + 1, None
            except NotRetryable as e:
                return k + 1, f"{type(e).__name__}: {e}"
            except Exception as e:  # a sink may raise anything; what it raised is reported
                error = f"{type(e).__name__}: {e}"
                time.sleep(pause)
        return times, error

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            lines = pdf["value"].tolist()
            failed = []
            for at in range(0, len(lines), chunk):
                part = lines[at : at + chunk]
                for name, sink in sinks.items():
                    if attempt(sink, [json.loads(x) for x in part], 1)[1] is None:
                        continue
                    for x in part:
                        times, error = attempt(sink, [json.loads(x)], tries)
                        if error is not None:
                            failed.append((name, times, error, x))
            yield pd.DataFrame(failed, columns=["sink", "attempts", "error", "row"])

    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).mapInPandas(send, FAILURES)


def alive(cache: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Entries (key, at, ...) that were put in no longer than ttl seconds ago, the last of each key."""
    fresh = cache.where(F.col("at") > now - ttl)
    names = [c for c in cache.columns if c != "key"]
    return fresh.groupBy("key").agg(F.max(F.struct("at", *[c for c in names if c != "at"])).alias("_e")).select("key", "_e.*")


def reclaimed(pending: DataFrame, now: Column, idle: int = 60, most: int = 3) -> DataFrame:
    """Pending messages (id, consumer, taken_at, deliveries) that nobody acknowledged for idle seconds: adds dead, when they were tried often enough."""
    return pending.where(F.col("taken_at") <= now - idle).withColumn("dead", F.col("deliveries") >= most)


def schema_of(kind: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in KINDS[kind].columns.items()))
