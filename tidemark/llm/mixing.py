"""Mixing sources to target weights by cube-method balanced sampling.

A source with target rate r (words wanted per word it has) takes every document floor(r) times and
a balanced sample of its documents once more, each with probability r - floor(r). The sample is
drawn by the cube method: the vector of inclusion probabilities moves inside the null space of the
constraints (words and documents of the source) until units reach 0 or 1. The flight runs over
cells of bounded size in parallel and leaves at most two open units in each; the open units of all
cells of a source then fly together, level by level, and the last ones land so that the words come
closest to the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, cut, repeated, row_print, text_or_empty

#: Documents in a cell of the flight, about; and the most sources (one row each goes to the driver).
CELL_ROWS = 50_000
MOST_SOURCES = 1_000_000
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: share * sum(sizes) by weight, none above most * its size.

    The excess of capped sources is reshared by weight until none is above its cap.
    """
    want, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(share, most) * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                want[i] = weights[i] * unit
            break
        for i in over:
            want[i] = most * sizes[i]
            left -= want[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return want


def flight(sizes: list[float], probs: list[float], draws: list[float]) -> list[float]:
    """Cube flight with two constraints: sum of probabilities and of size times probability stay.

    Three open units move along the vector orthogonal to (1, 1, 1) and their sizes, up or down by a
    draw that keeps every expectation, until one is 0 or 1. At most two units stay open.
    """
    p, open_ = list(probs), []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(open_, u, strict=True) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(open_, u, strict=True) if v)
            step = up if draws[i] * (up + down) < down else -down
            for k, v in zip(open_, u, strict=True):
                p[k] += step * v
                if p[k] < EPS:
                    p[k] = 0.0
                elif p[k] > 1 - EPS:
                    p[k] = 1.0
            open_ = [k for k in open_ if 0 < p[k] < 1]
    return p


def landing(sizes: list[float], probs: list[float], taken: float, wanted: float) -> list[float]:
    """Round the few open units so that the words taken come closest to wanted.

    An open unit may be much larger than what is missing; then single units are changed, each the one
    that brings the total closest, as long as that helps.
    """
    p = list(probs)
    open_ = [i for i, x in enumerate(p) if 0 < x < 1][:12]
    base = taken + sum(s for s, x in zip(sizes, p, strict=True) if x == 1)
    best = min(range(1 << len(open_)), key=lambda bits: abs(base + sum(sizes[i] for k, i in enumerate(open_) if bits >> k & 1) - wanted))
    for k, i in enumerate(open_):
        p[i] = float(best >> k & 1)
    size, chosen = np.array(sizes, float), np.array(p) >= 0.5
    missing = wanted - taken - float(size[chosen].sum())
    for _ in range(len(p)):
        change = np.where(chosen, -size, size)
        i = int(np.abs(missing - change).argmin())
        if abs(missing - change[i]) >= abs(missing) - EPS:
            break
        missing -= float(change[i])
        chosen[i] = not chosen[i]
    return chosen.astype(float).tolist()


def _moved(table: pa.Table, land: bool) -> pa.Table:
    """One cell: its probabilities after the flight, and after landing if no more units of its stratum fly."""
    size, draw, prob = (table.column(c).to_numpy() for c in ("size", "draw", "prob"))
    # Large documents first: the units left open are small, and so is what landing them costs.
    order = np.lexsort((table.column("nth").to_numpy(), table.column("print").to_numpy(), table.column("tie").to_numpy(), draw, -size))
    sizes = size[order].astype(float).tolist()
    p = flight(sizes, prob[order].tolist(), draw[order].tolist())
    if land:
        p = landing(sizes, p, float(table.column("taken")[0].as_py()), float(table.column("extra")[0].as_py()))
    out = np.empty(len(p))
    out[order] = p
    return table.set_column(table.schema.get_field_index("prob"), "prob", pa.array(out))


def cube_sample(units: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Balanced sample of units(stratum, size long, prob double, doc_id, print long, nth long; more pass through): adds included.

    prob is one value for a stratum. In each stratum the sum of sizes and the number of units come
    near their expectations. All draws are hashes of (doc_id, print, nth), which names a unit; so the
    sample doesn't depend on how the rows are dealt to tasks. cell_rows: units that fly together, about.
    """
    names = units.columns
    tie = F.xxhash64("doc_id", "print", "nth")
    draw = F.pmod(F.xxhash64(tie, F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    flying = f"prob > {EPS} and prob < {1 - EPS}"
    still = units.where(f"not ({flying})").withColumn("included", F.col("prob") > 0.5)
    open_ = cut(units.where(flying).withColumns({"tie": tie, "draw": draw}))
    columns, schema = open_.columns, open_.schema
    # Whole numbers, so that no order of adding changes them.
    wanted = open_.groupBy("stratum").agg((F.sum("size") * F.max("prob")).alias("extra"))
    done, rounds = [], 0
    while True:
        largest = open_.groupBy("stratum").agg(F.count("*").alias("units"))
        if (largest.agg(F.max("units")).first()[0] or 0) <= cell_rows:
            break
        cells = largest.select("stratum", F.ceil(F.col("units") / cell_rows).alias("cells"))
        # The draw decides in a cell; the cell is dealt by another hash of the unit.
        dealt = open_.join(F.broadcast(cells), "stratum").withColumn("cell", F.pmod(F.xxhash64("tie", F.lit(rounds)), "cells"))
        flown = cut(dealt.groupBy("stratum", "cell").applyInArrow(lambda t: _moved(t, False).select(columns), schema))
        done.append(flown.where("prob = 0 or prob = 1"))
        open_ = flown.where("prob > 0 and prob < 1")
        rounds += 1
    taken = wanted.withColumn("taken", F.lit(0).cast("long"))
    if done:
        gone = done[0]
        for more in done[1:]:
            gone = gone.unionByName(more)
        sums = gone.where("prob = 1").groupBy("stratum").agg(F.sum("size").alias("got"))
        taken = wanted.join(sums, "stratum", "left").select("stratum", "extra", F.coalesce("got", F.lit(0)).alias("taken"))
    landed = open_.join(F.broadcast(taken), "stratum").groupBy("stratum").applyInArrow(lambda t: _moved(t, True).select(columns), schema)
    for more in done:
        landed = landed.unionByName(more)
    return still.unionByName(landed.select(*names, (F.col("prob") > 0.5).alias("included")))


def units_of(docs: DataFrame) -> DataFrame:
    """The units of the mix, one for each row of docs: doc_id, source, print, nth and size (words of the text; null: 0).

    Rows alike in doc_id, text and source are told apart by nth, from 0: counted where they are read, then told out.
    """
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    alike = docs.select("doc_id", "source", row_print().alias("print"), words.alias("size")).groupBy("doc_id", "source", "print").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    return cut(repeated(cut(alike), "n").withColumnRenamed("__tidemark_nth", "nth").drop("n"))


def mix_units(units: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Copies of each of ``units_of`` the documents: adds source_size, target and copies.

    Sources are ordered by code point, null last, and weigh ``cycle``, repeating. A source of no
    words has target 0 and no copies. copies is 0, 1 or 2 and never above ``most``.
    """
    spark = units.sparkSession
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = [r["source_size"] for r in sources]
    wanted = targets(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))], share, most)
    plan = []
    for i, r in enumerate(sources):
        rate = wanted[i] / sizes[i] if sizes[i] else 0.0
        whole = int(rate + EPS)
        plan.append((i, r["source"], r["source_size"], wanted[i], whole, max(0.0, rate - whole)))
    plan = spark.createDataFrame(plan, T.StructType([T.StructField("stratum", T.LongType())] + [T.StructField("source", units.schema["source"].dataType)] + [T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.IntegerType()), T.StructField("prob", T.DoubleType())]))
    planned = units.join(F.broadcast(plan.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return cube_sample(planned, cell_rows).select("doc_id", "print", "source", "size", "source_size", "target", (F.col("whole") + F.col("included").cast("int")).alias("copies"))


def mix(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """How often the mix takes each row of docs(doc_id, text, source).

    Columns: doc_id, size, source_size, target, taken (size times copies), copies, print. Rows that repeat
    are separate units. A null text has size 0; a null source is a source; a null doc_id is a value as any
    other. Empty table: empty result. Other columns are ignored, whatever their names. The result depends on the
    rows alone, not on their order or partitions.
    """
    return mix_units(units_of(docs), cell_rows=cell_rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "print")
