"""Near duplicates by a chosen-path set similarity join.

Texts with one shingle set are one class. Each class has a signature of minwise tokens, some of them of
each tree's own. A tree starts from all classes; at a node every class goes on to the children named by
BRANCH of its minwise tokens, which the node's own hash selects, so similar classes share children; no
token is selected twice on a path. A node that is small enough is compared exhaustively, in blocks; a
larger one branches again. Independent trees are repeated: a pair at the threshold whose paths all go
to the last level is missed by one tree with a chance of 0.16 and by all with 4e-7, by simulation.

Two things keep dense groups from costing the square of their size. First every class is linked
with a center of each of its first nodes: the least class, in larger nodes the one most like what the node's
members have in common, which is the origin of a group of edited copies. The links are confirmed, and
most groups are components before any pairs are formed. Then only nodes that hold several components
are compared, and only pairs across components, each under the first tree that brings it together.
Nothing is capped. What stays quadratic is a node of the last level: rows that agree in LEVELS minwise tokens but
lie in several components; its blocks are compared in as many tasks as there are pairs of blocks.

All links are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, doc_order, join_one, narrow_batches, row_key, row_print
from tidemark.llm.components import components

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Trees; children of a class at a node; levels of a tree.
TREES, BRANCH, LEVELS = 8, 2, 6
#: Minwise tokens of all roots, one for each child of a root; and those each tree has for its deeper levels.
ROOTS, DEEP = TREES * BRANCH, 16
#: Rows up to which a node is compared at once, and up to which it is compared at all before it branches.
LEAF, NODE = 48, 4096
#: Bytes of the sketch, one of each of so many minwise hashes; and how many of them must agree before sets are
#: fetched: fewer agree with a chance of 1e-5 at the threshold.
SKETCH, LEAST_EQUAL = 512, 343
#: Of the sketch's first bytes, looked at first: fewer than so many agree with a chance below 1e-6 at the threshold.
HEAD, LEAST_HEAD = 64, 30
#: Rows of a block of a large node.
BLOCK = 256
#: Classes whose texts are found by broadcasting their keys (about 60 bytes each); more are found by a shuffle.
BROADCAST_ROWS = 500_000

_rng = np.random.Generator(np.random.PCG64(20240131))
_ROOT_MULTIPLIERS = _rng.integers(1, 2**63, ROOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _rng.integers(0, 2**31, SKETCH - ROOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Shingles that are multiplied at once: so many rows of products stay in a core's cache.
_AT_ONCE = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles: runs of WORDS words, or all its words if fewer; empty without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A to Z only, blanks 9 to 13 and 32 only
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([xxh64_intdigest(x) for x in words], np.uint64)
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _STEP + w[k : len(w) - n + 1 + k]
    return np.unique(_mixed(h))


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set that isn't empty: its ROOTS tokens, DEEP tokens for each tree, and SKETCH bytes."""
    # Roots have all classes below them, so they take all 64 bits of each hash. For the others 32 are enough, and faster.
    short, root, least = (s >> np.uint64(32)).astype(np.uint32), np.full(ROOTS, 2**64 - 1, np.uint64), np.full(SKETCH - ROOTS, 2**32 - 1, np.uint32)
    for at in range(0, len(s), _AT_ONCE):
        np.minimum(root, (s[at : at + _AT_ONCE, None] * _ROOT_MULTIPLIERS).min(axis=0), out=root)
        np.minimum(least, (short[at : at + _AT_ONCE, None] * _MULTIPLIERS).min(axis=0), out=least)
    mixed = _mixed(np.concatenate([root, least.astype(np.uint64) * _STEP]))
    tokens = mixed >> np.uint64(32)
    return tokens[:ROOTS].astype(np.uint32), tokens[ROOTS : ROOTS + TREES * DEEP].astype(np.uint16), (mixed & np.uint64(255)).astype(np.uint8)


def print_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


DESCRIBED = "print long, n_shingles long, set_print binary, roots binary, deep binary, sketch binary"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("n_shingles", "set_print", "roots", "deep", "sketch")}
        for text in batch.column("text"):
            s = shingles(text.as_py())
            out["n_shingles"].append(len(s))
            out["set_print"].append(print_of(s) if len(s) else None)
            for name, values in zip(("roots", "deep", "sketch"), signature(s) if len(s) else (None,) * 3, strict=True):
                out[name].append(None if values is None else values.tobytes())
        arrays = [pa.array(v, pa.int64() if c == "n_shingles" else pa.binary()) for c, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), *arrays], names=["doc_id", "print", *out])


def _matrix(column, kind, width: int) -> np.ndarray:
    """Rows of ``width`` values, from a column of binaries of that size."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _root_matrix(column) -> np.ndarray:
    return _matrix(column, np.uint32, ROOTS)


def _sketch_matrix(column) -> np.ndarray:
    return _matrix(column, np.uint8, SKETCH)


def root_nodes(roots: np.ndarray) -> np.ndarray:
    """First nodes of each row, a column for each child of a root."""
    return _mixed(_mixed((np.arange(ROOTS, dtype=np.uint64) + np.uint64(17)) * _STEP) + roots)


def children(nodes: np.ndarray, tree: np.ndarray, used: np.ndarray, deep: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row, its children and the places used on their paths; a node's hash selects places that its path hasn't used."""
    rows, out, taken = np.arange(len(nodes)), [], used.copy()
    for k in range(BRANCH):
        place = (_mixed(nodes + np.uint64(k)) % np.uint64(DEEP)).astype(np.int64)
        for _ in range(DEEP):
            place = np.where(taken >> place & 1 == 1, (place + 1) % DEEP, place)
        taken |= 1 << place
        token = deep[rows, tree * DEEP + place].astype(np.uint64)
        out.append((_mixed(_mixed(nodes ^ (place.astype(np.uint64) + np.uint64(1)) * _STEP) + token), used | (1 << place)))
    return out


def _rooted(batches):
    for batch in batches:
        ids = batch.column("cls").to_numpy()
        if len(ids):
            nodes = root_nodes(_root_matrix(batch.column("roots")))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64).ravel()), pa.array(np.repeat(ids, ROOTS)), pa.array(np.tile(np.arange(ROOTS, dtype=np.int32), len(ids)))], names=["node", "cls", "root"])


GROWN = "node long, cls long, comp long, tree int, used int"


def _grown(batches):
    for batch in batches:
        if batch.num_rows:
            node, cls, comp, tree, used = (batch.column(c).to_numpy() for c in ("node", "cls", "comp", "tree", "used"))
            kids = children(node.view(np.uint64), tree.astype(np.int64), used.astype(np.int64), _matrix(batch.column("deep"), np.uint16, TREES * DEEP))
            n = len(kids)
            nodes, masks = (np.concatenate([k[i] for k in kids]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *(pa.array(np.tile(x, n)) for x in (cls, comp, tree)), pa.array(masks.astype(np.int32))], names=["node", "cls", "comp", "tree", "used"])


def _votes(batches):
    """Rows (node, sketch) -> for each node of a batch, the commonest byte at each place and its count."""
    for batch in batches:
        nodes, back = np.unique(batch.column("node").to_numpy(), return_inverse=True)
        sketches = _sketch_matrix(batch.column("sketch"))
        order = np.argsort(back, kind="stable")
        cuts = np.searchsorted(back[order], np.arange(len(nodes) + 1))
        values, counts, rows = [], [], np.diff(cuts)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            m = sketches[order[lo:hi]]
            tally = np.stack([np.bincount(m[:, k], minlength=256) for k in range(SKETCH)])
            values.append(tally.argmax(axis=1).astype(np.uint8).tobytes())
            counts.append(tally.max(axis=1).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary()), pa.array(counts, pa.binary()), pa.array(rows, pa.int64())], names=["node", "bytes", "counts", "rows"])


def _elected(pdf: pd.DataFrame) -> pd.DataFrame:
    """One node's votes, one row for each batch -> its common sketch."""
    tally = np.zeros((SKETCH, 256), np.int64)
    for values, counts in zip(pdf["bytes"], pdf["counts"], strict=True):
        tally[np.arange(SKETCH), np.frombuffer(values, np.uint8)] += np.frombuffer(counts, np.uint32)
    return pd.DataFrame({"node": pdf["node"].iloc[:1], "common": [tally.argmax(axis=1).astype(np.uint8).tobytes()], "size": [int(pdf["rows"].sum())]})


def _likened(batches):
    """Rows (node, cls, sketch, common) -> how many bytes agree."""
    for batch in batches:
        equal = (_sketch_matrix(batch.column("sketch")) == _sketch_matrix(batch.column("common"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("cls"), pa.array(equal.astype(np.int64))], names=["node", "cls", "equal"])


def _pairs_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ([], [])))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _first_root(x: np.ndarray, y: np.ndarray, grown: np.ndarray) -> np.ndarray:
    """For rows of root tokens x and y: the first root node they share that didn't branch (bits of grown tell), else -1."""
    shared = (x == y) & (grown[:, None] >> np.arange(ROOTS) & 1 == 0)
    return np.where(shared.any(axis=1), shared.argmax(axis=1), -1)


@dataclass
class _Rows:
    """Rows of a node or block as arrays."""

    cls: np.ndarray
    comp: np.ndarray
    root: np.ndarray
    grown: np.ndarray
    roots: np.ndarray
    sketch: np.ndarray

    @classmethod
    def of(cls, column) -> _Rows:
        """Of an Arrow struct array or table."""
        get = column.field if isinstance(column, pa.StructArray) else column.column
        numbers = (get(c).to_numpy(zero_copy_only=False) if isinstance(column, pa.StructArray) else get(c).to_numpy() for c in ("cls", "comp", "root", "grown"))
        return cls(*numbers, _root_matrix(get("roots")), _sketch_matrix(get("sketch")))


ITEM = ("cls", "comp", "root", "grown", "roots", "sketch")


def _across(x: _Rows, y: _Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of those pairs (row i of x, row j of y) that are likely, lie in two components and have this node as their first."""
    apart = x.comp[i] != y.comp[j]
    i, j = i[apart], j[apart]
    for size, least in ((HEAD, LEAST_HEAD), (SKETCH, LEAST_EQUAL)):
        like = np.count_nonzero(x.sketch[i, :size] == y.sketch[j, :size], axis=1) >= least
        i, j = i[like], j[like]
    root = x.root[i]
    due = (root < 0) | (_first_root(x.roots[i], y.roots[j], x.grown[i]) == root)
    return x.cls[i[due]], y.cls[j[due]]


def _compared(table: pa.Table) -> pa.RecordBatch:
    nodes, rows = table.column("node").to_numpy(), _Rows.of(table)
    cuts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1], [True]]))
    found = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo > 1:
            i, j = np.triu_indices(hi - lo, 1)
            found.append(_across(rows, rows, lo + i, lo + j))
    return _pairs_batch(found)


def _leaf_pairs(batches):
    """Rows sorted by node -> likely pairs across components in each node."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        nodes = held.column("node").to_numpy()
        # The last node may go on in the next batch.
        before = np.flatnonzero(nodes != nodes[-1]) if len(nodes) else nodes
        if len(before):
            yield _compared(held.slice(0, int(before[-1]) + 1))
            held = held.slice(int(before[-1]) + 1)
    if held is not None and held.num_rows:
        yield _compared(held)


def _block_pairs(batches):
    """Rows of two blocks of a node: likely pairs across components; main: the component that ``some`` leaves out."""
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            x, y = (_Rows.of(batch.column(c)[k].values) for c in ("some", "many"))
            main = batch.column("main")[k].as_py()
            heads = np.ascontiguousarray(y.sketch[:, :HEAD])
            near, far = [], []
            for row in range(len(x.cls)):
                j = np.flatnonzero(np.count_nonzero(heads == x.sketch[row, :HEAD], axis=1) >= LEAST_HEAD)
                # A pair of two rows outside the main component comes up twice.
                j = j[(y.comp[j] == main) | (y.cls[j] > x.cls[row])]
                near.append(np.full(len(j), row))
                far.append(j)
            found.append(_across(x, y, np.concatenate(near), np.concatenate(far)))
        yield _pairs_batch(found)


def _sets(batches):
    """Rows (text, cls) -> (cls, high, low): the set in order, as the upper and lower 32 bits of its hashes."""
    for batch in batches:
        sets = [shingles(text) for text in batch.column("text").to_pylist()]
        halves = [pa.array([(s >> np.uint64(shift)).astype(np.uint32).tobytes() for s in sets], pa.binary()) for shift in (32, 0)]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), *halves], names=["cls", "high", "low"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets reach the threshold."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sets of which only the upper halves are known may reach the threshold: values that the other has too are at least the common ones."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = min(int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) for a, b in ((x, y), (y, x)))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _near(batches):
    """Rows (a, b, high_a, high_b) -> the pairs that may link."""
    for batch in batches:
        sides = [[np.frombuffer(s, np.uint32) for s in batch.column(c).to_pylist()] for c in ("high_a", "high_b")]
        good = pa.array([_may_link(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])


def _confirmed(batches):
    for batch in batches:
        halves = {c: [np.frombuffer(s, np.uint32).astype(np.uint64) for s in batch.column(c).to_pylist()] for c in ("high_a", "low_a", "high_b", "low_b")}
        sides = [[h << np.uint64(32) | l for h, l in zip(halves[f"high_{e}"], halves[f"low_{e}"], strict=True)] for e in "ab"]
        good = pa.array([linked(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """Those of pairs(a, b) of classes whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("cls")).distinct().unionByName(pairs.select(F.col("b").alias("cls")).distinct()).distinct()
    wanted = cut(ends.join(classes, "cls").select("cls", "first_key", "first_print"), total)
    few = wanted.count() <= BROADCAST_ROWS
    keys = F.broadcast(wanted) if few else wanted
    # By doc_id and text: rows without doc_id, or of one, meet their own class only. Rows alike in both give one set.
    keyed = docs.select("text", row_key().alias("row_key"), row_print().alias("print"))
    texts = keyed.join(keys, (F.col("row_key") == F.col("first_key")) & (F.col("print") == F.col("first_print"))).select("text", "cls")
    sets = cut(texts.mapInArrow(_sets, "cls long, high binary, low binary").dropDuplicates(["cls"]))

    def ends_of(pairs: DataFrame, *parts: str) -> DataFrame:
        for e in "ab":
            pairs = pairs.join(sets.select(F.col("cls").alias(e), *[F.col(p).alias(f"{p}_{e}") for p in parts]), e)
        return pairs

    # Half of each set decides nearly all pairs; whole ones are only moved for those that may link.
    near = cut(ends_of(pairs, "high").mapInArrow(_near, "a long, b long"), total)
    return ends_of(near, "high", "low").mapInArrow(_confirmed, "a long, b long")


def _agreeing(batches):
    """Rows (a, b, sketch_a, sketch_b) -> the pairs whose sketches agree enough."""
    for batch in batches:
        good = pa.array((_sketch_matrix(batch.column("sketch_a")) == _sketch_matrix(batch.column("sketch_b"))).sum(axis=1) >= LEAST_EQUAL)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])


def _likely(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sketches agree enough."""
    with_both = pairs.join(tokens.select(F.col("cls").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(tokens.select(F.col("cls").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return with_both.mapInArrow(_agreeing, "a long, b long")


def _several(rows: DataFrame, total: int) -> DataFrame:
    """Rows of nodes that hold several components, with the node's row count n."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return join_one(rows, sizes.select("node", "n", F.col("n").alias("size")), "node", "size", total).where("n IS NOT NULL")


def _in_blocks(rows: DataFrame, tokens: DataFrame, total: int) -> DataFrame:
    """Likely pairs in larger nodes: rows outside a node's largest component against all its rows, block by block."""
    by = rows.groupBy("node", "comp").agg(F.count("*").alias("k"))
    most = by.groupBy("node").agg(F.max(F.struct("k", F.col("comp").alias("main"))).alias("m"), F.sum("k").alias("size")).select("node", "m.main", "size")
    full = join_one(rows, most, "node", "size", total).join(tokens, "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BLOCK)))
    many = full.groupBy("node", "block").agg(F.collect_list(F.struct(*ITEM)).alias("many"))
    some = full.where("comp <> main").groupBy("node", "block").agg(F.collect_list(F.struct(*ITEM)).alias("some"), F.first("main").alias("main"))
    return some.drop("block").join(many.drop("block"), "node").select("some", "many", "main").mapInArrow(_block_pairs, "a long, b long")


def _stars(shared: DataFrame, tokens: DataFrame, total: int) -> DataFrame:
    """Pairs of every class with the least class of its small nodes and, in larger nodes, with the class most like the node's common sketch."""
    least = shared.where((F.col("cls") != F.col("center")) & (F.col("n") <= LEAF)).select(F.col("center").alias("a"), F.col("cls").alias("b"))
    large = shared.where(F.col("n") > LEAF).join(tokens.select("cls", "sketch"), "cls").select("node", "cls", "sketch")
    common = large.select("node", "sketch").mapInArrow(_votes, "node long, bytes binary, counts binary, rows long").groupBy("node").applyInPandas(_elected, "node long, common binary, size long")
    rated = join_one(large, common, "node", "size", total).mapInArrow(_likened, "node long, cls long, equal long")
    origin = rated.groupBy("node").agg(F.max(F.struct("equal", (-F.col("cls")).alias("less"))).alias("m"), F.count("*").alias("size")).select("node", (-F.col("m.less")).alias("origin"), "size")
    spread = join_one(shared.where(F.col("n") > LEAF), origin, "node", "size", total).where("cls <> origin").select(F.least("origin", "cls").alias("a"), F.greatest("origin", "cls").alias("b"))
    return least.unionByName(spread).distinct()


def links_between_classes(classes: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """(member, root): components of classes under the similarity join. classes(cls, first_key, first_print), tokens(cls, roots, deep, sketch)."""
    total = classes.count()
    first = cut(tokens.select("cls", "roots").mapInArrow(_rooted, "node long, cls long, root int"))
    nodes = first.groupBy("node").agg(F.count("*").alias("n"), F.min("cls").alias("center")).where("n > 1").withColumn("size", F.col("n"))
    shared = cut(join_one(first, cut(nodes, total), "node", "size", ROOTS * total).where("n is not null"), total)
    likely = cut(_likely(_stars(shared, tokens, ROOTS * total), tokens), total)
    roots = components(_confirm(likely, classes, docs, total), total)

    # Nodes too large to be compared branch; pairs under them may be due at a later tree.
    branching = shared.where(F.col("n") > NODE).groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1L, root)")).alias("grown"))
    rows = shared.join(roots.withColumnRenamed("member", "cls").withColumnRenamed("root", "comp"), "cls", "left").join(branching, "cls", "left")
    rows = rows.select("node", "cls", "root", F.coalesce("comp", "cls").alias("comp"), F.coalesce("grown", F.lit(0).cast("long")).alias("grown"), F.floor(F.col("root") / BRANCH).cast("int").alias("tree"), F.lit(0).alias("used"))
    pairs = None
    for level in range(1, LEVELS + 1):
        rows = cut(_several(rows, ROOTS * total), total)
        leaves = rows.where(F.col("n") <= LEAF).join(tokens, "cls").repartition("node").sortWithinPartitions("node").select("node", *ITEM)
        found = leaves.mapInArrow(_leaf_pairs, "a long, b long")
        last = level == LEVELS
        found = found.unionByName(_in_blocks(rows.where(F.col("n") > LEAF) if last else rows.where((F.col("n") > LEAF) & (F.col("n") <= NODE)), tokens, ROOTS * total))
        pairs = found if pairs is None else pairs.unionByName(found)
        if last or (rows.agg(F.max("n")).first()[0] or 0) <= NODE:
            break
        kids = rows.where(F.col("n") > NODE).join(tokens, "cls").select("node", "cls", "comp", "tree", "used", "deep").mapInArrow(_grown, GROWN)
        rows = kids.withColumns({"root": F.lit(-1), "grown": F.lit(0).cast("long")})
    more = _confirm(cut(pairs.distinct(), total), classes, docs, total)
    return components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("member").alias("b"))), total)


def near_dedup(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of docs(doc_id, text): doc_id, n_shingles, component_id, kept, print.

    Words are runs of other characters than blanks and controls 9 to 13, A to Z in lower case; a
    text's set is that of its 5-word shingles, or its whole word sequence when it is shorter; texts are read whole,
    however long. Sets link from 75 of 100 on. component_id is the least doc_id reachable over links, the row's own
    included. A text without words, or null, has an empty set, is linked with nothing and kept. One row of each
    group is kept: that of component_id, and just one if that doc_id repeats. Rows without doc_id
    come last in a group. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    narrow_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", row_print().alias("print")).mapInArrow(_described, f"doc_id {kind}, {DESCRIBED}")
    rows = cut(rows.withColumn("row_id", F.monotonically_increasing_id()))
    total = rows.count()
    sets = rows.where("n_shingles > 0").groupBy("set_print").agg(F.min(doc_order("row_id", "print")).alias("first"), F.count("*").alias("rows"))
    classes = cut(sets.select("set_print", F.col("first.row_id").alias("cls"), F.col("first.doc_id").alias("first_id"), row_key("first.doc_id").alias("first_key"), F.col("first.print").alias("first_print"), "rows"), total)
    tokens = cut(rows.join(classes.select(F.col("cls").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("cls"), "roots", "deep", "sketch"))
    roots = links_between_classes(classes, tokens, docs)
    grouped = classes.join(roots.withColumnRenamed("member", "cls"), "cls", "left").select("set_print", "cls", "first_id", "rows", F.coalesce("root", "cls").alias("root"))
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id").alias("doc_id"), F.col("cls").alias("row_id"))).alias("least"), F.count("*").alias("classes"))
    # Classes of a hot component meet its least row by broadcast, and so do rows of a hot class.
    named = cut(join_one(grouped, least, "root", "classes", total).select("set_print", F.col("least.doc_id").alias("group_id"), F.col("least.row_id").alias("keep_row"), "rows"), total)
    return join_one(rows.select("row_id", "doc_id", "print", "n_shingles", "set_print"), named, "set_print", "rows", total).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("component_id"),
        (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row_id"))).alias("kept"),
        "print",
    )
