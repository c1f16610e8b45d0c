"""Rows that repeat, lack a doc_id, or have doc_ids of other types, in the operators that fetch texts again."""

from __future__ import annotations

import random

import pytest

from tests.llm.test_text_operators import plain_bytes, plain_components, plain_words, rows_of
from tidemark.llm import near_dedup, repeats, suffix_array, suffix_tree


def sentences(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(n))


def shared_rows() -> list[tuple]:
    """Long rows that repeat and share a passage with another, also with other spacing, and short ones."""
    passage = sentences(60, 1)
    one, two = f"{sentences(80, 2)} {passage} {sentences(50, 3)}", f"{sentences(40, 4)} {passage} {sentences(90, 5)}"
    spaced = one.replace(" ", "  ")
    return [("1", one), ("1", one), ("2", two), ("3", sentences(30, 6)), ("1", spaced), ("4", two + " x"), ("5", ""), ("5", None)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_long_rows_that_share_passages(spark, monkeypatch, kind, broadcast):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", broadcast)
    rows = [(int(k) if kind == "long" else f"k{k}", t) for k, t in shared_rows()]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    # Rows of one doc_id and different texts come in an order of the run's own; of one text, all are alike.
    numbered = [(i, t) for i, (_, t) in enumerate(sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or "")))]
    a = rows_of(suffix_tree.substring_dedup(df))
    want = sorted((n, g) for n, g, _ in plain_words([(i, t or "") for i, t in numbered]).values())
    assert len(a) == len(rows) and sorted((r["n_words"], r["n_removed"]) for r in a) == want
    b = rows_of(suffix_array.byte_dedup(df))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in b) == sorted(plain_bytes(numbered).values())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_thousand_rows_without_doc_id(spark, kind):
    base = [sentences(60, s) for s in range(40)]
    texts = [f"{base[i % 40]} {sentences(20, 1000 + i)}" if i % 3 else base[i % 40] for i in range(1000)]
    df = spark.createDataFrame([(None, t) for t in texts], f"doc_id {kind}, text string").repartition(5)
    a, b, c = (rows_of(f(df)) for f in (suffix_tree.substring_dedup, suffix_array.byte_dedup, near_dedup.near_dedup))
    assert len(a) == len(b) == len(c) == 1000
    want = plain_bytes(list(enumerate(texts)))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in b) == sorted(want.values())
    roots = plain_components(dict(enumerate(texts)))
    assert sum(r["kept"] for r in c) == len(set(roots.values()))


def test_texts_are_fetched_in_linear_rows(spark):
    """1000 rows without doc_id and with different texts: each meets its own key only."""
    texts = [f"{sentences(40, 7)} {sentences(30, 50 + i)}" for i in range(1000)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    rows, classes = repeats.describe(df, suffix_tree.KIND)
    assert repeats.suspects(df, suffix_tree.KIND, rows, classes).count() == 1000


def test_ranks_follow_doc_ids_of_any_type(spark):
    named = spark.createDataFrame([(i, k) for i, k in enumerate(["b", None, "a", "c", "a", None, "aa"])], "row_id long, doc_id string").repartition(4)
    got = [(r["doc_id"], r["row_id"]) for r in sorted(rows_of(repeats._ranked(named)), key=lambda r: r["rank"])]
    assert got == [("a", 2), ("a", 4), ("aa", 6), ("b", 0), ("c", 3), (None, 1), (None, 5)]
