"""The stages in order, each against what its operator promises."""

from __future__ import annotations

import collections

import corpus_pipeline
from tests.llm.test_text_operators import SCHEMA, hostile, norm, plain_components, words


def test_stages_on_hostile_rows(spark, small):
    docs = spark.createDataFrame(hostile(), SCHEMA).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        before = collections.Counter((r.doc_id, r.text) for r in docs.collect())
        after = collections.Counter((r.doc_id, r.text) for r in out.collect())
        if name == "exact":
            assert len({norm(t) for _, t in before}) == sum(after.values())
        if name == "mixing":
            assert all(n <= 2 * before[k] for k, n in after.items())
        else:
            assert all(n <= before[k] for k, n in after.items())
        docs = spark.createDataFrame(out.collect(), SCHEMA)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0


def test_stages_on_an_empty_table(spark, small):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_near_stage_keeps_one_of_each_group(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {k for k, v in plain_components({r.doc_id: r.text for r in docs.collect()}).items() if k == v}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, small).collect()} == want


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(0 < r.length <= 2048 for r in rows)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= set(docs) and all(words(docs[r.doc_id]) for r in rows)


NAMES = ("__key", "__print", "__rows", "__copies", "__lang_pred", "__nth", "__hot", "copies", "print", "n", "place", "unit")


def test_stages_keep_columns_of_any_name(spark, small):
    rows = [(*r[:5], *[f"{c}{r[0]}" for c in NAMES]) for r in hostile()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0


def test_alike_rows_share_their_copies(spark):
    """The first in the order of all columns stays; copies go evenly, whatever the partitions."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import copies_of, row_print

    docs = spark.createDataFrame([(1, "a", x) for x in "cab"] + [(2, "b", "x")] * 5 + [(3, "c", "y"), (None, "a", "z")], "doc_id long, text string, more string")
    named = docs.select("doc_id", row_print().alias("print"))
    copies = {1: 0, 2: 2, 3: 3, None: 1}
    plan = named.withColumn("copies", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in copies.items() if k for x in (k, v)]), F.col("doc_id")), F.lit(1)))
    one = named.withColumn("copies", F.when(F.col("doc_id") == 1, F.lit(0)).otherwise(F.lit(1)))
    for parts in (1, 4):
        got = collections.Counter(tuple(r) for r in copies_of(docs.repartition(parts), plan).collect())
        assert got == {(2, "b", "x"): 10, (3, "c", "y"): 3, (None, "a", "z"): 1}
        # One copy for three rows that differ: the first by JSON.
        first = one.where("doc_id = 1").limit(1).withColumn("copies", F.lit(1)).unionByName(one.where("doc_id = 1").limit(2))
        assert [r.more for r in copies_of(docs.where("doc_id = 1").repartition(parts), first).collect()] == ["a"]
