"""Readers, the paged source and the keyed store."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import types as T

from tests import pages
from tidemark.sources import files
from tidemark.sources.paged import PagedBars
from tidemark.sources.stores import Store, claimed, merged_graph, revisions, upserted


def test_klines_with_and_without_header(spark, tmp_path):
    row = "1704067200000,1,2,0.5,1.5,10,1704070799999,15,3,4,6,0\n"
    micro = "1704070800000000,1.5,2,1,bad,10,1704074399999999,15,,4,6,0\n1704074400000000,1.5,2,1,1.2,10,1704077999999999,15,,4,6,0\n"
    for name, text in (("a", ",".join(files.KLINE) + "\n" + row), ("b", micro)):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(f"{name}.csv", text)
        (tmp_path / f"{name}.zip").write_bytes(data.getvalue())
    got = {r.t: r for r in files.read_klines(spark, f"{tmp_path}/*.zip").collect()}
    assert set(got) == {1704067200, 1704074400}  # the header and the row without a close are gone
    assert got[1704067200].trades == 3 and got[1704074400].trades == 0
    assert files.closed_only(files.read_klines(spark, f"{tmp_path}/*.zip"), 1704070800).count() == 1


def test_ticks_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,timestamp,price,volume,side\n1,1704067200.5,10,1,Buy\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("2,1704067201000,11,2,sell\n3,1704067202000,,2,sell\n")
    got = sorted((r.id, r.us, r.price, r.side) for r in files.read_ticks(spark, str(tmp_path)).collect())
    assert got == [("1", 1704067200500000, 10.0, "buy"), ("2", 1704067201000000, 11.0, "sell")]


def test_metrics_header_is_checked(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text(",".join(files.METRICS) + "\n2024-01-01 00:05:00,X,1,0,2,3,4,5\n")
    bad.write_text("create_time,symbol\n2024-01-01 00:05:00,X\n")
    row = files.read_metrics(spark, str(good)).collect()[0]
    assert row.sum_open_interest == 1 and row.sum_open_interest_value is None and row.t == 1704067500
    with pytest.raises(files.HeaderMismatch):
        files.read_metrics(spark, str(bad))
    found, failed = files.read_many(spark, {"X": ("metrics", str(good)), "Y": ("metrics", str(bad))})
    assert set(found) == {"X"} and "HeaderMismatch" in failed["Y"]


def test_daily_index(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"data": [{"value": "40", "timestamp": "1704153600", "value_classification": "Fear"}, {"value": "55", "timestamp": "1704067200", "value_classification": "Greed"}]}))
    got = [(r.day, r.value) for r in files.read_daily_index(spark, str(tmp_path / "i.json")).collect()]
    assert got == [(19723, 55.0), (19724, 40.0)]


def test_candidates_wrapped_bare_and_broken(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"payload": {"candidate_id": "a", "sample_size": 5}}\n{"candidate_id": "b"}\n{broken\n')
    schema = T.StructType([T.StructField("candidate_id", T.StringType()), T.StructField("sample_size", T.LongType())])
    got = sorted((r.candidate_id, r.sample_size) for r in files.read_candidates(spark, str(tmp_path / "c.jsonl"), schema).collect())
    assert got == [("a", 5), ("b", None)]


def test_text_records(spark):
    text = "# note\ncandidate_id: x1\nsample_size = 12 ← many\nresearch_score: nope\n"
    assert files.parse_record(text) == {"candidate_id": "x1", "sample_size": "12", "research_score": "nope"}
    fields = T.StructType([T.StructField("candidate_id", T.StringType()), T.StructField("sample_size", T.LongType()), T.StructField("research_score", T.DoubleType())])
    df = spark.createDataFrame([(text,), ('{"candidate_id": "j", "sample_size": "3"}',)], "raw string")
    got = sorted(tuple(r) for r in files.parse_records(df, "raw", fields).collect())
    assert got == [("j", 3, None), ("x1", 12, None)]


def test_paged_source(spark, tmp_path):
    """Pages come from files, in parallel; the open bar doesn't."""
    pages.write(tmp_path, 10_100, 900)
    spark.dataSource.register(PagedBars)
    df = spark.read.format("paged_bars").options(start="0", now="9000550", step="900", fetch="tests.pages:fetch", folder=str(tmp_path)).load()
    rows = df.collect()
    assert len(rows) == 10_000 and df.rdd.getNumPartitions() == 10 and {r.close for r in rows} == {100.0 + k for k in range(7)}
    assert max(r.t for r in rows) == 9000000 - 900


def test_paged_stream(spark, tmp_path):
    pages.write(tmp_path, 1100, 900)
    spark.dataSource.register(PagedBars)
    stream = spark.readStream.format("paged_bars").options(start="0", now="900500", step="900", fetch="tests.pages:fetch", folder=str(tmp_path)).load()
    q = stream.writeStream.format("memory").queryName("paged").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("paged").count() == 1000


def test_store_versions_and_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read() is None
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "c", 3.0), (3, "d", 4.0)], "k int, s string, v double")
    store.write(old)
    store.write(upserted(store.read(), new, ["k"]))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a", 1.0), (2, "c", 3.0), (3, "d", 4.0)]
    store.prune()
    assert len(store._versions()) == 1
    assert sorted(map(tuple, upserted(old, new, ["k"], update=["v"]).collect())) == [(1, "a", 1.0), (2, "b", 3.0), (3, "d", 4.0)]
    assert sorted(map(tuple, upserted(old, new, ["k"], keep_old=True).collect())) == [(1, "a", 1.0), (2, "b", 2.0), (3, "d", 4.0)]
    assert [tuple(r) for r in revisions(old, new, ["k"], "v").collect()] == [(2, 2.0, 3.0)]
    assert [r.k for r in claimed(new, old, ["k"]).collect()] == [3]


def test_graph_merge_in_batches_equals_one(spark):
    rows = spark.createDataFrame([("a", "b", 1, 2.0, "x", 1), ("a", "b", 1, 4.0, "y", 2), ("b", "a", 1, 1.0, "z", 3)], "a string, b string, n long, total double, label string, at long")
    two = merged_graph(merged_graph(None, rows.where("at = 1")), rows.where("at > 1"))
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, merged_graph(None, rows).collect())) == [("a", "b", 2, 6.0, "y", 2), ("b", "a", 1, 1.0, "z", 3)]
