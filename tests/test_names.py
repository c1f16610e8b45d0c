"""Names of states and the largest features of centroids against plain versions; kinds of records that hold them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import states as S
from tidemark.sources import sinks
from tidemark.sources.stores import Store

AXES = {"calm": {"a": ("wild", "calm"), "b": ("wide", "narrow")}, "trend": {"c": ("up", "down")}, "heat": {"d": ("hot", "cold"), "e": ("high", "low")}, "flow": {"f": ("in", "out")}}


def plain(row: dict) -> str:
    picked = []
    for order, vocabulary in enumerate(AXES.values()):
        best = None
        for feature, (up, down) in vocabulary.items():
            x = row[feature]
            if x is not None and x == x and abs(x) >= 0.5 and (best is None or abs(x) > best[0]):
                best = (abs(x), order, up if x > 0 else down)
        picked += [best] if best else []
    top = sorted(picked, key=lambda p: -p[0])[:3]
    return " · ".join(p for _, _, p in sorted(top, key=lambda p: p[1])) or "none"


def test_names(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(rng.integers(-6, 7)) / 4 for _ in range(6)) for _ in range(300)] + [(None,) * 6, (0.5, -0.5, 0.49, 0.5, 0.5, 0.5)]
    got = S.state_names(spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double"), AXES, F.lit("none")).collect()
    assert [r["name"] for r in got] == [plain(r.asDict()) for r in got]
    assert got[-1]["name"] == "wild · hot · in" and got[-2]["name"] == "none"


def test_largest_features_of_centroids(spark):
    rng = np.random.default_rng(4)
    names = ["p", "q", "r", "s", "u"]
    rows = [(int(rng.integers(4)), *[float(x) for x in rng.integers(-3, 4, 5)]) for _ in range(60)] + [(9, None, None, None, None, None), (8, 1.0, -1.0, 1.0, 0.0, None)]
    tops = S.centroid_features(spark.createDataFrame(rows, "g int, p double, q double, r double, s double, u double"), "g", names)
    got = {(r.g, r.place): (r.feature, r.value) for r in tops.collect()}
    for g in range(4):
        means = np.array([r[1:] for r in rows if r[0] == g]).mean(axis=0)
        for place, i in enumerate(np.argsort(-np.abs(means), kind="stable")[:3], 1):
            assert got[g, place][1] == pytest.approx(means[i]) and abs(got[g, place][1]) == pytest.approx(abs(means[i]))
    assert [got[8, k][0] for k in (1, 2, 3)] == ["p", "q", "r"] and (9, 1) not in got
    share = S.named_share(tops, "g", ["u"]).first()
    hit = sum(any(got.get((g, k), ("",))[0] == "u" for k in (1, 2, 3)) for g in (0, 1, 2, 3, 8))
    assert (share.groups, share.share) == (5, pytest.approx(hit / 5))
    assert S.named_share(tops.limit(0), "g", ["u"]).first().share == 0.0


def test_kinds_of_a_run(spark, tmp_path):
    groups = spark.createDataFrame([(1, "g1", 5, 0.5), (1, "g2", 5, 0.5)], "run_id int, group_id string, size int, share double")
    whole = groups.select("*", *[F.lit(None).alias(c) for c in ("dominant_bias", "up_share", "avg_ret", "centroid", "top_features")], F.lit("calm").alias("name"))
    store = Store(spark, str(tmp_path / "groups"))
    sinks.save(store, "groups", whole)
    sinks.save(store, "groups", whole.where("group_id = 'g2'").withColumn("name", F.lit("wild")))
    assert sorted((r.group_id, r.name) for r in store.read().collect()) == [("g1", "calm"), ("g2", "wild")]
    for kind, spec in sinks.KINDS.items():
        assert set(spec.key) <= set(spec.columns), kind
        assert [f.name for f in sinks.schema_of(kind).fields] == list(spec.columns)
