"""Scratch tables: where they may lie, when they go, and rows that are met by number."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import by_number, components, materialise, numbered, scope, scratch, wrapped


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name: folder)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId="app-1"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch(session(master))
        assert scratch(session(master, "hdfs://x/y")) == "hdfs://x/y/tessera-app-1"
    for master in ("local", "local[*]", "local[4]"):
        assert scratch(session(master)).endswith("tessera-app-1")


def path_of(df):
    return df.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0]


def test_what_a_scope_wrote_goes_with_it(spark):
    with scope(spark):
        inner = materialise(spark.range(10), "inner")
        table = numbered(spark.range(5), "table")
        outer = materialise(inner.join(table, "id"), "outer", outer=True)
        inside = [path_of(inner), path_of(table)]
        assert all(map(os.path.isdir, inside))
    assert not any(map(os.path.exists, inside)) and outer.count() == 5


def test_rows_are_met_by_number_without_being_moved(spark):
    rows = numbered(wrapped(spark.range(1000).withColumn("rid", F.lit("own")).repartition(7)), "rows")
    some = rows.where("row.id % 10 = 3").select("rid")
    assert by_number(rows, some, "left_semi").count() == 100
    left = by_number(rows, some, "left_anti")
    assert left.count() == 900 and left.select("row.*").columns == ["id", "rid"]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # that of the numbers alone


def test_the_loop_for_many_edges_gives_the_same_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(100, 3), (100, 200), (5, 5), (61, 300), (300, 61)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {tuple(r) for r in components(frame).collect()}
    monkeypatch.setattr("tessera.llm.common.AT_ONCE", 0)
    assert {tuple(r) for r in components(frame).collect()} == want
