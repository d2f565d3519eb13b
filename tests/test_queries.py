"""Each registered query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import carrier_queries, file_queries, pixel_queries, scalar_queries  # noqa: F401  registers
from tessera.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    if any(want[c].dtype == float for c in want.columns):
        for a, b in zip(rows(got), rows(want), strict=True):
            assert a == b or all(x == y or math.isclose(float(x), float(y), rel_tol=1e-9) for x, y in zip(a, b, strict=True))
    else:
        assert rows(got) == rows(want)


def test_box_fragments_of_every_part(spark, tmp_path):
    """Keys of all remainders, names of several bytes a letter, an empty and a missing one."""
    names = ["small widget", "größer", "名", "", None, "x" * 40, "a\0b"]
    parts = [(i, names[i % len(names)]) for i in range(1, 41)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = QUERIES["agg_03_box_fragments"](spark, str(tmp_path)).select("p_partkey", "label", "content_md5").collect()
    want = con.sql(SQL["agg_03_box_fragments"]).fetchall()
    assert {k for k, _, _ in want} == {k for k, _ in parts}
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want)
