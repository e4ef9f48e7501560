import pytest
from pyspark.sql import functions as F

from fieldloom import queries
from fieldloom.operators import reports as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(row):
    return str(tuple("null" if v is None else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "is_finite") else str(v) for v in row))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert rows
    if name in queries.ORACLES:
        want = duck.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(plain, rows)) == sorted(map(plain, want))


@pytest.mark.parametrize("quarters", ["4334434344432443", "4344433434433424", "4444434402444344"])
def test_variance_halfway_between_two_roundings(spark, duck, quarters):
    scores = [int(q) / 4 for q in quarters]
    reports = spark.createDataFrame([(False, x) for x in scores], "parse_error boolean, score double").coalesce(1)
    ((want,),) = duck.sql(f"select round(var_pop(x), 6) from (select unnest({scores}) as x)").fetchall()
    assert R.consistency(reports).select(F.round("score_variance", 6)).first()[0] == want
