import os

import duckdb
import pytest

from centra.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rounded(rows):
    return sorted(tuple(round(float(x), 5) + 0.0 if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rounded(got.select(columns).collect()) == rounded(want.select(*columns).fetchall())


def test_stratified_sample_draws_from_all_points(spark, tmp_path):
    spark.range(2000).selectExpr("id AS vec_id", "id % 7 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(r.id for r in catalogue.stratified_sample(spark, str(tmp_path)).collect())
    assert [i // 80 for i in got] == list(range(25))


def test_lsh_centers_of_a_number_of_points_that_k_does_not_divide(spark, tmp_path):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 257").coalesce(1)
    points.write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalogue.init_lsh_centers(spark, str(tmp_path))
    assert rounded(got.collect()) == rounded(c.sql(catalogue.oracle_sql()["init_lsh_centers"]).select(*got.columns).fetchall())
