import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stemma.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    rows = con.execute(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted("|".join(plain(r[names.index(c)]) for c in sorted(names)) for r in rows.fetchall())
    assert sorted("|".join(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "dependent", "support", "score", "rank"]


def test_pairs_of_one_group_are_dealt_over_tasks(spark, tmp_path):
    n = 2500
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.when(F.col("id") < n - 3, "a").alias("p_brand"), F.lit(1).alias("p_size"), F.concat(F.lit("x "), (F.col("id") % 3).cast("string")).alias("p_name"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["jaccard_pairs"](spark, str(tmp_path))
    n -= 3  # those without a brand are in no pair
    same = sum(m * (m - 1) // 2 for m in (len(range(i, n, 3)) for i in range(3)))
    said = got.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.count_distinct("x", "y"), F.sum("similarity"), F.sum((F.col("x") < F.col("y")).cast("int")), F.count_distinct("task")).first()
    pairs = n * (n - 1) // 2
    assert said[:2] == (pairs, pairs) and said[2] == pytest.approx(same + (pairs - same) * 0.3333) and said[3] == pairs and said[4] > 1
