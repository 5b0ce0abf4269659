"""Joins of hot keys, and where tables are written."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import skew
from tallyforge.plans import durable


def spread_of(frame):
    """Rows of the largest output task."""
    return max(r["n"] for r in frame.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


@pytest.fixture
def hot_rows(spark, monkeypatch, tmp_path):
    """3,000 rows, a third of them under one key."""
    monkeypatch.setattr(skew, "FEW", 50)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    rows.repartition(8).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def test_lookup_join_equals_join(spark, hot_rows):
    lookup = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k % 5 > 0")
    got = skew.lookup_join(hot_rows, lookup, "k")
    assert sorted(got.collect()) == sorted(hot_rows.join(lookup, "k").collect())
    assert spread_of(got) < 1000


def test_expanding_join_equals_join(spark, hot_rows):
    others = spark.range(3000).select(F.when(F.col("id") < 40, 7).otherwise(F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.expanding_join(hot_rows, others, "k")
    assert sorted(got.collect()) == sorted(hot_rows.join(others, "k").collect())
    assert skew.expanding_join(hot_rows.limit(0), others, "k").count() == 0


def test_hot_keys_of_bytes(spark, hot_rows):
    """Digests are keys too; nulls match nothing."""
    named = lambda d: d.withColumn("k", F.when(F.col("k") != 11, F.unhex(F.md5(F.col("k").cast("string")))))
    lookup = named(spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    rows = named(hot_rows)
    want = sorted(map(tuple, rows.join(lookup, "k").select("id", "v").collect()))
    assert sorted(map(tuple, skew.lookup_join(rows, lookup, "k").select("id", "v").collect())) == want
    assert sorted(map(tuple, skew.expanding_join(rows, lookup, "k").select("id", "v").collect())) == want
    assert len(want) == 2999


def test_tables_need_a_shared_folder_on_a_cluster():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    assert durable.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert durable.shared_folder(session("local[4]", None))
    for master in ("yarn", "spark://a:1", "local-cluster[2,1,1024]", "k8s://a"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            durable.shared_folder(session(master, None))
