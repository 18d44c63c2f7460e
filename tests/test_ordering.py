"""Numbers over ranges against window functions."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.operators.merge import content_versions
from docketry.operators.ordering import number_all, number_in_groups


def test_numbers_of_all_rows(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5000 as v").repartition(6)
    assert sorted((r.v, r.row_no) for r in number_all(df, [df.v.desc()]).collect()) == [(v, 5000 - v) for v in range(5000)]
    assert number_all(df.limit(0), [df.v.desc()]).collect() == []


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_numbers_in_groups(spark, hot):
    """A group that holds half of all rows, or all, spans several ranges; so do null keys."""
    rng = random.Random(int(hot * 10))
    rows = [("hot" if rng.random() < hot else rng.choice([None, "a", "b", *map(str, range(40))]), rng.randrange(2), k, rng.choice([None, f"v{k}"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, at int, v string")
    w = W.partitionBy("g", "h").orderBy(F.col("at").desc())
    want = df.withColumn("row_no", F.row_number().over(w)).withColumn("previous_v", F.lag("v").over(w)).withColumn("previous_at", F.lag("at").over(w))
    for few in ("1", "7"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", few)
        try:
            got = number_in_groups(df, ["g", "h"], [F.col("at").desc()], carry=["v", "at"])
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert number_in_groups(df.limit(0), ["g"], [F.col("at")]).collect() == []


def test_versions_of_one_key(spark):
    rng = random.Random(4)
    rows = [(k, k // 3, "only", rng.choice("aab")) for k in range(2000)]
    df = spark.createDataFrame(rows, "document_id int, captured_at int, source string, content_hash string")
    got = sorted((r.document_id, r.version, r.previous_version_id) for r in content_versions(df, ["source"]).collect())
    want, last = [], None
    for k, _, _, h in rows:
        if last is None or h != last:
            want.append((k, len(want) + 1, want[-1][0] if want else None))
        last = h
    assert got == want
