import random

import pytest
from pyspark.sql import functions as F

from stringloom.operators import quality, rewrite, skew, translate


def hot_table(spark, n=9000):
    """A third of the rows have one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("k"),
        F.col("id").cast("int").alias("n"))


def test_every_hot_key_is_listed(spark):
    counts = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") + 10).alias("n_rows"))
    total = sum(range(10, 5010))
    listed = sum(n > total / skew.MOST_HOT_KEYS for n in range(10, 5010))
    assert skew.hot_keys(counts, ["k"], hot_rows=5).count() == listed > 4800
    assert skew.hot_keys(counts.limit(0), ["k"], hot_rows=5).count() == 0


def test_hot_keys_are_bounded_by_their_share(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 80), ("c", 20)], "k string, n_rows long")
    for most, listed in ((2, 1), (20, 2), (100, 3)):
        hot = skew.hot_keys(counts, ["k"], hot_rows=1, most=most)
        assert hot.count() == listed <= most
        assert hot.agg(F.max("_parts")).first()[0] == -(-900 * most // 1000)


def test_key_types_must_agree(spark):
    left, right = spark.range(3), spark.range(3).select(F.col("id").cast("int").alias("id"))
    hot = skew.hot_keys(skew.count_keys(left, ["id"]), ["id"])
    with pytest.raises(ValueError):
        skew.spread_join(left, right, ["id"], ["id"], hot)
    with pytest.raises(ValueError):
        skew.spread_join(left, left, ["id"], ["id"], hot, "full")


def test_spread_join_equals_join(spark):
    left = hot_table(spark)
    right = left.select("k").distinct().where("k <> 'k7'").withColumn("v", F.upper("k"))
    hot = skew.hot_keys(skew.count_keys(left, ["k"]), ["k"], hot_rows=100)
    assert [r["_parts"] for r in hot.collect()] == [30]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.spread_join(left, right, ["k"], ["n"], hot, how)
        want = left.join(right, "k", how)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hot_key_is_spread_over_tasks(spark):
    left = hot_table(spark)
    right = left.select("k").distinct().withColumn("v", F.lit(1))
    hot = skew.hot_keys(skew.count_keys(left, ["k"]), ["k"], hot_rows=100)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.spread_join(left, right, ["k"], ["n"], hot)
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(per_task) == 8
    assert max(r["count"] for r in per_task) < 9000 / 3


def test_running_sum_of_a_hot_group(spark):
    rng = random.Random(1)
    data = [("a", i, rng.randint(0, 9)) for i in range(1, 2001)] + [("b", 5, 1), ("b", 900, 2)]
    df = spark.createDataFrame(data, "g string, i int, x int").repartition(5)
    got = skew.running_sum(df, ["g"], F.floor(F.col("i") / 64), "i", F.col("x"), "s")
    sums, want = {}, []
    for g, i, x in data:
        sums[g] = sums.get(g, 0) + x
        want.append((g, i, sums[g]))
    assert sorted(tuple(r) for r in got.select("g", "i", "s").collect()) == sorted(want)


def test_operators_do_not_depend_on_hot_limits(spark):
    found = spark.range(3000).select(
        F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("path"), F.lit(1).alias("pattern_id"),
        F.col("id").cast("int").alias("match_ord"), F.lit(1).alias("line_no"),
        F.when(F.col("id") % 3 == 0, F.lit("OK")).otherwise(F.concat(F.lit(" t "), (F.col("id") % 9).cast("string"))).alias("value"))
    entries = spark.createDataFrame([("ok", "ok", "p", 0), ("t1", "t 1", "p", 1)], "key string, value string, path string, ord int")
    few, many = (sorted(map(str, rewrite.match_keys(found, entries, h).collect())) for h in (50, 10**6))
    assert few == many and len(few) == 3000
    work = found.select(F.col("path").alias("sheet"), F.col("match_ord").alias("row_no"), F.col("value").alias("english"), F.lit("app_fr").alias("lang"))
    memory = spark.createDataFrame([("OK", "app_fr", "D'accord")], "english string, lang string, text string")
    few, many = (sorted(map(str, translate.translate_tm(work, memory, h).collect())) for h in (50, 10**6))
    assert few == many and sum("D'accord" in r for r in few) == 1000


def test_missing_in_a_hot_sheet(spark):
    long = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).otherwise(F.lit("hot")).alias("sheet"),
        F.col("id").cast("int").alias("row_no"), F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")).alias("key"),
    ).select("*", F.inline(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("en").alias("lang"), F.lit("x").alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit("fr").alias("lang"), F.when(F.col("row_no") % 7 == 0, F.lit("y")).otherwise(F.lit("")).alias("value")),
    )))
    table = quality.key_table(long)
    few, many = (sorted(map(str, quality.missing_by_key(table, hot_rows=h).collect())) for h in (10, 10**6))
    assert few == many and few
