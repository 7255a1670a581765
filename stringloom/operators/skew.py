"""Joins and running sums that hold when one key owns a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.staging import stage

# A key above this many rows is split over several tasks.
HOT_ROWS = 1_000_000
# A key with at most this part of all rows is never split, so that fewer than this many keys are.
MOST_HOT_KEYS = 65_536


def hot_keys(
    counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, most: int = MOST_HOT_KEYS
) -> DataFrame:
    """The hot keys of ``counts(keys…, n_rows)``, by hash, with the parts to split each into.

    Hot is a key with more than ``hot_rows`` rows and more than one ``most``-th of all rows. Fewer than
    ``most`` keys can have that many, so the list (two numbers each) is safe to broadcast, and no hot
    key is left out. A key that shares its hash with a hot one is split along with it, on both sides
    of the join, which changes no result.
    """
    share = counts.agg(F.sum("n_rows") / most).scalar()
    limit = F.greatest(F.lit(hot_rows), F.coalesce(share, F.lit(0)))
    # The limit stays outside the aggregate, which takes no expression over rows numbered by task.
    hot = counts.where(F.col("n_rows") > limit).select(
        F.xxhash64(*keys).alias("_hash"), (F.col("n_rows") / limit).alias("_times"))
    return hot.groupBy("_hash").agg(F.ceil(F.max("_times")).cast("int").alias("_parts"))


def count_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Join many left rows to at most one right row per key, splitting the hot keys of ``hot``.

    A hot key's left rows go to ``_parts`` tasks by a hash of ``spread_by`` (repeatable, so a
    retried task writes the same rows), and its right row is repeated once per part. Every left row
    meets its right row exactly once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the right side is repeated per part, so {how} is not possible")
    keys = list(keys)
    if [left.schema[k].dataType for k in keys] != [right.schema[k].dataType for k in keys]:
        raise ValueError(f"both sides need the same types for {keys}, since their hashes are compared")
    left = _with_parts(left, keys, hot).withColumn(
        "_part", F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int"))
    right = _with_parts(right, keys, hot).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [*keys, "_part"], how).drop("_part")


def _with_parts(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    joined = df.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(hot), "_hash", "left").drop("_hash")
    return joined.withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def running_sum(
    df: DataFrame, group: Sequence[str], block: Column, order: str, amount: Column, name: str
) -> DataFrame:
    """Running sum of ``amount`` by ``(block, order)`` within ``group``, without one task per group.

    ``block`` cuts a group into consecutive runs of bounded size. Block totals are few and get the
    running offset; each block adds its own running sum, so a group of any size is spread over its
    blocks. The rows are shuffled once: join and window share the key (group, block).
    """
    group = list(group)
    rows = df.withColumn("_block", block).withColumn("_amount", amount)
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group, "_block").agg(F.sum("_amount").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*group, "_block"])
        .withColumn(name, F.col("_offset") + F.sum("_amount").over(inside))
        .drop("_block", "_amount", "_offset")
    )


def prefix_sums(df: DataFrame, order: Sequence[str], amounts: dict[str, Column]) -> DataFrame:
    """Running sums over the whole table in ``order``, each row's own amount included, one column per name.

    The rows are dealt out by ranges of ``order`` and written, so that the layout stands. One total per
    range and sum is added up over all; the rest happens inside a range. ``order`` should be unique.
    """
    order = list(order)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.withColumns({f"_{name}": amount for name, amount in amounts.items()})
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumns(
        {"_range": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    inside = Window.partitionBy("_range").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    offsets = dealt.groupBy("_range").agg(*[F.sum(f"_{name}").alias(f"_before_{name}") for name in amounts]).select(
        "_range", *[F.coalesce(F.sum(f"_before_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in amounts])
    return dealt.join(F.broadcast(offsets), "_range").withColumns({
        name: F.col(f"_before_{name}") + F.sum(f"_{name}").over(inside) for name in amounts
    }).drop("_range", "_seq", *[f"_{name}" for name in amounts], *[f"_before_{name}" for name in amounts])
