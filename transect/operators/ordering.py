"""Ranks and running totals over whole tables, without gathering a table or a large group in one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transect.session import prepare


MAX_BROADCAST_ROWS = 100_000


def seeded(seed: int, *key: Column) -> Column:
    """The hash that stands for a shuffle: any engine with md5 gives the same order."""
    return F.md5(F.concat_ws("|", F.lit(seed), *key))


def running_total(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows before each (0 for the first), in a total order.

    Rows are dealt out by range; sums within partitions are windows, and of each partition only its sum meets the others'.
    """
    prepare(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.withColumn("_value", value)
    part = ordered.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = part.groupBy(F.col("_part").alias("_of")).agg(F.sum("_value").alias("_sum"))
    line = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = sums.select("_of", F.coalesce(F.sum("_sum").over(line), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = part.join(F.broadcast(bases), F.col("_part") == F.col("_of"))
    return joined.withColumn(name, F.coalesce(F.sum("_value").over(own), F.lit(0)) + F.col("_base")).drop("_value", "_part", "_of", "_base")


def running_min(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df with the least ``value`` of the rows before each in its group (null for the first), in a total order that ``by`` leads.

    As running_total: of each partition only its groups' minima meet the others', so a hot group isn't one partition.
    """
    prepare(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.withColumn("_value", value).repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    mins = part.groupBy(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_of")).agg(F.min("_value").alias("_min"))
    line = Window.partitionBy(*[f"_{b}" for b in by]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    same = F.col("_part") == F.col("_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = part.withColumn("_own", F.min("_value").over(own)).join(mins.withColumn("_before", F.min("_min").over(line)), same)
    return joined.withColumn(name, F.least("_own", "_before")).drop("_value", "_part", "_own", "_before", "_of", "_min", *[f"_{b}" for b in by])


def hash_rank(df: DataFrame, by: Sequence[str], digest: str, name: str) -> DataFrame:
    """df with each row's number (from 0) in its group by a hex digest column; equal digests are no ties to break here.

    A group is numbered in 4096 parts by the digest's first digits, so a hot group isn't one partition.
    """
    cut = df.withColumn("_part", F.substring(digest, 1, 3))
    counts = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    numbered = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(digest)) - 1)
    return numbered.join(bases, same).withColumn(name, F.col("_row") + F.col("_base")).drop("_part", "_row", "_p", "_base", *[f"_{b}" for b in by])


def percentiles(rows: DataFrame, by: str, value: str, shares: Sequence[float], between: str = "linear") -> DataFrame:
    """(by, _all, values): percentiles of a column, exact, for each group and (_all 1) for all rows; between neighbours linear, or the ``upper`` one.

    Equal values are counted before the shuffle, and the counts summed in order by range, so neither a hot group nor a hot
    value is one task's work. Null values are left out.
    """
    some = rows.filter(F.col(value).isNotNull()).select(by, value)
    each = some.groupBy(by, value).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    whole = some.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(1)).withColumn(by, F.lit(None).cast(dict(rows.dtypes)[by]))
    ranked = running_total(each.unionByName(whole), [F.col("_all"), F.col(by), F.col(value)], F.col("_n"), "_before")
    groups = ranked.groupBy(F.col("_all").alias("_g"), F.col(by).alias("_by")).agg(F.min("_before").alias("_start"), F.sum("_n").alias("_total"))
    wanted = groups.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in shares])).alias("_k", "_p")).withColumn("_at", F.col("_p") * (F.col("_total") - 1))
    same = (F.col("_all") == F.col("_g")) & F.col(by).eqNullSafe(F.col("_by"))
    first = F.col("_before") - F.col("_start")
    covers = lambda at: (first <= at) & (at < first + F.col("_n"))
    low, high = F.floor("_at"), F.ceil("_at")
    # a row for each group and share: where there are few, as for the whole table, none of the values are dealt out for them
    wanted = wanted.checkpoint()
    met = ranked.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_ROWS else wanted, same & (covers(low) | covers(high)))
    ends = met.groupBy(by, "_all", "_k").agg(F.max(F.when(covers(low), F.col(value))).alias("_low"), F.max(F.when(covers(high), F.col(value))).alias("_high"), F.max(F.col("_at") - low).alias("_part"))
    found = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part") if between == "linear" else F.col("_high")
    return ends.groupBy(by, "_all").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", found.alias("v")))), lambda x: x.v).alias("values"))
