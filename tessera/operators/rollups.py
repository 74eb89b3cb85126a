"""Group counts, conditional counts, shares and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialize


def guarded_share(n: Column, of: Column, digits: int = 1) -> Column:
    """Percentage rounded to ``digits`` decimals, 0 where nothing is counted."""
    return F.when(of > 0, F.round(n * 100.0 / of, digits)).otherwise(F.lit(0.0))


def nearest_rank(column: str, p: float) -> Column:
    """Percentile by nearest rank: a value of the data, never interpolated."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def spread(column: str, prefix: str) -> list[Column]:
    """min, p50, p75, p90, p95, max by nearest rank."""
    return [F.min(column).alias(f"{prefix}_min"), *[nearest_rank(column, p / 100).alias(f"{prefix}_p{p}") for p in (50, 75, 90, 95)], F.max(column).alias(f"{prefix}_max")]


def value_shares(df: DataFrame, column: str, least_total: int = 1000) -> DataFrame:
    """value, n, share of the non-null values; no rows below ``least_total`` rows, where shares say little."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("total") >= least_total).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def share_bits(share: Column, m: float = 0.95) -> Column:
    """log2(m / share) with the share held between 1e-9 and m."""
    return F.log2(F.lit(m) / F.least(F.greatest(share, F.lit(1e-9)), F.lit(m)))


def closed_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """code, n for each of a closed list, zero rows kept."""
    codes = df.sparkSession.createDataFrame([(v,) for v in values], "code string")
    return F.broadcast(codes).join(df.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("n")), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def entropy(p: Column) -> Column:
    """Binary entropy in bits, 0 at the ends."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def numbered(df: DataFrame, order: list[Column], total: str) -> DataFrame:
    """``df`` with rank and upto (sum of ``total`` so far) in a global order: ranges are sorted side by side and shifted by what stands before them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "rollup-ranges")
    sums = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), F.sum(total).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shifts = sums.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__sum"))
    own = Window.partitionBy("__part").orderBy(*order)
    rows = parts.join(F.broadcast(shifts), "__part")
    return rows.withColumns({"rank": (F.col("__rows") + F.row_number().over(own)).cast("int"), "upto": F.col("__sum") + F.sum(total).over(own.rowsBetween(Window.unboundedPreceding, 0))}).drop("__part", "__rows", "__sum")


def pareto(counts: DataFrame, key: str, n: str = "n", top: int | None = None) -> DataFrame:
    """Counts by falling count then key, with share and cumulative share of what is shown."""
    if top:
        counts = counts.orderBy(F.desc(n), key).limit(top)
    ranked = numbered(counts.select(key, n), [F.desc(n), F.asc(key)], n)
    total = counts.agg(F.sum(n).alias("__total"))
    return ranked.crossJoin(F.broadcast(total)).select(key, n, "rank", (F.col(n) / F.col("__total")).alias("share"), (F.col("upto") / F.col("__total")).alias("cumulative"))  # one row


def gauges(series: DataFrame, key: str, n: str, cap: int = 50, floor: int = 5) -> DataFrame:
    """At most ``cap`` series of at least ``floor`` members; each row also tells how many were withheld and dropped."""
    order = Window.orderBy(F.desc(n), key)
    big = series.where(F.col(n) >= floor).withColumn("__r", F.row_number().over(order))
    said = series.agg(F.count_if(F.col(n) < floor).alias("withheld"), F.greatest(F.count_if(F.col(n) >= floor) - cap, F.lit(0)).alias("dropped"))
    return big.where(F.col("__r") <= cap).drop("__r").crossJoin(F.broadcast(said))


def last_activity(first: str, *others: str) -> Column:
    """The latest of several instants, the earlier-named source on ties; a struct of source and at."""
    best = F.struct(F.lit(first).alias("source"), F.col(first).alias("at"))
    for name in others:
        best = F.when(F.col(name).isNotNull() & (best["at"].isNull() | (F.col(name) > best["at"])), F.struct(F.lit(name).alias("source"), F.col(name).alias("at"))).otherwise(best)
    return best
