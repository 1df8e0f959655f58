"""Exact order statistics and running positions that never sort a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 256


def _borders(column: str) -> Column:
    """Aggregate: about BUCKETS borders between which equally many of the rows lie, whatever their values."""
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    return F.array_distinct(F.percentile_approx(column, shares, F.lit(8 * BUCKETS)))


def _bucket(value: Column, borders: Column) -> Column:
    return F.size(F.filter(borders, lambda b: b <= value))


def positioned(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Distinct values per group with count ``n`` and position range [``start``, ``start + n``).

    Rows collapse to one per value first. Values are cut into buckets at approximate
    quantiles, so outliers and dense stretches do not fill one bucket; bucket offsets come
    from a window over at most BUCKETS rows per group, and only inside a bucket are values
    ordered. Borders only deal out the work: positions are exact.
    """
    by = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*by).agg(_borders("v").alias("_cuts"), F.sum("n").alias("total"))
    ranged = (counts.join(ends, by) if by else
              counts.withColumn("_e", ends.select(F.struct("*")).scalar()).select(*counts.columns, "_e.*"))
    placed = ranged.withColumn("_bucket", _bucket(F.col("v"), F.col("_cuts"))).drop("_cuts")
    order = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (placed.groupBy(*by, "_bucket").agg(F.sum("n").alias("_m"))
               .withColumn("_before", F.sum("_m").over(order) - F.col("_m")).drop("_m"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (placed.join(offsets, [*by, "_bucket"])
           .withColumn("start", F.col("_before") + F.sum("n").over(inside) - F.col("n")))
    return out.select(*by, "v", "n", "start", "total")


def quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] = ()) -> DataFrame:
    """Per group an array ``q`` of quantiles with linear interpolation."""
    placed = positioned(df, value, keys)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("start") <= position) & (position < F.col("start") + F.col("n")), F.col("v")))

    parts = []
    for p in probs:
        rank = F.lit(float(p)) * (F.col("total") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        parts.append(low + (high - low) * (F.max(rank) - F.floor(F.max(rank))))
    return placed.groupBy(*keys).agg(F.array(*parts).alias("q"))


def paged(df: DataFrame, value: str, id: str, size: int) -> DataFrame:
    """Rows with ``page`` (0-based) when ordered by value, then id.

    Rows of one value are numbered in buckets of their ids, so a value that most rows share is
    not ordered in one task.
    """
    offsets = positioned(df.select(value), value).select(F.col("v").alias(value), "start", "total")
    dealt = df.withColumn("_cuts", df.agg(_borders(id)).scalar()).withColumn("_bucket", _bucket(F.col(id), F.col("_cuts"))).drop("_cuts")
    before = Window.partitionBy(value).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = (dealt.groupBy(value, "_bucket").agg(F.count("*").alias("_m"))
             .select(value, "_bucket", (F.sum("_m").over(before) - F.col("_m")).alias("_base")))
    tie = Window.partitionBy(value, "_bucket").orderBy(id)
    position = F.col("start") + F.col("_base") + F.col("_tie")
    return (dealt.withColumn("_tie", F.row_number().over(tie) - 1).join(bases, [value, "_bucket"]).join(offsets, value)
            .withColumn("page", F.floor(position / size)).withColumn("pages", F.ceil(F.col("total") / size))
            .drop("start", "total", "_bucket", "_base", "_tie"))


def quartile_label(df: DataFrame, value: str) -> DataFrame:
    """Label 0..3: how many of the three quartiles a value reaches (strictly below keeps it lower)."""
    cuts = quantiles(df, value, [0.25, 0.5, 0.75]).scalar()
    q = df.withColumn("_q", cuts)
    label = (F.when(F.col(value) < F.col("_q")[0], 0).when(F.col(value) < F.col("_q")[1], 1)
             .when(F.col(value) < F.col("_q")[2], 2).otherwise(3))
    return q.withColumn("label", label).drop("_q")
