"""Lookups in page indexes: nearest start, containing interval, ranked interval.

Spark has no as-of join. An index becomes closed intervals (each start runs to
the next one, the last without end), and an interval join meets points and intervals
by an equi-join on the key and a cell, with the exact bounds as the rest of the
condition. Cells come in sizes of powers of four, and an interval goes into cells
about as long as itself, two at most, so long and open intervals cost no more rows
than short ones; a point looks into one cell of each size that the index uses. The
large side is neither sorted nor gathered by key, so a volume that a third of all
points cite is dealt like any skewed equi-join (split by Spark, or not shuffled at
all where the index is small enough to broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the smallest cell, of the step from size to size, and of open intervals.
SMALL, STEP, OPEN = 6, 2, 62


def until_next(index: DataFrame, by: list[str], at: str, until: str = "until") -> DataFrame:
    """Distinct starts with the last place before the next start (null: open)."""
    return index.withColumn(until, F.lead(at).over(Window.partitionBy(*by).orderBy(at)) - 1)


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, lo: str, hi: str, how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them; an interval without ``hi`` is open.
    ``intervals`` must not share other column names with points."""
    length = F.col(hi).cast("long") - F.col(lo).cast("long") + 1
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)))) - SMALL)
    size = F.when(F.col(hi).isNull(), F.lit(OPEN)).otherwise(SMALL + STEP * F.ceil(bits / STEP)).cast("int")
    closed = intervals.where(F.col(lo).isNotNull() & (F.col(hi).isNull() | (F.col(hi) >= F.col(lo)))).withColumn("_size", size)
    sizes = sorted(r["_size"] for r in closed.select("_size").distinct().collect())
    cell = lambda c: F.call_function("shiftright", c.cast("long"), F.col("_size"))
    last = F.coalesce(F.col(hi), F.col(lo))
    closed = closed.withColumn("_cell", F.explode(F.when(F.col(hi).isNull(), F.array(F.lit(0).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array_distinct(F.array(cell(F.col(lo)), cell(last))))))
    closed = closed.withColumnsRenamed({k: f"_{k}" for k in by} | {"_size": "_size0"})
    asked = points.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    cond = (F.col("_size") == F.col("_size0")) & (cell(F.col(at)) == F.col("_cell"))
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    cond = cond & (F.col(at) >= F.col(lo)) & (F.col(hi).isNull() | (F.col(at) <= F.col(hi)))
    found = asked.join(closed, cond, "inner").drop("_cell", "_size", "_size0", *[f"_{k}" for k in by])
    if how != "left":
        return found
    # Rows that are equal in all columns lie in the same intervals.
    hit = found.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(points.columns)]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(points.columns)]
    return found.unionByName(points.join(hit, same, "left_anti"), allowMissingColumns=True)


def nearest(points: DataFrame, index: DataFrame, by: list[str], at: str, start: str, how: str = "left") -> DataFrame:
    """Each point with the index rows of the greatest start at or below it."""
    starts = until_next(index.select(*by, start).distinct(), by, start, "_until")
    found = interval_join(points, starts, by, at, start, "_until", how)
    return found.drop("_until")


def ranked_interval(points: DataFrame, intervals: DataFrame, key: list[str], by: list[str], at: str, lo: str, hi: str, order: list[Column]) -> DataFrame:
    """Of the intervals that hold a point, the first by ``order``; ``key`` tells
    points apart."""
    found = interval_join(points, intervals, by, at, lo, hi)
    rank = Window.partitionBy(*key).orderBy(*order)
    return found.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def with_fallback(left: DataFrame, right: DataFrame, by: list[str], finer: str, whole: str, value: str) -> DataFrame:
    """``value`` for (by, finer), else for (by, ``whole``)."""
    exact = right.withColumnRenamed(value, "_exact")
    rest = right.where(F.col(finer) == whole).drop(finer).withColumnRenamed(value, "_rest")
    return (
        left.join(exact, [*by, finer], "left").join(rest, by, "left")
        .withColumn(value, F.coalesce("_exact", "_rest")).drop("_exact", "_rest")
    )


def neighbourhood(table: DataFrame, picks: DataFrame, by: list[str], order: str, before: int, after: int) -> DataFrame:
    """Rows at most ``before`` places before and ``after`` places after a pick."""
    placed = table.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    at = placed.join(picks, [*by, order], "left_semi").select(*by, F.explode(F.sequence(F.col("_n") - before, F.col("_n") + after)).alias("_n"))
    return placed.join(at.distinct(), [*by, "_n"], "left_semi").drop("_n")


def threshold(points: DataFrame, limits: list[tuple[int, int, int]], at: str, name: str) -> DataFrame:
    """A fixed table of (value, first, last) as one expression, no join."""
    out = F.lit(None).cast("int")
    for value, first, last in limits:
        out = F.when(F.col(at).between(first, last), F.lit(value)).otherwise(out)
    return points.withColumn(name, out)
