"""Sequential computations as windows and folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_spans(spans: Column) -> Column:
    """Leftmost-longest choice from array<struct<start, end, order, ...>>: walk by
    start, then longer, then order; a span that begins before the last taken
    one's end goes. One fold inside a row."""
    ordered = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["order"].alias("o"), s.alias("s")))),
        lambda x: x["s"],
    )
    begin = F.struct(F.lit(0).alias("at"), F.filter(spans, lambda s: F.lit(False)).alias("out"))

    def step(acc, s):
        free = s["start"] >= acc["at"]
        return F.struct(
            F.when(free, s["end"]).otherwise(acc["at"]).cast("int").alias("at"),
            F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ordered, begin, step)["out"]


def islands(table: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers: by, first, last, n."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(at))
    runs = table.select(*by, at).distinct().withColumn("_g", F.col(at) - n)
    return runs.groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_g")


def coalesce_spans(table: DataFrame, by: list[str], lo: str, hi: str, gap: int) -> DataFrame:
    """Spans joined where the next begins at most ``gap`` after the end so far."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(lo) > reach + gap, 1).when(reach.isNull(), 1).otherwise(0)
    marked = table.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_g").agg(F.min(lo).alias("first"), F.max(hi).alias("last"), F.count("*").alias("n")).drop("_g")


def dominant_cluster(table: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """Of the clusters that gaps over ``gap`` part, the one with most members; of
    equals the first."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    marked = table.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = marked.groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    best = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return clusters.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_g")


def neighbours(table: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return table.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def up_to_linked(table: DataFrame, by: list[str], order: list, linked: str, limit: int) -> DataFrame:
    """Rows in order up to and with the ``limit``-th linked one."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col(linked).cast("int")).over(before), F.lit(0))
    return table.withColumn("_seen", seen).where(F.col("_seen") < limit).drop("_seen")


def interpolate(table: DataFrame, by: list[str], at: str, value: str, trust: float = 0.55) -> DataFrame:
    """Null values between two known ones are set on the line between them, with
    ``confidence`` ``trust``; known ones have 1, others null."""
    back = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    known = lambda c: F.when(F.col(value).isNotNull(), F.col(c))
    t = table.withColumns(
        {
            "_a0": F.last(known(at), True).over(back), "_v0": F.last(value, True).over(back),
            "_a1": F.first(known(at), True).over(ahead), "_v1": F.first(value, True).over(ahead),
        }
    )
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_a0")) / (F.col("_a1") - F.col("_a0"))
    return t.withColumns(
        {
            "filled": F.when(F.col(value).isNotNull(), F.col(value).cast("double")).otherwise(line),
            "confidence": F.when(F.col(value).isNotNull(), F.lit(1.0)).when(line.isNotNull(), F.lit(trust)),
        }
    ).drop("_a0", "_v0", "_a1", "_v1")


def longest_chain(pdf: pd.DataFrame) -> list[bool]:
    """Members of the heaviest chain of non-decreasing values, by position. A
    Fenwick tree over the values' ranks holds the heaviest chain that ends at or
    below each, of equal ones the first, so n values take n log n steps."""
    values, weights = pdf["value"].tolist(), pdf["weight"].tolist()
    rank = {v: k for k, v in enumerate(sorted(set(values)), 1)}
    tree: list[tuple[float, int]] = [(0.0, 1)] * (len(rank) + 1)
    best, back = [], []
    for i, (v, w) in enumerate(zip(values, weights, strict=True)):
        top, at = (0.0, 1), rank[v]
        while at:
            top = max(top, tree[at])
            at &= at - 1
        best.append(w + top[0])
        back.append(-top[1])
        own, at = (best[i], -i), rank[v]
        while at < len(tree):
            tree[at] = max(tree[at], own)
            at += at & -at
    keep = [False] * len(values)
    k = max(range(len(best)), key=lambda i: (best[i], -i), default=-1)
    while k >= 0:
        keep[k], k = True, back[k]
    return keep


def monotonic(table: DataFrame, by: str, at: str, value: str, weight: str) -> DataFrame:
    """by, at, value, kept: outliers of a sequence that should not fall. One
    document's pages make a group, so groups are small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable").reset_index(drop=True)
        pdf["kept"] = longest_chain(pdf)
        return pdf[["key", "at", "value", "kept"]]

    rows = table.select(F.col(by).alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("value"), F.col(weight).cast("double").alias("weight"))
    kind = rows.schema["key"].dataType.simpleString()
    place = rows.schema["at"].dataType.simpleString()
    return rows.groupBy("key").applyInPandas(run, f"key {kind}, at {place}, value double, kept boolean")


def unique_names(table: DataFrame, stem: str, order: list[str]) -> DataFrame:
    """File names made distinct, ignoring case: "stem", "stem (2)", ..."""
    n = F.row_number().over(Window.partitionBy(F.lower(stem)).orderBy(*order))
    return table.withColumn("_n", n).withColumn("file", F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))).drop("_n")

