"""A source's text as one string with addresses, and scans of printed volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import lookup


def flattened(blocks: DataFrame, by: str, order: str, text: str, gap: int = 1) -> DataFrame:
    """Blocks with ``start`` and ``end``: where each lies in the document's text,
    blocks being ``gap`` letters apart."""
    w = Window.partitionBy(by).orderBy(order)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    before = F.coalesce(F.sum(size + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("start", before.cast("int")).withColumn("end", (F.col("start") + size).cast("int"))


def addresses(offsets: DataFrame, flat: DataFrame, by: str, order: str, at: str) -> DataFrame:
    """``by, at``, the block that holds each offset, and the place in it; an offset
    between blocks belongs to the one before."""
    starts = flat.select(by, F.col("start"), F.col(order).alias("block"))
    found = lookup.nearest(offsets, starts.select(by, "start"), [by], at, "start")
    return found.join(starts, [by, "start"], "left").withColumn("place", F.col(at) - F.col("start")).drop("start")


def scan_pages(cited: DataFrame, runs: DataFrame, vol: str, page: str) -> DataFrame:
    """``vol, page``, the scan and its page: printed pages run on from the first of
    a run. ``runs``: vol, first, last, seq, scan."""
    found = lookup.interval_join(cited, runs, [vol], page, "first", "last")
    return found.withColumn("seq", F.col("seq") + F.col(page) - F.col("first")).drop("first", "last")


def carve(pages: DataFrame, opinions: DataFrame, vol: str, first: str) -> DataFrame:
    """The pages of each opinion of a volume: from its first printed page to the
    one on which the next begins. ``pages``: vol, label, seq."""
    ends = F.lead(first).over(Window.partitionBy(vol).orderBy(first))
    spans = opinions.withColumn("until", ends)
    return lookup.interval_join(pages, spans, [vol], "label", first, "until")


def breadcrumbs(units: DataFrame, key: str, parent: str, name: str, depth: int = 12) -> DataFrame:
    """``key, path``: the names from the root of a table of contents to each unit. A
    round climbs one level; rounds end with the deepest unit, or after ``depth``."""
    done = units.where(F.col(parent).isNull()).select(key, F.col(name).alias("path"))
    level = done
    for _ in range(depth):
        up = level.select(F.col(key).alias(parent), F.col("path").alias("above"))
        level = units.join(up, parent).select(key, F.concat_ws(" > ", "above", name).alias("path"))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done
