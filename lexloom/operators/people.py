"""Judges: the table of names, and the surname in a byline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.names import letters

SUFFIX = r"(?i)(?:\s+(?:Jr|Sr)\.?|\s+I{2,3}|\s+IV)+$"


def read_judges(spark: SparkSession, path: str) -> DataFrame:
    """last, first, middle from a directory's CSV; rows without a last name go."""
    rows = spark.read.option("header", True).csv(path)
    trimmed = [F.trim(F.coalesce(f"`{c} Name`", F.lit(""))).alias(c.lower()) for c in ("Last", "First", "Middle")]
    return rows.select(*trimmed).where("last <> ''").distinct()


def judge_surnames(bylines: DataFrame, judges: DataFrame, key: str, name: str) -> DataFrame:
    """``key, surname``: the longest end of a byline's name that is a judge's last
    name, where its first word is that judge's first or a middle name, or their
    initial; null where there is none. As printed, unless only the capitals of the
    table's differ.

    Judges are gathered by what a first word may be, so a byline meets one row,
    however many judges share the name."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), SUFFIX, "")), r"\s+")
    rows = bylines.select(key, words.alias("w")).where(F.size("w") > 1)
    ends = F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.array_join(F.slice("w", k, F.size("w")), " "))
    split = rows.select(key, letters(F.get("w", F.lit(0))).alias("word"), F.posexplode(ends).alias("at", "written")).where("word <> ''")
    asked = split.withColumns({"k": letters(F.col("written")), "low": F.lower("written")})
    table = judges.select(
        letters(F.col("last")).alias("k"), "last", F.lower("last").alias("low"),
        F.concat(F.array(letters(F.col("first"))), F.transform(F.split(F.coalesce("middle", F.lit("")), r"\s+"), letters)).alias("given"),
    )
    fits = F.array_distinct(F.filter(F.concat("given", F.transform("given", lambda g: F.left(g, F.lit(1)))), lambda g: g != ""))
    told = table.select("k", "low", "last", F.explode(fits).alias("word")).groupBy("k", "word", "low").agg(F.min("last").alias("last"))
    found = asked.join(told.select("k", "word").distinct(), ["k", "word"]).join(told, ["k", "word", "low"], "left")
    surname = F.coalesce("last", "written")
    one = found.groupBy(key).agg(F.min_by(surname, F.struct("at", F.col("last").isNull(), surname)).alias("surname"))
    return bylines.select(key).join(one, key, "left")
