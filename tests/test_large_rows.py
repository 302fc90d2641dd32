"""Operators on rows that every row would meet, or long ones: right, and in seconds."""

import time

from pyspark.sql import functions as F

from lexloom.functions import dates, names
from lexloom.operators import people, ranking, resolve


def test_long_numerals(spark):
    n = spark.range(300).select((F.col("id") + 4_000_000).cast("int").alias("n"))
    began = time.time()
    got = n.select("n", dates.from_roman(dates.to_roman(F.col("n"))).alias("back")).collect()
    assert len(got) == 300 and all(r.n == r.back for r in got) and time.time() - began < 30
    odd = spark.createDataFrame([("MMIM",), ("xiv",), ("",), ("MX\n",), ("IIX",), (None,)], "t string")
    assert [r[0] for r in odd.select(dates.from_roman(F.col("t"))).collect()] == [2999, 14, None, None, 10, None]


def test_captions_of_many_rows(spark):
    """States and other prosecutors are told once a side."""
    pairs = [("People of the State of New York v. Roe", "State v. Roe", True), ("Kansas v. Glover", "State v. Glover", True), ("New York v. Roe", "New York v. Doe", False), ("Smith v. Acme", "Acme Corp. v. Smithson", True)]
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in pairs])
    rows = spark.range(20_000).select(F.get(made, (F.col("id") % 4).cast("int")).alias("p")).repartition(4)
    began = time.time()
    wrong = rows.where((names.related(F.col("p.a"), F.col("p.b")) != F.col("p.c")) | (names.related(F.col("p.a"), F.col("p.b"), strict=True) != F.col("p.c"))).count()
    assert wrong == 0 and time.time() - began < 30


def test_judges_of_one_surname(spark):
    """Each byline would meet every judge of its surname."""
    judges = spark.range(8_000).select(F.when(F.col("id") % 2 == 0, "McCoy").otherwise("MCCOY").alias("last"), F.concat(F.lit("g"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("first"), F.lit("Xav").alias("middle"))
    given = F.when(F.col("id") % 3 == 0, "X.").when(F.col("id") % 3 == 1, "Gba").otherwise("Qzx")
    asked = spark.range(60_000).select("id", F.concat(given, F.lit(" McCoy Jr.")).alias("byline"))
    began = time.time()
    got = people.judge_surnames(asked, judges, "id", "byline").groupBy(F.col("id") % 3, "surname").count().collect()
    assert {tuple(r) for r in got} == {(0, "MCCOY", 20_000), (1, "McCoy", 20_000), (2, None, 20_000)} and time.time() - began < 40


def test_slips_of_one_date(spark):
    """Requests and slips of one date, alike or not."""
    some = spark.range(20_000)
    slips = some.select(F.col("id").alias("slip_id"), F.lit(1).alias("filed"), F.concat(F.lit("19-"), F.col("id") % 50).alias("docket"), F.lit("").alias("cite"), F.lit("Roe v. Wade").alias("name"), F.col("id").alias("seq"))
    asked = some.select(F.col("id").alias("request"), F.lit(1).alias("filed"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("19-"), F.col("id") % 50)).otherwise("").alias("docket"), F.lit(None).cast("string").alias("cite"), F.when(F.col("id") % 4 < 2, "Roe v. Wade").otherwise("Doe v. Poe").alias("name"))
    began = time.time()
    got = {r.request: (r.slip_id, r.score) for r in resolve.slip_match(asked, slips).collect()}
    took = time.time() - began
    want = {k: (k % 50 if k % 2 == 0 else 0, 1000.0 * (k % 2 == 0) + 30.0 * (k % 4 < 2)) for k in range(20_000) if k % 4 != 3}
    assert got == want and took < 40


def test_pages_of_one_text(spark):
    """Ranges of one long text meet the pages they touch, not all."""
    some = spark.range(60_000).select(F.lit("d").alias("doc"), (F.col("id") * 10).cast("int").alias("offset"), F.col("id").cast("int").alias("page"))
    ranges = some.select("doc", (F.col("offset") + 5).alias("lo"), F.when(F.col("page") % 2 == 0, F.col("offset") + 25).otherwise(F.col("offset") + 5).alias("hi"))
    began = time.time()
    got = {r.lo: r.pages for r in ranking.pages_of_ranges(ranges, some, "doc").collect()}
    took = time.time() - began
    want = {10 * k + 5: [p for p in range(k, k + (3 if k % 2 == 0 else 1)) if p < 60_000] for k in range(60_000)}
    assert got == want and took < 40


def test_pages_of_a_small_file(spark):
    """A side that is many times the file it is read from is not sent to the driver."""
    some = spark.range(60_000).select(F.lit("d").alias("doc"), (F.col("id") * 10).cast("int").alias("offset"), F.col("id").cast("int").alias("page"))
    ranges = some.select("doc", (F.col("offset") + 5).alias("lo"), (F.col("offset") + 25).alias("hi"))
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        got = {r.lo: r.pages for r in ranking.pages_of_ranges(ranges, some, "doc").collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {10 * k + 5: [p for p in range(k, k + 3) if p < 60_000] for k in range(60_000)}
