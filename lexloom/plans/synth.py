"""Legal tables built from the driver's tables, with answers known from columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the reporter spelling of a line number, cycling.
SPELLINGS = ("U.S.", "U. S.", "US", "F.2d", "F. 2d", "S. Ct.", "S.Ct.")
#: What each spelling is, canonically; for the oracle.
CANON = ("U.S.", "U.S.", "U.S.", "F.2d", "F.2d", "S. Ct.", "S. Ct.")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scholar_id, name, court, filed, year, docket."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").cast("string").alias("scholar_id"),
            F.concat("c_name", F.lit(" v. "), "n_name").alias("name"),
            F.col("c_mktsegment").alias("court"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"),
            F.date_format("o_orderdate", "yyyy").alias("year"),
            F.col("c_custkey").alias("party"),
        )
    )


OPINIONS = """
opinions as (
  select cast(o_orderkey as varchar) as scholar_id, c_name || ' v. ' || n_name as name, c_mktsegment as court,
         strftime(o_orderdate, '%Y-%m-%d') as filed, strftime(o_orderdate, '%Y') as year, c_custkey as party
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
)"""


def spelling(line):
    return F.get(F.array(*map(F.lit, SPELLINGS)), (line - 1) % len(SPELLINGS))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scholar_id, vol, reporter, page (one row a distinct citation)."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").cast("string").alias("scholar_id"),
        (F.col("l_suppkey") + 1).cast("int").alias("vol"),
        spelling(F.col("l_linenumber")).alias("reporter"),
        (F.col("l_partkey") + 1).cast("int").alias("page"),
    ).distinct()


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


CITATIONS = f"""
citations as (
  select distinct cast(l_orderkey as varchar) as scholar_id, cast(l_suppkey + 1 as int) as vol,
         {_list(SPELLINGS)}[(l_linenumber - 1) % 7 + 1] as reporter,
         {_list(CANON)}[(l_linenumber - 1) % 7 + 1] as canon,
         cast(l_partkey + 1 as int) as page
  from lineitem
)"""


def citing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, and the columns that the text was made from: a full citation
    with a pin, a short form, an "Id.", and a statute."""
    c = citations(spark, sf_dir).withColumn("pin", F.col("page") + F.col("vol") % 7)
    text = F.format_string(
        "See Party%s v. State, %d %s %d, %d (1990). Then %d %s, at %d. Id. at %d; but cf. 42 U.S.C. § %d(a)(1).",
        "scholar_id", "vol", "reporter", "page", "pin", "vol", "reporter", F.col("pin") + 1, F.col("pin") + 2, "page",
    )
    return c.select(F.concat_ws("-", "scholar_id", "vol", "reporter", "page").alias("doc_id"), text.alias("text"), "vol", "reporter", "page", "pin")
