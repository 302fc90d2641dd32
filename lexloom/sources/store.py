"""The opinion store: JSON lines as the source, Parquet tables as its indexes.

A store is a folder of JSONL files plus derived tables (opinions, citations,
parties). Changes make a new table; nothing is edited in place. The identity of
an opinion is its ``scholar_id`` (text: ids have up to 20 digits).
"""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import cites, names

VERSION = 10
RECORD = T.StructType(
    [
        T.StructField("v", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("scholar_id", "url", "name", "court", "year", "date_filed", "source", "snippet", "html_gz")],
        *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("parties", "cites", "dockets")],
        T.StructField("added_at", T.DoubleType()),
        T.StructField("us_pagination", T.StringType()),
    ]
)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of lines of JSON (column ``value``); other columns of
    the lines stay with the records. A line without an id is bad too."""
    schema = T.StructType([*RECORD.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.where("r is null or r._bad is not null or r.scholar_id is null").select("value")
    rest = [c for c in lines.columns if c != "value"]
    good = parsed.where("r._bad is null and r.scholar_id is not null").select("r.*", *rest).drop("_bad")
    return good, bad


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines). A bad line is set aside, it doesn't fail the read.
    Of several lines for an id the first counts; lines of a file keep their
    order through the position in it."""
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_n")
    )
    good, bad = parse_lines(lines)
    first = Window.partitionBy("scholar_id").orderBy("_file", "_n")
    return good.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_file", "_n"), bad


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select(*[f.name for f in RECORD.fields]).write.mode("overwrite").json(path)


def opinions_table(records: DataFrame) -> DataFrame:
    """One summary row a record: first cite, size of the packed text."""
    return records.select(
        "scholar_id", "url", "name", "court", "year", "date_filed",
        F.get("cites", F.lit(0)).alias("cite"),
        F.length("html_gz").alias("packed"),
    )


def citations_table(records: DataFrame) -> DataFrame:
    """scholar_id, vol, key, page, raw: one row a parsed citation."""
    raw = records.select("scholar_id", F.explode(cites.dedupe_cites(F.col("cites"))).alias("raw"))
    return raw.withColumn("c", cites.parse_cite(F.col("raw"))).where("c is not null").select("scholar_id", "c.vol", "c.key", "c.page", "raw")


def parties_table(records: DataFrame) -> DataFrame:
    return records.select("scholar_id", F.explode(names.tokens(F.col("name"))).alias("token"))


def build(records: DataFrame, path: str) -> None:
    """Write the derived tables, sorted so that point reads prune row groups."""
    for name, table, order in (
        ("opinions", opinions_table(records), ["scholar_id"]),
        ("citations", citations_table(records), ["key", "vol", "page"]),
        ("parties", parties_table(records), ["token"]),
    ):
        table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")


def add(store: DataFrame, new: DataFrame, key: str = "scholar_id") -> DataFrame:
    """The store with the new rows whose ids it lacks; of new rows with one id,
    the first by all columns."""
    order = Window.partitionBy(key).orderBy(*[F.col(c) for c in new.columns if c != key])
    once = new.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return store.unionByName(once.join(store.select(key), key, "left_anti").select(*store.columns))


def replace(store: DataFrame, new: DataFrame, key: str = "scholar_id") -> DataFrame:
    """Rows of the store, those with an id among ``new`` by the new ones; ids the
    store lacks are not added."""
    kept = store.join(new.select(key), key, "left_anti").select(*store.columns)
    changed = new.join(store.select(key).distinct(), key, "left_semi").select(*store.columns)
    return kept.unionByName(changed)


def delete(store: DataFrame, ids: DataFrame, key: str = "scholar_id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti").select(*store.columns)


def merge(ours: DataFrame, theirs: DataFrame, key: str = "scholar_id") -> DataFrame:
    """Both stores with ``status``: kept (ours), added, skipped (ours has it) or
    error (no id). Rows kept and added are the merged store."""
    both = ours.withColumn("_rank", F.lit(0)).unionByName(theirs.withColumn("_rank", F.lit(1)))
    order = Window.partitionBy(key).orderBy("_rank", *[F.col(c) for c in ours.columns if c != key])
    marked = both.withColumn("_r", F.row_number().over(order))
    return marked.withColumn(
        "status",
        F.when(F.col(key).isNull(), "error").when(F.col("_rank") == 0, "kept").when(F.col("_r") == 1, "added").otherwise("skipped"),
    ).drop("_rank", "_r")


def attach(store: DataFrame, facts: DataFrame, column: str, key: str = "scholar_id") -> DataFrame:
    """Set a column from ``facts`` where it has the id; clear it by a null there."""
    facts = facts.select(key, F.col(column).alias("_new"), F.lit(True).alias("_set"))
    return store.join(facts, key, "left").withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_set")


def add_parallel_cite(store: DataFrame, facts: DataFrame, key: str = "scholar_id") -> DataFrame:
    """Append each fact's ``cite`` to the record's cites unless it has it."""
    facts = facts.groupBy(key).agg(F.sort_array(F.collect_set("cite")).alias("_c"))
    joined = store.join(facts, key, "left")
    both = F.when(F.col("_c").isNull(), F.col("cites")).otherwise(F.concat("cites", "_c"))
    return joined.withColumn("cites", cites.dedupe_cites(both)).drop("_c")


def fresh_or_stale(fresh: DataFrame, cached: DataFrame, by: list[str], at: str, now, ttl_seconds: int) -> DataFrame:
    """Cached rows within their time to live; else the fresh row; else the stale."""
    c = cached.withColumn("_age", F.unix_timestamp(now) - F.unix_timestamp(at))
    rows = (
        c.withColumn("_p", F.when(F.col("_age") <= ttl_seconds, 0).otherwise(2)).drop("_age")
        .unionByName(fresh.withColumn("_p", F.lit(1)))
    )
    order = Window.partitionBy(*by).orderBy("_p", F.desc(at))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").withColumn("origin", F.element_at(F.array(F.lit("cache"), F.lit("fresh"), F.lit("stale")), F.col("_p") + 1)).drop("_p", "_r")


def missed_before(queries: DataFrame, misses: DataFrame) -> DataFrame:
    """Queries (``request, citations``) of which any citation was missed: the
    first of them."""
    q = queries.select("request", F.posexplode("citations").alias("n", "citation"))
    return q.join(misses.select("citation").distinct(), "citation", "left_semi").groupBy("request").agg(F.min_by("citation", "n").alias("citation"))


@F.pandas_udf(T.StringType())
def unpack(packed: pd.Series) -> pd.Series:
    """Text of a base64 gzip payload; null where it can't be read."""

    def one(x):
        try:
            return zlib.decompressobj(47).decompress(base64.b64decode(x)).decode("utf-8", "replace")
        except (TypeError, ValueError, zlib.error):
            return None

    return packed.map(one).astype(object)


def unpack_prefix(limit: int):
    """Like ``unpack``, but reads no more than ``limit`` bytes of text."""

    @F.pandas_udf(T.StringType())
    def run(packed: pd.Series) -> pd.Series:
        def one(x):
            try:
                return zlib.decompressobj(47).decompress(base64.b64decode(x), limit).decode("utf-8", "ignore")
            except (TypeError, ValueError, zlib.error):
                return None

        return packed.map(one).astype(object)

    return run


def read_tagged(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A tab-separated file whose first field names the kind of row: p (page
    runs), v (years of volumes), d (starts of decisions)."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    int_at = lambda k: F.get("f", F.lit(k)).try_cast("int")
    return {
        "pages": rows.where("f[0] = 'p'").select(int_at(1).alias("vol"), int_at(2).alias("first"), int_at(3).alias("last"), int_at(4).alias("seq"), F.get("f", F.lit(5)).alias("scan")),
        "volumes": rows.where("f[0] = 'v'").select(int_at(1).alias("vol"), int_at(2).alias("first"), int_at(3).alias("last")),
        "starts": rows.where("f[0] = 'd'").select(int_at(1).alias("vol"), int_at(2).alias("page"), int_at(3).alias("year")),
    }


def read_index(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a uniform tab-separated index (gzip or plain)."""
    options = {"sep": "\t", "quote": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = spark.read.text(path).withColumn("r", F.from_csv("value", f"{schema}, _bad string", options))
    return rows.where("r._bad is null").select("r.*").drop("_bad"), rows.where("r._bad is not null").select("value")
