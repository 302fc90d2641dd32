"""Searches of the opinion store: by citation, by party, by shape of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import cites, names


def by_citation(opinions: DataFrame, citations: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: request, cite text -> request, scholar_id, name, year, rank
    (by year, then name, then id). Spellings of a reporter count as one."""
    asked = wanted.withColumn("c", cites.parse_cite(F.col("cite"))).where("c is not null").select("request", "c.vol", "c.key", "c.page")
    keyed = citations.withColumn("key", cites.reporter_key(F.col("reporter"))).select("scholar_id", "vol", "key", "page").distinct()
    found = keyed.join(asked, ["vol", "key", "page"]).select("request", "scholar_id").distinct()
    out = found.join(opinions.select("scholar_id", "name", "year"), "scholar_id")
    order = Window.partitionBy("request").orderBy("year", "name", "scholar_id")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).select("request", "scholar_id", "name", "year", "rank")


def party_index(opinions: DataFrame) -> DataFrame:
    """scholar_id, tokens (all of a name's), token (one a row)."""
    named = opinions.select("scholar_id", names.tokens(F.col("name")).alias("tokens"))
    return named.select("scholar_id", "tokens", F.explode("tokens").alias("token"))


def _asked(wanted: DataFrame) -> DataFrame:
    held = wanted.select("request", names.tokens(F.col("query")).alias("needed"))
    return held.select("request", "needed", F.explode("needed").alias("token"))


def all_tokens(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relational division: opinions whose names hold every token of a query.

    Opinions meet a query on its rarest token only (a token that no name holds is
    rarest of all), and the other tokens are looked up in the name's own array, so
    a token that all names share pairs nothing."""
    asked = _asked(wanted)
    found = index.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        asked.join(found, "token", "left").groupBy("request")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("needed").alias("needed"))
    )
    return index.join(rarest, "token").where(F.size(F.array_except("needed", "tokens")) == 0).select("request", "scholar_id")


def any_token(index: DataFrame, opinions: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best opinions of each query: most hits, year, name, id. The
    window's limit is applied before its shuffle too, so a token that all names
    share sends ``limit`` rows a task."""
    hits = F.size(F.array_intersect("needed", "tokens")).cast("long").alias("hits")
    # An opinion meets a query once, on the first of the tokens that they share.
    first = F.get(F.array_intersect("tokens", "needed"), F.lit(0)) == F.col("token")
    found = index.join(_asked(wanted), "token").where(first).select("request", "scholar_id", hits)
    found = found.join(opinions.select("scholar_id", "name", "year"), "scholar_id")
    order = Window.partitionBy("request").orderBy(F.desc("hits"), "year", "name", "scholar_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).withColumn("rank", F.col("n").cast("long")).drop("n")


def shape(query):
    """What a query is, by its form: an id, a citation, or party names."""
    return F.when(query.rlike("^[0-9]{1,20}$"), "id").when(cites.parse_cite(query).isNotNull(), "cite").otherwise("name")


def find(opinions: DataFrame, citations: DataFrame, wanted: DataFrame) -> DataFrame:
    """request, route, scholar_id: each query goes down the way of its shape."""
    routed = wanted.withColumn("route", shape(F.col("query")))
    by_id = routed.where("route = 'id'").join(opinions.select("scholar_id"), F.col("query") == F.col("scholar_id"))
    cite = by_citation(opinions, citations, routed.where("route = 'cite'").select("request", F.col("query").alias("cite")))
    name = all_tokens(party_index(opinions), routed.where("route = 'name'").select("request", "query"))
    return (
        by_id.select("request", "route", "scholar_id")
        .unionByName(cite.select("request", F.lit("cite").alias("route"), "scholar_id"))
        .unionByName(name.select("request", F.lit("name").alias("route"), "scholar_id"))
    )


def page_mates(cites_df: DataFrame, opinions: DataFrame, floor: float = 0.6) -> DataFrame:
    """Of the opinions that share a page, the one whose name fits the citing name
    best (score, year match, then input order); null where none fits."""
    scored = cites_df.join(opinions, ["vol", "key", "page"]).withColumn("score", names.overlap_score(F.col("cited_name"), F.col("name"), floor))
    order = Window.partitionBy("cite_id").orderBy(F.desc("score"), F.desc(F.col("cited_year") == F.col("year")), "scholar_id")
    best = scored.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select("cite_id", F.when(F.col("score") > 0, F.col("scholar_id")).alias("scholar_id"), "score")
