"""Votes and evidence: years, name forms, grouped writings, related cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def year_votes(cited: DataFrame) -> DataFrame:
    """``case_id, snippet, given, year`` -> ``case_id, year, votes, total``: one
    vote a distinct snippet (white space made single), for the year given or the
    next one only."""
    plain = F.trim(F.regexp_replace("snippet", r"\s+", " "))
    votes = cited.where((F.col("year") - F.col("given")).isin(0, 1)).withColumn("_s", plain).groupBy("case_id", "_s").agg(F.min("year").alias("year"))
    counts = votes.groupBy("case_id", "year").agg(F.count("*").alias("votes"))
    return counts.withColumn("total", F.sum("votes").over(Window.partitionBy("case_id")))


def pick_year(votes: DataFrame) -> DataFrame:
    """The year with two votes or more and two thirds of them at least."""
    return votes.where("votes >= 2 and votes * 3 >= total * 2").select("case_id", "year", "votes", "total")


def pick_form(counts: DataFrame) -> DataFrame:
    """``case_id, form, uses, is_default`` -> the most used form with two uses or
    more; the default wins a tie, then the form first by text."""
    top = counts.where("uses >= 2")
    order = Window.partitionBy("case_id").orderBy(F.desc("uses"), F.desc("is_default"), "form")
    return top.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("case_id", "form", "uses")


def group_writings(rows: DataFrame) -> DataFrame:
    """``day, docket, name, author, url, page, seq, cite`` -> one row a case and
    day: members by page then input order, distinct authors in that order, the
    first url that isn't empty, the first member's cite."""
    key = F.coalesce(F.nullif(F.upper(F.trim("docket")), F.lit("")), F.lower(F.trim("name")))
    members = F.array_sort(F.collect_list(F.struct("page", "seq", "author", "url", "cite")))
    grouped = rows.withColumn("case_key", key).groupBy("day", "case_key").agg(members.alias("m"))
    urls = F.filter(F.transform("m", lambda x: x["url"]), lambda u: u.isNotNull() & (u != ""))
    return grouped.select(
        "day", "case_key",
        F.size("m").alias("n"),
        F.array_join(F.array_distinct(F.transform("m", lambda x: x["author"])), "; ").alias("authors"),
        F.get(urls, F.lit(0)).alias("url"),
        F.col("m")[0]["cite"].alias("cite"),
    )


STRONG = ("docket", "cites")


def merge_signals(signals: DataFrame) -> DataFrame:
    """``case_id, court, cite, cluster, seq, relation, name, filed, signal`` -> one
    row a related case: the first relation and name win, other facts are filled
    from later rows; confirmed by a strong signal or two different ones."""
    key = F.coalesce(F.nullif(F.lower("cite"), F.lit("")), F.concat(F.lit("#"), F.col("cluster").cast("string")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    merged = signals.withColumn("rel_key", key).groupBy("case_id", "court", "rel_key").agg(
        first("relation"), first("name"), first("filed"), F.sort_array(F.collect_set("signal")).alias("signals")
    )
    strong = F.arrays_overlap("signals", F.array(*map(F.lit, STRONG)))
    return merged.withColumn("confidence", F.when(strong | (F.size("signals") >= 2), "confirmed").otherwise("possible"))


def relation_of(rank, other_rank, filed, other_filed):
    """What another court's decision is to ours, by rank of court and date."""
    return (
        F.when(other_rank == rank, "same").when(other_rank > rank, "reviewed").when(other_filed > filed, "remand").otherwise("below")
    )


def vote_lines(votes: DataFrame) -> DataFrame:
    """``case_id, justice, side`` -> counts by side and a line such as 5–4."""
    n = lambda s: F.count_if(F.col("side") == s)
    out = votes.groupBy("case_id").agg(n("majority").alias("majority"), n("minority").alias("minority"), F.count_if(~F.col("side").isin("majority", "minority")).alias("other"))
    return out.withColumn("line", F.concat_ws("-", F.col("majority").cast("string"), F.col("minority").cast("string")))


def authorities(links: DataFrame) -> DataFrame:
    """``doc_id, start, kind, value, name, year`` -> one row a distinct authority,
    in order of first appearance; pins don't tell authorities apart; the first
    name and year that are known fill it."""
    base = F.regexp_replace("value", "@.*$", "")
    key = F.when(F.col("kind").isin("usc", "cfr"), F.regexp_replace("value", "^([^:]*:[^:]*):.*$", "$1")).otherwise(base)
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("start"))).alias(c)
    rows = links.withColumn("authority", key).groupBy("doc_id", "kind", "authority").agg(F.min("start").alias("first"), F.count("*").alias("uses"), known("name"), known("year"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "kind", "authority")))
