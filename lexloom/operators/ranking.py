"""Rankings, choices and tallies over candidates, documents, pages and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import names
from lexloom.operators.lookup import interval_join

# Relations of a case to another, in the order they are listed.
RELATIONS = ("reviewed", "below", "remand", "same")


def pick_named(candidates: DataFrame, key: str, name: str, year: str, title: str, title_year: str, seq: str, floor: float = 0.6) -> DataFrame:
    """``key``, all columns and ``score``: of each key's candidates the one whose
    title answers best to the name, then whose year is the one given, then the
    first. None where a name is given and no side of it matches; the first where
    neither name nor year is."""
    asked = F.coalesce(F.col(name), F.lit("")) != ""
    score = F.when(asked, names.overlap_score(F.col(name), F.col(title), floor)).otherwise(0.0)
    hit = F.coalesce(F.col(year) == F.col(title_year), F.lit(False)) & (F.coalesce(F.col(year).cast("string"), F.lit("")) != "")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("year_hit"), seq))
    scored = candidates.withColumns({"score": score, "year_hit": hit})
    return scored.withColumn("n", rank).where("n = 1").where(~asked | (F.col("score") > 0)).drop("n")


def rerank(hits: DataFrame, key: str, order: list, query: str, title: str, limit: int, floor: float) -> DataFrame:
    """The first ``4 * limit`` hits of each key in ``order``, then by how closely
    their title answers to the query, those of ``floor`` or more, best first."""
    wide = hits.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= 4 * limit)
    scored = wide.withColumn("score", names.overlap_score(F.col(query), F.col(title))).where(F.col("score") >= floor)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "n"))
    return scored.withColumn("rank", best).where(F.col("rank") <= limit).drop("n")


def by_relation(rows: DataFrame, key: str, relation: str, filed: str, seq: str) -> DataFrame:
    """``place``: relations in their order, then by date, missing dates last."""
    order = F.coalesce(*[F.when(F.col(relation) == r, F.lit(k)) for k, r in enumerate(RELATIONS)], F.lit(9))
    by = Window.partitionBy(key).orderBy(order, F.coalesce(F.nullif(F.col(filed), F.lit("")), F.lit("9999")), seq)
    return rows.withColumn("place", F.row_number().over(by))


def several_cases(results: DataFrame, key: str, title: str) -> DataFrame:
    """``key, several``: do the results' titles name more than one case?"""
    return results.groupBy(key).agg((F.count_distinct(names.title_words(F.col(title))) > 1).alias("several"))


def canonical_url(url: Column) -> Column:
    """Host and path without case and closing slashes, and the query if any."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    # A plus sign is a plus sign in a path, where url_decode takes it for a blank.
    path = F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path), "/+$", ""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def distinct_documents(documents: DataFrame, by: str, url: str, stage: str, seq: str) -> DataFrame:
    """Each canonical url once, the first in order; certiorari before merits before
    the rest (``place``). Documents without a url go."""
    keyed = documents.withColumn("url_key", canonical_url(F.col(url))).where("url_key <> ''")
    first = F.row_number().over(Window.partitionBy(by, "url_key").orderBy(seq))
    order = F.when(F.col(stage) == "cert", 0).when(F.col(stage) == "merits", 1).otherwise(2)
    once = keyed.withColumn("n", first).where("n = 1").drop("n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, seq)))


def modes(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """``by, value, n``: the most frequent value, of equals the first seen."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    best = F.struct("n", (-F.col("first")).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(value, best).alias(value), F.max("n").alias("n"))


def body_metrics(lines: DataFrame, by: str, seq: str, full: int = 40) -> DataFrame:
    """``by, left, right, height``: modal margins (rounded) and median height of
    lines over ``full`` letters; 0, 612 and 10 where there are none."""
    body = lines.where(F.length("text") > full)
    out = lines.select(by).distinct()
    for name, at in (("left", "x0"), ("right", "x1")):
        rounded = body.select(by, seq, F.bround(F.col(at)).alias(name))
        out = out.join(modes(rounded, [by], name, seq).drop("n"), by, "left")
    out = out.join(body.groupBy(by).agg(F.median("height").alias("height")), by, "left")
    return out.select(by, F.coalesce("left", F.lit(0.0)).alias("left"), F.coalesce("right", F.lit(612.0)).alias("right"), F.coalesce("height", F.lit(10.0)).alias("height"))


def pages_of_ranges(ranges: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """``by, lo, hi, pages``: the printed pages that each range of offsets touches,
    in order, runs of the same page once. ``ranges``: by, lo, hi; ``pages``: by,
    offset (where a page begins), page.

    A page is touched that begins in the range, or that holds its beginning; both
    are interval joins. Both sides are large, and several times the file that Spark
    judges their size by; the hints keep it from broadcasting one."""
    ends = F.lead("offset").over(Window.partitionBy(by).orderBy("offset"))
    spans = pages.where("page is not null").select(by, "offset", "page", ends.alias("until"))
    asked = ranges.select(by, "lo", "hi").distinct().withColumn("first", F.least("lo", "hi"))
    asked = asked.withColumn("last", F.greatest(F.greatest("lo", "hi"), F.col("first") + 1) - 1)
    begun = interval_join(spans.hint("merge"), asked, [by], "offset", "first", "last").where(F.coalesce(F.col("until") > F.col("first"), F.lit(True)))
    inner = spans.select(by, "offset", "page", (F.col("offset") + 1).alias("from"), (F.col("until") - 1).alias("to"))
    under = interval_join(asked.hint("merge"), inner, [by], "first", "from", "to")
    touched = begun.select(by, "lo", "hi", "offset", "page").unionByName(under.select(by, "lo", "hi", "offset", "page"))
    listed = touched.groupBy(by, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("offset", "page"))).alias("p"))
    runs = F.filter("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1)["page"] != x["page"]))
    return ranges.hint("merge").join(listed.select(by, "lo", "hi", F.transform(runs, lambda x: x["page"]).alias("pages")), [by, "lo", "hi"], "left").withColumn(
        "pages", F.coalesce("pages", F.array().cast("array<int>"))
    )


def spaced(requests: DataFrame, by: str, at: str, seq: str, gap: float) -> DataFrame:
    """``sent``: when each request goes if a source's requests are ``gap`` apart at
    least. sent(i) = max over j <= i of at(j) + (i - j) gap, a running maximum."""
    order = Window.partitionBy(by).orderBy(at, seq)
    n = F.row_number().over(order)
    lead = requests.withColumn("n", n).withColumn("slack", F.col(at) - F.col("n") * gap)
    run = F.max("slack").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lead.withColumn("sent", run + F.col("n") * gap).drop("n", "slack")


def resting(requests: DataFrame, by: str, at: str, failed: str, rest: float) -> DataFrame:
    """``blocked``: is a source resting when a request comes, ``rest`` after the
    last failure before it?"""
    before = Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(failed), F.col(at))).over(before)
    return requests.withColumn("blocked", F.coalesce(F.col(at) < last + rest, F.lit(False)))


def cached(requests: DataFrame, cache: DataFrame, key: str, now: str, ok: str, ttl: float) -> DataFrame:
    """``answer, source``: a fresh entry; else what the source gives; else, where it
    fails, the stale entry."""
    held = requests.join(cache.select(key, F.col("saved_at"), F.col("value").alias("held")), key, "left")
    fresh = F.coalesce(F.col(now) - F.col("saved_at") < ttl, F.lit(False))
    source = F.when(fresh, "cache").when(F.col(ok), "source").when(F.col("held").isNotNull(), "stale").otherwise("none")
    return held.withColumn("source", source).withColumn("answer", F.when(F.col("source").isin("cache", "stale"), F.col("held")).when(F.col("source") == "source", F.col("live")))


def newest(rows: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, with the group's total."""
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    top = rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= limit)
    return top.join(total, by)


def offset_votes(source: DataFrame, page: DataFrame, by: str, width: int = 3, often: int = 8, top: int = 12) -> DataFrame:
    """``by, offset, votes, rank``: by how many words a page lies behind the start
    of its source. Equal runs of ``width`` words give six votes, equal words one;
    words and runs that the source has more than ``often`` times don't vote.
    ``source`` and ``page``: by, pos, word."""

    def grams(t: DataFrame, n: int) -> DataFrame:
        order = Window.partitionBy(by).orderBy("pos")
        words = F.array(*[F.lead("word", k).over(order) if k else F.col("word") for k in range(n)])
        return t.select(by, "pos", words.alias("gram")).where(~F.exists("gram", F.isnull))

    votes = None
    for n, weight in ((width, 6), (1, 1)):
        own = grams(source, n)
        rare = own.groupBy(by, "gram").agg(F.count("*").alias("m"), F.collect_list("pos").alias("at")).where(F.col("m") <= often)
        part = grams(page, n).join(rare, [by, "gram"]).select(by, F.explode("at").alias("at"), "pos").select(by, (F.col("at") - F.col("pos")).alias("offset"), F.lit(weight).alias("w"))
        votes = part if votes is None else votes.unionByName(part)
    summed = votes.groupBy(by, "offset").agg(F.sum("w").alias("votes"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("votes"), "offset"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= top)


def report_rank(title: Column, congress: Column, number: Column, chamber: Column) -> Column:
    """How surely an archive's title is a report itself: 2 where it says so apart
    from the number, 1 where it names the report, 0 where it is a bill or names
    another report or chamber."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")
    no = F.concat(congress.cast("string"), F.lit(r"\s*[-–]\s*"), number.cast("string"), F.lit(r"(?!\d)"))
    word = r"(?i)(?:Rep(?:ort|t)?\.?|Rpt\.?)"
    named = F.regexp_like(t, F.concat(F.lit(word + r"\s*(?:No\.?\s*)?"), no)) | F.regexp_like(t, F.concat(F.lit(word + r"\b[^;]{0,80};\s*no\.\s*"), no))
    house, senate = t.rlike(r"(?i)(?:House|H\.\s?R?\.?|Representatives)"), t.rlike(r"(?i)(?:Senate|S\.)")
    bill = t.rlike(r"(?i)^\W*(?:ERIC\s+\w+:\s*)?(?:S\.|H\.\s?R\.|H\.\s?J\.\s?Res\.)\s*\d+\s*[;,.]|\bAn Act\b")
    own = t.rlike(r"(?i)\breport\b(?!\s*(?:No\.?\s*)?\d)")
    return F.when(named & F.when(chamber == "h", house).otherwise(senate) & ~bill, 1 + own.cast("int")).otherwise(0)


def case_search(index: DataFrame, asked: DataFrame, limit: int = 1) -> DataFrame:
    """``request, num, score, rank``: names that hold every distinctive word of a
    query, by the closeness of the match, then the shorter name, then the number.
    They meet on the query's longest word, by its letters but the last two that a
    name may add."""
    need, words = names.distinctive(F.col("query")), F.array_distinct(F.split(names.folded(F.col("name")), " "))
    longest = F.element_at(F.array_sort(F.transform(need, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    left = asked.where(F.size(need) > 0).withColumn("meet", longest)
    shorter = lambda w: F.transform(F.sequence(F.lit(0), F.least(F.lit(2), F.length(w) - 1)), lambda k: F.left(w, F.length(w) - k))
    right = index.withColumn("meet", F.explode(F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: w != ""), shorter)))))
    scored = left.join(right, "meet").withColumn("score", names.name_match(F.col("query"), F.col("name"))).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), F.length(names.folded(F.col("name"))), "num"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("request", "num", "score", "rank")


def alignment_scores(source: DataFrame, page: DataFrame, offsets: DataFrame, by: str) -> DataFrame:
    """``by, offset, score``: 0.85 of the share of a page's words that equal the
    source's at an offset, and 0.15 of the longest run of them, of eight words at
    most. ``offsets``: by, offset; the others: by, pos, word."""
    size = page.groupBy(by).agg(F.count("*").alias("n"))
    placed = page.join(offsets, by).withColumn("at", F.col("pos") + F.col("offset"))
    hits = placed.join(source.select(by, F.col("pos").alias("at"), "word"), [by, "at", "word"]).select(by, "offset", "pos")
    runs = hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(by, "offset").orderBy("pos")))
    blocks = runs.groupBy(by, "offset", "run").agg(F.count("*").alias("size")).groupBy(by, "offset").agg(F.sum("size").alias("matched"), F.max("size").alias("longest"))
    out = offsets.join(size, by).join(blocks, [by, "offset"], "left")
    matched, longest = F.coalesce("matched", F.lit(0)), F.coalesce("longest", F.lit(0))
    return out.select(by, "offset", (0.85 * matched / F.col("n") + 0.15 * F.least(F.lit(1.0), longest / 8.0)).alias("score"))
