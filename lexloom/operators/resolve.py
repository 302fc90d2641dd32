"""Entity resolution: revisions, near-duplicates, slip opinions, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import names, text
from lexloom.operators import shingles
from lexloom.session import stage


def shared_shingles(table: DataFrame, key: str, grams: str, floor: float) -> DataFrame:
    """``a, b, shared, similarity``: pairs of rows whose gram sets overlap by
    ``floor`` of the smaller set or more. Every shared gram counts.

    Equal gram sets are one class before the join, so a group of copies costs one
    row; a gram that all classes share would pair them all, so pairs are formed
    on the rarest grams only: a pair that shares ``floor`` of the smaller set has
    a common gram among the smaller set's ``(1 - floor) * n + 1`` rarest.
    """
    sets = table.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(grams)).alias("g")).where("size(g) > 0")
    classes = sets.groupBy("g").agg(F.min("id").alias("id"))
    freq = classes.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    ranked = (
        classes.select("id", F.size("g").alias("size"), F.explode("g").alias("gram")).join(freq, "gram")
        .withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("n", "gram")))
    )
    # A product that rounding left below a whole number counts as that number.
    probe = ranked.where(F.col("r") <= F.floor((1 - floor) * F.col("size") + 1e-6) + 1).where("n > 1").select("gram", F.col("id").alias("a"), F.col("size").alias("a_size"))
    build = ranked.where("n > 1").select("gram", F.col("id").alias("b"), F.col("size").alias("b_size"))
    pairs = probe.join(build, "gram").where("a <> b and (a_size < b_size or (a_size = b_size and a < b))").select("a", "b").distinct()
    x, y = classes.select(F.col("id").alias("a"), F.col("g").alias("ga")), classes.select(F.col("id").alias("b"), F.col("g").alias("gb"))
    exact = pairs.join(x, "a").join(y, "b")
    scored = exact.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("shared"), text.containment(F.col("ga"), F.col("gb")).alias("similarity"))
    return scored.where(F.col("similarity") >= floor).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "similarity")


def gram_classes(table: DataFrame, key: str, grams: str) -> DataFrame:
    """``key, class_id``: the least key of the rows with the same gram set, which
    stands for them all in the pairs of ``shared_shingles``."""
    sets = table.select(key, F.array_sort(F.array_distinct(grams)).alias("g")).where("size(g) > 0")
    return sets.select(key, F.min(key).over(Window.partitionBy("g")).alias("class_id"))


def alike_texts(table: DataFrame, key: str, column: str, n: int, floor: float) -> DataFrame:
    """``a, b, shared, similarity`` as ``shared_shingles`` has them, of the texts'
    runs of ``n`` words, compared by their 64-bit hashes. ``key``: whole numbers."""
    texts = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.lit(0).cast("long").alias("scope"), F.lower(F.coalesce(column, F.lit(""))).alias("text"))
    sets = stage(shingles.sizes(texts, n).groupBy("set").agg(F.min("id").alias("id"), F.first("size").alias("size")).select("id", "size"), "sets")
    return shingles.overlaps(texts, sets, n, floor)


def revisions(records: DataFrame, floor: float = 0.55, court: str | None = None) -> DataFrame:
    """``old_id, new_id, similarity``: unreported records that a reported one of
    the same date supersedes. Dockets may not both be known and disjoint; texts
    share ``floor`` of their seven-word shingles; the most similar reported record
    wins, then the largest id. ``records``: scholar_id, filed, reported, dockets,
    text, and with ``court`` a column of that name.

    Records of a date meet on the rare shingles that similar texts must share, so a
    date on which much was filed pairs no more than that. Those alike in date,
    dockets and shingles are one: of the reported ones the largest id."""
    chosen = records.where("filed is not null and reported is not null and scholar_id is not null")
    if court is not None:
        chosen = chosen.where(F.col("court") == court)
    whole = chosen.schema["scholar_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = (F.col("scholar_id").cast("long") if whole else F.xxhash64("scholar_id")).alias("id")
    texts = chosen.select(number, F.xxhash64("filed").alias("scope"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    facts = chosen.select(number, "scholar_id", "filed", "reported", "dockets")
    rows = stage(shingles.sizes(texts, 7).join(facts, "id"), "records")
    first = F.when(F.col("reported"), F.max_by("id", "scholar_id")).otherwise(F.min_by("id", "scholar_id"))
    classes = rows.groupBy("set", "filed", "reported", "dockets").agg(first.alias("id"), F.max("scholar_id").alias("last"), F.first("size").alias("size"))
    classes = stage(classes, "classes")
    found = shingles.overlaps(texts, classes.select("id", "size", (~F.col("reported")).alias("old")), 7, floor, sided=True)
    old = classes.where("not reported").select(F.col("id").alias("a"), F.col("dockets").alias("d0"), "set", "filed")
    new = classes.where("reported").select(F.col("id").alias("b"), F.col("dockets").alias("d1"), F.col("last").alias("new_id"))
    apart = (F.size("d0") > 0) & (F.size("d1") > 0) & ~F.arrays_overlap("d0", "d1")
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), F.desc("new_id"))
    top = found.join(old, "a").join(new, "b").where(~apart).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    members = rows.where("not reported").select(F.col("scholar_id").alias("old_id"), "set", "filed", F.col("dockets").alias("d0"))
    same = (members["set"] == top["set"]) & (members["filed"] == top["filed"]) & members["d0"].eqNullSafe(top["d0"])
    return members.join(top, same).select("old_id", "new_id", "similarity")


def slip_match(wanted: DataFrame, slips: DataFrame, floor: float = 0.65) -> DataFrame:
    """``request, slip_id, score``: the slip of the same date with the best
    1000 * docket + 900 * cite + 30 * name; it must match by docket or cite, or by
    a name score of ``floor`` or more. Ties go to the first in order.

    Slips alike in all that is compared are one, the first of them, and so are the
    requests. The rest meet on a docket, a cite or a word of their names: names
    without a common word score 0."""
    w = wanted.select("request", "filed", F.col("docket").alias("w_docket"), F.col("cite").alias("w_cite"), F.col("name").alias("w_name"))
    asks, has = ["w_docket", "w_cite", "w_name"], ["docket", "cite", "name"]
    asked = w.where("filed is not null").select("filed", *asks).distinct()
    held = slips.groupBy("filed", *has).agg(F.min(F.struct("seq", "slip_id")).alias("first"))
    if floor > 0:
        word = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(names.sides(F.col(c)), names.words)))).alias("word")
        x, y = asked.select("*", word("w_name")), held.select("*", word("name"))
        met = x.join(y, ["filed", "word"]).drop("word")
        for mine, other in (("w_docket", "docket"), ("w_cite", "cite")):
            same = (asked["filed"] == held["filed"]) & (F.col(mine) == F.col(other)) & (F.col(other) != "")
            met = met.unionByName(asked.join(held, same).drop(held["filed"]))
        met = met.distinct()
    else:
        met = asked.join(held, "filed")
    docket = F.coalesce((F.col("w_docket") == F.col("docket")) & (F.col("docket") != ""), F.lit(False))
    cite = F.coalesce((F.col("w_cite") == F.col("cite")) & (F.col("cite") != ""), F.lit(False))
    met = met.withColumn("like", names.overlap_score(F.col("w_name"), F.col("name")))
    scored = met.withColumn("score", docket.cast("int") * 1000 + cite.cast("int") * 900 + F.col("like") * 30).where(docket | cite | (F.col("like") >= floor))
    best = scored.groupBy("filed", *asks).agg(F.min(F.struct((-F.col("score")).alias("less"), "first")).alias("best"))
    best = best.select(F.col("filed").alias("_filed"), *[F.col(c).alias(f"_{c}") for c in asks], "best")
    same = F.col("filed") == F.col("_filed")
    for c in asks:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    one = w.join(best, same).groupBy("request").agg(F.min("best").alias("best"))
    return one.select("request", F.col("best.first.slip_id").alias("slip_id"), (-F.col("best.less")).alias("score"))


def cascade(wanted: DataFrame, stages: list[DataFrame], key: str = "request", value: str = "found") -> DataFrame:
    """Each request with the answer of the first stage that has exactly one; a
    stage with several different answers for a request passes it on."""
    rows = None
    for k, s in enumerate(stages):
        s = s.select(key, value).distinct().withColumn("_k", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    single = rows.groupBy(key, "_k").agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1")
    first = single.groupBy(key).agg(F.min_by(value, "_k").alias(value), F.min("_k").alias("stage"))
    return wanted.select(key).join(first, key, "left")


def unique_best(scored: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """The best answer where it stands alone; a tie at the top is no answer."""
    top = scored.groupBy(key).agg(F.max(score).alias("_top"))
    best = scored.join(top, key).where(F.col(score) == F.col("_top")).groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value))
    return best.select(key, F.when(F.col("_n") == 1, F.col(value)).alias(value))


def one_hop(edges: DataFrame, seeds: DataFrame, direction: str = "up") -> DataFrame:
    """Cases one citation away: those that cite a seed (up) or that it cites."""
    near, far = ("cited", "citing") if direction == "up" else ("citing", "cited")
    return (
        edges.join(seeds.select(F.col("scholar_id").alias(near)), near)
        .groupBy(F.col(near).alias("seed"), F.col(far).alias("found")).agg(F.max("depth").alias("depth"))
        .where("seed <> found")
    )
