"""URL filters by propagation over the link graph, on DataFrame functions.

A url is judged by the longest rule that fits its host (or a parent domain) and
path. Where none fits, its host is judged: host edges are counted from the links
of the pages (``//host`` after a quote or an equals sign, in any attribute);
personalised PageRank runs from the hosts of allowed pages along the edges
(trust) and from the hosts of blocked pages against them (distrust). A host is
blocked where its distrust exceeds ``threshold`` times its trust.

Edges are summed on the map side before the shuffle, so a host with a third of
all pages costs one row a task. Both walks go in one table; each round is staged
and the loop ends when ranks move by less than ``tolerance`` in sum. Nothing but
the sum of changes reaches the driver.

Defined cases: a null url, or one without ``://``, has an empty host and path, no
rule, and the verdict allow, as has any host without rank. Pages without an id
are judged too; repeated rows are judged one by one (and their links count
again). A null html has no links. With no pages the result is empty. Columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import stage, unstage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
LINK = r"""["'=]\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return out.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    return (
        pages.where("html like '%//%'")
        .select(host_of(F.col("url")).alias("src"), F.explode(links).alias("dst"))
        .select("src", F.translate(F.regexp_replace("dst", r"^.*@|:[0-9]*$", ""), UPPER, LOWER).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """``kind, host, rank``. ``edges``: kind, src, dst, share (shares of a source
    sum to 1); ``seeds``: kind, host, seed (a kind's seeds sum to 1). The walk
    that leaves a host without edges is lost, the same for both kinds. A round
    moves the ranks by ``damping`` times what the one before moved at most, so the
    rounds end, after 66 at most for the two kinds at the usual settings."""
    rank = stage(seeds.select("kind", "host", F.col("seed").alias("rank")), "rank")
    while True:
        moved = (
            edges.join(rank, (edges.kind == rank.kind) & (edges.src == rank.host))
            .select(edges.kind, F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("part"))
        )
        base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("part"))
        parts = moved.unionByName(base).select("kind", "host", "part", F.lit(0.0).alias("old"))
        parts = parts.unionByName(rank.select("kind", "host", F.lit(0.0).alias("part"), F.col("rank").alias("old")))
        after = stage(parts.groupBy("kind", "host").agg(F.sum("part").alias("rank"), F.sum("old").alias("old")), "rank")
        change = after.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        unstage(rank)
        rank = after.select("kind", "host", "rank")
        if change < tolerance:
            break
    return rank


def host_verdicts(pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 1.0) -> DataFrame:
    """``host, trust, distrust, host_verdict`` of each host with a rank."""
    marked = judged(pages.select("url"), rules).where("fit is not null and host <> ''")
    seeds = marked.groupBy(F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    total = F.broadcast(seeds.groupBy("kind").agg(F.sum("n").alias("total")))
    seeds = stage(seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed")), "seeds")
    edges = stage(host_edges(pages), "edges")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = stage(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    rank = propagate(shares, seeds, damping, tolerance)
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return (
        rank.groupBy("host").agg(one("trust"), one("distrust"))
        .withColumn("host_verdict", F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow"))
    )


def filter_urls(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``."""
    pages = pages.select("page_id", "url", "html")
    hosts = host_verdicts(pages, rules, **options)
    urls = judged(pages.select("page_id", "url"), rules)
    return urls.join(hosts, "host", "left").select(
        "page_id", "host", "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: a verdict for every row of ``pages``."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
