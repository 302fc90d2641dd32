"""Document fingerprints by consistent weighted sampling, on DataFrame functions.

A text's terms are its shingles of five words, weighted by how often they occur
(a text of fewer words is one term). Each of the ``ENTRIES`` entries of a
fingerprint draws for every term its own r and c from Gamma(2, 1) and b uniform,
fixed by the hash of term and entry. With t = floor(ln w / r + b) the term with
the smallest a = c exp(r (b - t - 1)) is the entry's sample, and two texts have the
same sample with the probability of their generalised Jaccard similarity.

The draws come from three exponential numbers, so that the frequent weight 1 is
cheap: c = e3 + e4, r = e1 + e2 and b = e2 / r, where e1 = -ln(e3 / c). These r, c
and b are independent and distributed as said (the share of one of two exponential
numbers in their sum is uniform and independent of the sum). They give
t = floor((ln w + e2) / r) and a = e3 exp(-t r); for w = 1, t is 0 and a is e3.
Compared is x = 1 - exp(-a), which grows with a: for w = 1 it is the uniform number
that e3 is made of, a hash of term and entry.

A sample is kept as its x, which is the same for two texts just where term and t
are. An entry's sample is the least x over a document's terms, so ``ENTRIES``
minima in one aggregation, whose buffers hold one number an entry.

A text costs no shuffle but the one that brings it beside its neighbour. For that,
ids are cut into ranges by approximate quantiles (``RANGE_BYTES`` of text each, at
most ``MAX_RANGES`` ranges, which then grow) and a window orders each range; the
first document of the next range joins it as an extra row, so the window needs no
other range. Terms are counted inside the row and exploded; the minima that follow
are by range and document, so they stay in the task that holds the range.

Defined cases: null texts are empty; empty texts have empty fingerprints, whose
likeness is 1 to each other and 0 to others. Rows of one id are ordered by text.
A row without an id is its own next document. A single document is its own next.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRIES = 64
SHINGLE = 5
RANGE_BYTES = 2 << 20
#: Ranges, and points of the quantiles that they are cut by.
MAX_RANGES = 10_000
BLANKS = " \t\n\x0b\x0c\r"
#: An x is kept as a whole number below 2^62.
SCALE = 2.0**62


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _uniform(term: Column, entry: Column, turn: int) -> Column:
    """A uniform number of 62 bits, by term, entry and turn."""
    return F.shiftrightunsigned(F.xxhash64(term, entry, F.lit(turn)), 2)


def _heavy(term: Column, entry: Column, weight: Column) -> Column:
    """x of a term of any weight."""

    def exponential(turn: int) -> Column:
        return -F.log1p(-(_uniform(term, entry, turn) + F.lit(0.5)) / F.lit(SCALE))

    def sample(e):
        e2, e3, e4 = (F.get(e, F.lit(k)) for k in range(3))
        r = e2 - F.log(e3 / (e3 + e4))
        return let(r, lambda r: -F.expm1(-e3 * F.exp(-F.floor((F.log(weight) + e2) / r) * r)))

    drawn = F.array(exponential(2), exponential(0), exponential(1))
    return (let(drawn, sample) * F.lit(SCALE)).cast("long")


def _counted(names: tuple[str, str]):
    """Of a sorted array: its values and how often each occurs, as structs."""

    def body(xs):
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)))
        count = lambda at, s, k: F.coalesce(F.get(s, k + 1), F.size(xs)) - at
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(xs, at).alias(names[0]), count(at, s, k).alias(names[1]))))

    return body


def terms(text: Column) -> Column:
    """array<struct<term, weight>>: the text's shingles by hash, and their counts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.split(trimmed, r"[ \t\n\x0B\f\r]+")

    def hashes(ws):
        last = F.greatest(F.size(ws) - F.lit(SHINGLE), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ws, i + k if k else i) for k in range(SHINGLE)]))

    def pair(term, weight):
        return F.struct(term.alias("term"), weight.alias("weight"))

    def found(ts):
        # Most texts repeat no shingle: their terms need no counting.
        once = F.size(F.array_distinct(ts)) == F.size(ts)
        return F.when(once, F.transform(ts, lambda t: pair(t, F.lit(1)))).otherwise(let(F.sort_array(ts), _counted(("term", "weight"))))

    empty = F.array().cast("array<struct<term:bigint,weight:int>>")
    return F.when(trimmed == "", empty).otherwise(let(let(words, hashes), found))


def as_string(found: Column) -> Column:
    """Eight hexadecimal digits an entry."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The rate of equal entries; 1 for two empty fingerprints."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(same / F.lit(ENTRIES))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the value, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    top = F.array(*[F.lit(g[0]) for g in groups])
    all_groups = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    return let(
        below(top),
        lambda n: F.when(n == 0, F.lit(0)).otherwise((n - 1) * step + below(F.get(all_groups, n - 1))),
    )


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, next_text, extra, place, seq`` partitioned by ``place``; rows
    with ``extra`` only stand in for the next range's first document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    points = [k / MAX_RANGES for k in range(1, MAX_RANGES)]
    facts = rows.agg(F.sum(F.length("text")).alias("size"), F.percentile_approx("id", points, 10 * MAX_RANGES).alias("at")).first()
    n = min(MAX_RANGES, max(1, -(-(facts["size"] or 0) // RANGE_BYTES)))
    bounds = sorted({facts["at"][k * MAX_RANGES // n - 1] for k in range(1, n)}) if facts["at"] else []
    rows = rows.withColumn("place", _range_of(F.col("id"), bounds))
    firsts = {r["place"]: r["id"] for r in rows.where("id is not null").groupBy("place").agg(F.min("id").alias("id")).collect()}
    order = sorted(firsts)
    before = {firsts[p]: order[k - 1] for k, p in enumerate(order)}
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame([(i, p) for i, p in before.items()], "id long, before int"))
    halo = (
        rows.join(heads, "id").groupBy("id", "before").agg(F.min("text").alias("text"))
        .select("id", "text", F.col("before").alias("place"), F.lit(True).alias("extra"))
    )
    by = Window.partitionBy("place").orderBy("extra", F.col("id").asc_nulls_first(), "text")
    return (
        rows.withColumn("extra", F.lit(False)).unionByName(halo)
        .withColumns({"next_text": F.lead("text").over(by), "seq": F.row_number().over(by)})
        .withColumn("next_text", F.when(F.col("id").isNull(), F.col("text")).otherwise(F.coalesce("next_text", "text")))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, own, edited, next``: the samples of the text,
    of the edited text and of the next document, 32 bits an entry, as array<long>
    (empty for a text without words)."""
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, cast(length(text) div 2 as int))"))
    # The digest rides along as numbers, which a hash aggregation can hold.
    digest = [F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("bigint").alias(f"sha{k}") for k in range(4)]
    keys = ["place", "seq", "kind", "id", "extra", "n_chars", *[f"sha{k}" for k in range(4)]]
    weight, every = F.col("weight"), F.array(*[F.lit(k) for k in range(ENTRIES)])
    # A term of weight 1 is one row for all entries (-1), another one a row an entry.
    entries = F.when(weight == 1, F.array(F.lit(-1))).when(weight > 1, every)
    rows = (
        with_next(docs, id_col, text_col)
        .withColumn("edited_text", edited)
        .select("place", "seq", "id", "extra", F.length("text").alias("n_chars"), F.sha2("edited_text", 256).alias("sha"), "text", "edited_text")
        .select("place", "seq", "id", "extra", "n_chars", *digest, F.posexplode(F.array("text", "edited_text")).alias("kind", "body"))
        .select(*keys, F.inline_outer(terms(F.col("body"))))
        .select(*keys, "term", "weight", F.explode_outer(entries).alias("entry"))
        .select(*keys, "term", "entry", F.when(F.col("entry") >= 0, _heavy(F.col("term"), F.col("entry"), F.col("weight").cast("double"))).alias("x"))
    )

    def least(k: int) -> Column:
        light = _uniform(F.col("term"), F.lit(k), 0)
        return F.min(F.when(F.col("entry") < 0, light).when(F.col("entry") == k, F.col("x"))).alias(f"x{k}")

    drawn = rows.groupBy(*keys).agg(*[least(k) for k in range(ENTRIES)])
    bits = F.array(*[F.xxhash64(f"x{k}").bitwiseAND(F.lit((1 << 32) - 1)) for k in range(ENTRIES)])
    sign = F.when(F.col("x0").isNull(), F.array().cast("array<bigint>")).otherwise(bits).alias("own")
    by = Window.partitionBy("place").orderBy("seq", "kind")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"sha{k}"), 16, "0") for k in range(4)]))
    return (
        drawn.select(*keys, sign)
        .withColumns({"edited": F.lead("own", 1).over(by), "next": F.lead("own", 2).over(by)})
        .where("kind = 0 and not extra")
        .select(
            "id", F.col("n_chars").cast("long").alias("n_chars"), sha.alias("edited_sha256"), "own", "edited",
            F.when(F.col("id").isNull(), F.col("own")).otherwise(F.coalesce("next", "own")).alias("next"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprints of the whole of ``documents`` and of its edited texts."""
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
