"""Text scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(value: Column, f) -> Column:
    """``f(value)`` with the value made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def snippet(text: Column, limit: int = 300) -> Column:
    """The first ``limit`` code points with white space made single blanks."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, limit)


def bind_signs(text: Column) -> Column:
    """No break between a section or paragraph sign and its number."""
    return F.regexp_replace(text, "([§¶]) +(?=[0-9])", "$1\u00a0")


def dehyphenate(text: Column) -> Column:
    """Words that a line end cut are joined again."""
    return F.regexp_replace(text, r"(?<=[a-z])-\n(?=[a-z])", "")


def clean_passage(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
    for name, mark in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def mark_runs(markup: Column, tag: str = "mark") -> Column:
    """array<struct<text, hl>>: runs of marked and unmarked text."""
    pieces = F.split(F.coalesce(markup, F.lit("")), f"</?{tag}>", -1)
    runs = F.transform(pieces, lambda t, i: F.struct(t.alias("text"), (i % 2 == 1).alias("hl")))
    return F.filter(runs, lambda r: r["text"] != "")


def blank_marks(text: Column) -> Column:
    """Raised note numbers become blanks, so that offsets stay."""
    marks = "⁰¹²³⁴⁵⁶⁷⁸⁹"
    return F.translate(text, marks, " " * len(marks))


def word_shingles(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` lower-case a-z0-9 words."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    grams = F.get(
        F.transform(
            F.array(ws),
            lambda w: F.when(
                F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
            ).otherwise(F.array().cast("array<string>")),
        ),
        F.lit(0),
    )
    return F.array_distinct(grams)


def containment(a: Column, b: Column) -> Column:
    """Shared members over the smaller set's size; 0 where one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def utf16_length(text: Column) -> Column:
    """The length in UTF-16 units: letters beyond the first plane count twice."""
    return (F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))).cast("long")


def without_heads(pages, by: str, page: str, text: str, share: float = 0.4, lines: int = 2):
    """Pages without running heads: of a page's first ``lines`` lines those go that,
    digits aside, begin at least ``share`` of the document's pages; the lines left
    are joined by blanks."""
    first = F.transform(F.slice(F.split(F.col(text), "\n"), 1, lines), lambda x: F.trim(F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    heads = pages.select(by, page, F.explode(F.array_distinct(first)).alias("head")).groupBy(by, "head").agg(F.count("*").alias("n"))
    total = pages.groupBy(by).agg(F.count("*").alias("total"))
    often = heads.join(total, by).where((F.col("n") >= share * F.col("total")) & (F.col("n") > 1)).groupBy(by).agg(F.collect_set("head").alias("heads"))
    known = F.coalesce("heads", F.array().cast("array<string>"))
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[0-9]+", "#"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: (i >= lines) | ~F.array_contains(known, plain(x)))
    return pages.join(often, by, "left").withColumn(text, F.array_join(F.transform(kept, lambda x: F.trim(x)), " ")).drop("heads")


def word_spans(text: Column) -> Column:
    """array<struct<start, end>> of a text's runs of a-z and 0-9, any case. Offsets
    are running sums, by doubling the reach, so n words take n log n steps."""
    pattern = "[A-Za-z0-9]+"

    def further(acc, j):
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), j).cast("int")), F.lit(0))).cast("array<int>")

    def placed(ws, ps):
        sizes = F.transform(ws, lambda w, i: F.length(F.get(ps, i)) + F.length(w)).cast("array<int>")
        rounds = F.when(F.size(ws) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(ws))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        ends = F.aggregate(rounds, sizes, further)
        return F.get(F.transform(F.array(ends), lambda es: F.transform(ws, lambda w, i: F.struct((F.get(es, i) - F.length(w)).alias("start"), F.get(es, i).alias("end")))), F.lit(0))

    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    return F.get(F.transform(F.array(F.struct(words.alias("w"), pieces.alias("p"))), lambda x: placed(x["w"], x["p"])), F.lit(0))
