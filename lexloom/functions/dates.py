"""Date and number scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import held

# Month names, numerals.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ROMAN = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))


def long_date(text: Column) -> Column:
    """ISO form of "March 4, 1999" (or "Mar. 4, 1999") anywhere in the text."""
    pattern = r"(?i)\b(" + "|".join(m[:3] for m in MONTHS) + r")[a-z]*\.?\s+([0-9]{1,2}),?\s+([0-9]{4})"
    month = F.initcap(F.regexp_extract(text, pattern, 1))
    number = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), month)
    day, year = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)
    iso = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month != "", F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def display_date(iso: Column) -> Column:
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "MMMM d, yyyy")


def date_precision(iso: Column) -> Column:
    return F.when(iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "day").when(iso.rlike("^[0-9]{4}$"), "year").otherwise("none")


def congress_of(year: Column) -> Column:
    """The congress that sits for most of a year: the 1st began in 1789."""
    return F.floor((year - 1789) / 2).cast("int") + 1


def congress_year(congress: Column, session: Column) -> Column:
    return (1789 + 2 * (congress - 1) + F.when(session >= 2, 1).otherwise(0)).cast("int")


def term_of(date: Column) -> Column:
    """Terms begin in October."""
    return F.when(F.month(date) >= 10, F.year(date)).otherwise(F.year(date) - 1)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def to_roman(n: Column) -> Column:
    thousands = F.floor(n / 1000).cast("int")
    begin = F.struct((n - thousands * 1000).cast("int").alias("rest"), F.lit("").alias("out"))

    def step(acc, pair):
        times = F.floor(acc["rest"] / pair["value"]).cast("int")
        return F.struct((acc["rest"] - times * pair["value"]).cast("int").alias("rest"), F.concat(acc["out"], F.repeat(pair["sign"], times)).alias("out"))

    signs = F.array(*[F.struct(F.lit(s).alias("sign"), F.lit(v).alias("value")) for s, v in ROMAN[1:]])
    return F.concat(F.repeat(F.lit("M"), thousands), F.aggregate(signs, begin, step)["out"])


def from_roman(text: Column) -> Column:
    """The value of a numeral; null for other text. A sign before a larger one counts
    against it; no sign is larger than the M's that a numeral begins with."""
    single = [(s, v) for s, v in ROMAN if len(s) == 1]

    def value(t, rest):
        total = (F.length(t) - F.length(rest)) * 1000
        for k, (sign, v) in enumerate(single):
            total = total + (F.length(rest) - F.length(F.replace(rest, F.lit(sign), F.lit("")))) * v
            if k:
                larger = "".join(s for s, _ in single[:k])
                total = total - F.regexp_count(rest, F.lit(f"{sign}(?=[{larger}])")) * (2 * v)
        return F.when((t != "") & rest.rlike(r"^[MDCLXVI]*\z"), total)

    return held(F.upper(text), lambda t: held(F.regexp_replace(t, "^M+", ""), lambda rest: value(t, rest)))


def plausible_year(given: Column, found: Column) -> Column:
    return (found - given).isin(0, 1)


def late_term(line: Column, year: Column) -> Column:
    """Does a line head a case with a term that opened late in ``year``?"""
    found = F.regexp_extract(line, r"(?i)\b(?:September|October|November|December)\s+Term,?\s+(1[6-9][0-9]{2})\b", 1)
    return F.coalesce(found.try_cast("int") == year, F.lit(False))
