"""Series scalars: congresses and their records, volumes by year, renamed series,
specs and labels of statutes, rules, the Constitution and agency decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.cites import loose_key
from lexloom.functions.dates import to_roman
from lexloom.plans.forms import RULE_SETS

# The year of each volume of the Congressional Record up to 140; later
# years are one volume each.
RECORD_YEARS = (
    1873, 1874, 1875, 1876, 1877, 1877, 1878, 1879, 1879, 1880, 1881, 1881, 1882, 1883, 1884, 1885, 1886, 1887, 1888, 1889,
    1890, 1891, 1892, 1893, 1893, 1894, 1895, 1896, 1897, 1897, 1898, 1899, 1900, 1901, 1902, 1903, 1903, 1904, 1905, 1906,
    1907, 1908, 1909, 1909, 1910, 1911, 1911, 1912, 1913, 1913, 1914, 1915, 1916, 1917, 1917, 1918, 1919, 1919, 1920, 1921,
    1921, 1922, 1922, 1923, 1924, 1925, 1926, 1927, 1928, 1929, 1929, 1930, 1930, 1931, 1932, 1933, 1933, 1934, 1935, 1936,
    1937, 1937, 1938, 1939, 1939, 1940, 1941, 1942, 1943, 1944, 1945, 1946, 1947, 1948, 1949, 1950, 1951, 1952, 1953, 1954,
    1955, 1956, 1957, 1958, 1959, 1960, 1961, 1962, 1963, 1964, 1965, 1966, 1967, 1968, 1969, 1970, 1971, 1972, 1973, 1974,
    1975, 1976, 1977, 1978, 1979, 1980, 1981, 1982, 1983, 1984, 1985, 1986, 1987, 1988, 1989, 1990, 1991, 1992, 1993, 1994,
)
#: Series that "Wash." may name: its form, last volume, first year.
WASHINGTON = (("Va.", 2, 1790), ("Wash. C.C.", 4, 1803), ("Wash.", None, 1889))
#: Renamed series: the older name, the newer, its first volume.
RENAMED = (("App. D.C.", "U.S. App. D.C.", 75), ("Cl. Ct.", "Fed. Cl.", 27))
#: Nominative volumes of the Supreme Court: name, offset, volumes.
NOMINATIVE = (("Dall.", 0, 4), ("Cranch", 4, 9), ("Wheat.", 13, 12), ("Pet.", 25, 16), ("How.", 41, 24), ("Black", 65, 2), ("Wall.", 67, 23), ("Otto", 90, 17))
_CITE = r"^\s*([0-9]{1,9})\s+(.+?),?\s+([0-9]{1,9})\s*$"


def bluebook_ordinal(n: Column) -> Column:
    """1st, 2d, 3d, 4th, 11th, 21st, 42d."""
    end = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when((n % 10).isin(2, 3), "d").otherwise("th")
    return F.concat(n.cast("string"), end)


def congresses_of_year(year: Column) -> Column:
    """The congresses that sat in a year, the likelier first: before 1935 an odd
    year's first months belong to the one that ends."""
    later = (F.floor((year - 1789) / 2) + 1).cast("int")
    early = F.when(year % 2 == 0, F.array(F.floor((year - 1788) / 2).cast("int"))).when(later > 1, F.array(later - 1, later)).otherwise(F.array(later))
    return F.when(year < 1789, F.array().cast("array<int>")).when(year >= 1935, F.array(later)).otherwise(early)


def year_of_congress(congress: Column, session: Column) -> Column:
    """The year that a session mostly sat in; before the 74th it opened late."""
    first = 1789 + 2 * (congress - 1)
    return F.when(congress >= 74, first + session - 1).when(session <= 1, first + 1).otherwise(first + 2).cast("int")


def record_year(volume: Column) -> Column:
    """The year of a volume of the Congressional Record; 0 where there is none."""
    years, n = F.array(*map(F.lit, RECORD_YEARS)), len(RECORD_YEARS)
    return F.when(volume.between(1, n), F.get(years, volume.cast("int") - 1)).when(volume > n, (volume + 1854).cast("int")).otherwise(0)


def record_volumes(year: Column) -> Column:
    """The volumes of a year: two where a special session had its own."""
    listed = F.array(*[F.struct(F.lit(k + 1).alias("v"), F.lit(y).alias("y")) for k, y in enumerate(RECORD_YEARS)])
    found = F.transform(F.filter(listed, lambda x: x["y"] == year), lambda x: x["v"])
    return F.when(year > RECORD_YEARS[-1], F.array((year - 1854).cast("int"))).otherwise(found)


def _parts(cite: Column) -> tuple[Column, Column, Column]:
    vol, reporter, page = (F.regexp_extract(cite, _CITE, k) for k in (1, 2, 3))
    return vol.try_cast("int"), reporter, page


def _plain_washington(cite: Column) -> Column:
    return F.coalesce(loose_key(_parts(cite)[1]).isin("wash", "washington"), F.lit(False))


def washington_series(cite: Column) -> Column:
    """The older series that a plain "Wash." citation may name, in order."""
    vol, _, page = _parts(cite)
    every = F.array(*[F.when(vol <= last, F.concat_ws(" ", vol.cast("string"), F.lit(name), page)) for name, last, _ in WASHINGTON if last])
    return F.when(_plain_washington(cite), F.array_compact(every)).otherwise(F.array().cast("array<string>"))


def cite_for_era(cite: Column, year: Column) -> Column:
    """A plain "Wash." citation in the series it must name, cited in a year: the
    first that had begun and reaches the volume. As it is where the year is unknown
    or the Washington Reports are among them, or none is."""
    vol, _, page = _parts(cite)
    able = [(name, (year >= began) & (vol <= last if last else F.lit(True))) for name, last, began in WASHINGTON]
    name = F.coalesce(*[F.when(ok, F.lit(n)) for n, ok in able])
    keep = ~_plain_washington(cite) | year.isNull() | able[-1][1] | name.isNull()
    return F.when(F.coalesce(keep, F.lit(True)), cite).otherwise(F.concat_ws(" ", vol.cast("string"), name, page))


def renamed_series(cite: Column) -> Column:
    """A citation under the name its volume was printed under, "" where it has it."""
    vol, reporter, page = _parts(cite)
    out = F.lit("")
    for old, new, first in RENAMED:
        for mine, other, moved in ((old, new, vol >= first), (new, old, vol < first)):
            out = F.when((loose_key(reporter) == loose_key(F.lit(mine))) & moved, F.concat_ws(" ", vol.cast("string"), F.lit(other), page)).otherwise(out)
    return out


def search_phrases(cite: Column) -> Column:
    """How citing opinions write a case: its U.S. Reports citation and that of the
    reporter of its time; any other citation as given, blanks single."""
    vol, reporter, page = _parts(cite)
    key = loose_key(reporter)
    us = F.when(key == "us", vol)
    for name, offset, volumes in NOMINATIVE:
        us = F.coalesce(us, F.when((key == loose_key(F.lit(name))) & vol.between(1, volumes), vol + offset))
    own = [F.when((us > offset) & (us <= offset + volumes), F.concat_ws(" ", (us - offset).cast("string"), F.lit(name), page)) for name, offset, volumes in NOMINATIVE]
    plain = F.when(vol.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.trim(F.regexp_replace(cite, r"\s+", " "))))
    return F.when(us.isNull(), plain).otherwise(F.array_compact(F.array(F.concat_ws(" ", us.cast("string"), F.lit("U.S."), page), *own)))


def citing_query(ids: Column, phrases: Column) -> Column:
    """A search for the cases that cite one of the opinions, with the phrases as
    alternatives; quotes and backslashes go, phrases under three letters too."""
    graph = F.concat(F.lit("("), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("cites:"), i.cast("string"))), " OR "), F.lit(")"))
    clean = F.transform(phrases, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(p, F.lit("")), r'["\\\\]', " "), r"\s+", " ")))
    quoted = F.transform(F.array_distinct(F.filter(clean, lambda p: F.length(p) >= 3)), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    return F.when(F.size(quoted) == 0, graph).otherwise(F.concat(graph, F.lit(" AND ("), F.array_join(F.concat(F.array(graph), quoted), " OR "), F.lit(")")))


def written_key(reporter: Column) -> Column:
    """The older key of a reporter: no blanks, lower case, marks kept."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(reporter, F.lit("")), "’", "'"), r"\s+", ""))


def clean_cite(written: Column) -> Column:
    """"vol reporter page" of a written citation: brackets and what they hold go,
    a dash or comma before the page too, "Rep." after a reporter's period, and
    blanks are single."""
    s = F.regexp_replace(F.translate(F.regexp_replace(written, "U\\. S\\.", "U.S."), "’", "'"), r"\s+", " ")
    s = F.regexp_replace(s, r"\s*[\[(][^\])]*[\])]\s*", " ")
    s = F.regexp_replace(s, r"\s[-–—]\s*(?=[0-9])", " ")
    s = F.regexp_replace(s, r"(?<=\.)\s+Rep\.(?=\s+[0-9])", "")
    s = F.regexp_replace(s, r"\s*,\s*(?=[0-9]+$)", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def sec_spec(vol: Column, page: Column, pin: Column) -> Column:
    """Compact JSON with sorted keys; a pin that is the first page is left out."""
    return F.to_json(F.struct(page.cast("int").alias("page"), F.when((pin > 0) & (pin != page), pin.cast("int")).alias("pin"), vol.cast("int").alias("vol")))


def sec_parts(spec: Column) -> Column:
    return F.from_json(spec, "page int, pin int, vol int")


def sec_label(spec: Column, year: Column) -> Column:
    """"8 S.E.C. 893, 915 (1941)"; without pin or year where they are unknown."""
    s = sec_parts(spec)
    base = F.concat(s["vol"].cast("string"), F.lit(" S.E.C. "), s["page"].cast("string"))
    pin = F.when(s["pin"].isNotNull(), F.concat(F.lit(", "), s["pin"].cast("string"))).otherwise("")
    known = F.when(F.coalesce(year, F.lit(0)) > 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")
    return F.when((s["vol"] > 0) & (s["page"] > 0), F.concat(base, pin, known)).otherwise("")


def debates_key(source: Column, congress: Column, session: Column, volume: Column, appendix: Column) -> Column:
    """The index key of an early debates citation."""
    tail = F.when(appendix, "a").otherwise("")
    return (
        F.when(source == "globe", F.concat(F.lit("globe "), congress.cast("string"), F.lit("."), F.coalesce(session, F.lit(1)).cast("string"), tail))
        .when(source == "annals", F.concat(F.lit("annals "), volume.cast("string")))
        .when(source == "regdeb", F.concat(F.lit("regdeb "), volume.cast("string"), tail))
        .otherwise("")
    )


def chamber_hint(text: Column) -> Column:
    """S or H where a parenthesis or a title names the speaker's chamber."""
    senate = r"\((?:Senate|(?:remarks of |statement of )?Sen\.)|\b(?:Senator|Sen\.)\s+[A-Z]"
    house = r"\((?:House|(?:remarks of |statement of )?Rep\.)|\b(?:Representative|Rep\.|Mr\.\s+Speaker)\s+[A-Z]"
    text = F.coalesce(text, F.lit(""))
    at = lambda p: F.length(F.get(F.split(text, p, 2), F.lit(0)))
    return F.when(text.rlike(senate) & (~text.rlike(house) | (at(senate) <= at(house))), "S").when(text.rlike(house), "H").otherwise("")


def _subs(written: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(written, F.lit("")), ","), lambda s: s != ""), lambda s: F.concat(F.lit("("), s, F.lit(")"))), "")


def spec_label(kind: Column, spec: Column) -> Column:
    """How a statute, regulation, rule or provision is printed, by its spec."""
    part = lambda k: F.coalesce(F.get(F.split(spec, ":"), F.lit(k)), F.lit(""))
    name = F.create_map(*[F.lit(x) for key, (short, _, _) in RULE_SETS.items() for x in (key, short)])
    word = F.when(part(0) == "amend", "amend.").otherwise("art.")
    const = F.concat(F.lit("U.S. Const. "), word, F.lit(" "), to_roman(part(1).try_cast("int")), F.when(part(2) != "", F.concat(F.lit(", § "), part(2))).otherwise(""))
    return (
        F.when(kind == "usc", F.concat(part(0), F.lit(" U.S.C. § "), part(1), _subs(part(2))))
        .when(kind == "cfr", F.concat(part(0), F.lit(" C.F.R. § "), part(1), _subs(part(2))))
        .when(kind == "rule", F.concat(F.try_element_at(name, part(0)), F.lit(" "), part(1), _subs(part(2))))
        .when((kind == "const") & (part(0) == "pmbl"), "U.S. Const. pmbl.")
        .when(kind == "const", const)
    )


def is_heading(line: Column) -> Column:
    """A line in capitals throughout, or one that ends in a division's name."""
    last = F.lower(F.regexp_extract(line, r"(\S+)\s*$", 1))
    # The divisions of a table of authorities.
    named = last.isin(*"cases authorities statutes provisions rules regulations materials sources treatises articles miscellaneous page(s) pages".split())
    letters = F.regexp_replace(line, r"\P{L}", "")
    return F.coalesce((F.trim(line) != "") & (((F.length(letters) > 1) & letters.rlike(r"^\p{Lu}+$")) | named), F.lit(False))
