"""Courts by name, and the benches that opinions print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of the states and territories in court names.
STATES = {
    "alabama": "Ala.", "alaska": "Alaska", "arizona": "Ariz.", "arkansas": "Ark.", "california": "Cal.", "colorado": "Colo.", "connecticut": "Conn.",
    "delaware": "Del.", "district of columbia": "D.C.", "florida": "Fla.", "georgia": "Ga.", "guam": "Guam", "hawaii": "Haw.", "idaho": "Idaho",
    "illinois": "Ill.", "indiana": "Ind.", "iowa": "Iowa", "kansas": "Kan.", "kentucky": "Ky.", "louisiana": "La.", "maine": "Me.", "maryland": "Md.",
    "massachusetts": "Mass.", "michigan": "Mich.", "minnesota": "Minn.", "mississippi": "Miss.", "missouri": "Mo.", "montana": "Mont.", "nebraska": "Neb.",
    "nevada": "Nev.", "new hampshire": "N.H.", "new jersey": "N.J.", "new mexico": "N.M.", "new york": "N.Y.", "north carolina": "N.C.",
    "north dakota": "N.D.", "ohio": "Ohio", "oklahoma": "Okla.", "oregon": "Or.", "pennsylvania": "Pa.", "puerto rico": "P.R.", "rhode island": "R.I.",
    "south carolina": "S.C.", "south dakota": "S.D.", "tennessee": "Tenn.", "texas": "Tex.", "utah": "Utah", "vermont": "Vt.", "virginia": "Va.",
    "washington": "Wash.", "west virginia": "W. Va.", "wisconsin": "Wis.", "wyoming": "Wyo.",
}
# Circuits as court lines name them.
CIRCUITS = {
    "first": "ca1", "second": "ca2", "third": "ca3", "fourth": "ca4", "fifth": "ca5", "sixth": "ca6", "seventh": "ca7", "eighth": "ca8", "ninth": "ca9",
    "tenth": "ca10", "eleventh": "ca11", "federal": "cafc",
}
_EN_BANC = r"(?:en|in)\s+banc"


def _one_line(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def circuit_id(name: Column) -> Column:
    """The id of the court of appeals that a court line names, or ""."""
    line = F.lower(_one_line(name))
    words = "|".join(CIRCUITS)
    found = F.regexp_extract(line, rf"\bcourt of appeals,? (?:for the )?({words}|district of columbia|d\. ?c\.) circuit\b", 1)
    ids = F.create_map(*[F.lit(x) for pair in CIRCUITS.items() for x in pair])
    return F.when(found.startswith("d"), "cadc").otherwise(F.coalesce(F.try_element_at(ids, found), F.lit("")))


def trial_court(name: Column) -> Column:
    """The short form of a federal trial court's name: "M.D.N.C.", "Bankr. S.D.
    Tex.", "C.C.D. Mass."; "" for other courts. Only what stands before the state
    tells the district; without it, and without a federal sign, the court is a
    state's."""
    low = F.lower(_one_line(name))
    every = "|".join(sorted(STATES, key=len, reverse=True))
    # The longest name that stands in the line counts, as "West Virginia" does.
    found = F.regexp_extract_all(low, F.lit(rf"\b({every})\b"), F.lit(1))
    size = F.array_max(F.transform(found, lambda s: F.length(s)))
    state = F.get(F.filter(found, lambda s: F.length(s) == size), F.lit(0))
    short = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), state)
    head = F.call_function("substring_index", low, state, F.lit(1))
    letter = F.regexp_extract(head, r"\b([nsewmc])\.? ?d\.(?= |$)", 1)
    word = F.regexp_extract(head, r"\b(northern|southern|eastern|western|middle|central) district\b|\bdistrict of (northern|southern|eastern|western|middle|central)\b", 0)
    named = F.regexp_extract(word, r"(northern|southern|eastern|western|middle|central)", 1)
    part = F.when(letter != "", letter).otherwise(F.left(named, F.lit(1)))
    district = F.when(part != "", F.concat(F.upper(part), F.lit(".D."))).otherwise("D.")
    bankruptcy = low.contains("bankruptcy court")
    circuit = ~bankruptcy & low.contains("circuit court")
    federal = bankruptcy | low.rlike(r"united states|u\. ?s\.") | (part != "") | head.rlike(r"\bdistrict of\b|\bd\. *$")
    text = F.concat(district, F.when(short.rlike(r"^([A-Z]\.)+$"), "").otherwise(" "), short)
    out = F.when(bankruptcy, F.concat(F.lit("Bankr. "), text)).when(circuit, F.concat(F.lit("C.C."), text)).otherwise(text)
    ok = ~low.contains("court of appeal") & (bankruptcy | circuit | low.contains("district court")) & federal & short.isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), out).otherwise("")


def bench_names(line: Column) -> Column:
    """The judges of a bench line: it opens "Before" or "Present" and gives them a
    title; what is said of them besides their names goes."""
    body = F.regexp_replace(F.trim(F.coalesce(line, F.lit(""))), r"^(?:\*[0-9]+[A-Za-z]{0,2}\s*)+", "")
    is_bench = body.rlike(r"(?i)^(?:before|present)\b") & body.rlike(r"(?i)\b(?:judges?|justices?)\b|\b(?:c\.\s?j|jj?|p\.\s?j)\.")
    rest = F.regexp_replace(F.regexp_replace(body, r"(?i)^(?:before|present)\b\s*:?\s*", ""), r"\[[^\]]{0,6}\]|[*†‡]", "")
    rest = F.get(F.split(rest, r"(?<![A-Z])\.\s+(?=[A-Z][a-z])", 2), F.lit(0))
    words = (
        r"(?i)\b(?:chief|senior|presiding|circuit|district|associate|retired|active|judges?|justices?|united|states|sitting|by|designation|en\s+banc|the|court|"
        r"constituting|all|jr|sr|ii|iii|iv)\b\.?|\bu\.\s?s\.|\b(?:c\.\s?j|jj?|p\.\s?j)\."
    )

    def bare(piece):
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(piece, r"(?i)\b(?:for|of)\s+the\b.*", ""), words, " "), r"\s+", " "))

    found = F.filter(F.transform(F.split(rest, r"[,;]|\band\b|&"), bare), lambda n: n.rlike(r"(?<!\p{L})[\p{L}&&[^a-z]]\p{L}"))
    return F.when(is_bench, found).otherwise(F.array().cast("array<string>"))


def en_banc(lines: Column, panel_court: Column) -> Column:
    """Did the whole court decide? By its front matter's lines: heard so, a bench
    that says so, or more than three judges in a court of panels; not where a
    rehearing was denied."""
    clean = F.transform(F.coalesce(lines, F.array().cast("array<string>")), _one_line)
    refused = rf"(?i)\b(?:deni(?:al|ed|es)|deny(?:ing)?)\b[^.;]{{0,100}}?\b{_EN_BANC}|{_EN_BANC}\b[^.;]{{0,60}}?\b(?:deni(?:al|ed)|(?:is|are|was|were)\s+denied)\b|\bon\s+(?:the\s+)?petitions?\s+for\s+(?:panel\s+)?rehearing\s+(?:and|or)\s+(?:for\s+)?rehearing\s+{_EN_BANC}"
    heard = rf"(?i)\b(?:re)?(?:argued|submitted|heard)(?:\s+and\s+submitted)?\s+{_EN_BANC}\b|\b(?:on|upon)\s+(?:a\s+)?rehearing\s+{_EN_BANC}\b"
    sat = rf"(?i)\b(?:judges?|justices?|j{{1,2}}\.|court)\s*,?\s*(?:sitting\s+|constituting\s+the\s+court\s+)?{_EN_BANC}\b"
    bench = F.filter(clean, lambda t: t.rlike(r"(?i)^(?:\*[0-9]+\s*)*(?:before|present)\b") & (F.length(t) <= 600))
    short = F.filter(clean, lambda t: F.length(t) <= 300)
    alone = panel_court & F.exists(short, lambda t: t.rlike(rf"(?i)^{_EN_BANC}\.?$"))
    many = panel_court & F.exists(bench, lambda t: F.size(bench_names(t)) > 3)
    said = F.exists(bench, lambda t: t.rlike(sat)) | F.exists(short, lambda t: t.rlike(heard))
    return ~F.exists(clean, lambda t: t.rlike(refused)) & (said | alone | many)


# The circuit of each state's and territory's federal courts.
CIRCUIT_STATES = {
    "ca1": "maine massachusetts new_hampshire puerto_rico rhode_island", "ca2": "connecticut new_york vermont", "ca3": "delaware new_jersey pennsylvania",
    "ca4": "maryland north_carolina south_carolina virginia west_virginia", "ca5": "louisiana mississippi texas", "ca6": "kentucky michigan ohio tennessee",
    "ca7": "illinois indiana wisconsin", "ca8": "arkansas iowa minnesota missouri nebraska north_dakota south_dakota",
    "ca9": "alaska arizona california guam hawaii idaho montana nevada oregon washington", "ca10": "colorado kansas new_mexico oklahoma utah wyoming",
    "ca11": "alabama florida georgia", "cadc": "district_of_columbia",
}


def circuit_of(state: Column) -> Column:
    """The circuit of a state's federal courts, or ""."""
    pairs = [F.lit(x) for circuit, states in CIRCUIT_STATES.items() for s in states.split() for x in (s.replace("_", " "), circuit)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(_one_line(state))), F.lit(""))
