"""Captions: from a page's lines to a name, ejectment forms, settled names; and the
openings by which a writing's role is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import abbrev
from lexloom.functions.cites import parse_cite

#: What a caption begins with before its name.
PREAMBLE = r"(?i)^\s*(?:on\s+certification\s+from\b.*?:|certified\s+question\b.*?:|(?:no|nos|case\s+no)\.\s*[\w\s,&-]+?[.:]\s+)"


def caption_name(lines: Column) -> Column:
    """A caption's lines as one name: notes in brackets, docket preambles and what
    follows the second party's role go."""
    line = F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))
    line = F.trim(F.regexp_replace(F.regexp_replace(line, r"\[[^\]]*\]|\(and related cases?\)", " "), PREAMBLE, ""))
    sides = F.split(F.regexp_replace(line, r"\s+", " "), r"(?i)\s+vs?\.\s+", 2)
    return F.when(F.size(sides) == 2, F.array_join(F.transform(sides, abbrev.first_party), " v. ")).otherwise(line)


def ejectment(name: Column) -> Column:
    """The forms that an ejectment party is cited in: by the fictitious plaintiff on
    the demise of another, by the lessee, by the lessor's lessee; empty for others."""
    demise = r"(?i)^(.*?\b(?:Den|Doe|Jackson|Roe)),?\s+(?:ex\s+dem\.|on\s+(?:the\s+)?demise\s+of)\s+(.+)$"
    lessee = r"(?i)^(?:the\s+)?lessee\s+of\s+(.+)$"
    owned = r"^(.+?)['’]s\s+[Ll]essee$"
    who = F.coalesce(*[F.nullif(F.regexp_extract(name, p, k), F.lit("")) for p, k in ((demise, 2), (lessee, 1), (owned, 1))])
    last = F.element_at(F.split(who, " "), -1)
    plain = F.initcap(F.element_at(F.split(F.regexp_extract(name, demise, 1), " "), -1))
    forms = F.array(F.when(plain != "", F.concat(plain, F.lit(" ex dem. "), last)), F.concat(F.lit("Lessee of "), last), F.concat(last, F.lit("'s Lessee")))
    return F.when(who.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(forms))


def settled_name(name: Column, cite: Column, exceptions: dict[str, str]) -> Column:
    """The settled name of the case at a citation, else the name's short form."""
    key = parse_cite(cite)
    folded = F.concat_ws(" ", key["vol"].cast("string"), key["key"], key["page"].cast("string"))
    table = F.create_map(*[F.lit(x) for pair in exceptions.items() for x in pair])
    return F.coalesce(F.try_element_at(table, folded), abbrev.short_name(name))


def role_by_opening(text: Column) -> Column:
    """dissent, concurrence or separate, by what a writing says of itself first."""
    head = F.lower(F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), F.lit(1500)))
    dissent = head.rlike(r"\bi (?:must )?(?:respectfully )?dissent\b|\bdissenting\b")
    concur = head.rlike(r"\bi (?:respectfully )?(?:concur|join)\b|\bconcurring\b")
    return F.when(dissent & concur, "separate").when(dissent, "dissent").when(concur, "concurrence").otherwise("")


def inline_byline(text: Column) -> Column:
    """struct<author, rest> of a paragraph that opens with its byline."""
    pattern = r"^\s*(?:(?:MR\.|MRS\.)\s+)?(?:CHIEF\s+)?JUSTICE\s+([A-Z][A-Z'’.-]+)\s+(?:delivered\s+the\s+opinion\s+of\s+the\s+Court|,?\s*(?:concurring|dissenting)[^.]*)\.\s*(.*)$"
    author = F.regexp_extract(text, pattern, 1)
    return F.when(author != "", F.struct(F.initcap(author).alias("author"), F.regexp_extract(text, pattern, 2).alias("rest")))


def provisional(decided: Column, today: Column, pages: Column, first_pages: Column, length: Column) -> Column:
    """Is an opinion's copy still to be revised? Decided in the last year, and with
    no page marks (but for a short order with a citation) or with marks that no
    citation in its header accounts for."""
    recent = F.datediff(today, decided) <= 365
    short = (F.size(first_pages) > 0) & (length <= 5000)
    low = F.array_min(pages)
    known = F.exists(first_pages, lambda p: (p <= low) & (low <= p + 1000))
    return F.coalesce(recent & F.when(F.size(pages) == 0, ~short).otherwise(~known), F.lit(False))


def identity(url: Column) -> Column:
    """The id that an opinion's address carries."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]case=([0-9]{1,20})", 1), F.lit(""))


