"""Parentheticals after a citation: their order, and how they are joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a note on what was left out.
OMISSION = "all|and|brackets?|call|citations?|ellipses|ellipsis|footnotes?|internal|marks?|numbers?|other|quotations?|signals?|some"
TITLE = r"(?:C\.\s?J\.|J\.|JJ\.|P\.\s?J\.|V\.\s?C\.|(?:Chief\s+|Senior\s+|Presiding\s+)?(?:Circuit\s+|District\s+)?(?:Judge|Justice))"
#: Pattern of each kind in the rule's order; the first that fits tells the rank, and
#: what fits none comes last. Kinds marked False are matched as written.
KINDS = (
    (r"^\[", 0, True),
    (r"^en banc$", 1, True),
    (r"^plurality opinion$", 3, True),
    (r"^(?:per curiam|mem\.|table|unpublished table decision)$", 4, True),
    (rf"^(?:[Pp]er\s+[Cc]uriam|[A-Z][^,()]{{0,59}},\s*{TITLE})\s*,\s*\S", 2, False),
    (r"^(?:(?:opinion|statement|memorandum)\s+of\s+[^,()]{1,60},\s*(?:c\.\s?j\.|j\.|jj\.)|separate\s+opinion$)", 2, True),
    (r"^(?:emphasis and )?alterations? in original$", 5, True),
    (r"^(?:(?:first|second|third|all) )?emphasis (?:added|omitted|in original|added and omitted)$", 6, True),
    (rf"^footnotes?(?:[^a-z]+(?:{OMISSION}))*[^a-z]+omitted$", 7, True),
    (rf"^(?:{OMISSION})(?:[^a-z]+(?:{OMISSION}))*[^a-z]+omitted$", 8, True),
    (r"^(?:citation modified|cleaned up)$", 9, True),
    (r"^quoting\b", 10, True),
    (r"^citing\b", 11, True),
    (r"^(?:https?://|last visited\b)", 12, True),
)
LAST = 13


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def rank(text: Column) -> Column:
    plain = F.translate(tidy(text), "’", "'")
    out = F.lit(LAST)
    for pattern, place, lower in reversed(KINDS):
        out = F.when((F.lower(plain) if lower else plain).rlike(pattern), place).otherwise(out)
    return out


def ordered(texts: Column) -> Column:
    """In the rule's order, blanks and repeats gone; equals keep their order."""
    clean = F.filter(F.transform(texts, tidy), lambda p: p != "")
    keyed = F.transform(clean, lambda p, i: F.struct(rank(p).alias("rank"), i.alias("at"), p.alias("text"), F.lower(F.translate(p, "’", "'")).alias("key")))
    keys = F.transform(keyed, lambda x: x["key"])
    kept = F.filter(keyed, lambda x: F.array_position(keys, x["key"]) == x["at"] + 1)
    return F.transform(F.array_sort(kept), lambda x: x["text"])


def joined(texts: Column) -> Column:
    """As they follow a citation; a bracketed one keeps its brackets."""
    return F.array_join(F.transform(ordered(texts), lambda p: F.when(p.startswith("["), F.concat(F.lit(" "), p)).otherwise(F.concat(F.lit(" ("), p, F.lit(")")))), "")
