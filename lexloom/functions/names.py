"""Case-name scalars: parties, tokens, similarity scores, file stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.courts import STATES
from lexloom.functions.text import held

# Words too general to search a party by; words that tell no two
# captions apart; business forms.
STOP_TOKENS = ("the", "of", "and", "in", "re", "v", "vs", "et", "al", "a", "an", "for", "on", "ex", "parte", "matter", "state", "people")
CAPTION_WORDS = ("v", "vs", "the", "of", "and", "in", "re", "ex", "parte", "et", "al", "no")
ENTITY_WORDS = ("llc", "llp", "lp", "plc", "inc", "co", "cos", "corp", "ltd", "company", "corporation", "incorporated")


def sides(name: Column) -> Column:
    """The sides of "A v. B" as written, split once; one side without a "v."."""
    return F.filter(F.transform(F.split(name, r"(?i)\s+vs?\.\s+", 2), lambda p: F.trim(p)), lambda p: p != "")


def parties(name: Column) -> Column:
    """The sides in lower case, only a-z, 0-9 and single blanks."""
    plain = lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " "))
    return F.filter(F.transform(sides(name), plain), lambda p: p != "")


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def tokens(text: Column) -> Column:
    """Distinct a-z0-9 runs of two letters or more that aren't stop words."""
    return F.array_distinct(F.filter(_runs(text), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_TOKENS)))


def words(text: Column) -> Column:
    """Distinct words of a party that can tell it from another."""
    return F.array_distinct(F.filter(_runs(text), lambda t: (F.length(t) >= 2) & ~t.isin(*CAPTION_WORDS, *ENTITY_WORDS)))


def overlap_score(query: Column, candidate: Column, floor: float = 0.6) -> Column:
    """Mean over the query's parties of the best share of a party's words found
    in one of the candidate's parties; 0 where no party reaches ``floor``."""
    theirs = F.filter(F.transform(sides(candidate), words), lambda w: F.size(w) > 0)
    mine = F.filter(F.transform(sides(query), words), lambda w: F.size(w) > 0)

    def best(w):
        return F.coalesce(F.array_max(F.transform(theirs, lambda c: F.size(F.array_intersect(w, c)) / F.size(w))), F.lit(0.0))

    scores = F.transform(mine, best)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.array_max(scores), F.lit(0.0)) < floor, F.lit(0.0)).otherwise(total / F.size(scores))


def title_words(title: Column) -> Column:
    """The set of a title's words by which two results are one case or two."""
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.isin("the", "and", "inc", "corp", "llc"))))


# Words that caption sides are compared without, and sides that stand
# for no party of their own.
RELATION_STOP = (
    "the", "of", "and", "in", "re", "ex", "rel", "et", "al", "a", "an", "on", "behalf", "matter", "estate", "appellant", "appellee", "petitioner",
    "respondent", "plaintiff", "defendant", "inc", "llc", "llp", "corp", "co", "ltd", "lp", "na", "fsb", "company", "corporation", "incorporated", "others",
)
GENERIC = ("people", "state", "united", "states", "us", "government", "commonwealth", "commissioner", "america")


def caption_sides(name: Column) -> Column:
    """Sets of words of a caption's sides, without roles and business forms."""

    def words(side):
        found = F.regexp_extract_all(F.lower(F.regexp_replace(side, "<[^>]+>", " ")), F.lit("([a-z][a-z0-9'&.-]*)"), F.lit(1))
        bare = F.transform(found, lambda t: F.regexp_replace(t, "^[.'-]+|[.'-]+$", ""))
        return F.array_distinct(F.filter(bare, lambda t: (F.length(t) > 1) & ~t.isin(*RELATION_STOP)))

    split = F.split(F.coalesce(name, F.lit("")), r"(?i)\bv(?:s?\.|\b)", 2)
    return F.filter(F.transform(split, words), lambda w: F.size(w) > 0)


def close(a: Column, b: Column) -> Column:
    """Equal tokens, or one a prefix of the other and both over three letters."""
    long = (F.length(a) > 3) & (F.length(b) > 3)
    return (a == b) | (long & (a.startswith(b) | b.startswith(a)))


def side_overlap(a: Column, b: Column) -> Column:
    """Tokens of one side that are close to one of the other's, as a share of the
    smaller side."""
    hits = F.size(F.filter(a, lambda x: F.exists(b, lambda y: close(x, y))))
    return F.coalesce(F.try_divide(hits, F.least(F.size(a), F.size(b))), F.lit(0.0))


def generic(side: Column) -> Column:
    """A prosecutor: only filler words, or exactly the name of a state besides."""
    core = F.array_join(F.sort_array(F.filter(side, lambda t: ~t.isin(*GENERIC))), " ")
    states = sorted({" ".join(sorted(set(s.split()) - set(RELATION_STOP))) for s in STATES} | {""})
    return held(core, lambda c: c.isin(*states))


def related(a: Column, b: Column, strict: bool = False) -> Column:
    """Do two captions plausibly name one case? Loosely, one pair of sides that
    aren't generic overlaps by half, or both have a generic side and their others
    do. Strictly (two sides each), both match in one order, a generic side only a
    generic one, others by 0.6."""

    def told(name):
        return F.transform(caption_sides(name), lambda w: F.struct(w.alias("words"), generic(w).alias("generic")))

    def decide(left, right):
        half = F.exists(left, lambda x: ~x["generic"] & F.exists(right, lambda y: ~y["generic"] & (side_overlap(x["words"], y["words"]) >= 0.5)))

        def pair(i, j):
            x, y = F.get(left, F.lit(i)), F.get(right, F.lit(j))
            return F.when(x["generic"] | y["generic"], x["generic"] & y["generic"]).otherwise(side_overlap(x["words"], y["words"]) >= 0.6)

        two = (F.size(left) == 2) & (F.size(right) == 2)
        either = F.coalesce(half, F.lit(False)) & (F.size(left) > 0) & (F.size(right) > 0)
        if not strict:
            return either
        both = (pair(0, 0) & pair(1, 1)) | (pair(0, 1) & pair(1, 0))
        return F.when(two, F.coalesce(both, F.lit(False))).otherwise(either)

    return held(told(a), lambda left: held(told(b), lambda right: decide(left, right)))


# Connectors and roles, which identify no reported case.
ROLE_WORDS = (
    "v", "vs", "versus", "against", "and", "the", "of", "in", "on", "an", "a", "re", "ex", "parte", "or", "to", "for", "his", "her", "wife", "al", "ux",
    "anor", "another", "others", "co", "ltd", "limited", "esq", "esqrs", "gent", "clerk", "knt", "bart", "appellant", "appellants", "respondent",
    "respondents", "plaintiff", "plaintiffs", "defendant", "defendants", "executor", "executors", "administratrix", "administrator", "deceased",
    "same", "case",
)


def folded(name: Column) -> Column:
    """A case name for comparison: lower case, "&" as "and", no marks, single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def distinctive(name: Column) -> Column:
    """The words that identify a case: three letters or more, no number, no role."""
    return F.filter(F.split(folded(name), " "), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*ROLE_WORDS))


def name_match(query: Column, name: Column) -> Column:
    """1.0 for the same name, 0.9 for a run of words inside it, 0.7 for all
    distinctive words scattered, else 0: each must equal a word of the name or be
    its prefix, two letters short at most."""
    q, n = folded(query), folded(name)
    words = F.split(n, " ")
    need = distinctive(query)
    fits = F.forall(need, lambda t: F.exists(words, lambda x: x.startswith(t) & (F.length(x) - F.length(t) <= 2)))
    padded = lambda s: F.concat(F.lit(" "), s, F.lit(" "))
    return F.when((F.size(need) == 0) | ~fits, F.lit(0.0)).when(q == n, F.lit(1.0)).when(padded(n).contains(padded(q)), F.lit(0.9)).otherwise(F.lit(0.7))


def safe_stem(label: Column, limit: int = 80) -> Column:
    """A file name stem: no reserved marks, blanks single, at most ``limit`` long."""
    clean = F.regexp_replace(F.regexp_replace(label, r"""[\\/:*?"<>|\x00-\x1f]""", " "), r"\s+", " ")
    return F.regexp_replace(F.substring(F.trim(clean), 1, limit), r"[\s.]+$", "")


# Accented letters and what they are without their accents.
ACCENTED, PLAIN = "áàâäãåāăąçćčďéèêëēėęěğíìîïīłñńňóòôöõøōřśšşťúùûüūůýÿžźż", "aaaaaaaaacccdeeeeeeeegiiiiilnnnooooooorssstuuuuuuyyzzz"


def letters(text: Column) -> Column:
    """A name's letters alone, unaccented and in lower case."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), "[^a-z]", "")
