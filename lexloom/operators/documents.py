"""Documents: marked-up pages to blocks, writings of an opinion, statute levels,
decision dates, docket papers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import cites, dates

BLOCK_TAGS = frozenset("p div h1 h2 h3 h4 h5 h6 li blockquote td th article section footer nav br tr center".split())
SKIP_TAGS = frozenset(("script", "style", "head"))


class _Blocks(HTMLParser):
    """Blocks of a page in order: (kind, text, links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, list[str]]] = []
        self.kind, self.text, self.links, self.skip = "body", [], [], 0

    def flush(self, kind: str = "body") -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((self.kind, text, self.links))
        self.kind, self.text, self.links = kind, [], []

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.skip += 1
        elif tag in BLOCK_TAGS:
            self.flush("head" if tag[0] == "h" and len(tag) == 2 else "item" if tag == "li" else "body")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")

    def handle_endtag(self, tag):
        if tag in SKIP_TAGS:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def parse_blocks(html: str | None) -> list[tuple[str, str, list[str]]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, n, kind, text, links``: the blocks of each page. A null page has none."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string()))]))
        for batch in batches:
            rows = [[{"kind": k, "text": t, "links": ls} for k, t, ls in parse_blocks(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, block)], names=["id", "blocks"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {kind}, blocks array<struct<kind:string,text:string,links:array<string>>>")
    return out.select("id", F.posexplode("blocks").alias("n", "b")).select("id", "n", "b.kind", "b.text", "b.links")


# How writings of an opinion begin.
ROLES = (
    ("per curiam", r"(?i)^\s*per curiam"),
    ("both", r"(?i)concurring in part and dissenting in part"),
    ("dissent", r"(?i),? dissenting\b"),
    ("concurrence", r"(?i),? concurring\b"),
    ("majority", r"(?i)delivered the opinion of the court|^\s*opinion of the court"),
)
BYLINE_LIMIT = 200


def role_of(block: Column) -> Column:
    """The role that a byline opens, or null for other blocks. Bylines are short."""
    out = F.lit(None).cast("string")
    for role, pattern in reversed(ROLES):
        out = F.when(block.rlike(pattern), F.lit(role)).otherwise(out)
    return F.when(F.length(block) <= BYLINE_LIMIT, out)


def segment(blocks: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Blocks with ``part`` (0: the header) and ``role``. A byline opens a part;
    one with no block after it before the next is a vote and opens none."""
    w = Window.partitionBy(by).orderBy(order)
    marked = blocks.withColumn("_r", role_of(F.col(text)))
    opens = F.col("_r").isNotNull() & F.lead(order).over(w).isNotNull() & F.lead("_r").over(w).isNull()
    marked = marked.withColumn("_o", opens.cast("int")).withColumn("part", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    role = F.last(F.when(F.col("_o") == 1, F.col("_r")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("role", F.coalesce(role, F.lit("header"))).drop("_r", "_o")


#: Kinds of enumerators, outermost first.
HIERARCHY = ("lower", "number", "upper", "roman", "ROMAN")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def enumerator_value(mark: str, kind: str) -> int:
    """The place of a mark in the series of a kind, 0 where it isn't of that kind:
    after z come aa, bb and so on."""
    if kind == "number":
        return int(mark) if mark.isdigit() else 0
    if not mark.isalpha() or not (mark.islower() if kind in ("lower", "roman") else mark.isupper()):
        return 0
    letters = mark.lower()
    if kind in ("lower", "upper"):
        return 26 * (len(letters) - 1) + ord(letters[0]) - 96 if len(set(letters)) == 1 else 0
    values = [_ROMAN.get(c, 0) for c in letters]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values)) if all(values) else 0


def place(marks: list[str], stack: list[tuple[str, int]]) -> int | None:
    """The level of a paragraph by its first enumerator, under the open levels,
    which it changes: the next of an open level (deepest first), else the first of
    the level below, else the first of a level above, else a sibling of the deepest.
    Further enumerators open levels below. Null where the first is none."""
    values = {k: v for k in HIERARCHY if (v := enumerator_value(marks[0], k))}
    if not values:
        return None
    below = lambda n: HIERARCHY[min(n, len(HIERARCHY) - 1)]
    follows = [d for d, (k, v) in enumerate(stack) if v and values.get(k) == v + 1]
    firsts = [d for d in range(min(len(stack), len(HIERARCHY))) if values.get(HIERARCHY[d]) == 1]
    if follows:
        level, kind = follows[-1], stack[follows[-1]][0]
    elif values.get(below(len(stack))) == 1:
        level, kind = len(stack), below(len(stack))
    else:
        level = firsts[-1] if firsts else max(len(stack) - 1, 0)
        kind = below(level)
    stack[level:] = [(kind, values.get(kind, 0))]
    for mark in marks[1:]:
        stack.append((below(len(stack)), enumerator_value(mark, below(len(stack)))))
    return level


def indents(paragraphs: list[list[str]]) -> list[int]:
    """Levels of the paragraphs of one section, by their enumerators; a paragraph
    without one has the level of the paragraph before."""
    stack: list[tuple[str, int]] = []
    out: list[int] = []
    for marks in paragraphs:
        level = place(marks, stack) if marks else None
        out.append(level if level is not None else (out[-1] if out else 0))
    return out


def statute_levels(paragraphs: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``by``, ``levels``: the indent of each paragraph of a section, in order."""
    leading = F.regexp_extract(text, r"^\s*((?:\([0-9A-Za-z]{1,6}\)\s*)+)", 1)
    marks = F.regexp_extract_all(leading, F.lit(r"\(([0-9A-Za-z]+)\)"), F.lit(1))
    rows = paragraphs.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), marks.alias("m")))), lambda x: x["m"]).alias("marks"))
    kind = rows.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indents(m) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=[by, "levels"])

    return rows.select(by, "marks").mapInArrow(run, f"{by} {kind}, levels array<int>")


def decision_date(front: Column) -> Column:
    """ISO date of a decision from its front matter: a refiling, else the first
    labelled date, else a bracketed one, else the last date there is. Dates of
    argument, submission or amendment don't count."""
    day = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? [0-9]{1,2}, [0-9]{4})"
    other = r"(?i)(?:argued|submitted|amended|reargued)[:,]?\s+(?:on\s+)?" + day
    clean = F.regexp_replace(front, other, "")
    pick = lambda p: dates.long_date(F.regexp_extract(clean, p, 1))
    return F.coalesce(
        pick(r"(?i)refiled[:,]?\s+(?:on\s+)?" + day), pick(r"(?i)(?:decided|filed|released|entered)[:,]?\s+(?:on\s+)?" + day),
        pick(r"[\[(]" + day + r"[\])]"), pick(r"(?s).*" + day),
    )


# Kinds of docket papers, in the order that they are tried.
PAPERS = (
    ("skip", r"(?i)certificate of|proof of service|motion to (extend|dispense)|waiver"),
    ("amicus", r"(?i)\bamic(us|i)\b"),
    ("reply", r"(?i)\breply\b"),
    ("petition", r"(?i)petition for (a writ|rehearing|cert)"),
    ("opposition", r"(?i)brief.*in opposition|opposition"),
    ("merits", r"(?i)brief (of|for)"),
    ("transcript", r"(?i)transcript|oral argument"),
    ("opinion", r"(?i)\bopinion|judgment"),
)


def paper_kind(description: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(PAPERS):
        out = F.when(description.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


# Early volumes by reporter's name: (name, first volume, last, offset
# to the official series).
NOMINATIVE = (
    ("Dall.", 1, 4, 0), ("Cranch", 1, 9, 4), ("Wheat.", 1, 12, 13), ("Pet.", 1, 16, 25), ("How.", 1, 24, 41), ("Black", 1, 2, 65), ("Wall.", 1, 23, 67),
)


def official_volume(reporter: Column, vol: Column) -> Column:
    """The official volume of an early one, or null."""
    out = F.lit(None).cast("int")
    for name, first, last, offset in NOMINATIVE:
        same = cites.loose_key(reporter) == cites.loose_key(F.lit(name))
        out = F.when(same & vol.between(first, last), (vol + offset).cast("int")).otherwise(out)
    return out


def bears(text: Column, cite: Column) -> Column:
    """Does a title or byline print this citation, in any spelling?"""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{1,9}\s+[A-Z][A-Za-z0-9.' ]{0,18}?\s+[0-9]{1,9})(?![0-9])"), F.lit(1))

    def key(c):
        p = cites.parse_cite(c)
        return F.concat_ws(" ", p["vol"], p["key"], p["page"])

    return F.coalesce(F.array_contains(F.transform(found, key), key(cite)), F.lit(False))


def trailing_parentheticals(citation: Column) -> Column:
    """struct<head, notes>: parentheticals at the end, innermost brackets kept; two
    levels of brackets are read."""
    one = r"\s*\((?:[^()]|\([^()]*\))*\)"
    tail = F.regexp_extract(citation, rf"((?:{one})+)\s*$", 1)
    notes = F.transform(F.regexp_extract_all(tail, F.lit(one), F.lit(0)), lambda n: F.trim(n))
    return F.struct(F.expr("1").alias("_"), F.rtrim(F.substring(citation, F.lit(1), F.length(F.rtrim(citation)) - F.length(tail))).alias("head"), notes.alias("notes")).dropFields("_")


def curl_quotes(text: Column) -> Column:
    """Straight quotes to curly: opening at the start, after a blank or an opening
    bracket; closing elsewhere."""
    for mark, left, right in (('"', "“", "”"), ("'", "‘", "’")):
        text = F.regexp_replace(text, rf"(?<=^|[\s(\[—“‘]){mark}", left)
        text = F.regexp_replace(text, mark, right)
    return text
