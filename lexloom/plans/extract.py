"""Citation extraction: text -> links, in one Arrow pass a batch.

Spark has no function for the positions of all matches, so one pass draws the
matches of every kind with their offsets, chooses among them from left to right
(the earliest start, then the longest, then the order of the kinds), and resolves
short forms and "Id." against the citations before them. Texts without a digit are
left out before the pass, and only links leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.cites import REPORTERS, _plain, alias_map
from lexloom.plans import forms

LINK = "start int, end int, kind string, vol int, reporter string, page int, pin string, value string, name string, year int"
# Limits of back-references.
PAGE_WINDOW, NEAR_GAP, FAR_GAP, LOOK_BACK = 100, 240, 900, 4


def _spellings() -> str:
    every = sorted({s for name, others in REPORTERS.items() for s in (name, *others)}, key=len, reverse=True)
    return "|".join(re.escape(s) for s in every)


#: Numbers have as many digits as an int always holds.
FULL = re.compile(rf"(?<![\w.])(\d{{1,9}})\s+({_spellings()})\s+(\d{{1,9}})(?:,\s+(\d{{1,9}})(?!\d|\s+(?:{_spellings()})\s+\d)(?:[-–]\d+)?)?(?!\d)")
SHORT = re.compile(rf"(?<![\w.])(\d{{1,9}})\s+({_spellings()}),?\s+at\s+(\d{{1,9}})(?!\d)")
ID = re.compile(r"(?<!\w)[Ii]d\.(?:,?\s+at\s+(\d{1,9})(?!\d))?")
ORDER = {"usc": 0, "cfr": 1, "rule": 2, "const": 3, "statpdf": 4, "frpdf": 5, "sec": 6, "recap": 7, "scotus": 8, "leghist": 9, "fedcas": 10, "cite": 11, "short": 12, "id": 13}
#: Kinds that "Id." passes over: they have no pages.
UNPAGED = ("usc", "cfr", "rule", "const")
RECORD = re.compile(r"\b(?:Tr\.|Rec\.|J\.A\.|R\.|Pet\. App\.)\s*(?:at\s+)?\d")
QUOTED = re.compile(r"\((?:quoting|citing)\b[^()]*$")


def _canon() -> dict[str, str]:
    return alias_map()


def draw(text: str, alias: dict[str, str]) -> list[dict]:
    """All matches of all kinds, not yet reconciled."""
    out = [dict(zip(("start", "end", "kind", "vol", "page", "value"), x, strict=True), reporter=None, pin=None, name=None, year=None) for x in forms.draw(text)]

    def put(m, kind, vol=None, reporter=None, page=None, pin=None, value=None):
        out.append({"start": m.start(), "end": m.end(), "kind": kind, "vol": vol, "reporter": reporter, "page": page, "pin": pin, "value": value, "name": None, "year": None})

    for m in FULL.finditer(text):
        name = alias[_plain(m[2])]
        put(m, "cite", int(m[1]), name, int(m[3]), m[4], f"{m[1]} {name} {m[3]}" + (f"@{m[4]}" if m[4] and m[4] != m[3] else ""))
    for m in SHORT.finditer(text):
        put(m, "short", int(m[1]), alias[_plain(m[2])], None, m[3])
    for m in ID.finditer(text):
        put(m, "id", pin=m[1])
    return out


NAME = re.compile(
    r"(?:^|(?<=[\s(“\"]))((?:In re |Ex parte |Matter of )?[A-Z][\w.'’&-]*(?:,? (?:of|the|and|&|for|in|de|la|ex|rel\.|[A-Z][\w.'’&-]*))*?"
    r"(?: v\. [A-Z][\w.'’&-]*(?:,? (?:of|the|and|&|for|in|de|la|ex|rel\.|[A-Z][\w.'’&-]*))*)?),\s*$"
)
SIGNAL = re.compile(r"^(?:(?:See|Cf\.|Accord|Compare|But|Also|Then|Under|In|E\.g\.,)\s+(?:also\s+|cf\.\s+|see\s+)?)+(?!re\b)")
YEAR = re.compile(r"\s*\((?:[^()]{0,60}?[\s.])?(1[6-9]\d\d|20\d\d)\)")


def name_before(text: str, at: int) -> str | None:
    """The case name that ends right before a citation, without a signal: two
    parties, or a matter; a lone word only as a short form of a name."""
    m = NAME.search(text[max(0, at - 200) : at])
    return (SIGNAL.sub("", m[1]) or None) if m else None


def named(links: list[dict], text: str) -> list[dict]:
    """Full citations with the name before and the year after them. Parallel
    citations, with only a comma between, share the first one's name and the year
    at their end."""
    run: list[dict] = []
    for x in links:
        if x["kind"] != "cite":
            run = []
            continue
        if run and not text[run[-1]["end"] : x["start"]].strip(" ,\t\n"):
            x["name"] = run[0]["name"]
            run.append(x)
        else:
            x["name"] = name_before(text, x["start"])
            run = [x]
        year = YEAR.match(text, x["end"])
        for y in run if year else ():
            y["year"] = y["year"] or int(year[1])
    return links


def chosen(found: list[dict]) -> list[dict]:
    """Leftmost, then longest, then by kind; what overlaps the one before goes."""
    out, at = [], 0
    for x in sorted(found, key=lambda x: (x["start"], -x["end"], ORDER[x["kind"]])):
        if x["start"] >= at:
            out.append(x)
            at = x["end"]
    return out


def resolve_chain(links: list[dict], text: str) -> list[dict]:
    """Short forms and "Id." in reading order. A short form goes to the document's
    largest first page of its volume at or below the pin, else to the smallest;
    one without any blocks what follows. A provision of the Constitution is linked
    where the document first cites it."""
    firsts: dict[tuple, list[int]] = {}
    for x in links:
        if x["kind"] == "cite":
            firsts.setdefault((x["vol"], x["reporter"]), []).append(x["page"])
    out, recent, provisions = [], [], set()
    for x in links:
        kind = x["kind"]
        if kind == "short":
            pages, pin = firsts.get((x["vol"], x["reporter"])), int(x["pin"])
            if not pages:
                recent.append(x | {"kind": "block"})
                continue
            below = [p for p in pages if p <= pin]
            page = max(below) if below else min(pages)
            x = x | {"page": page, "value": f"{x['vol']} {x['reporter']} {page}" + (f"@{pin}" if pin != page else "")}
        elif kind == "id":
            found = antecedent(x, recent, text)
            if found is None:
                continue
            x = x | {"vol": found["vol"], "reporter": found["reporter"], "page": found["page"], "value": _at_page(found, int(x["pin"]))}
            recent.append(found | {"start": x["start"], "end": x["end"]})
            out.append(x)
            continue
        elif kind == "const":
            if x["value"] in provisions:
                recent.append(x)
                continue
            provisions.add(x["value"])
        recent.append(x)
        out.append(x)
    return out


def _at_page(found: dict, pin: int) -> str:
    if found["kind"] == "leghist":
        return forms.leghist_at(found["value"], str(pin))
    if found["kind"] == "sec":
        return forms.sec_spec(found["vol"], found["page"], pin)
    base = found["value"] if found["kind"] in ("statpdf", "frpdf") else f"{found['vol']} {found['reporter']} {found['page']}"
    return base + (f"@{pin}" if pin != found["page"] else "")


def antecedent(x: dict, recent: list[dict], text: str) -> dict | None:
    """The citation that "Id. at N" means, of the last ``LOOK_BACK``, newest first.

    None where no page is given; where a record citation or a blank line comes
    between; beyond ``FAR_GAP`` letters or past a short form that names nothing.
    Passed over are citations inside "(quoting ..." and "(citing ...", and kinds
    without pages. Of comma-joined parallel citations the first that can hold the
    page is meant. Serials must be within ``NEAR_GAP``."""
    if x["pin"] is None or not recent:
        return None
    between = text[recent[-1]["end"] : x["start"]]
    if re.search(r"\n[ \t]*\n", between) or RECORD.search(between):
        return None
    pin, last = int(x["pin"]), recent[-LOOK_BACK:]
    for k in range(len(last) - 1, -1, -1):
        c = last[k]
        gap = len(text[c["end"] : x["start"]].strip())
        if c["kind"] == "block" or gap > FAR_GAP:
            return None
        if c["kind"] in UNPAGED or QUOTED.search(text, max(0, c["start"] - 300), c["start"]):
            continue
        if c["page"] is None:
            if gap <= NEAR_GAP and c["kind"] not in ("recap", "scotus", "fedcas"):
                return c
            continue
        if not c["page"] <= pin <= c["page"] + PAGE_WINDOW:
            continue
        first = k
        while first and last[first - 1]["kind"] == "cite" and not text[last[first - 1]["end"] : last[first]["start"]].strip(" ,\t\n"):
            first -= 1
        return next((p for p in last[first:k] if p["page"] <= pin <= p["page"] + PAGE_WINDOW), c)
    return None


def typed(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, value``: queries that are one whole citation."""
    kind = queries.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forms.typed(t) for t in batch.column(1).to_pylist()]
            hold = pa.array([k for k, x in enumerate(found) if x], pa.int64())
            columns = [pa.array([x[c] for x in found if x], pa.string()) for c in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hold), *columns], names=[key, "kind", "value"])

    return queries.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, value string")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, kind, vol, reporter, page, pin, value, name, year`` of
    each link.
    Null texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alias = _canon()
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = resolve_chain(named(chosen(draw(text, alias)), text), text)
                ids += [k] * len(found)
                rows += found
            if rows:
                columns = [pa.array([r[c] for r in rows], t) for c, t in FOUND.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *columns], names=["doc_id", *FOUND])

    rows = docs.where(F.col(text_col).rlike("[0-9]")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {LINK}")


FOUND = {
    "start": pa.int32(), "end": pa.int32(), "kind": pa.string(), "vol": pa.int32(), "reporter": pa.string(), "page": pa.int32(), "pin": pa.string(), "value": pa.string(),
    "name": pa.string(), "year": pa.int32(),
}
