"""Scalars on web pages and saved citations: what a page is, what it links to, and
citations that a reader has edited."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.cites import loose_key


def _text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]+>", " "), r"\s+", " "))


def _unescaped(text: Column) -> Column:
    for name, mark in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def is_search_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://scholar\.google\.com(?::\d+)?/scholar/?(?:[?#]|$)"), F.lit(False))


def is_versions_url(url: Column) -> Column:
    return F.coalesce(url.contains("/scholar?") & url.rlike(r"[?&]cluster=\d+"), F.lit(False))


def is_how_cited_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"scholar_case\?(?:[^#]*&)?about=\d"), F.lit(False))


def has_search_content(html: Column) -> Column:
    """A result with a title, its badge aside, or a notice that nothing was found."""
    html = F.coalesce(html, F.lit(""))
    titles = F.regexp_extract_all(html, F.lit(r'(?is)class="[^"]*\bgs_rt\b[^"]*"[^>]*>(.*?)</h3>'), F.lit(1))
    real = F.exists(titles, lambda t: F.regexp_replace(_text(t), r"(?i)^(?:\s*\[(?:citation|book|pdf|html|doc)\]\s*)+", "") != "")
    empty = r"(?i)\bdid not match any\b|\b(?:no|0) (?:results|articles|cases|opinions|documents|citations) (?:(?:were )?found|match(?:ed)?|for (?:your )?(?:search|query))\b|\b(?:search|query) (?:returned|yielded|produced) (?:no|0) (?:results|articles|cases|opinions|documents)\b"
    return real | _text(html).rlike(empty) | F.lower(_text(html)).rlike(r"^[ .]*no (?:results|articles)[ .]*$")


def is_challenge(url: Column, html: Column) -> Column:
    """A page that asks for a proof of being human: by its address or a widget; by
    its words only where it has no results and no opinion."""
    html = F.coalesce(html, F.lit(""))
    widget = html.rlike(r'(?i)\bid="(?:recaptcha|recaptcha-form|captcha-form)"|\bclass="[^"]*\bg-recaptcha\b|<(?:form|iframe)\b[^>]*(?:action|src)="[^"]*(?:/sorry/|recaptcha)')
    script = html.rlike(r'(?i)<script\b[^>]*src="[^"]*(?:/sorry/|recaptcha)')
    words = _text(html).rlike(r"(?i)\bunusual traffic\b|\bnot a robot\b|\bverify (?:that )?you(?:'re| are) (?:a )?human\b")
    content = has_search_content(html) | html.rlike(r'(?i)\bid="gs_opinion"|class="[^"]*\bgs_opinion\b')
    return F.coalesce(url.rlike(r"(?i)^[a-z]+://[^/]+/sorry(?:/|$|\?)"), F.lit(False)) | widget | (~content & (script | words))


def did_you_mean(html: Column) -> Column:
    """The words of the search that a results page suggests, or ""."""
    href = _unescaped(F.regexp_extract(F.coalesce(html, F.lit("")), r'(?is)Did you mean:?\s*(?:</[^>]+>\s*|<(?!a\b)[^>]*>\s*)*<a\b[^>]*href="([^"]*)"', 1))
    words = F.regexp_extract(href, r"[?&]q=([^&#]*)", 1)
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(words), words), r"\s+", " "))


def cited_by(html: Column) -> Column:
    """struct<n, cites> of a result's "Cited by N" link; 0 and "" without one."""
    pattern = r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>\s*Cited\s+by\s+([\d,]+)\s*</a>'
    html = F.coalesce(html, F.lit(""))
    n = F.regexp_replace(F.regexp_extract(html, pattern, 2), ",", "")
    return F.struct(
        F.coalesce(n.try_cast("int"), F.lit(0)).alias("n"),
        F.regexp_extract(_unescaped(F.regexp_extract(html, pattern, 1)), r"[?&]cites=(\d+)", 1).alias("cites"),
    )


_CITE_IN = r"(?<!\d)(\d{1,9})\s+([A-Z][A-Za-z.' ]*?(?:\d[a-z]{1,2})?)\s+(\d{1,9})(?!\d)"


def clean_citation(text: Column) -> Column:
    """Blanks single, and no full stop after the year or the page."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.regexp_replace(plain, r"(?<=\)|\d)\.$", "")


def with_pin(citation: Column, pin: Column) -> Column:
    """A pin after the first reporter citation, unless it is the first page."""
    base, pin = clean_citation(citation), F.trim(F.coalesce(pin, F.lit("")))
    found = F.regexp_extract(base, _CITE_IN, 0)
    at = F.length(F.call_function("substring_index", base, found, F.lit(1))) + F.length(found)
    placed = F.concat(F.left(base, at), F.lit(", "), pin, F.substring(base, at + 1, F.length(base)))
    return F.when((pin == "") | (found == "") | (pin == F.regexp_extract(base, _CITE_IN, 3)), base).otherwise(placed)


def identity_keys(cluster: Column, citations: Column, url: Column) -> Column:
    """The keys of an opinion, strongest first: its cluster, each reporter
    citation, and the id in its address."""

    def key(c):
        vol, reporter, page = (F.regexp_extract(c, _CITE_IN, k) for k in (1, 2, 3))
        return F.when(vol != "", F.concat_ws(":", F.lit("cite"), vol.try_cast("int").cast("string"), loose_key(reporter), page.try_cast("int").cast("string")))

    case = F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]case=([^&#]+)", 1)
    first = F.when(F.coalesce(cluster.cast("string"), F.lit("")) != "", F.concat(F.lit("cl:"), cluster.cast("string")))
    last = F.when(case != "", F.concat(F.lit("scholar:"), case))
    return F.array_distinct(F.array_compact(F.concat(F.array(first), F.transform(citations, key), F.array(last))))


def trailing(citation: Column) -> Column:
    """struct<core, parens, history>: to the date's parenthesis, the groups after
    it (a bracketed one with its brackets), and what follows them."""
    text = F.rtrim(F.coalesce(citation, F.lit("")))
    group = r"(?:\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\])"
    date = r"\((?:[^()]*\s)?(?:1[5-9]|20)\d\d\)"
    core = F.regexp_extract(text, rf"^((?:(?!{date}).)*{date})", 1)
    rest = F.substring(text, F.length(core) + 1, F.length(text))
    run = F.regexp_extract(rest, rf"^((?:\s*{group})*)", 1)
    bare = lambda g: F.when(g.startswith("("), F.trim(F.substring(g, F.lit(2), F.length(g) - 2))).otherwise(g)
    parens = F.transform(F.regexp_extract_all(run, F.lit(f"({group})"), F.lit(1)), bare)
    history = F.rtrim(F.substring(rest, F.length(run) + 1, F.length(rest)))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(core == "", text).otherwise(core).alias("core"), F.when(core == "", none).otherwise(parens).alias("parens"), F.when(core == "", "").otherwise(history).alias("history")
    )


def note_pin(text: Column) -> Column:
    """The note numbers after a page or range: "254–255 n.7" gives [7], "nn.3-5"
    the notes from 3 to 5."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\*?\d{1,6}(?:\s*[-–—]\s*\*?\d{1,6})?,?\s+nn?\.\s*(\d{1,3}(?:\s*[-–,&]\s*\d{1,3})*)", 1)
    parts = F.filter(F.split(F.regexp_replace(found, r"\s+", ""), "[,&]"), lambda p: p != "")

    def span(p):
        ends = F.transform(F.split(p, "[-–]"), lambda x: x.try_cast("int"))
        return F.sequence(F.get(ends, F.lit(0)), F.greatest(F.get(ends, F.lit(0)), F.element_at(ends, -1)))

    return F.when(found == "", F.array().cast("array<int>")).otherwise(F.flatten(F.transform(parts, span)))


def best_name(*fields: Column) -> Column:
    """The first field that has text once its markup is gone; "" without one."""
    return F.coalesce(*[F.nullif(_text(f), F.lit("")) for f in fields], F.lit(""))


def link_label(kind: Column, value: Column, spec_label: Column) -> Column:
    """What a link is shown as: a citation with its pin, or a spec's label."""
    pin = F.regexp_extract(value, "@(.*)$", 1)
    case = F.concat(F.regexp_replace(value, "@.*$", ""), F.when(pin != "", F.concat(F.lit(", "), pin)).otherwise(""))
    return F.coalesce(spec_label, case)


def link_category(kind: Column) -> Column:
    """Case, statute, rule, provision or other, for a client's colours."""
    return (
        F.when(kind.isin("cite", "short", "id", "recap", "scotus", "fedcas"), "case").when(kind.isin("usc", "cfr", "statpdf", "frpdf"), "statute")
        .when(kind == "rule", "rule").when(kind == "const", "constitution").otherwise("other")
    )


def link_url(kind: Column, value: Column) -> Column:
    """The official address of a session law, a register page, a section of the
    Code of Federal Regulations or of the United States Code."""
    vol, page = F.regexp_extract(value, r"^(\d+) ", 1), F.regexp_replace(F.regexp_extract(value, r" ([\d,]+)(?:@|$)", 1), ",", "")
    title, section = F.get(F.split(value, ":"), F.lit(0)), F.get(F.split(value, ":"), F.lit(1))
    return (
        F.when(kind == "statpdf", F.concat(F.lit("https://www.govinfo.gov/link/statute/"), vol, F.lit("/"), page))
        .when(kind == "frpdf", F.concat(F.lit("https://www.govinfo.gov/link/fr/"), vol, F.lit("/"), page, F.lit("?link-type=pdf")))
        .when(kind == "cfr", F.concat(F.lit("https://www.ecfr.gov/current/title-"), title, F.lit("/section-"), section))
        .when(kind == "usc", F.concat(F.lit("https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title"), title, F.lit("-section"), section))
    )
