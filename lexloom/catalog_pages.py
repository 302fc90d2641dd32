"""Registered queries of web pages, edited citations, alignment and lookups.

As in ``catalog``: tables made from the driver's tables, answers from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.catalog import query
from lexloom.functions import cites, pages, series, text
from lexloom.operators import lookup, ranking, votes
from lexloom.plans import extract, forms, synth
from lexloom.plans.synth import CITATIONS, OPINIONS, table


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("int").alias("n"), F.col("p_size").alias("size"), "p_name", "p_brand")


def _pick(n, *values):
    return F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), n % len(values))


# ---- pages ------------------------------------------------------------------


@query("""
select p_partkey as id, p_partkey % 8 in (0, 1, 2, 6) as content, p_partkey % 8 in (2, 3, 5, 7) as challenge from part
""")
def page_kinds(spark, sf_dir):
    """Result pages and empty ones, told from challenges and shells."""
    html = (
        '<div class="gs_r"><h3 class="gs_rt">[CITATION] <a href="x">Roe v. Wade</a></h3><p>are you not a robot</p></div>', "<p>Your search did not match any articles.</p>",
        '<div class="g-recaptcha"></div><h3 class="gs_rt">Roe</h3>', "<p>Our systems have detected unusual traffic</p>", '<div id="gs_res_ccl"><h3 class="gs_rt">[PDF] </h3></div>',
        '<form action="/sorry/index">x</form>', "<b>No results.</b>", "<script src='a'>x</script><p>Please show you're not a robot</p>",
    )
    p = _part(spark, sf_dir)
    page = p.select("id", _pick(F.col("n"), *html).alias("html"))
    return page.select(
        "id", pages.has_search_content(F.col("html")).alias("content"),
        pages.is_challenge(F.lit("https://scholar.google.com/scholar?q=x"), F.col("html")).alias("challenge"),
    )


@query("""
select p_partkey as id, case p_partkey % 5 when 0 then 'search' when 1 then 'versions,search' when 2 then 'about' when 3 then 'sorry' else '' end as kinds from part
""")
def url_kinds(spark, sf_dir):
    """Addresses of searches, of versions lists, of pages about a case."""
    p = _part(spark, sf_dir)
    n = F.col("n").cast("string")
    url = _pick(
        F.col("n"), F.concat(F.lit("https://Scholar.google.com/scholar/?q="), n), F.concat(F.lit("https://scholar.google.com/scholar?hl=en&cluster="), n),
        F.concat(F.lit("/scholar_case?hl=en&about="), n), F.lit("https://www.google.com/sorry/index?x"), F.concat(F.lit("https://example.com/scholar?q="), n),
    )
    u = F.col("url")
    kinds = F.concat_ws(
        ",", F.when(pages.is_versions_url(u), "versions"), F.when(pages.is_search_url(u), "search"), F.when(pages.is_how_cited_url(u), "about"),
        F.when(pages.is_challenge(u, F.lit("")), "sorry"),
    )
    return p.select("id", url.alias("url")).select("id", kinds.alias("kinds"))


@query("""
select p_partkey as id, case when p_partkey % 2 = 0 then 'Roe v Wade ' || p_partkey else '' end as meant,
       cast(case when p_partkey % 3 = 0 then 1000 + p_partkey else 0 end as int) as n, case when p_partkey % 3 = 0 then '77' || p_partkey else '' end as cites from part
""")
def result_links(spark, sf_dir):
    """The suggested search of a results page, and its "Cited by" link."""
    p = _part(spark, sf_dir)
    n = F.col("n").cast("string")
    meant = F.when(F.col("n") % 2 == 0, F.concat(F.lit('<div>Did you mean: <span><a class="x" href="/scholar?hl=en&amp;q=Roe+v++Wade%20'), n, F.lit('&amp;x=1">Roe</a>'))).otherwise("<div>none</div>")
    cited = F.when(F.col("n") % 3 == 0, F.concat(F.lit('<a href="/scholar?cites=77'), n, F.lit('&amp;as=2">Cited by '), F.format_number(F.col("n") + 1000, 0), F.lit("</a>"))).otherwise('<a href="y">Related</a>')
    rows = p.select("id", F.concat(meant, cited).alias("html"))
    by = pages.cited_by(F.col("html"))
    return rows.select("id", pages.did_you_mean(F.col("html")).alias("meant"), by["n"].alias("n"), by["cites"].alias("cites"))


@query("""
with l as (select p_brand as doc, p_partkey as page, row_number() over (partition by p_brand order by p_partkey) as k from part)
select doc, page, case when k % 7 = 0 then 'prose ' || page || ' ends' else 'prose ' || page end as text from l
""")
def running_heads(spark, sf_dir):
    """Lines that many pages of a document begin with are heads, and go."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("page"))
    k = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    n = F.col("page").cast("string")
    prose = F.when(k % 7 == 0, F.concat(F.lit("prose "), n, F.lit("\nends"))).otherwise(F.concat(F.lit("prose "), n))
    whole = F.concat(F.lit("Cite as: "), n, F.lit(" U. S. (1990)\n"), F.when(k % 2 == 0, F.lit("OCTOBER TERM 1990\n")).otherwise(F.lit("Syllabus of the Court\n")), prose)
    return text.without_heads(part.withColumn("text", whole), "doc", "page", "text").select("doc", "page", "text")


# ---- edited citations -------------------------------------------------------


@query("""
select p_partkey as id, case p_partkey % 4 when 0 then 'Roe v. Wade, 410 U.S. ' || p_partkey || ', 999999 (1973)' when 1 then 'Roe v. Wade, 410 U.S. ' || p_partkey || ' (1973)'
       when 2 then 'Doe v. Roe, 81 F.4th ' || p_partkey || ', 999999' else 'no citation here' end as cite from part
""")
def pinned_citations(spark, sf_dir):
    """A pin put into a citation that a reader has edited."""
    p = _part(spark, sf_dir)
    n = F.col("n").cast("string")
    base = _pick(F.col("n"), F.concat(F.lit("Roe v.  Wade, 410 U.S. "), n, F.lit(" (1973).")), F.concat(F.lit("Roe v. Wade, 410 U.S. "), n, F.lit(" (1973)")), F.concat(F.lit("Doe v. Roe, 81 F.4th "), n, F.lit(".")), F.lit("no citation here"))
    pin = F.when(F.col("n") % 4 == 1, n).otherwise("999999")
    return p.select("id", pages.with_pin(base, pin).alias("cite"))


@query("""
with k as (select p_partkey as id, p_partkey % 3 as form, case when p_partkey % 3 = 0 then 'cl:' || p_partkey || '|' else '' end || 'cite:410:us:' || p_partkey || '|cite:93:sct:' || p_partkey || case when p_partkey % 2 = 0 then '|scholar:' || p_partkey else '' end as keys from part)
select id, keys, case when form = 0 then 'by cluster' when id % 5 = 0 then 'by cite' else '' end as override from k
""")
def citation_overrides(spark, sf_dir):
    """An opinion's keys, and the saved citation under the strongest of them."""
    p = _part(spark, sf_dir)
    n = F.col("n").cast("string")
    keys = pages.identity_keys(F.when(F.col("n") % 3 == 0, F.col("id")), F.array(F.concat(F.lit("410 U. S. "), n), F.concat(F.lit("93 S. Ct. "), n), F.concat(F.lit("410 U.S. "), n)), F.when(F.col("n") % 2 == 0, F.concat(F.lit("https://x/scholar_case?case="), n)))
    rows = p.select("id", keys.alias("keys"))
    saved = p.where("n % 3 = 0").select(F.concat(F.lit("cl:"), n).alias("key"), F.lit("by cluster.").alias("base")).unionByName(p.where("n % 5 = 0").select(F.concat(F.lit("cite:93:sct:"), n).alias("key"), F.lit(" by  cite").alias("base")))
    found = rows.select("id", F.posexplode("keys").alias("at", "key")).join(saved, "key").groupBy("id").agg(F.min_by("base", "at").alias("base"))
    out = rows.join(found, "id", "left")
    return out.select("id", F.array_join("keys", "|").alias("keys"), F.regexp_replace(pages.clean_citation(F.col("base")), r"\.$", "").alias("override"))


@query("""
select p_partkey as id, case p_partkey % 3 when 0 then 'Roe, 1 U.S. 2 (Tex. 1990)' when 1 then 'Roe, 1 U.S. 2 (1990)' else 'Roe, 1 U.S. 2 (holding so)' end as core,
       case p_partkey % 3 when 0 then 'Scalia, J., dissenting|[hereinafter Roe]' when 1 then 'quoting Doe, 2 U.S. 3 (1800)|footnote omitted' else '' end as parens,
       case p_partkey % 3 when 0 then ', aff''d, 3 U.S. ' || p_partkey || ' (1991)' else '' end as history from part
""")
def trailing_groups(spark, sf_dir):
    """A citation to its date, the parentheses after it, and its history."""
    p = _part(spark, sf_dir)
    cite = _pick(
        F.col("n"), F.concat(F.lit("Roe, 1 U.S. 2 (Tex. 1990) (Scalia, J., dissenting) [hereinafter Roe], aff'd, 3 U.S. "), F.col("n").cast("string"), F.lit(" (1991)")),
        F.lit("Roe, 1 U.S. 2 (1990) (quoting Doe, 2 U.S. 3 (1800)) (footnote omitted) "), F.lit("Roe, 1 U.S. 2 (holding so)"),
    )
    t = pages.trailing(cite)
    return p.select("id", t["core"].alias("core"), F.array_join(t["parens"], "|").alias("parens"), t["history"].alias("history"))


@query("""
select p_partkey as id, case p_partkey % 4 when 0 then '7' when 1 then '3,4,5' when 2 then '3,9' else '' end as notes from part
""")
def note_pins(spark, sf_dir):
    """Note numbers after a page or a range of pages."""
    p = _part(spark, sf_dir)
    written = _pick(F.col("n"), "254–255 n.7 and", "254 nn.3-5", "12, nn. 3 & 9", "254, 255 (1990)")
    return p.select("id", F.array_join(pages.note_pin(written).cast("array<string>"), ",").alias("notes"))


@query("""
select p_partkey as id, case p_partkey % 3 when 0 then p_name when 1 then 'full ' || p_partkey else '' end as name from part
""")
def record_names(spark, sf_dir):
    """The best case name of a record's four."""
    p = _part(spark, sf_dir)
    first = F.when(F.col("n") % 3 == 0, F.concat(F.lit("<b>"), "p_name", F.lit("</b> ")))
    third = F.when(F.col("n") % 3 == 1, F.concat(F.lit("full  "), F.col("n").cast("string")))
    return p.select("id", pages.best_name(first, F.lit(" <i></i>"), third, F.lit(None).cast("string")).alias("name"))


# ---- links ------------------------------------------------------------------


@query("""
with p as (select p_partkey as id, p_size as s from part)
select id, 'usc' as kind, 'statute' as category, '29 U.S.C. § ' || id || '(a)' as label, 'https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title29-section' || id as url from p
union all select id, 'rule', 'rule', 'Fed. R. Evid. ' || s, null from p
union all select id, 'statpdf', 'statute', s || ' Stat. ' || (id + 1), 'https://www.govinfo.gov/link/statute/' || s || '/' || (id + 1) from p
union all select id, 'cite', 'case', '410 U.S. 113, 152', null from p
union all select id, 'const', 'constitution', 'U.S. Const. amend. XIV, § 1', null from p
""")
def link_cards(spark, sf_dir):
    """Label, category and address of every link of a text."""
    p = _part(spark, sf_dir)
    prose = F.format_string("29 U.S.C. § %d(a); Fed. R. Evid. %d; %d Stat. %d; 410 U.S. 113, 152; U.S. Const. amend. XIV, § 1.", "n", "size", "size", F.col("n") + 1)
    found = extract.links(p.select(F.col("id").alias("doc_id"), prose.alias("text")))
    kind, value = F.col("kind"), F.col("value")
    return found.select(
        F.col("doc_id").alias("id"), "kind", pages.link_category(kind).alias("category"),
        pages.link_label(kind, value, series.spec_label(kind, value)).alias("label"), pages.link_url(kind, value).alias("url"),
    )


@query("""
with p as (select p_partkey as id, p_size as s, p_partkey as n from part)
select id, 'case' as kind, '410 U.S. 113' as authority, 'Roe v. Part' || n as name, cast(1973 as int) as year, cast(2 as bigint) as uses from p
union all select id, 'case', '93 S. Ct. ' || (n + 1), 'Roe v. Part' || n, 1973, 1 from p
union all select id, 'case', '387 U.S. 1', 'In re Gault', 1967, 1 from p
union all select id, 'usc', '42:' || (n + 1), null, null, 2 from p
""")
def named_authorities(spark, sf_dir):
    """A brief's authorities with name and year; parallel citations share theirs."""
    p = _part(spark, sf_dir)
    prose = F.format_string("See Roe v. Part%d, 410 U.S. 113, 93 S. Ct. %d (1973); 42 U.S.C. § %d(a). Roe, 410 U.S. at 120; In re Gault, 387 U.S. 1 (1967); 42 U.S.C. § %d(b).", "n", F.col("n") + 1, F.col("n") + 1, F.col("n") + 1)
    found = extract.links(p.select(F.col("id").alias("doc_id"), prose.alias("text")))
    kind = F.when(F.col("kind").isin("cite", "short", "id"), "case").otherwise(F.col("kind"))
    return votes.authorities(found.select("doc_id", "start", kind.alias("kind"), "value", "name", "year")).select(F.col("doc_id").alias("id"), "kind", "authority", "name", "year", "uses")


@query("""
select p_partkey as id, case p_partkey % 7 when 0 then 'usc' when 1 then 'const' when 2 then 'rule' when 3 then 'statpdf' when 4 then 'sec' else 'const' end as kind,
       case p_partkey % 7 when 0 then '42:' || p_partkey || ':' when 1 then 'amend:14:' when 2 then 'fre:404:b' when 3 then '88 Stat. ' || p_partkey when 4 then '{"page":893,"pin":915,"vol":' || p_size || '}' else 'pmbl:0:' end as value
from part where p_partkey % 7 < 6 and p_size < 60 and p_partkey > 0
""")
def typed_queries(spark, sf_dir):
    """Queries that are one whole citation; others are left to other searches."""
    p = _part(spark, sf_dir).where("n > 0 and size < 60")
    n, s = F.col("n").cast("string"), F.col("size").cast("string")
    typed = _pick(F.col("n"), F.concat(F.lit("42 USC "), n), F.lit("14th Amendment"), F.lit(" FRE 404(b). "), F.concat(F.lit("88 Stat. "), n), F.concat(s, F.lit(" S.E.C. 893, 915")), F.lit("the United States Constitution"), F.concat(F.lit("see 42 U.S.C. § "), n))
    return extract.typed(p.select("id", typed.alias("query")), "id", "query")


@query("""
with p as (select p_partkey as id, p_partkey + 1 as n, p_partkey % 5 as form from part),
v as (select id, unnest(case form
  when 0 then ['{"page":"' || n || '","src":"cr","vol":120,"year":1974}', '{"page":"4906","src":"cr","vol":120,"year":1974}', '{"page":"' || (n + 7) || '","src":"cr","vol":120,"year":1974}']
  when 1 then ['{"daily":true,"date":"1999-11-17","page":"S' || n || '","src":"cr","vol":145,"year":1999}']
  when 2 then ['{"cong":39,"page":' || n || ',"sess":1,"src":"globe","year":1866}', '{"app":true,"cong":39,"page":68,"sess":1,"src":"globe"}']
  when 3 then ['{"ch":"h","cong":94,"num":' || n || ',"pin":"47","src":"rpt","year":1976}', '{"ch":"h","cong":94,"num":' || n || ',"pin":"48","src":"rpt","year":1976}', '{"ch":"s","cong":94,"num":473,"src":"doc"}']
  else ['{"page":' || n || ',"src":"annals","vol":12,"year":1803}', '{"app":true,"page":5,"src":"regdeb","vol":7}'] end) as value from p where n < 9000)
select id, value from v
""")
def legislative_links(spark, sf_dir):
    """The Congressional Record, early debates and reports found in prose."""
    prose = (
        "120 Cong. Rec. %1$d, 4906 (1974). Id. at %2$d.", "See 145 Cong. Rec. S%1$d (daily ed. Nov. 17, 1999).", "Cong. Globe, 39th Cong., 1st Sess., %1$d (1866); Cong. Globe App. 68.",
        "H.R. Rep. No. 94-%1$d, at 47 (1976). Id. at 48. S. Doc. 94-473.", "12 Annals of Cong. %1$d (1803); 7 Reg. of Deb., App. 5.",
    )
    p = _part(spark, sf_dir).where("n < 8999")
    told = F.coalesce(*[F.when(F.col("n") % 5 == k, F.format_string(f, F.col("n") + 1, F.col("n") + 8)) for k, f in enumerate(prose)])
    return extract.links(p.select(F.col("id").alias("doc_id"), told.alias("text"))).select(F.col("doc_id").alias("id"), "value")


@query(f"""
with {OPINIONS}, {CITATIONS}, asked as (select p_partkey as id, p_size as vol, p_partkey + 1 as page from part)
select distinct asked.id, scholar_id, name from asked join citations on citations.vol = asked.vol and citations.page = asked.page and canon = 'U.S.' join opinions using (scholar_id)
""")
def text_lookup(spark, sf_dir):
    """The stored opinions that a text cites."""
    p = _part(spark, sf_dir)
    prose = F.format_string("Compare %d U. S. %d (1990) with 9999 F.2d 1.", "size", F.col("n") + 1)
    found = extract.links(p.select(F.col("id").alias("doc_id"), prose.alias("text"))).where("kind = 'cite'").select("doc_id", "vol", "reporter", "page")
    held = synth.citations(spark, sf_dir).select("scholar_id", "vol", cites.canonical_reporter(F.col("reporter")).alias("reporter"), "page").distinct()
    return found.join(held, ["vol", "reporter", "page"]).join(synth.opinions(spark, sf_dir), "scholar_id").select(F.col("doc_id").alias("id"), "scholar_id", "name").distinct()


@query("""
with e as (select l_suppkey as cited, l_orderkey as citing, count(*) as depth from lineitem group by 1, 2)
select cited, citing, depth, cast(row_number() over (partition by cited order by depth desc, citing) as int) as rank from e qualify rank <= 5
""")
def citing_edges(spark, sf_dir):
    """The cases that cite one, those that cite it most first."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cited"), F.col("l_orderkey").alias("citing")).agg(F.count("*").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("cited").orderBy(F.desc("depth"), "citing"))
    return e.withColumn("rank", rank).where("rank <= 5")


@query("""
select 'usc' as name, true as named union all select 'cfr', true union all select 'const', true union all select 'stat', true
union all select 'register', true union all select 'sec', true union all select 'unreported', true union all select 'numbered', true
""")
def script_patterns(spark, sf_dir):
    """The link patterns as a script engine reads them: no Python-only syntax."""
    rows = [(name, "(?P" not in forms.to_script(p) and "\\Z" not in forms.to_script(p)) for name, p in forms.EXPORTED.items()]
    return spark.createDataFrame(rows, "name string, named boolean")


# ---- alignment --------------------------------------------------------------

_WORDS = """
w as (select doc_id as doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as word, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), 1) - 1 as pos from documents),
pg as (select doc, pos - 20 as pos, case when pos % 11 = 0 then 'zzz' else word end as word from w where pos >= 20 and pos < 60)"""


@query(f"""
with {_WORDS},
n as (select doc, count(*) as n from pg group by doc),
m as (select p.doc, p.pos, p.pos - row_number() over (partition by p.doc order by p.pos) as run from pg p join w s on s.doc = p.doc and s.pos = p.pos + 20 and s.word = p.word),
b as (select doc, run, count(*) as size from m group by 1, 2)
select n.doc, 20 as "offset", cast(0.85 * coalesce(sum(size), 0) / any_value(n.n) + 0.15 * least(1.0, coalesce(max(size), 0) / 8.0) as double) as score
from n left join b using (doc) group by n.doc
""")
def alignment_score(spark, sf_dir):
    """How well a page's words match a source at an offset: the share of words that
    match, and the longest run of them."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    src = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(words).alias("pos", "word"))
    page = src.where("pos >= 20 and pos < 60").select("doc", (F.col("pos") - 20).alias("pos"), F.when(F.col("pos") % 11 == 0, "zzz").otherwise(F.col("word")).alias("word"))
    asked = page.select("doc").distinct().withColumn("offset", F.lit(20))
    return ranking.alignment_scores(src, page, asked, "doc").select("doc", "offset", F.col("score"))


@query("""
with pg as (select p_brand as doc, cast(p_partkey * 10 as int) as off, cast(p_partkey as int) as page from part),
q as (select p_brand as doc, cast(p_partkey * 10 + p_partkey % 25 as int) as at from part)
select q.doc, q.at as "at", pg.page, pg.off as "from" from q asof left join pg on q.doc = pg.doc and q.at >= pg.off
""")
def offset_pages(spark, sf_dir):
    """The printed page at an offset of a text, and where that page begins."""
    part = table(spark, sf_dir, "part")
    begins = part.select(F.col("p_brand").alias("doc"), (F.col("p_partkey") * 10).cast("int").alias("from"), F.col("p_partkey").cast("int").alias("page"))
    asked = part.select(F.col("p_brand").alias("doc"), (F.col("p_partkey") * 10 + F.col("p_partkey") % 25).cast("int").alias("at"))
    return lookup.nearest(asked, begins, ["doc"], "at", "from").join(begins, ["doc", "from"], "left").select("doc", "at", "page", "from")


@query("""
select p_partkey as id, case when p_partkey % 3 = 0 then null else p_size || ',' || (p_size + 1) end as pages from part
""")
def saved_pagination(spark, sf_dir):
    """A saved pagination counts only while the text's fingerprint is the same."""
    p = _part(spark, sf_dir)
    now = p.select("id", F.sha2(F.col("p_name"), 256).alias("fingerprint"))
    saved = p.select("id", F.sha2(F.when(F.col("n") % 3 == 0, F.lit("old")).otherwise(F.col("p_name")), 256).alias("fingerprint"), F.concat_ws(",", F.col("size").cast("string"), (F.col("size") + 1).cast("string")).alias("pages"))
    return now.join(saved, ["id", "fingerprint"], "left").select("id", "pages")


@query(r"""
select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '\bthe\b')) as bigint) as lower_uses,
       cast(len(regexp_extract_all(coalesce(text, ''), '[a-z,] The\b')) as bigint) as name_uses from documents
""")
def word_uses(spark, sf_dir):
    """How often a word stands in lower case, and how often as a name in prose."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit(r"\bthe\b")).cast("long").alias("lower_uses"), F.regexp_count(t, F.lit(r"[a-z,] The\b")).cast("long").alias("name_uses"))


@query("""
with every as (
  select l_orderkey as docket, l_suppkey % 9 as k, 0 as src, l_linenumber as seq from lineitem where l_returnflag <> 'R'
  union all select l_orderkey, l_suppkey % 9, 1, l_linenumber from lineitem where l_returnflag = 'R'
), f as (select docket, k, src from every qualify row_number() over (partition by docket, k order by src, seq) = 1)
select docket, 'x.gov/' || k as url_key, case src when 0 then 'court' else 'blog' end as source from f
""")
def docket_merge(spark, sf_dir):
    """A docket's documents of the court and of a blog, each link once; the court's
    own come first."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("docket"), (F.col("l_suppkey") % 9).alias("k"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("at"))
    court = line.where("flag <> 'R'").select("docket", F.concat(F.lit("https://x.gov/"), F.col("k").cast("string")).alias("url"), F.lit("court").alias("source"), F.struct(F.lit(0), "at").alias("seq"))
    blog = line.where("flag = 'R'").select("docket", F.concat(F.lit("http://X.gov/"), F.col("k").cast("string"), F.lit("/")).alias("url"), F.lit("blog").alias("source"), F.struct(F.lit(1), "at").alias("seq"))
    both = court.unionByName(blog).withColumn("stage", F.lit("other"))
    return ranking.distinct_documents(both, "docket", "url", "stage", "seq").select("docket", "url_key", "source")
