"""Registered queries of citation forms, series, rankings and tallies.

As in ``catalog``: tables made from the driver's tables, answers from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.catalog import query
from lexloom.functions import abbrev, cites, courts, dates, names, parentheticals, series, text
from lexloom.operators import lookup, people, ranking
from lexloom.plans import extract, synth
from lexloom.plans.synth import CITATIONS, OPINIONS, table


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("int").alias("n"), F.col("p_size").alias("size"), "p_name", "p_brand", "p_type")


# ---- series -----------------------------------------------------------------


@query("""
select p_partkey as id, p_partkey || case when p_partkey % 100 between 10 and 20 then 'th' when p_partkey % 10 = 1 then 'st' when p_partkey % 10 in (2, 3) then 'd' else 'th' end as ordinal from part
""")
def bluebook_ordinals(spark, sf_dir):
    """1st, 2d, 3d, 4th, 11th, 42d."""
    return _part(spark, sf_dir).select("id", series.bluebook_ordinal(F.col("n")).alias("ordinal"))


_YEARS = ", ".join(map(str, series.RECORD_YEARS))


@query(f"""
with r as (select unnest([{_YEARS}]) as y, generate_subscripts([{_YEARS}], 1) as v),
p as (select p_partkey as id, cast(1780 + p_partkey % 260 as int) as yr, cast(p_partkey % 130 as int) as cong, cast(p_partkey % 3 + 1 as int) as sess, cast(p_partkey % 180 as int) as vol from part)
select id, yr, case when yr < 1789 then '' when yr >= 1935 then cast((yr - 1789) // 2 + 1 as varchar) when yr % 2 = 0 then cast((yr - 1788) // 2 as varchar)
         when (yr - 1789) // 2 = 0 then '1' else ((yr - 1789) // 2) || ',' || ((yr - 1789) // 2 + 1) end as congresses,
       cast(case when cong >= 74 then 1789 + 2 * (cong - 1) + sess - 1 when sess <= 1 then 1790 + 2 * (cong - 1) else 1791 + 2 * (cong - 1) end as int) as sat,
       cast(coalesce((select y from r where v = vol), case when vol > {len(series.RECORD_YEARS)} then vol + 1854 else 0 end) as int) as record_year,
       case when yr > 1994 then cast(yr - 1854 as varchar) else coalesce((select string_agg(v, ',' order by v) from r where y = yr), '') end as volumes
from p
""")
def congress_years(spark, sf_dir):
    """Congresses of a year, the year of a session, Record volumes both ways."""
    p = _part(spark, sf_dir).select("id", (1780 + F.col("n") % 260).alias("yr"), (F.col("n") % 130).alias("cong"), (F.col("n") % 3 + 1).alias("sess"), (F.col("n") % 180).alias("vol"))
    return p.select(
        "id", "yr", F.array_join(series.congresses_of_year(F.col("yr")).cast("array<string>"), ",").alias("congresses"),
        series.year_of_congress(F.col("cong"), F.col("sess")).alias("sat"), series.record_year(F.col("vol")).alias("record_year"),
        F.array_join(series.record_volumes(F.col("yr")).cast("array<string>"), ",").alias("volumes"),
    )


@query("""
with p as (select p_partkey as id, cast(p_partkey % 6 + 1 as int) as v, p_partkey as page, case when p_partkey % 13 = 0 then null else cast(1780 + p_partkey % 130 as int) end as yr, p_partkey % 4 as form from part),
c as (select *, v || case form when 0 then ' Wash. ' when 1 then ' Washington ' when 2 then ' Wash. 2d ' else ' Wash., ' end || page as cite, form <> 2 as plain from p)
select id, cite, case when not plain or yr is null or yr >= 1889 then cite
                      when yr >= 1790 and v <= 2 then v || ' Va. ' || page
                      when yr >= 1803 and v <= 4 then v || ' Wash. C.C. ' || page else cite end as era,
       case when plain and v <= 2 then v || ' Va. ' || page || '; ' || v || ' Wash. C.C. ' || page when plain and v <= 4 then v || ' Wash. C.C. ' || page else '' end as earlier
from c
""")
def washington_era(spark, sf_dir):
    """The series that a plain "Wash." citation names, by the citing year."""
    p = _part(spark, sf_dir)
    name = F.get(F.array(*map(F.lit, (" Wash. ", " Washington ", " Wash. 2d ", " Wash., "))), F.col("n") % 4)
    c = p.select("id", F.concat((F.col("n") % 6 + 1).cast("string"), name, F.col("n").cast("string")).alias("cite"), F.when(F.col("n") % 13 != 0, 1780 + F.col("n") % 130).alias("yr"))
    return c.select("id", "cite", series.cite_for_era(F.col("cite"), F.col("yr")).alias("era"), F.array_join(series.washington_series(F.col("cite")), "; ").alias("earlier"))


@query("""
with p as (select p_partkey as id, cast(p_partkey % 140 as int) as v, p_partkey % 5 as form from part)
select id, case when form = 0 and v >= 75 then v || ' U.S. App. D.C. ' || id when form = 1 and v < 75 then v || ' App. D.C. ' || id
                when form = 2 and v >= 27 then v || ' Fed. Cl. ' || id when form = 3 and v < 27 then v || ' Cl. Ct. ' || id else '' end as renamed
from p
""")
def renamed_series(spark, sf_dir):
    """Citations under the name that their volume was printed under."""
    name = F.get(F.array(*map(F.lit, ("App. D.C.", "U.S. App. D.C.", "Cl. Ct.", "Fed. Cl.", "F.2d"))), F.col("n") % 5)
    p = _part(spark, sf_dir).select("id", F.concat_ws(" ", (F.col("n") % 140).cast("string"), name, F.col("n").cast("string")).alias("cite"))
    return p.select("id", series.renamed_series(F.col("cite")).alias("renamed"))


_NOMINATIVE = ", ".join(f"('{n}', {o}, {k})" for n, o, k in series.NOMINATIVE)


@query(f"""
with nom as (select * from (values {_NOMINATIVE}) t(name, off, vols)),
p as (select p_partkey as id, cast(p_partkey % 120 + 1 as int) as v, p_partkey % 3 as form from part),
c as (select id, v || case form when 0 then ' U.S. ' when 1 then ' How. ' else '  F.2d ' end || id as cite,
             case form when 0 then v when 1 then case when v <= 24 then v + 41 end end as us, v, form from p)
select c.id, coalesce(c.us || ' U.S. ' || c.id || coalesce('; ' || string_agg((c.us - off) || ' ' || name || ' ' || c.id, '; ' order by off), ''), regexp_replace(any_value(c.cite), ' +', ' ', 'g')) as phrases,
       '(cites:' || c.id || ' OR cites:' || (c.id + 1) || ') AND ((cites:' || c.id || ' OR cites:' || (c.id + 1) || ') OR "' || replace(any_value(c.cite), '  ', ' ') || '")' as query
from c left join nom on c.us > off and c.us <= off + vols group by c.id, c.us
""")
def search_phrases(spark, sf_dir):
    """How citing opinions write a case, and the search for them."""
    name = F.get(F.array(*map(F.lit, (" U.S. ", " How. ", "  F.2d "))), F.col("n") % 3)
    p = _part(spark, sf_dir).select("id", F.concat((F.col("n") % 120 + 1).cast("string"), name, F.col("n").cast("string")).alias("cite"))
    graph = series.citing_query(F.array("id", F.col("id") + 1), F.array(F.col("cite"), F.lit(" a"), F.concat(F.lit('"'), F.col("cite"), F.lit('"'))))
    return p.select("id", F.array_join(series.search_phrases(F.col("cite")), "; ").alias("phrases"), graph.alias("query"))


@query(f"""
with {CITATIONS}
select reporter, replace(lower(reporter), ' ', '') as written, count(*) as n from citations group by reporter
""")
def written_keys(spark, sf_dir):
    """The older key of each spelling, marks kept."""
    return synth.citations(spark, sf_dir).groupBy("reporter").agg(F.count("*").alias("n")).select("reporter", series.written_key(F.col("reporter")).alias("written"), "n")


@query("""
select p_partkey as id, case p_partkey % 6 when 0 then p_size || ' Johns. ' || p_partkey when 1 then p_size || ' Wheat. ' || p_partkey when 2 then p_size || ' U.S. ' || p_partkey
       when 3 then p_size || ' Wall. ' || p_partkey when 4 then p_size || ' Massachusetts ' || p_partkey else p_size || ' Wheat. ' || p_partkey end as cite from part
""")
def clean_cites(spark, sf_dir):
    """Citations as opinions print them, reduced to "vol reporter page"."""
    forms = ("%d Johns. (N.Y.) %d", "%d  Wheat. [17 U. S.]\n%d", "%d U. S. (1 Cranch) %d", "%d Wall. (88 U. S.) -%d", "%d Massachusetts, %d", "%d Wheat. Rep. %d")
    p = _part(spark, sf_dir)
    written = F.coalesce(*[F.when(F.col("n") % 6 == k, F.format_string(f, "size", "n")) for k, f in enumerate(forms)])
    return p.select("id", series.clean_cite(written).alias("cite"))


@query("""
with starts as (select p_size as vol, cast(p_partkey + 1 as int) as page, cast(1930 + p_partkey % 20 as int) as yr from part where p_partkey % 3 = 0),
years as (select distinct p_size as vol, cast(1930 + p_size % 5 as int) as a, cast(1930 + p_size % 5 + p_size % 2 as int) as b from part),
q as (select p_partkey as id, p_size as vol, cast(p_partkey % 1000 + 1 as int) as page, cast(p_partkey % 1000 + 1 + p_partkey % 4 as int) as pin from part),
own as (select q.*, s.yr from q asof left join starts s on q.vol = s.vol and q.page >= s.page)
select id, case when pin = page then '{"page":' || page || ',"vol":' || own.vol || '}' else '{"page":' || page || ',"pin":' || pin || ',"vol":' || own.vol || '}' end as spec,
       own.vol || ' S.E.C. ' || page || case when pin = page then '' else ', ' || pin end || coalesce(' (' || coalesce(own.yr, case when a = b then a end) || ')', '') as label
from own left join years on own.vol = years.vol
""")
def sec_labels(spark, sf_dir):
    """Agency decisions: spec, and label with the year of the decision that holds
    the page, else of a volume of one year."""
    p = _part(spark, sf_dir)
    starts = p.where("n % 3 = 0").select(F.col("size").alias("vol"), (F.col("n") + 1).alias("start"), (1930 + F.col("n") % 20).alias("own"))
    years = p.select(F.col("size").alias("vol")).distinct().where(F.col("vol") % 2 == 0).select("vol", (1930 + F.col("vol") % 5).alias("only"))
    asked = p.select("id", F.col("size").alias("vol"), (F.col("n") % 1000 + 1).alias("page"), (F.col("n") % 1000 + 1 + F.col("n") % 4).alias("pin"))
    found = lookup.nearest(asked, starts, ["vol"], "page", "start").join(starts, ["vol", "start"], "left").join(years, "vol", "left")
    spec = series.sec_spec(F.col("vol"), F.col("page"), F.col("pin"))
    return found.select("id", spec.alias("spec"), series.sec_label(spec, F.coalesce("own", "only")).alias("label"))


@query("""
select p_partkey as id, case p_partkey % 4 when 0 then 'globe ' || p_size || '.' || case when p_partkey % 3 = 0 then 1 else p_partkey % 3 end || case when p_partkey % 5 = 0 then 'a' else '' end
         when 1 then 'annals ' || p_partkey when 2 then 'regdeb ' || p_partkey || case when p_partkey % 5 = 0 then 'a' else '' end else '' end as key,
       case p_partkey % 5 when 0 then 'S' when 1 then 'H' when 2 then 'S' when 3 then 'H' else '' end as chamber
from part
""")
def debates_keys(spark, sf_dir):
    """Keys of early debates, and the chamber that a parenthesis names."""
    p = _part(spark, sf_dir)
    kind = F.get(F.array(*map(F.lit, ("globe", "annals", "regdeb", "other"))), F.col("n") % 4)
    said = F.get(F.array(*map(F.lit, ("(remarks of Sen. Hatch)", "(House)", "as Senator Lodge (Rep. X) said", "Mr. Speaker Reed; Sen. Low", "no one"))), F.col("n") % 5)
    session = F.when(F.col("n") % 3 != 0, F.col("n") % 3)
    return p.select("id", series.debates_key(kind, F.col("size"), session, F.col("n"), F.col("n") % 5 == 0).alias("key"), series.chamber_hint(said).alias("chamber"))


@query("""
select p_partkey as id, case p_partkey % 6 when 0 then p_size || ' U.S.C. § ' || p_partkey || '(a)(1)' when 1 then p_size || ' C.F.R. § 240.' || p_partkey when 2 then 'Fed. R. Civ. P. ' || p_partkey || '(b)'
       when 3 then 'U.S. Const. amend. XIV, § ' || p_size when 4 then 'U.S. Const. pmbl.' else 'U.S. Const. art. III' end as label from part
""")
def spec_labels(spark, sf_dir):
    """Specs of statutes, regulations, rules and provisions as printed."""
    p = _part(spark, sf_dir)
    kind = F.get(F.array(*map(F.lit, ("usc", "cfr", "rule", "const", "const", "const"))), F.col("n") % 6)
    specs = (F.format_string("%d:%d:a,1", "size", "n"), F.format_string("%d:240.%d:", "size", "n"), F.format_string("frcp:%d:b", "n"), F.format_string("amend:14:%d", "size"), F.lit("pmbl:0:"), F.lit("art:3:"))
    return p.select("id", series.spec_label(kind, F.get(F.array(*specs), F.col("n") % 6)).alias("label"))


@query("""
select p_partkey as id, p_partkey % 5 in (0, 1, 3) as heading from part
""")
def headings(spark, sf_dir):
    """Lines that head a part of a brief, told from prose."""
    lines = F.array(F.lit("TABLE OF AUTHORITIES"), F.lit("Federal  Cases"), F.concat(F.lit("The court held "), "p_name"), F.lit("ÉTAT 12"), F.lit("A 1"))
    return _part(spark, sf_dir).select("id", series.is_heading(F.get(lines, F.col("n") % 5)).alias("heading"))


@query("""
select p_partkey as id, case p_partkey % 3
  when 0 then ' [hereinafter Act] (en banc) (Scalia, J., dissenting) (footnote omitted) (quoting Roe) (holding that it is)'
  when 1 then ' (plurality opinion) (per curiam) (emphasis added) (internal quotation marks and citations omitted) (cleaned up) (citing Doe)'
  else ' (opinion of Black, J.) (alterations in original) (first emphasis added) (https://x.y/' || p_partkey || ') (Tester is omitted)' end as joined from part
""")
def parenthetical_order(spark, sf_dir):
    """Parentheticals in the rule's order, repeats and blanks gone."""
    sets = (
        ("holding that  it is", "quoting Roe", "en banc", "", "Scalia, J., dissenting", "[hereinafter Act]", "footnote omitted", "En Banc"),
        ("citing Doe", "cleaned up", "emphasis added", "per curiam", "internal quotation marks and citations omitted", "plurality opinion", "citing doe"),
    )
    p = _part(spark, sf_dir)
    third = F.array(F.concat(F.lit("https://x.y/"), F.col("n").cast("string")), F.lit("Tester is omitted"), F.lit("first emphasis added"), F.lit("opinion of Black, J."), F.lit("alterations in original"))
    texts = F.when(F.col("n") % 3 == 0, F.array(*map(F.lit, sets[0]))).when(F.col("n") % 3 == 1, F.array(*map(F.lit, sets[1]))).otherwise(third)
    return p.select("id", parentheticals.joined(texts).alias("joined"))


# ---- extraction -------------------------------------------------------------

#: Sentences, by number, as a format of (part's number, its size).
SENTENCES = (
    "Compare 29 U.S.C. §§ %1$d, 1512(b)(2), and 9%1$d with 17 C.F.R. §§ 240.%1$d, 240.11(a); 18 U.S.C. § 2, 1%1$d.",
    "See Fed. R. Civ. P. %2$d(b)(6); Rule %2$d(a) of the Federal Rules of Evidence; Federal Rule of Appellate Procedure 4.",
    "U.S. Const. art. I, § %2$d; U.S. Const. amend. XIV, § 1; then U.S. Const. art. I, § %2$d. The First Amendment.",
    "%2$d Stat. 1%1$d. Id. at 1%1$d. But 63 Fed. Reg. 1%1$d; cf. 12 Minn. Stat. § 3.",
    "Smith v. Jones, No. 05-cv-1%1$d, 2008 WL 46%1$d, at *3 (D.N.J. Jan. 3, 2008). Doe, 2009 WL 77%1$d (D.N.J. 2009).",
    "See %2$d S.E.C. 893, 915, 920; %2$d S.E.C. at 917. Id. at 918. But 1941 SEC LEXIS 12.",
    "Doe v. Roe, Case No. 2,976. Id. 2,717. Then 9 U.S. 1%1$d and Id. 450.",
    "Smith v. Jones, No. 19-%1$d (U.S. June 24, 2022), and No. 20-5 (on file).",
    "Roe, 410 U.S. 113, 152; 42 U.S.C. § %1$d. Id. at 160. Poe, 536 U.S. 101, 122 S. Ct. 2061. Id. at 115. Id. at 2070. Id. at 9999.",
    "Roe, 410 U.S. 113 (quoting Poe, 536 U.S. 101). Id. at 120. Tr. 5. Id. at 121. Foo, 9 U.S. at 5. Id. at 130.",
)


@query("""
with p as (select p_partkey as id, p_partkey as n, p_size as s, p_partkey % 10 as form from part),
v as (
  select id, form, unnest(case form
    when 0 then ['usc|29:' || n || ':', 'usc|29:1512:b,2', 'usc|29:9' || n || ':', 'cfr|17:240.' || n || ':', 'cfr|17:240.11:a', 'usc|18:2:']
    when 1 then ['rule|frcp:' || s || ':b,6', 'rule|fre:' || s || ':a', 'rule|frap:4:']
    when 2 then ['const|art:1:' || s, 'const|amend:14:1']
    when 3 then ['statpdf|' || s || ' Stat. 1' || n, 'id|' || s || ' Stat. 1' || n, 'frpdf|63 Fed. Reg. ' || format('{:,}', cast('1' || n as bigint))]
    when 4 then ['recap|{"cite":"2008 WL 46' || n || '","court":"D.N.J.","date":"Jan. 3, 2008","docket":"05-cv-1' || n || '"}']
    when 5 then ['sec|{"page":893,"pin":915,"vol":' || s || '}', 'sec|{"page":893,"pin":920,"vol":' || s || '}', 'sec|{"page":893,"pin":917,"vol":' || s || '}', 'id|{"page":893,"pin":918,"vol":' || s || '}']
    when 6 then ['fedcas|2976', 'fedcas|2717', 'cite|9 U.S. 1' || n]
    when 7 then ['scotus|19-' || n]
    when 8 then ['cite|410 U.S. 113@152', 'usc|42:' || n || ':', 'id|410 U.S. 113@160', 'cite|536 U.S. 101', 'cite|122 S. Ct. 2061', 'id|536 U.S. 101@115', 'id|122 S. Ct. 2061@2070']
    else ['cite|410 U.S. 113', 'cite|536 U.S. 101', 'id|410 U.S. 113@120'] end) as x,
  generate_subscripts(case form when 0 then [1,2,3,4,5,6] when 1 then [1,2,3] when 2 then [1,2] when 3 then [1,2,3] when 4 then [1] when 5 then [1,2,3,4] when 6 then [1,2,3] when 7 then [1] when 8 then [1,2,3,4,5,6,7] else [1,2,3] end, 1) as k
  from p
)
select id, cast(k as int) as k, split_part(x, '|', 1) as kind, split_part(x, '|', 2) as value from v
""")
def forms_extract(spark, sf_dir):
    """Statute lists, rules, provisions, serials, unreported opinions, agency
    decisions, numbered cases, dockets and back-references found in prose."""
    p = _part(spark, sf_dir)
    prose = F.coalesce(*[F.when(F.col("n") % 10 == k, F.format_string(s, F.col("n"), F.col("size"))) for k, s in enumerate(SENTENCES)])
    found = extract.links(p.select(F.col("id").alias("doc_id"), prose.alias("text")))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    return found.select(F.col("doc_id").alias("id"), k.alias("k"), "kind", "value")


@query(f"""
with {CITATIONS}
select scholar_id, vol, canon as reporter, string_agg(distinct page, ',' order by page) as pages from citations group by 1, 2, 3
""")
def first_pages(spark, sf_dir):
    """First pages cited of each volume and reporter, sorted."""
    c = synth.citations(spark, sf_dir).withColumn("reporter", cites.canonical_reporter(F.col("reporter")))
    pages = F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",")
    return c.groupBy("scholar_id", "vol", "reporter").agg(pages.alias("pages"))


# ---- rankings ---------------------------------------------------------------


@query("""
with c as (
  select l_orderkey as cite_id, l_linenumber as seq, l_partkey % 3 as k, l_suppkey % 4 as y, l_partkey as p, l_suppkey as u from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)
), s as (select *, case k when 0 then 1.0 when 1 then 0.5 else 0.0 end as score, y = 0 as hit from c)
select cite_id, cast(min(seq) as int) as seq, cast(max(score) as double) as score
from (select *, row_number() over (partition by cite_id order by score desc, hit desc, seq, p, u) as r from s) where score > 0 and r = 1 group by cite_id
""")
def pick_cited(spark, sf_dir):
    """Of the cases on one page the one that the citing name and year mean."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    title = F.get(F.array(*map(F.lit, ("ROE, Inc. v. The Wade Company", "Roe v. Smith", "State v. Poe"))), (F.col("l_partkey") % 3).cast("int"))
    rows = line.select(
        F.col("l_orderkey").alias("cite_id"), F.col("l_linenumber").alias("seq"), title.alias("title"), F.lit("Roe v. Wade").alias("name"), F.lit("1973").alias("year"),
        F.when(F.col("l_suppkey") % 4 == 0, "1973").otherwise("1980").alias("title_year"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )
    return ranking.pick_named(rows, "cite_id", "name", "year", "title", "title_year", "at").select("cite_id", "seq", "score")


@query("""
with h as (select n_nationkey as request, o_orderkey as hit, o_orderkey % 4 as form from nation, orders where o_orderkey % 25 = n_nationkey),
w as (select *, row_number() over (partition by request order by hit) as n from h qualify n <= 40),
s as (select *, case form when 0 then 1.0 when 1 then 0.5 when 2 then 1.0 else 0.0 end as score from w)
select request, hit, cast(score as double) as score, cast(row_number() over (partition by request order by score desc, n) as int) as rank from s where score >= 0.6 qualify rank <= 10
""")
def rerank_names(spark, sf_dir):
    """Four times as many hits as wanted, ranked again by their names."""
    title = F.get(F.array(*map(F.lit, ("Poe v. Roe Corp.", "Poe v. Doe", "Roe v. Poe", "In re Moe"))), (F.col("o_orderkey") % 4).cast("int"))
    hits = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 25).cast("int").alias("request"), F.col("o_orderkey").alias("hit"), title.alias("title"), F.lit("Poe v. Roe").alias("query"))
    return ranking.rerank(hits, "request", ["hit"], "query", "title", 10, 0.6).select("request", "hit", "score", "rank")


@query("""
select l_partkey as case_id, l_orderkey, l_linenumber, cast(row_number() over (partition by l_partkey order by
   case l_suppkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else 9 end,
   case when l_suppkey % 7 = 0 then '9999' else strftime(l_shipdate, '%Y-%m-%d') end, l_orderkey, l_linenumber, l_quantity, l_suppkey) as int) as place
from lineitem qualify place <= 3
""")
def relation_order(spark, sf_dir):
    """Related cases by relation, then by date, those without one last."""
    line = table(spark, sf_dir, "lineitem")
    relation = F.get(F.array(*map(F.lit, (*ranking.RELATIONS, "other"))), (F.col("l_suppkey") % 5).cast("int"))
    rows = line.select(
        F.col("l_partkey").alias("case_id"), "l_orderkey", "l_linenumber", relation.alias("relation"),
        F.when(F.col("l_suppkey") % 7 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("filed"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey").alias("seq"),
    )
    return ranking.by_relation(rows, "case_id", "relation", "filed", "seq").where("place <= 3").select("case_id", "l_orderkey", "l_linenumber", "place")


@query("""
select p_partkey as id, cast(case p_partkey % 6 when 0 then 2 when 1 then 1 when 2 then 0 when 3 then 0 when 4 then 2 else 0 end as int) as rank from part
""")
def archive_rank(spark, sf_dir):
    """How surely an archive's title is the report that is wanted."""
    titles = ("Report Together with Additional Views, House Report No. 94-%1$d", "H. Rept. 94-%1$d", "H.R. 22; An Act ... House Report No. 94-%1$d", "Senate Report No. 94-%1$d", "Report / 94th Congress, House of Representatives ; no. 94-%1$d", "House Report No. 94-%1$d9")
    p = _part(spark, sf_dir)
    title = F.coalesce(*[F.when(F.col("n") % 6 == k, F.format_string(t, "n")) for k, t in enumerate(titles)])
    return p.select("id", ranking.report_rank(title, F.lit(94), F.col("n"), F.lit("h")).alias("rank"))


@query("""
select l_orderkey as cite_id, count(distinct case l_suppkey % 3 when 0 then 1 else l_suppkey % 3 end) > 1 as several from lineitem group by 1
""")
def several_cases(spark, sf_dir):
    """Do the results that bear a citation name more than one case?"""
    title = F.get(F.array(*map(F.lit, ("The Roe v. Wade", "Roe, Inc. v. WADE", "Doe v. Bolton"))), (F.col("l_suppkey") % 3).cast("int"))
    return ranking.several_cases(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cite_id"), title.alias("title")), "cite_id", "title")


@query("""
with d as (select l_orderkey as docket, l_linenumber as seq, l_suppkey % 7 as k, l_returnflag as stage from lineitem),
o as (select *, row_number() over (partition by docket, k order by seq, stage) as r from d where k <> 6),
f as (select * from o where r = 1)
select docket, 'www.x.gov/a b/' || k || '.pdf' || case when k = 5 then '?v=A' else '' end as url_key,
       cast(row_number() over (partition by docket order by case stage when 'A' then 0 when 'N' then 1 else 2 end, seq, stage, k) as int) as place from f
""")
def docket_documents(spark, sf_dir):
    """A docket's documents, each address once, by stage."""
    spelled = F.when(F.col("l_linenumber") % 2 == 0, F.lit("https://WWW.x.gov/A%20b/")).otherwise("http://user@www.x.gov:80/a b/")
    url = F.when(F.col("l_suppkey") % 7 == 6, "").otherwise(F.concat(spelled, (F.col("l_suppkey") % 7).cast("string"), F.lit(".PDF"), F.when(F.col("l_suppkey") % 7 == 5, "?v=A#x").when(F.col("l_suppkey") % 7 < 3, "/").otherwise("")))
    stage = F.create_map(*[F.lit(x) for x in ("A", "cert", "N", "merits", "R", "other")])
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("docket"), url.alias("url"), F.try_element_at(stage, F.col("l_returnflag")).alias("stage"), F.struct("l_linenumber", "l_returnflag", F.col("l_suppkey") % 7).alias("seq")
    )
    return ranking.distinct_documents(rows, "docket", "url", "stage", "seq").select("docket", "url_key", "place")


@query("""
select docket, string_agg(d || ' ' || e, '; ' order by d, e) as events from (
  select distinct l_orderkey as docket, strftime(l_shipdate, '%Y-%m') as d, case l_suppkey % 3 when 0 then 'Argued' when 1 then 'Decided' else 'Filed' end as e from lineitem
) group by docket
""")
def docket_events(spark, sf_dir):
    """A docket's events, each date and kind once, in order."""
    kind = F.get(F.array(*map(F.lit, ("Argued", "Decided", "Filed"))), (F.col("l_suppkey") % 3).cast("int"))
    event = F.struct(F.date_format("l_shipdate", "yyyy-MM").alias("d"), kind.alias("e"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("docket")).agg(F.array_sort(F.collect_set(event)).alias("x"))
    return rows.select("docket", F.array_join(F.transform("x", lambda x: F.concat_ws(" ", x["d"], x["e"])), "; ").alias("events"))


@query("""
select l_orderkey as brief, count(*) filter (l_returnflag = 'A') as saved, count(*) filter (l_returnflag <> 'A') as missing, count(*) as total from lineitem group by 1
""")
def compile_summary(spark, sf_dir):
    """Authorities of a brief that were saved and that are missing."""
    ok = F.col("l_returnflag") == "A"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("brief")).agg(F.count_if(ok).alias("saved"), F.count_if(~ok).alias("missing"), F.count("*").alias("total"))


@query("""
with c as (select l_suppkey as section, l_quantity as head, count(*) as n, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by 1, 2)
select section, head, n from c qualify row_number() over (partition by section order by n desc, first) = 1
""")
def head_modes(spark, sf_dir):
    """The most frequent head of a section, of equals the first seen."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("section"), F.col("l_quantity").alias("head"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return ranking.modes(rows, ["section"], "head", "seq")


@query("""
with b as (select l_suppkey as page, l_orderkey * 10 + l_linenumber as seq, cast(l_quantity as int) as x0, cast(500 + l_linenumber as int) as x1, l_quantity as h, l_returnflag <> 'A' as body from lineitem),
x as (select page, x0, count(*) as n, min(seq) as f from b where body group by 1, 2 qualify row_number() over (partition by page order by n desc, f) = 1),
y as (select page, x1, count(*) as n, min(seq) as f from b where body group by 1, 2 qualify row_number() over (partition by page order by n desc, f) = 1),
m as (select page, median(h) as h from b where body group by 1)
select p.page, cast(coalesce(x0, 0) as double) as left, cast(coalesce(x1, 612) as double) as right, cast(coalesce(h, 10) as double) as height
from (select distinct page from b) p left join x using (page) left join y using (page) left join m using (page)
""")
def page_metrics(spark, sf_dir):
    """Modal margins and median height of full lines."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_quantity") + 0.25).alias("x0"),
        (500.25 + F.col("l_linenumber")).alias("x1"), F.col("l_quantity").alias("height"), F.when(F.col("l_returnflag") != "A", F.repeat(F.lit("x"), 41)).otherwise("short").alias("text"),
    )
    return ranking.body_metrics(rows, "page", "seq")


@query("""
with pg as (select p_brand as doc, cast(p_partkey * 10 as int) as off, case when p_partkey % 11 = 0 then null else cast(p_size as int) end as page from part),
k as (select *, lead(off) over (partition by doc order by off) as until from pg where page is not null),
r as (select p_brand as doc, cast(p_partkey * 10 as int) as lo, cast(p_partkey * 10 + (p_partkey % 90) * 60 as int) as hi from part),
t as (select r.doc, r.lo, r.hi, k.off, k.page, lag(k.page) over (partition by r.doc, r.lo, r.hi order by k.off) as before from r join k on r.doc = k.doc and k.off < greatest(hi, lo + 1) and coalesce(k.until > lo, true))
select r.doc, r.lo, r.hi, coalesce(string_agg(t.page, ',' order by t.off) filter (t.page is not null and t.before is distinct from t.page), '') as pages
from r left join t using (doc, lo, hi) group by 1, 2, 3
""")
def pages_of_ranges(spark, sf_dir):
    """The printed pages that ranges of a text touch."""
    part = table(spark, sf_dir, "part")
    doc, off = F.col("p_brand").alias("doc"), (F.col("p_partkey") * 10).cast("int")
    pages = part.select(doc, off.alias("offset"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("int")).alias("page"))
    ranges = part.select(doc, off.alias("lo"), (off + (F.col("p_partkey") % 90) * 60).cast("int").alias("hi"))
    return ranking.pages_of_ranges(ranges, pages, "doc").select("doc", "lo", "hi", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("""
with recursive e as (select user_id % 20 as source, event_id, epoch(ts) as t, row_number() over (partition by user_id % 20 order by epoch(ts), event_id) as n from events),
w as (
  select source, event_id, n, t as sent from e where n = 1
  union all
  select e.source, e.event_id, e.n, greatest(e.t, w.sent + 3) from w join e on e.source = w.source and e.n = w.n + 1
)
select source, event_id, round(sent, 3) as sent from w
""")
def request_spacing(spark, sf_dir):
    """When requests go if a source's are three seconds apart at least."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("source"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = ranking.spaced(e.withColumn("at", F.col("us") / 1e6), "source", "at", "event_id", 3.0)
    return rows.select("source", "event_id", F.round("sent", 3).alias("sent"))


@query("""
with e as (select user_id % 20 as source, event_id, cast(floor(epoch(ts)) as bigint) as t, event_type = 'click' as failed from events)
select source, event_id, coalesce(t < (select max(f.t) from e f where f.source = e.source and f.failed and f.t < e.t) + 600, false) as blocked from e
""")
def resting_sources(spark, sf_dir):
    """Requests that come while their source rests after a failure."""
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("source"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "click").alias("failed")
    )
    return ranking.resting(e, "source", "at", "failed", 600).select("source", "event_id", "blocked")


@query("""
with c as (select p_partkey as key, p_size as saved, 'v' || p_partkey as value from part where p_partkey % 3 <> 0),
q as (select p_partkey as key, p_partkey % 4 <> 0 as ok, 'n' || p_partkey as live from part)
select q.key, case when 60 - saved < 30 then 'cache' when ok then 'source' when value is not null then 'stale' else 'none' end as source,
       case when 60 - saved < 30 then value when ok then live else value end as answer from q left join c using (key)
""")
def cached_answers(spark, sf_dir):
    """Fresh entries from the cache, stale ones where the source fails."""
    p = _part(spark, sf_dir)
    cache = p.where("n % 3 <> 0").select(F.col("id").alias("key"), F.col("size").alias("saved_at"), F.concat(F.lit("v"), F.col("n").cast("string")).alias("value"))
    asked = p.select(F.col("id").alias("key"), F.lit(60).alias("now"), (F.col("n") % 4 != 0).alias("ok"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("live"))
    return ranking.cached(asked, cache, "key", "now", "ok", 30).select("key", "source", "answer")


@query("""
with t as (select l_suppkey as docket, count(*) as total from lineitem group by 1)
select docket, l_orderkey, l_linenumber, total from (select l_suppkey as docket, l_orderkey, l_linenumber, l_shipdate, l_partkey from lineitem
  qualify row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey, l_linenumber, l_partkey) <= 5) join t using (docket)
""")
def docket_newest(spark, sf_dir):
    """The newest five entries of a docket, and how many it has."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("docket"), "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return ranking.newest(rows, "docket", [F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey"], 5).select("docket", "l_orderkey", "l_linenumber", "total")


_WORDS = """
w as (select doc_id as doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as word, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), 1) - 1 as pos from documents),
src as (select * from w), pg as (select doc, pos - 20 as pos, word from w where pos >= 20 and pos < 60)"""


@query(f"""
with {_WORDS},
s3 as (select doc, pos, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as gram from src window o as (partition by doc order by pos)),
p3 as (select doc, pos, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as gram from pg window o as (partition by doc order by pos)),
every as (
  select p.doc, s.pos - p.pos as offset, 6 as w from p3 p join (select *, count(*) over (partition by doc, gram) as m from s3 where gram is not null) s on p.doc = s.doc and p.gram = s.gram and s.m <= 8 where p.gram is not null
  union all
  select p.doc, s.pos - p.pos, 1 from pg p join (select *, count(*) over (partition by doc, word) as m from src) s on p.doc = s.doc and p.word = s.word and s.m <= 8
)
select doc, cast("offset" as int) as "offset", cast(sum(w) as bigint) as votes, cast(row_number() over (partition by doc order by sum(w) desc, "offset") as int) as rank
from every group by doc, "offset" qualify rank <= 12
""")
def offset_votes(spark, sf_dir):
    """By how many words a page lies behind the start of its source."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    src = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(words).alias("pos", "word"))
    page = src.where("pos >= 20 and pos < 60").withColumn("pos", F.col("pos") - 20)
    return ranking.offset_votes(src, page, "doc").select("doc", "offset", "votes", "rank")


@query("""
with idx as (select p_partkey as num, lower(p_name) as name from part),
q as (select n_nationkey as request, (select max(p_name) from part where p_partkey = n_nationkey * 3) as name from nation)
select q.request, idx.num, cast(1.0 as double) as score, cast(row_number() over (partition by request order by idx.num) as int) as rank
from q join idx on lower(q.name) = idx.name qualify rank <= 3
""")
def case_search(spark, sf_dir):
    """Reported cases whose name holds every distinctive word of a query."""
    part = table(spark, sf_dir, "part")
    index = part.select(F.col("p_partkey").alias("num"), F.col("p_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request"), (F.col("n_nationkey") * 3).alias("num"))
    return ranking.case_search(index, nation.join(index, "num").select("request", F.upper("name").alias("query")), 3)


# ---- lookups and counts -----------------------------------------------------


@query(f"""
with {OPINIONS} select court, count(*) as n, count(distinct year) as years from opinions group by court
""")
def store_counts(spark, sf_dir):
    """Records held, by court."""
    return synth.opinions(spark, sf_dir).groupBy("court").agg(F.count("*").alias("n"), F.count_distinct("year").alias("years"))


@query(f"""
with {OPINIONS} select scholar_id, court, name from opinions where court in ('BUILDING', 'MACHINERY') and cast(scholar_id as bigint) % 7 = 0
""")
def court_semijoin(spark, sf_dir):
    """Results of the selected courts only."""
    o = synth.opinions(spark, sf_dir).where(F.col("scholar_id").cast("long") % 7 == 0)
    chosen = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("court")).where("court in ('BUILDING', 'MACHINERY')").distinct()
    return o.join(F.broadcast(chosen), "court", "left_semi").select("scholar_id", "court", "name")


@query(f"""
with {OPINIONS}, asked as (select p_partkey as request, case p_partkey % 3 when 0 then cast(p_partkey as varchar) else 'x?case=' || p_partkey || '&q=1' end as k, p_partkey from part)
select request, scholar_id, name from asked join opinions on scholar_id = cast(p_partkey as varchar)
""")
def point_lookup(spark, sf_dir):
    """Records by id, or by an address that carries it."""
    part = _part(spark, sf_dir)
    asked = part.select(F.col("id").alias("request"), F.when(F.col("n") % 3 == 0, F.col("n").cast("string")).otherwise(F.concat(F.lit("x?case="), F.col("n").cast("string"), F.lit("&q=1"))).alias("k"))
    key = F.when(F.col("k").rlike("^[0-9]{1,20}$"), F.col("k")).otherwise(F.nullif(F.regexp_extract("k", r"[?&]case=([0-9]{1,20})", 1), F.lit("")))
    return asked.withColumn("scholar_id", key).join(synth.opinions(spark, sf_dir), "scholar_id").select("request", "scholar_id", "name")


@query("""
with idx as (select p_size as vol, cast(p_partkey // 3 + 1 as int) as page, p_partkey as num from part),
q as (select distinct cast(l_suppkey % 50 + 1 as int) as vol, cast(l_partkey % 700 as int) as page from lineitem),
found as (select q.vol, q.page, s.page as start from q asof join (select distinct vol, page from idx) s on q.vol = s.vol and q.page >= s.page)
select found.vol, found.page, found.start, idx.num from found join idx on idx.vol = found.vol and idx.page = found.start
""")
def reports_at_page(spark, sf_dir):
    """Every report that begins at a page, else at the nearest one before it."""
    part = table(spark, sf_dir, "part")
    index = part.select(F.col("p_size").alias("vol"), (F.floor(F.col("p_partkey") / 3) + 1).cast("int").alias("start"), F.col("p_partkey").alias("num"))
    line = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50 + 1).cast("int").alias("vol"), (F.col("l_partkey") % 700).cast("int").alias("page")).distinct()
    return lookup.nearest(line, index, ["vol"], "page", "start", "inner").join(index, ["vol", "start"]).select("vol", "page", "start", "num")


@query("""
with idx as (select case when p_partkey % 2 = 0 then 'ves' else 'vesjr' end as rep, p_size as vol, p_partkey as page, p_partkey as num from part),
q as (select p_partkey as request, p_size as vol, p_partkey as page, p_partkey % 3 as form from part)
select request, num from q join idx on q.vol = idx.vol and q.page = idx.page where form = 0 or (form = 1 and rep = 'ves') or (form = 2 and rep = 'vesjr')
""")
def alias_lookup(spark, sf_dir):
    """A reporter's name that several series share is looked up in all of them."""
    p = _part(spark, sf_dir)
    index = p.select(F.when(F.col("n") % 2 == 0, "ves").otherwise("vesjr").alias("rep"), F.col("size").alias("vol"), F.col("n").alias("page"), F.col("id").alias("num"))
    series_of = F.create_map(F.lit("Ves."), F.array(F.lit("ves"), F.lit("vesjr")), F.lit("Ves. Sen."), F.array(F.lit("ves")), F.lit("Ves. Jun."), F.array(F.lit("vesjr")))
    written = F.get(F.array(*map(F.lit, ("Ves.", "Ves. Sen.", "Ves. Jun."))), F.col("n") % 3)
    asked = p.select(F.col("id").alias("request"), F.col("size").alias("vol"), F.col("n").alias("page"), F.explode(F.try_element_at(series_of, written)).alias("rep"))
    return asked.join(index, ["rep", "vol", "page"]).select("request", "num").distinct()


@query(r"""
with d as (select doc_id, coalesce(text, '') || '😀x𝒜y' as t from documents)
select doc_id, length(t) as points, length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')) as units from d
""")
def utf16_offsets(spark, sf_dir):
    """Lengths in code points and in UTF-16 units, which script readers count."""
    t = F.concat(F.coalesce("text", F.lit("")), F.lit("😀x𝒜y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("points"), text.utf16_length(t).alias("units"))


@query("""
select p_partkey as id, case when p_partkey % 3 = 0 then '{"q":"Roe"}' when p_partkey % 3 = 1 then '{"q":"Roe","court":"scotus ca9","filed_after":"' || (1950 + p_size) || '-01-01"}'
       else '{"q":"Roe","filed_before":"' || (1950 + p_size) || '-12-31","order_by":"dateFiled desc"}' end as params from part
""")
def search_params(spark, sf_dir):
    """A search's parameters without those that aren't set."""
    n, year = F.col("n") % 3, (1950 + F.col("size")).cast("string")
    fields = {
        "q": F.lit("Roe"),
        "court": F.when(n == 1, F.array_join(F.array_sort(F.array(F.lit("scotus"), F.lit("ca9")), lambda a, b: F.when(a > b, -1).otherwise(1)), " ")),
        "filed_after": F.when(n == 1, F.concat(year, F.lit("-01-01"))),
        "filed_before": F.when(n == 2, F.concat(year, F.lit("-12-31"))),
        "order_by": F.when(n == 2, "dateFiled desc"),
    }
    return _part(spark, sf_dir).select("id", F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("params"))


@query("""
select p_partkey as id, p_partkey % 7 in (0, 1) as plausible, p_partkey % 2 = 0 as term from part
""")
def uncertain_years(spark, sf_dir):
    """Years that may be a term's: can the found one be the decision's, and does
    the front matter head the case with a term that ran into the next year?"""
    p = _part(spark, sf_dir)
    given = F.lit(1855)
    head = F.when(F.col("n") % 2 == 0, "DECEMBER TERM, 1855.").otherwise("January Term, 1855")
    return p.select("id", dates.plausible_year(given, given + F.col("n") % 7).alias("plausible"), dates.late_term(head, given).alias("term"))


# ---- names and courts -------------------------------------------------------


@query("""
select p_partkey as id, case p_partkey % 6 when 0 then 'Part' || p_partkey || ' Ins. Co. v. Ohio' when 1 then 'In re Part' || p_partkey || ' Corp.' when 2 then 'SEC v. Part' || p_partkey || ' Bros. Co.'
       when 3 then 'United States ex rel. Part' || p_partkey || ' v. Am. R.R. Ass''n' when 4 then 'People v. Part' || p_partkey || ' Univs.' else 'Part' || p_partkey || ' v. National' end as short from part
""")
def short_names(spark, sf_dir):
    """Captions as citations print them."""
    forms = (
        "The Part%d Insurance  Company, et al. v. State of Ohio", "In the Matter of Part%d Corporation", "Securities and Exchange Commission v. Part%d Brothers Company, Inc.",
        "United States on the relation of Part%d, Petitioner v. American Railroad Association", "The People of the State of New York v. Part%d Universities; Beta LLC", "Part%d, Plaintiff-Appellee v. National",
    )
    p = _part(spark, sf_dir)
    name = F.coalesce(*[F.when(F.col("n") % 6 == k, F.format_string(f, "n")) for k, f in enumerate(forms)])
    once = abbrev.short_name(name, F.lit("new york"))
    return p.select("id", once.alias("name")).select("id", abbrev.short_name(F.col("name"), F.lit("new york")).alias("short"))


@query("""
with w as (select * from (values ('university', 'Univ.'), ('company', 'Co.'), ('academy', 'Acad.'), ('business', 'Bus.'), ('exchange', 'Exch.'), ('association', 'Ass''n'), ('board', 'Bd.')) t(word, short))
select case when word like '%y' then substr(word, 1, length(word) - 1) || 'ies' when word like '%s' or word like '%x' or word like '%ch' then word || 'es' else word || 's' end as plural,
       case when short like '%s.' then short when short like '%.' then substr(short, 1, length(short) - 1) || 's.' else short || 's' end as short from w
""")
def word_plurals(spark, sf_dir):
    """Plurals of words and of their abbreviations, by rule."""
    table_ = abbrev.word_map()
    wanted = [abbrev.plural(w, abbrev.WORDS[w])[0] for w in ("university", "company", "academy", "business", "exchange", "association", "board")]
    return spark.createDataFrame([(w, table_[w]) for w in wanted], "plural string, short string")


@query("""
select p_partkey as id, case p_partkey % 8 when 0 then 'M.D.N.C.' when 1 then 'Bankr. S.D. Tex.' when 2 then 'E.D. Pa.' when 3 then 'C.C.S.D.N.Y.' when 4 then 'S.D. W. Va.' when 7 then 'D. Mass.' else '' end as trial,
       case p_partkey % 8 when 6 then 'ca6' else '' end as circuit from part
""")
def court_forms(spark, sf_dir):
    """Federal trial courts in short form, and circuits by their court lines."""
    lines = (
        "United States District Court, M.D. North Carolina, Greensboro Division", "United States Bankruptcy Court, S.D. Texas", "District Court, E. D.  Pennsylvania",
        "Circuit Court, S. D. New York", "U.S. District Court for the Southern District of West Virginia", "Circuit Court for Baltimore County, Maryland",
        "United States Court of Appeals, Sixth Circuit.", "District Court, D. Massachusetts",
    )
    line = F.get(F.array(*map(F.lit, lines)), F.col("n") % 8)
    return _part(spark, sf_dir).select("id", courts.trial_court(line).alias("trial"), courts.circuit_id(line).alias("circuit"))


@query("""
select p_partkey as id, case p_partkey % 5 when 0 then 'EASTERBROOK|BAUER|POSNER' when 1 then 'CLARK|HINCKS|LUMBARD|SMITH' when 2 then '' when 3 then 'WOOD|KANNE' else '' end as judges,
       p_partkey % 5 in (1, 3, 4) as en_banc from part
""")
def bench_lines(spark, sf_dir):
    """The judges of a bench, and whether the whole court sat."""
    lines = (
        "Before EASTERBROOK, Chief Judge, and BAUER and POSNER, Circuit Judges.", "*292 Before CLARK, Chief Judge, and HINCKS, LUMBARD, and SMITH, Circuit Judges.",
        "The panel denied rehearing en banc.", "Present: WOOD and KANNE, Circuit Judges, sitting en banc.", "ON REHEARING EN BANC",
    )
    line = F.get(F.array(*map(F.lit, lines)), F.col("n") % 5)
    return _part(spark, sf_dir).select("id", F.array_join(courts.bench_names(line), "|").alias("judges"), courts.en_banc(F.array(line), F.lit(True)).alias("en_banc"))


@query("""
select p_partkey as id, p_partkey % 7 in (0, 1, 3) as loose, p_partkey % 7 in (0, 1) as strict from part
""")
def caption_relation(spark, sf_dir):
    """Do two captions name one case, by one side or by both?"""
    pairs = (
        ("State v. Glover", "Kansas v. Glover"), ("Smith v. Acme Corp.", "Acme Corporation, Appellant v. Smithson"), ("People v. Sanchez", "People v. Lopez"),
        ("Roe v. Wade", "Roe v. Bolton"), ("United States v. Jones", "Commonwealth v. Smith"), ("In re Gault", "Doe v. Roe"), ("", "Roe v. Wade"),
    )
    left, right = (F.get(F.array(*[F.lit(p[k]) for p in pairs]), F.col("n") % 7) for k in range(2))
    return _part(spark, sf_dir).select("id", names.related(left, right).alias("loose"), names.related(left, right, strict=True).alias("strict"))


@query("""
with j as (select distinct 'Mc' || p_brand as last, p_type as first, p_name as middle from part)
select p_partkey as id, case when p_partkey % 4 = 3 then null else 'Mc' || p_brand end as surname from part
""")
def judge_surnames(spark, sf_dir):
    """The surname in a byline, by a directory of judges."""
    part = table(spark, sf_dir, "part")
    judges = part.select(F.concat(F.lit("Mc"), "p_brand").alias("last"), F.col("p_type").alias("first"), F.col("p_name").alias("middle")).distinct()
    given = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).when(F.col("p_partkey") % 4 == 1, F.concat(F.left("p_type", F.lit(1)), F.lit("."))).when(
        F.col("p_partkey") % 4 == 2, F.concat(F.col("p_type"), F.lit(" X."))).otherwise("Qzx")
    byline = F.concat(given, F.lit(" MC"), F.upper("p_brand"), F.when(F.col("p_partkey") % 5 == 0, F.lit(" Jr.")).otherwise(""))
    return people.judge_surnames(part.select(F.col("p_partkey").alias("id"), byline.alias("byline")), judges, "id", "byline")
