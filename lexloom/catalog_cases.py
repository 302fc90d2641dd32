"""Registered queries of captions, writings, scans, contents and bookkeeping.

As in ``catalog``: tables made from the driver's tables, answers from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.catalog import query
from lexloom.functions import captions, courts, text
from lexloom.operators import sources_text
from lexloom.plans import records
from lexloom.plans.synth import table


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("int").alias("n"), F.col("p_size").alias("size"), "p_name", "p_brand")


def _pick(n, *values):
    return F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), n % len(values))


@query("""
select p_partkey as id, case p_partkey % 4 when 0 then 'ROE v. WADE' when 1 then 'JOHN DOE ' || p_partkey || ' v. ACME CORP.' when 2 then 'In re GAULT' else 'Alpha v. Beta' end as name from part
""")
def caption_names(spark, sf_dir):
    """Names from the lines of a caption."""
    n = F.col("n").cast("string")
    lines = _pick(
        F.col("n") % 4, F.array(F.lit("ROE, et al.,"), F.lit("v."), F.lit("WADE, Appellee.")), F.array(F.concat(F.lit("JOHN DOE "), n, F.lit(", Plaintiff,")), F.lit("v."), F.lit("ACME CORP.; BETA LLC")),
        F.array(F.lit("In re"), F.lit("GAULT [1967]")), F.array(F.lit("On Certification from the Ninth Circuit:"), F.lit("Alpha v. Beta, Defendant")),
    )
    return _part(spark, sf_dir).select("id", captions.caption_name(lines).alias("name"))


@query("""
select p_partkey as id, case p_partkey % 4 when 0 then 'Den ex dem. Murray|Lessee of Murray|Murray''s Lessee' when 1 then 'Lessee of Livingston|Livingston''s Lessee' when 2 then 'Lessee of Hunter|Hunter''s Lessee' else '' end as forms from part
""")
def ejectment_forms(spark, sf_dir):
    """The forms that an ejectment party may be cited in."""
    side = _pick(F.col("n"), "JOHN DEN, ex dem. James B. Murray", "the Lessee of Robert Livingston", "Hunter's Lessee", "Acme Corp.")
    return _part(spark, sf_dir).select("id", F.array_join(captions.ejectment(side), "|").alias("forms"))


@query("""
select p_partkey as id, case when p_partkey % 2 = 0 then 'Steel Seizure Case' else 'Acme Co. v. Roe' end as name from part
""")
def settled_names(spark, sf_dir):
    """Cases that are known by another name than their caption's."""
    cite = _pick(F.col("n"), "343 U. S. 579", "343 U.S. 580")
    return _part(spark, sf_dir).select("id", captions.settled_name(F.lit("Acme Company v. Roe"), cite, {"343 us 579": "Steel Seizure Case"}).alias("name"))


@query("""
select p_partkey as id, case p_partkey % 4 when 0 then 'dissent' when 1 then 'concurrence' when 2 then 'separate' else '' end as role, case p_partkey % 2 when 0 then 'Stevens' end as author,
       case p_partkey % 2 when 0 then 'We affirm ' || p_partkey || '.' end as rest from part
""")
def writing_roles(spark, sf_dir):
    """A writing's role by its opening, and the author of an inline byline."""
    said = _pick(F.col("n"), "For these reasons I respectfully  dissent.", "I concur in the judgment.", "concurring in part and dissenting in part", "The facts are these.")
    line = F.when(F.col("n") % 2 == 0, F.concat(F.lit("JUSTICE STEVENS delivered the opinion of the Court. We affirm "), F.col("n").cast("string"), F.lit("."))).otherwise("We affirm.")
    by = captions.inline_byline(line)
    return _part(spark, sf_dir).select("id", captions.role_by_opening(said).alias("role"), by["author"].alias("author"), by["rest"].alias("rest"))


@query("""
select p_partkey as id, case p_partkey % 5 when 0 then true when 1 then false when 2 then false when 3 then true else false end as provisional from part
""")
def provisional_copies(spark, sf_dir):
    """Copies that are still to get their printed pages."""
    n = F.col("n") % 5
    decided = F.when(n == 4, F.lit("2020-01-01")).otherwise("2026-01-01").cast("date")
    none = F.array().cast("array<int>")
    pages = F.when(n.isin(0, 1), none).when(n == 3, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(115), F.lit(114)))
    firsts = F.when(n == 0, none).when(n == 3, F.array(F.lit(2438))).otherwise(F.array(F.lit(113)))
    return _part(spark, sf_dir).select("id", captions.provisional(decided, F.lit("2026-06-01").cast("date"), pages, firsts, F.lit(900)).alias("provisional"))


_BLOCKS = """
b as (select l_orderkey as doc, l_linenumber as ord, l_partkey as k from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey) = 1),
t as (select doc, ord, 'block ' || k as text from b),
f as (select doc, ord, cast(coalesce(sum(length(text) + 1) over (partition by doc order by ord rows between unbounded preceding and 1 preceding), 0) as int) as "start", length(text) as n from t)"""


def _blocks(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("k"))
    return line.select("doc", "ord", F.concat(F.lit("block "), F.col("k").cast("string")).alias("text"))


@query(f"""
with {_BLOCKS} select doc, ord, "start", cast("start" + n as int) as "end" from f
""")
def flattened_source(spark, sf_dir):
    """Where each block lies in a document's text."""
    return sources_text.flattened(_blocks(spark, sf_dir), "doc", "ord", "text").select("doc", "ord", "start", "end")


@query(f"""
with {_BLOCKS}, q as (select distinct doc, unnest([0, 5, 17, 40]) as pos from f)
select q.doc, q.pos as "at", f.ord as block, q.pos - f."start" as place from q asof left join f on q.doc = f.doc and q.pos >= f."start"
""")
def block_addresses(spark, sf_dir):
    """The block and the place in it of an offset."""
    flat = sources_text.flattened(_blocks(spark, sf_dir), "doc", "ord", "text")
    asked = flat.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, (0, 5, 17, 40)))).alias("at"))
    return sources_text.addresses(asked, flat, "doc", "ord", "at").select("doc", "at", "block", "place")


@query("""
with runs as (select p_size as vol, cast(p_partkey as int) as first, cast(p_partkey + 20 as int) as last, cast(p_partkey * 2 as int) as seq, 's' || p_partkey as scan from part where p_partkey % 40 = 0),
q as (select distinct cast(l_suppkey % 50 + 1 as int) as vol, cast(l_partkey as int) as page from lineitem)
select q.vol, q.page, runs.seq + q.page - runs.first as seq, scan from q join runs on q.vol = runs.vol and q.page between runs.first and runs.last
""")
def scan_pages(spark, sf_dir):
    """The page of a scan that a printed page is on."""
    p = _part(spark, sf_dir).where("n % 40 = 0")
    runs = p.select(F.col("size").alias("vol"), F.col("n").alias("first"), (F.col("n") + 20).alias("last"), (F.col("n") * 2).alias("seq"), F.concat(F.lit("s"), F.col("n").cast("string")).alias("scan"))
    line = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50 + 1).cast("int").alias("vol"), F.col("l_partkey").cast("int").alias("page")).distinct()
    return sources_text.scan_pages(line, runs, "vol", "page").select("vol", "page", "seq", "scan")


@query("""
with op as (select p_brand as vol, cast(p_partkey as int) as first, p_partkey as id from part where p_partkey % 3 = 0),
s as (select *, lead(first) over (partition by vol order by first) as until from op),
pg as (select p_brand as vol, cast(p_partkey as int) as label, cast(p_partkey + 7 as int) as seq from part)
select s.id, count(*) as pages, min(seq) as begins from pg join s on pg.vol = s.vol and pg.label >= s.first and (until is null or pg.label <= until) group by s.id
""")
def carved_opinions(spark, sf_dir):
    """The pages of each opinion of a volume."""
    p = _part(spark, sf_dir)
    opinions = p.where("n % 3 = 0").select(F.col("p_brand").alias("vol"), F.col("n").alias("first"), "id")
    pages = p.select(F.col("p_brand").alias("vol"), F.col("n").alias("label"), (F.col("n") + 7).alias("seq"))
    return sources_text.carve(pages, opinions, "vol", "first").groupBy("id").agg(F.count("*").alias("pages"), F.min("seq").alias("begins"))


@query("""
with recursive u as (select p_partkey as id, case when p_partkey > 0 then p_partkey // 7 end as parent, 'u' || p_partkey as name from part),
w as (select id, name as path from u where parent is null union all select u.id, w.path || ' > ' || u.name from u join w on u.parent = w.id)
select id, path from w
""")
def breadcrumbs(spark, sf_dir):
    """The way from the root of a table of contents to each unit."""
    p = _part(spark, sf_dir)
    units = p.select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 7)).alias("parent"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    return sources_text.breadcrumbs(units, "id", "parent", "name")


@query("""
select p_size as vol, count(*) as cases, cast(max(p_partkey) as int) as last_page from part group by p_size
""")
def volume_ends(spark, sf_dir):
    """Volumes held, and the last page of each."""
    return _part(spark, sf_dir).groupBy(F.col("size").alias("vol")).agg(F.count("*").alias("cases"), F.max("n").alias("last_page"))


@query("""
select p_partkey as id, p_size || ':' || p_partkey || '@' || (p_partkey + 3) as spec, p_size || ':' || p_partkey as base, cast(p_partkey + 3 as varchar) as pin,
       p_name || ', ' || p_size || ' E.R. ' || p_partkey as label, '[' || (1800 + p_size) || '] EngR ' || p_partkey as neutral from part
""")
def reprint_labels(spark, sf_dir):
    """Specs, pins and labels of reprinted reports."""
    size, n = F.col("size").cast("string"), F.col("n").cast("string")
    spec = F.concat(size, F.lit(":"), n, F.lit("@"), (F.col("n") + 3).cast("string"))
    return _part(spark, sf_dir).select(
        "id", spec.alias("spec"), F.substring_index(spec, "@", 1).alias("base"), F.substring_index(spec, "@", -1).alias("pin"),
        F.concat(F.col("p_name"), F.lit(", "), size, F.lit(" E.R. "), n).alias("label"), F.format_string("[%d] EngR %d", 1800 + F.col("size"), "n").alias("neutral"),
    )


@query("""
select l_suppkey as justice, count(*) filter (l_returnflag = 'N') as dissents, count(*) filter (l_returnflag = 'A') as majority,
       string_agg(distinct l_orderkey, ',' order by l_orderkey) filter (l_returnflag = 'N' and l_orderkey < 40) as cases from lineitem group by 1
""")
def dissents(spark, sf_dir):
    """Each justice's votes, and the cases of their dissents."""
    line = table(spark, sf_dir, "lineitem")
    n = F.col("l_returnflag") == "N"
    low = F.array_sort(F.collect_set(F.when(n & (F.col("l_orderkey") < 40), F.col("l_orderkey"))))
    out = line.groupBy(F.col("l_suppkey").alias("justice")).agg(F.count_if(n).alias("dissents"), F.count_if(F.col("l_returnflag") == "A").alias("majority"), low.alias("c"))
    return out.select("justice", "dissents", "majority", F.when(F.size("c") > 0, F.array_join(F.col("c").cast("array<string>"), ",")).alias("cases"))


@query("""
with m as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), g as (select distinct l_partkey as k from lineitem where l_suppkey < 3)
select k from m where k not in (select k from g)
""")
def forgotten_misses(spark, sf_dir):
    """Recorded misses, without those that were found since."""
    line = table(spark, sf_dir, "lineitem")
    missed = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct()
    return missed.join(line.where("l_suppkey < 3").select(F.col("l_partkey").alias("k")).distinct(), "k", "left_anti")


@query("""
select l_partkey as case_id, count(*) filter (l_suppkey % 4 = 0) > 0 as reviewed, count(*) filter (l_suppkey % 4 = 1) > 0 as below, count(*) filter (l_suppkey % 4 = 2) > 0 as remand from lineitem group by 1
""")
def relations_present(spark, sf_dir):
    """Which relations a case's related ones stand in."""
    k = F.col("l_suppkey") % 4
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("case_id")).agg(*[F.bool_or(k == i).alias(r) for i, r in enumerate(("reviewed", "below", "remand"))])


@query(r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as ws from documents)
select doc_id, cast(len(ws) as bigint) as words, ws[1] as first, ws[len(ws)] as last from w
""")
def word_stream(spark, sf_dir):
    """A text's words with their offsets; the words stand where they say."""
    t = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("w", text.word_spans(F.col("t")))
    stand = lambda x: F.lower(F.substring(F.col("t"), x["start"] + 1, x["end"] - x["start"]))
    at = lambda k: F.when(F.size("w") > 0, stand(F.get("w", k)))
    return d.select("doc_id", F.size("w").cast("long").alias("words"), at(F.lit(0)).alias("first"), at(F.size("w") - 1).alias("last"))


@query("""
with s as (select * from (values ('Ohio', 'ca6'), ('Texas', 'ca5'), ('New York', 'ca2'), ('Puerto Rico', 'ca1')) t(state, circuit))
select state, circuit from s
""")
def court_groups(spark, sf_dir):
    """The circuit that a state's federal courts belong to."""
    rows = spark.createDataFrame([("Ohio",), ("Texas",), ("New York",), ("Puerto Rico",)], "state string")
    return rows.select("state", courts.circuit_of(F.col("state")).alias("circuit"))


@query("""
select p_partkey as id, case when p_partkey % 2 = 0 then cast(p_partkey as varchar) end as scholar_id, 'Roe v. Wade ' || p_partkey as name, '410 U.S. ' || p_partkey as cite, '1973-01-22' as decided from part
""")
def page_records(spark, sf_dir):
    """A record from an opinion's page: id, name, first citation, date."""
    n = F.col("n").cast("string")
    url = F.when(F.col("n") % 2 == 0, F.concat(F.lit("https://x/scholar_case?case="), n, F.lit("&hl=en"))).otherwise("https://x/other")
    html = F.concat(F.lit('<h3 id="gsl_case_name">Roe v.  Wade '), n, F.lit("</h3><center>410 U. S. "), n, F.lit(" (1973)</center><center>Decided January 22, 1973.</center><p>Text.</p>"))
    return records.from_pages(_part(spark, sf_dir).select("id", url.alias("url"), html.alias("html")), "id")


@query("""
with runs as (select p_brand as doc, p_partkey as pos, p_size % 4 as head from part),
m as (select *, case when head is distinct from lag(head) over (partition by doc order by pos) then 1 else 0 end as opens from runs),
g as (select *, sum(opens) over (partition by doc order by pos) as sec from m)
select doc, cast(sec as bigint) as section, min(head) as head, min(pos) as first, max(pos) as last from g group by doc, sec
""")
def head_sections(spark, sf_dir):
    """Sections of a document by its pages' running heads."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 4).alias("head"))
    w = Window.partitionBy("doc").orderBy("pos")
    opens = (~F.col("head").eqNullSafe(F.lag("head").over(w))).cast("int")
    g = p.withColumn("o", opens).withColumn("section", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return g.groupBy("doc", "section").agg(F.min("head").alias("head"), F.min("pos").alias("first"), F.max("pos").alias("last"))
