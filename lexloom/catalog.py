"""Registered queries of the engine's own operators and their oracle SQL.

The driver's tables hold no legal text, so most queries run on tables made from
them (``plans.synth``), and the oracle computes the answer from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import cites, dates, names, text
from lexloom.operators import documents, lookup, resolve, search, votes, windows
from lexloom.plans import extract, synth
from lexloom.plans.synth import CITATIONS, OPINIONS, table
from lexloom.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite_lookup(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- search -----------------------------------------------------------------


@query(f"""
with {OPINIONS}, {CITATIONS}, asked as (
  select p_partkey as request, cast(p_partkey % 100 + 1 as int) as vol, cast(p_partkey + 1 as int) as page from part
), hit as (
  select distinct request, scholar_id from asked join citations using (vol, page) where canon = 'U.S.'
)
select request, scholar_id, name, year, row_number() over (partition by request order by year, name, scholar_id) as rank
from hit join opinions using (scholar_id)
""")
def cite_lookup(spark, sf_dir):
    """Opinions at a typed citation, whatever its spelling."""
    spell = F.get(F.array(F.lit("U.S."), F.lit("US"), F.lit("U. S.")), (F.col("p_partkey") % 3).cast("int"))
    asked = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request"),
        F.concat_ws(" ", (F.col("p_partkey") % 100 + 1).cast("string"), spell, (F.col("p_partkey") + 1).cast("string")).alias("cite"),
    )
    return search.by_citation(synth.opinions(spark, sf_dir), synth.citations(spark, sf_dir), asked)


@query(f"""
with {CITATIONS}
select reporter, canon as canonical, regexp_replace(lower(canon), '[^a-z0-9]', '', 'g') as key,
       case canon when 'U.S.' then 'us' when 'F.2d' then 'f2d' else 's-ct' end as slug, count(*) as n
from citations group by reporter, canon
""")
def cite_key_normalise(spark, sf_dir):
    """Spellings folded to a canonical reporter, its key and folder name."""
    c = synth.citations(spark, sf_dir).groupBy("reporter").agg(F.count("*").alias("n"))
    r = F.col("reporter")
    return c.select("reporter", cites.canonical_reporter(r).alias("canonical"), cites.reporter_key(r).alias("key"), cites.reporter_slug(r).alias("slug"), "n")


@query(f"""
with {CITATIONS}, raw as (
  select scholar_id, vol, page, canon, vol || ' ' || reporter || ' ' || page as cite,
         row_number() over (partition by scholar_id order by vol, page, reporter) as pos from citations
), once as (
  select *, row_number() over (partition by scholar_id, vol, canon, page order by pos) as r from raw
)
select scholar_id, string_agg(cite, '; ' order by pos) as cites, count(*) as n from once where r = 1 group by scholar_id
""")
def cite_dedupe(spark, sf_dir):
    """A record's citations in order, each parsed key once."""
    c = synth.citations(spark, sf_dir)
    one = F.struct("vol", "page", "reporter", F.concat_ws(" ", "vol", "reporter", "page").alias("cite"))
    rows = c.groupBy("scholar_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["cite"]).alias("cites"))
    kept = rows.select("scholar_id", cites.dedupe_cites(F.col("cites")).alias("kept"))
    return kept.select("scholar_id", F.array_join("kept", "; ").alias("cites"), F.size("kept").cast("long").alias("n"))


def _party_queries(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").cast("string").alias("request"), F.format_string("Customer#%09d of the NATION_%d", F.col("n_nationkey") * 7, "n_nationkey").alias("query"))


_TOKENS = """
t as (select distinct scholar_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) as token from opinions),
tok as (select * from t where length(token) >= 2 and token not in ('the','of','and','in','re','v','vs','et','al','a','an','for','on','ex','parte','matter','state','people')),
q as (
  select request, token from (
    select cast(n_nationkey as varchar) as request, unnest(['customer', lpad(cast(n_nationkey * 7 as varchar), 9, '0'), 'nation', cast(n_nationkey as varchar)]) as token from nation
  ) where length(token) >= 2
)"""


@query(f"""
with {OPINIONS}, {_TOKENS}, need as (select request, count(*) as need from q group by request)
select request, scholar_id from tok join q using (token) join need using (request)
group by request, scholar_id, need having count(distinct token) >= need
""")
def party_all_tokens(spark, sf_dir):
    """Opinions whose party names hold every token of the query."""
    return search.all_tokens(search.party_index(synth.opinions(spark, sf_dir)), _party_queries(spark, sf_dir))


@query(f"""
with {OPINIONS}, {_TOKENS}, hit as (
  select request, scholar_id, count(distinct token) as hits from tok join q using (token) group by request, scholar_id
)
select request, scholar_id, hits, name, year, row_number() over (partition by request order by hits desc, year, name, scholar_id) as rank
from hit join opinions using (scholar_id) qualify rank <= 10
""")
def party_any_ranked(spark, sf_dir):
    """The ten opinions that share most tokens with the query."""
    o = synth.opinions(spark, sf_dir)
    return search.any_token(search.party_index(o), o, _party_queries(spark, sf_dir), 10).select("request", "scholar_id", "hits", "name", "year", "rank")


@query(f"""
with {OPINIONS}, {CITATIONS}, asked as (select n_nationkey as k from nation),
byid as (select 'i' || k as request, 'id' as route, scholar_id from asked join opinions on scholar_id = cast(k * 11 as varchar)),
bycite as (select distinct 'c' || k as request, 'cite' as route, scholar_id from asked join citations on vol = k + 1 and page = k * 20 + 1 and canon = 'F.2d' join opinions using (scholar_id)),
byname as (select 'n' || k as request, 'name' as route, scholar_id from asked join opinions on name = 'Customer#' || lpad(cast(k * 7 as varchar), 9, '0') || ' v. ' || split_part(name, ' v. ', 2))
select * from byid union all select * from bycite union all select * from byname
""")
def find_dispatch(spark, sf_dir):
    """A query goes by its shape: id, citation, or party names."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    asked = (
        k.select(F.concat(F.lit("i"), "k").alias("request"), (F.col("k") * 11).cast("string").alias("query"))
        .unionByName(k.select(F.concat(F.lit("c"), "k").alias("request"), F.format_string("%d Fed. 2d %d", F.col("k") + 1, F.col("k") * 20 + 1).alias("query")))
        .unionByName(k.select(F.concat(F.lit("n"), "k").alias("request"), F.format_string("Customer#%09d", F.col("k") * 7).alias("query")))
    )
    return search.find(synth.opinions(spark, sf_dir), synth.citations(spark, sf_dir), asked)


# ---- lookups ----------------------------------------------------------------


def _index(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("vol"), (F.col("p_partkey") + 1).cast("int").alias("first"), F.col("p_name").alias("title"))


def _points(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_suppkey") % 50 + 1).cast("int").alias("vol"), F.col("l_partkey").cast("int").alias("page")).distinct()


_POINTS = "pts as (select distinct cast(l_suppkey % 50 + 1 as int) as vol, cast(l_partkey as int) as page from lineitem)"
_INDEX = "idx as (select p_size as vol, cast(p_partkey + 1 as int) as first, p_name as title from part)"


@query(f"""
with {_POINTS}, {_INDEX}
select pts.vol, pts.page, idx.first from pts asof left join idx on pts.vol = idx.vol and pts.page >= idx.first
""")
def nearest_page(spark, sf_dir):
    """The greatest first page at or below a cited page; null before the first."""
    return lookup.nearest(_points(spark, sf_dir), _index(spark, sf_dir), ["vol"], "page", "first").select("vol", "page", "first")


@query(f"""
with {_POINTS}, {_INDEX}, span as (select vol, first, first + 39 as last, title from idx)
select pts.vol, pts.page, span.first, span.last, span.title from pts join span on pts.vol = span.vol and pts.page between span.first and span.last
""")
def containing_case(spark, sf_dir):
    """Every case whose pages hold the cited one."""
    spans = _index(spark, sf_dir).withColumn("last", F.col("first") + 39)
    return lookup.interval_join(_points(spark, sf_dir), spans, ["vol"], "page", "first", "last").select("vol", "page", "first", "last", "title")


@query(f"""
with {_POINTS}, {_INDEX}, span as (select vol, first, first + 20 + first % 50 as last, title from idx)
select pts.vol, pts.page, span.first, span.last, span.title from pts join span on pts.vol = span.vol and pts.page between span.first and span.last
qualify row_number() over (partition by pts.vol, pts.page order by case when title like 'red%' then 0 else 1 end, span.last - span.first, case when pts.page = span.last then 1 else 0 end, span.first) = 1
""")
def granule_rank(spark, sf_dir):
    """Of the granules that hold a page: wanted kind, narrowest, page not last."""
    spans = _index(spark, sf_dir).withColumn("last", F.col("first") + 20 + F.col("first") % 50)
    order = [(~F.col("title").startswith("red")).cast("int"), F.col("last") - F.col("first"), (F.col("page") == F.col("last")).cast("int"), F.col("first")]
    out = lookup.ranked_interval(_points(spark, sf_dir), spans, ["vol", "page"], ["vol"], "page", "first", "last", order)
    return out.select("vol", "page", "first", "last", "title")


@query("""
with d as (select p_brand as brand, p_type as kind, min(p_partkey) as granule from part group by 1, 2),
w as (select p_brand as brand, min(p_partkey) as granule from part where p_type = 'ECONOMY' group by 1),
asked as (select distinct p_brand as brand, k as kind from part, (values ('ECONOMY'), ('STANDARD'), ('NONE')) v(k))
select asked.brand, asked.kind, coalesce(d.granule, w.granule) as granule from asked left join d using (brand, kind) left join w on asked.brand = w.brand
""")
def day_chamber_fallback(spark, sf_dir):
    """A day's granule for a chamber, else the whole day's."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("granule"))
    days = part.groupBy("brand", "kind").agg(F.min("granule").alias("granule"))
    asked = part.select("brand").distinct().select("brand", F.explode(F.array(F.lit("ECONOMY"), F.lit("STANDARD"), F.lit("NONE"))).alias("kind"))
    return lookup.with_fallback(asked, days, ["brand"], "kind", "ECONOMY", "granule").select("brand", "kind", "granule")


@query("""
with p as (select p_brand as brand, p_partkey as page, row_number() over (partition by p_brand order by p_partkey) as n from part),
near as (select distinct a.brand, a.page from p a join p b on a.brand = b.brand and a.n between b.n - 1 and b.n + 2 where b.page % 100 = 0)
select brand, page from near
""")
def page_neighbourhood(spark, sf_dir):
    """Pages next to a picked one, in the volume's own order."""
    pages = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("page"))
    return lookup.neighbourhood(pages, pages.where("page % 100 = 0"), ["brand"], "page", 1, 2).select("brand", "page")


#: Volumes by case number, as (volume, first, last).
VOLUMES = [(k + 1, k * 60, k * 60 + 59 - k % 3) for k in range(30)]


@query(f"""
with v as (select * from (values {", ".join(map(str, VOLUMES))}) t(volume, first, last))
select p_partkey as no, v.volume,
       case when p_partkey >= 10000 then format('{{:,}}', p_partkey) else cast(p_partkey as varchar) end as printed
from part left join v on p_partkey between v.first and v.last
""")
def fedcas_volume(spark, sf_dir):
    """The volume that a case number falls in, and the number as printed."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("no"))
    return lookup.threshold(part, VOLUMES, "no", "volume").select("no", "volume", cites.fedcas_number(F.col("no")).alias("printed"))


# ---- extraction -------------------------------------------------------------


@query(f"""
with {CITATIONS}, d as (
  select scholar_id || '-' || vol || '-' || reporter || '-' || page as doc_id, vol, canon, page, page + vol % 7 as pin from citations
)
select doc_id, 1 as n, 'cite' as kind, vol || ' ' || canon || ' ' || page || case when pin <> page then '@' || pin else '' end as value from d
union all select doc_id, 2, 'short', vol || ' ' || canon || ' ' || page || '@' || (pin + 1) from d
union all select doc_id, 3, 'id', vol || ' ' || canon || ' ' || page || '@' || (pin + 2) from d
union all select doc_id, 4, 'usc', '42:' || page || ':a,1' from d
""")
def cite_extract(spark, sf_dir):
    """Full, short and back-reference citations and statutes found in prose."""
    found = extract.links(synth.citing_text(spark, sf_dir))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    return found.select("doc_id", n.alias("n"), "kind", "value")


@query(f"""
with {CITATIONS}, d as (
  select scholar_id || '-' || vol || '-' || reporter || '-' || page as doc_id, vol, canon, page from citations
)
select doc_id, 'case' as kind, vol || ' ' || canon || ' ' || page as authority, cast(3 as bigint) as uses from d
union all select doc_id, 'usc', '42:' || page, cast(1 as bigint) from d
""")
def link_rollup(spark, sf_dir):
    """The distinct authorities of a document with their uses."""
    found = extract.links(synth.citing_text(spark, sf_dir))
    kind = F.when(F.col("kind").isin("cite", "short", "id"), "case").otherwise(F.col("kind"))
    rows = found.select("doc_id", "start", kind.alias("kind"), "value", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("year"))
    return votes.authorities(rows).select("doc_id", "kind", "authority", "uses")


@query("""
with recursive s as (
  select l_orderkey as doc, cast(l_partkey as int) as a, cast(l_partkey + 50 + l_suppkey as int) as b, l_linenumber as o from lineitem
), r as (
  select doc, a, b, row_number() over (partition by doc order by a, b desc, o) as n from (select distinct * from s)
), walk as (
  select doc, n, a, b, true as taken, b as pos from r where n = 1
  union all
  select r.doc, r.n, r.a, r.b, r.a >= w.pos, case when r.a >= w.pos then r.b else w.pos end from walk w join r on r.doc = w.doc and r.n = w.n + 1
)
select doc, count(*) as n, sum(b - a) as covered, min(a) as first from walk where taken group by doc
""")
def greedy_nonoverlap(spark, sf_dir):
    """Leftmost-longest spans of each document, by one fold."""
    line = table(spark, sf_dir, "lineitem")
    s = line.select(
        F.col("l_orderkey").alias("doc"), F.col("l_partkey").cast("int").alias("start"),
        (F.col("l_partkey") + 50 + F.col("l_suppkey")).cast("int").alias("end"), F.col("l_linenumber").alias("order"),
    ).distinct()
    rows = s.groupBy("doc").agg(windows.greedy_spans(F.collect_list(F.struct("start", "end", "order"))).alias("t"))
    return rows.select(
        "doc", F.size("t").cast("long").alias("n"),
        F.aggregate("t", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("decimal(38,0)").alias("covered"),
        F.array_min(F.transform("t", lambda x: x["start"])).alias("first"),
    )


@query("""
select p_partkey as id, cast(p_size as varchar) || case p_partkey % 3 when 0 then '' when 1 then 'n4' else 'n4,5' end as pin,
       cast(p_size as varchar) || case p_partkey % 3 when 0 then '' when 1 then ' n.4' else ' nn.4–5' end as shown,
       cast(p_size as varchar) as page, cast(p_partkey % 3 as int) as n_notes,
       p_size || ':' || p_partkey || case when p_partkey % 2 = 0 then ':a,1' else ':' end as spec,
       p_size || ' U.S.C. § ' || p_partkey || case when p_partkey % 2 = 0 then '(a)(1)' else '' end as label
from part
""")
def pin_codec(spark, sf_dir):
    """Pins with note numbers, statute specs and labels, there and back."""
    part = table(spark, sf_dir, "part")
    notes = F.slice(F.array(F.lit("4"), F.lit("5")), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    subs = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("1"))).otherwise(F.array().cast("array<string>"))
    rows = part.select(
        F.col("p_partkey").alias("id"), cites.join_pin(F.col("p_size").cast("string"), notes).alias("pin"),
        cites.statute_spec(F.col("p_size"), F.col("p_partkey").cast("string"), subs).alias("spec"),
    )
    split = cites.split_pin(F.col("pin"))
    return rows.select("id", "pin", cites.show_pin(F.col("pin")).alias("shown"), split["page"].alias("page"), F.size(split["notes"]).alias("n_notes"), "spec", cites.statute_label(F.col("spec")).alias("label"))


# ---- votes and evidence -----------------------------------------------------


_VOTES = """
v as (
  select case_id, snip, min(yr) as yr from (
    select l_partkey as case_id, l_suppkey % 20 as snip, year(l_shipdate) as yr, 1998 as given from lineitem
  ) where yr - given in (0, 1) group by case_id, snip
), c as (select case_id, yr, count(*) as votes from v group by 1, 2), t as (select *, sum(votes) over (partition by case_id) as total from c)"""


def _cited(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_partkey").alias("case_id"),
        F.concat(F.lit("as held  in "), (F.col("l_suppkey") % 20).cast("string")).alias("snippet"),
        F.lit(1998).alias("given"),
        F.year("l_shipdate").alias("year"),
    )


@query(f"with {_VOTES} select case_id, yr as year, votes, total from t where votes >= 2 and votes * 3 >= total * 2")
def year_vote(spark, sf_dir):
    """The decision year that citing snippets agree on by two thirds."""
    picked = votes.pick_year(votes.year_votes(_cited(spark, sf_dir)))
    return picked.select("case_id", F.col("year").cast("long").alias("year"), "votes", F.col("total").cast("decimal(38,0)").alias("total"))


@query("""
with c as (select l_partkey as case_id, l_returnflag as form, count(*) as uses from lineitem group by 1, 2)
select case_id, form, uses from c where uses >= 2
qualify row_number() over (partition by case_id order by uses desc, case when form = 'N' then 1 else 0 end desc, form) = 1
""")
def form_vote(spark, sf_dir):
    """The name form most used, two uses at least; the default wins ties."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("case_id"), F.col("l_returnflag").alias("form")).agg(F.count("*").alias("uses"))
    return votes.pick_form(c.withColumn("is_default", F.col("form") == "N"))


@query("""
with r as (
  select o_orderdate as day, case when o_custkey % 2 = 0 then 'D' || (o_custkey % 50) else 'name ' || (o_custkey % 50) end as case_key,
         o_orderstatus as author, o_orderkey as seq, o_custkey % 5 as page,
         case when o_orderkey % 3 = 0 then '' else 'u' || o_orderkey end as url, 'c' || o_orderkey as cite from orders
), o as (select *, row_number() over (partition by day, case_key order by page, seq, author, url, cite) as n from r),
a as (select day, case_key, author, min(n) as n from o group by 1, 2, 3)
select cast(day as date) as day, case_key, cast(count(*) as int) as n,
       (select string_agg(author, '; ' order by a.n) from a where a.day = o.day and a.case_key = o.case_key) as authors,
       arg_min(url, n) filter (url <> '') as url, arg_min(cite, n) as cite
from o group by day, case_key
""")
def order_groups(spark, sf_dir):
    """Separate writings of one case and day as one row."""
    o = table(spark, sf_dir, "orders")
    even = F.col("o_custkey") % 2 == 0
    rows = o.select(
        F.to_date("o_orderdate").alias("day"),
        F.when(even, F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string"))).otherwise("").alias("docket"),
        F.concat(F.lit("Name "), (F.col("o_custkey") % 50).cast("string")).alias("name"),
        F.col("o_orderstatus").alias("author"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 5).alias("page"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("u"), "o_orderkey")).alias("url"),
        F.concat(F.lit("c"), "o_orderkey").alias("cite"),
    )
    return votes.group_writings(rows)


@query("""
with s as (
  select l_partkey as case_id, l_suppkey % 10 as rel, l_orderkey * 10 + l_linenumber as seq, l_returnflag as relation,
         case when l_linenumber % 2 = 0 then l_shipmode else null end as nm,
         ['name', 'date', 'docket', 'text', 'cites', 'court', 'judge'][l_linenumber] as signal
  from (select *, l_linestatus as l_shipmode from lineitem)
)
select case_id, 'c' || rel as rel_key, arg_min(relation, seq * 4 + ascii(relation) % 4) as relation, string_agg(distinct signal, ',' order by signal) as signals,
       case when bool_or(signal in ('docket', 'cites')) or count(distinct signal) >= 2 then 'confirmed' else 'possible' end as confidence
from s group by case_id, rel
""")
def signal_merge(spark, sf_dir):
    """Related cases with the evidence of all signals."""
    line = table(spark, sf_dir, "lineitem")
    signals = F.array(*[F.lit(x) for x in ("name", "date", "docket", "text", "cites", "court", "judge")])
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 4 + F.ascii("l_returnflag") % 4
    rows = line.select(
        F.col("l_partkey").alias("case_id"), F.lit("scotus").alias("court"), F.concat(F.lit("C"), (F.col("l_suppkey") % 10).cast("string")).alias("cite"),
        F.lit(None).cast("string").alias("cluster"), seq.alias("seq"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("name"),
        F.col("l_shipdate").alias("filed"), F.get(signals, F.col("l_linenumber") - 1).alias("signal"),
    )
    return votes.merge_signals(rows).select("case_id", "rel_key", "relation", F.array_join("signals", ",").alias("signals"), "confidence")


@query("""
select l_orderkey as case_id, count(*) filter (l_returnflag = 'A') as majority, count(*) filter (l_returnflag = 'N') as minority,
       count(*) filter (l_returnflag = 'R') as other,
       count(*) filter (l_returnflag = 'A') || '-' || count(*) filter (l_returnflag = 'N') as line
from lineitem group by 1
""")
def vote_line(spark, sf_dir):
    """Votes of each case by side."""
    side = F.create_map(F.lit("A"), F.lit("majority"), F.lit("N"), F.lit("minority"), F.lit("R"), F.lit("other"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.try_element_at(side, F.col("l_returnflag")).alias("side"))
    return votes.vote_lines(rows)


# ---- resolution -------------------------------------------------------------


_SHINGLES = r"""
w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as ws from documents),
g as (select doc_id, list_distinct([array_to_string(ws[i:i + 3], ' ') for i in generate_series(1, len(ws) - 3)]) as g from w where len(ws) >= 4)"""


@query(f"""
with {_SHINGLES},
c as (select min(doc_id) as id, list_sort(g) as g from g group by list_sort(g)),
x as (select id, unnest(g) as gram, len(g) as n from c),
p as (select a.id as a, b.id as b, count(*) as shared, min(least(a.n, b.n)) as m from x a join x b on a.gram = b.gram and a.id < b.id group by 1, 2)
select a, b, cast(shared as int) as shared, shared / m as similarity from p where shared / m >= 0.55
""")
def shingle_containment(spark, sf_dir):
    """Documents that share four-word shingles, 0.55 of the smaller set or more; a
    set's least id stands for all (``shingle_classes``)."""
    return resolve.alike_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 0.55)


@query(f"""
with {_SHINGLES}
select doc_id, min(doc_id) over (partition by list_sort(g)) as class_id from g
""")
def shingle_classes(spark, sf_dir):
    """The class of each document, whose least id names it in the pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.word_shingles(F.col("text"), 4).alias("g"))
    return resolve.gram_classes(docs, "doc_id", "g")


_REVISION = r"""
r as (
  select doc_id, n_chars % 97 as filed, doc_id % 2 = 0 as reported, doc_id % 7 as dk,
         regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as ws from documents
), g as (select *, list_distinct([array_to_string(ws[i:i + 6], ' ') for i in generate_series(1, len(ws) - 6)]) as g from r where len(ws) >= 7)"""


@query(f"""
with {_REVISION}
select o.doc_id as old_id, n.doc_id as new_id, len(list_intersect(o.g, n.g)) / least(len(o.g), len(n.g)) as similarity
from g o join g n on o.filed = n.filed and not o.reported and n.reported
where (o.dk = 0 or n.dk = 0 or o.dk = n.dk) and len(list_intersect(o.g, n.g)) / least(len(o.g), len(n.g)) >= 0.55
qualify row_number() over (partition by o.doc_id order by similarity desc, n.doc_id desc) = 1
""")
def revision_collapse(spark, sf_dir):
    """Unreported records that a reported one of the same date supersedes."""
    d = table(spark, sf_dir, "documents")
    dk = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("doc_id") % 7).cast("string")))
    rows = d.select(
        F.col("doc_id").alias("scholar_id"), (F.col("n_chars") % 97).alias("filed"), (F.col("doc_id") % 2 == 0).alias("reported"),
        dk.alias("dockets"), "text",
    )
    return resolve.revisions(rows)


@query(f"""
with {OPINIONS}
select scholar_id, cast(case when party % 2 = 0 then 1.0 else 0.0 end as double) as score, party % 2 = 0 as related from opinions
""")
def name_scores(spark, sf_dir):
    """Overlap score and relation of two captions; the parity of the party picks the
    other one."""
    o = synth.opinions(spark, sf_dir)
    other = F.when(F.col("party") % 2 == 0, F.concat(F.lit("the "), F.col("name"), F.lit(", Inc."))).otherwise("Zebra Ltd. v. Yak")
    return o.select("scholar_id", names.overlap_score(F.col("name"), other).alias("score"), names.related(F.col("name"), other).alias("related"))


@query("""
with t as (select p_brand as request, p_partkey as found, p_size as score from part),
top as (select request, max(score) as m from t group by 1)
select request, case when count(distinct found) = 1 then min(found) end as found from t join top using (request) where score = m group by request
""")
def unique_best(spark, sf_dir):
    """The best match where it stands alone; ties give no answer."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("request"), F.col("p_partkey").alias("found"), F.col("p_size").alias("score"))
    return resolve.unique_best(p, "request", "found", "score")


@query("""
with e as (select l_partkey as citing, l_suppkey as cited, max(l_quantity) as depth from lineitem where l_partkey <> l_suppkey group by 1, 2)
select cited as seed, citing as found, depth from e where cited % 10 = 0
""")
def lineage_onehop(spark, sf_dir):
    """Cases one citation away from the seeds, with the depth of treatment."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited"), F.col("l_quantity").alias("depth"))
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scholar_id")).where("scholar_id % 10 = 0")
    return resolve.one_hop(e, seeds)


@query("""
with a as (select p_brand as request, 0 as k, p_partkey as found from part where p_size = 1 group by all),
b as (select p_brand as request, 1 as k, p_partkey as found from part where p_size = 2 group by all),
u as (select request, k, min(found) as found from (select * from a union all select * from b) group by 1, 2 having count(*) = 1)
select w.request, arg_min(u.found, u.k) as found, cast(min(u.k) as int) as stage from (select distinct p_brand as request from part) w left join u using (request) group by 1
""")
def resolve_cascade(spark, sf_dir):
    """Stages in turn; a stage with several answers passes a request on."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("request"), F.col("p_partkey").alias("found"), "p_size")
    return resolve.cascade(p.select("request").distinct(), [p.where("p_size = 1"), p.where("p_size = 2")])


# ---- store ------------------------------------------------------------------


def _stores(spark, sf_dir):
    o = synth.opinions(spark, sf_dir).select("scholar_id", "name", "court", F.col("scholar_id").cast("int").alias("k"))
    return o.where("k % 3 <> 1").drop("k"), o.where("k % 3 <> 0").withColumn("court", F.lit("OTHER")).drop("k")


@query(f"""
with {OPINIONS}, o as (select scholar_id, name, court, cast(scholar_id as int) as k from opinions)
select scholar_id, name, court, 'kept' as status from o where k % 3 <> 1
union all select scholar_id, name, 'OTHER', case when k % 3 = 1 then 'added' else 'skipped' end from o where k % 3 <> 0
""")
def store_merge(spark, sf_dir):
    """Two stores in one: ours wins, theirs fills in."""
    return store.merge(*_stores(spark, sf_dir))


@query(f"""
with {OPINIONS}, o as (select scholar_id, name, court, cast(scholar_id as int) as k from opinions)
select scholar_id, name, case when k % 3 = 2 then 'OTHER' else court end as court from o where k % 3 <> 1
""")
def store_replace(spark, sf_dir):
    """Stored records changed by newer ones; unknown ids are not added."""
    return store.replace(*_stores(spark, sf_dir))


@query(f"""
with {OPINIONS}, o as (select scholar_id, name, court, cast(scholar_id as int) as k from opinions)
select scholar_id, name, case when k % 3 = 1 then 'OTHER' else court end as court from o
""")
def store_add(spark, sf_dir):
    """Append what the store lacks."""
    return store.add(*_stores(spark, sf_dir))


@query(f"""
with {OPINIONS} select scholar_id, name, court from opinions where cast(scholar_id as int) % 3 = 0
""")
def store_delete(spark, sf_dir):
    return store.delete(*_stores(spark, sf_dir))


@query("""
with q as (select p_brand as request, p_partkey as c, row_number() over (partition by p_brand order by p_partkey) as n from part)
select request, arg_min(c, n) as citation from q where c % 97 = 0 group by request
""")
def negative_cache(spark, sf_dir):
    """Requests of which a citation was looked up before in vain."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("c"))
    q = p.groupBy(F.col("p_brand").alias("request")).agg(F.sort_array(F.collect_list("c")).alias("citations"))
    return store.missed_before(q, p.where("c % 97 = 0").select(F.col("c").alias("citation")))


# ---- windows ----------------------------------------------------------------


@query("""
with p as (select distinct l_suppkey as vol, cast(l_partkey as int) as page from lineitem),
g as (select *, page - row_number() over (partition by vol order by page) as g from p)
select vol, min(page) as first, max(page) as last, count(*) as n from g group by vol, g
""")
def island_runs(spark, sf_dir):
    """Runs of consecutive printed pages."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("vol"), F.col("l_partkey").cast("int").alias("page"))
    return windows.islands(p, ["vol"], "page")


@query("""
with s as (select l_suppkey as f, cast(l_partkey * 10 as int) as a, cast(l_partkey * 10 + l_quantity as int) as b from lineitem),
m as (select *, max(b) over (partition by f order by a, b rows between unbounded preceding and 1 preceding) as r from s),
g as (select *, sum(case when r is null or a > r + 5 then 1 else 0 end) over (partition by f order by a, b rows unbounded preceding) as g from m)
select f as file, min(a) as first, max(b) as last, count(*) as n from g group by f, g
""")
def span_coalesce(spark, sf_dir):
    """Near-adjacent byte ranges fetched as one."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") * 10).cast("int").alias("a"), (F.col("l_partkey") * 10 + F.col("l_quantity")).cast("int").alias("b"))
    return windows.coalesce_spans(s, ["file"], "a", "b", 5)


@query("""
with e as (select distinct user_id, cast(floor(epoch(ts)) as bigint) as t from events),
m as (select *, case when t - lag(t) over (partition by user_id order by t) > 25000 then 1 else 0 end as new from e),
g as (select *, sum(new) over (partition by user_id order by t rows unbounded preceding) as g from m),
c as (select user_id, g, min(t) as first, max(t) as last, count(*) as n from g group by 1, 2)
select user_id, first, last, n from c qualify row_number() over (partition by user_id order by n desc, first) = 1
""")
def dominant_cluster(spark, sf_dir):
    """The densest cluster of anchors between large gaps."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).distinct()
    return windows.dominant_cluster(e, ["user_id"], "t", 25000)


@query("""
select p_brand as title, p_partkey as section, lag(p_partkey) over w as previous, lead(p_partkey) over w as next
from part window w as (partition by p_brand order by p_partkey)
""")
def prev_next(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), F.col("p_partkey").alias("section"))
    return windows.neighbours(p, ["title"], ["section"], "section")


@query("""
with o as (select o_custkey as term, o_orderkey as id, o_orderdate as d, o_orderstatus = 'F' as linked from orders),
s as (select *, coalesce(sum(linked::int) over (partition by term order by d desc, id rows between unbounded preceding and 1 preceding), 0) as seen from o)
select term, id, linked from s where seen < 3
""")
def up_to_linked(spark, sf_dir):
    """Newest first, as far as the third row that can be opened."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"), (F.col("o_orderstatus") == "F").alias("linked"))
    return windows.up_to_linked(o, ["term"], [F.desc("d"), F.col("id")], "linked", 3).select("term", "id", "linked")


@query("""
with t as (select p_brand as doc, p_partkey as pos, case when p_size % 3 = 0 then p_partkey * 2 + 5 end as v from part),
k as (select *, max(case when v is not null then pos end) over (partition by doc order by pos) as a0,
                min(case when v is not null then pos end) over (partition by doc order by pos rows between current row and unbounded following) as a1 from t)
select doc, pos, v as value, case when v is not null then cast(v as double) when a0 is not null and a1 is not null then cast(pos * 2 + 5 as double) end as filled,
       cast(case when v is not null then 1.0 when a0 is not null and a1 is not null then 0.55 end as double) as confidence from k
""")
def interpolate_boundaries(spark, sf_dir):
    """Missing page boundaries on the line between their neighbours."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 3 == 0, F.col("p_partkey") * 2 + 5).alias("value"))
    out = windows.interpolate(p, ["doc"], "pos", "value")
    return out.select("doc", "pos", "value", F.round("filled", 6).alias("filled"), "confidence")


@query("""
with recursive g as (
  select o_custkey as doc, list(o_totalprice order by o_orderkey) as v, list(o_orderkey order by o_orderkey) as k, cast(count(*) as int) as n from orders group by 1
), walk as (
  select doc, v, n, 1 as i, [1] as best, [0] as back from g
  union all
  select doc, v, n, i + 1, list_append(best, 1 + coalesce(m.b, 0)), list_append(back, coalesce(-m.j, 0)) from (
    select *, list_max([{'b': best[j], 'j': -j} for j in generate_series(1, i) if v[j] <= v[i + 1]]) as m from walk where i < n
  )
), done as (select *, list_max([{'b': best[j], 'j': -j} for j in generate_series(1, n)]) as top from walk where i = n
), back as (
  select doc, back as prior, cast(-top.j as int) as j from done
  union all
  select doc, prior, cast(prior[j] as int) from back where prior[j] > 0
)
select o_custkey as key, o_orderkey as "at", o_totalprice as value, back.j is not null as kept
from (select *, row_number() over (partition by o_custkey order by o_orderkey) as j from orders) o left join back on back.doc = o.o_custkey and back.j = o.j
""")
def monotonic_chain(spark, sf_dir):
    """Outliers of a page sequence, by the heaviest rising chain."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("at"), "o_totalprice", F.lit(1).alias("w"))
    return windows.monotonic(o, "doc", "at", "o_totalprice", "w")


@query("""
select p_partkey as id, p_name || case when n = 1 then '' else ' (' || n || ')' end as file
from (select *, row_number() over (partition by lower(p_name) order by p_partkey) as n from part)
""")
def unique_names(spark, sf_dir):
    """File names of a bundle made distinct."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"))
    return windows.unique_names(p, "stem", ["id"]).select("id", "file")


@query("""
select o_orderkey as id, rn, (rn - 1) // 10 as page from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders
) s where rn <= 20
""")
def newest_first_page(spark, sf_dir):
    """A ranked list, ten rows a page, two pages."""
    o = table(spark, sf_dir, "orders")
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return o.withColumn("rn", rn).where("rn <= 20").select(F.col("o_orderkey").alias("id"), F.col("rn").cast("long").alias("rn"), F.expr("(rn - 1) div 10").alias("page"))


# ---- scalars ----------------------------------------------------------------


@query("""
select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') as shown,
       case when month(o_orderdate) >= 10 then year(o_orderdate) else year(o_orderdate) - 1 end as term,
       cast((year(o_orderdate) - 1789) // 2 + 1 as int) as congress
from orders
""")
def date_forms(spark, sf_dir):
    """Printed dates to ISO and back, terms and congresses."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"), F.concat(F.lit("Decided "), F.date_format("o_orderdate", "MMM. d, yyyy"), F.lit(".")).alias("printed"))
    iso = dates.long_date(F.col("printed"))
    return o.select("id", iso.alias("iso"), dates.display_date(iso).alias("shown"), dates.term_of(F.col("d")).cast("long").alias("term"), dates.congress_of(F.year("d")).alias("congress"))


@query("""
select n, n as back, case when n % 100 between 11 and 13 then n || 'th' when n % 10 = 1 then n || 'st' when n % 10 = 2 then n || 'nd' when n % 10 = 3 then n || 'rd' else n || 'th' end as ordinal
from (select cast(p_partkey + 1 as int) as n from part)
""")
def numerals(spark, sf_dir):
    """Roman numerals there and back, ordinals."""
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("int").alias("n"))
    return n.select("n", dates.from_roman(dates.to_roman(F.col("n"))).alias("back"), dates.ordinal(F.col("n")).alias("ordinal"))


@query("""
select doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), 1, 300) as snippet from documents
""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("""
select o_orderkey as id, 'Nos. ' || (o_orderkey % 90 + 10) || '–' || (o_custkey + 1) || ' & ' || (o_orderkey % 90 + 10) || 'A' || (o_custkey % 900 + 1) as printed,
       (o_orderkey % 90 + 10) || '-' || (o_custkey + 1) || ',' || (o_orderkey % 90 + 10) || 'A' || (o_custkey % 900 + 1) as tokens
from orders
""")
def docket_tokens(spark, sf_dir):
    """Docket numbers in a caption line."""
    a, b = F.col("o_orderkey") % 90 + 10, F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("Nos. %d–%d & %dA%d", a, b + 1, a, b % 900 + 1).alias("printed"))
    return o.select("id", "printed", F.array_join(cites.docket_tokens(F.col("printed")), ",").alias("tokens"))


@query("""
select page_id, len(regexp_extract_all(html, '<p[ >]')) as paragraphs, len(regexp_extract_all(html, '<a [^>]*href=')) as links,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title
from pages
""")
def page_blocks(spark, sf_dir):
    """Paragraphs, links and title of marked-up pages."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select(
        "page_id", count("<p[ >]").alias("paragraphs"), count("<a [^>]*href=").alias("links"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )


# ---- documents --------------------------------------------------------------


@query(r"""
with b as (
  select l_orderkey as doc, l_partkey * 10 + l_linenumber as n, case l_linenumber when 1 then 'Justice X delivered the opinion of the Court.'
    when 4 then 'Justice Y, dissenting.' when 6 then 'Justice Z, concurring.' else 'Text ' || l_suppkey end as block,
    case l_linenumber when 1 then 'majority' when 4 then 'dissent' when 6 then 'concurrence' end as r
  from (select distinct l_orderkey, l_partkey, l_linenumber, min(l_suppkey) as l_suppkey from lineitem group by all)
), o as (
  select *, r is not null and lead(n) over w is not null and lead(r) over w is null as opens from b window w as (partition by doc order by n)
)
select doc, n, sum(opens::int) over w as part,
       coalesce(last_value(case when opens then r end ignore nulls) over (partition by doc order by n rows unbounded preceding), 'header') as role
from o window w as (partition by doc order by n rows unbounded preceding)
""")
def segment_opinions(spark, sf_dir):
    """Header, majority and separate writings of an opinion's blocks."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    k = F.col("l_linenumber")
    block = (
        F.when(k == 1, "Justice X delivered the opinion of the Court.").when(k == 4, "Justice Y, dissenting.")
        .when(k == 6, "Justice Z, concurring.").otherwise(F.concat(F.lit("Text "), F.col("s").cast("string")))
    )
    blocks = line.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") * 10 + k).alias("n"), block.alias("block"))
    return documents.segment(blocks, "doc", "n", "block").select("doc", "n", F.col("part").cast("decimal(38,0)").alias("part"), "role")


@query(r"""
select o_orderkey as id, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 3 = 1 then strftime(o_orderdate + interval 1 day, '%Y-%m-%d')
       else strftime(o_orderdate, '%Y-%m-%d') end as decided from orders
""")
def decision_dates(spark, sf_dir):
    """The decision date among the dates of a front matter."""
    day = lambda d: F.date_format(d, "MMMM d, yyyy")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    front = (
        F.when(k == 0, F.concat(F.lit("Argued "), day(F.date_add(d, -30)), F.lit("\nDecided "), day(d)))
        .when(k == 1, F.concat(F.lit("Filed "), day(d), F.lit("\nRefiled "), day(F.date_add(d, 1))))
        .otherwise(F.concat(F.lit("No. 7. "), day(F.date_add(d, -9)), F.lit("\n"), day(d)))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), documents.decision_date(front).alias("decided"))


@query("""
select p_partkey as id, ['petition', 'reply', 'merits', 'amicus', 'skip', 'transcript', 'other'][p_partkey % 7 + 1] as kind,
       case when p_size between 1 and 23 then p_size + 67 end as official, p_partkey % 2 = 0 as bears from part
""")
def docket_papers(spark, sf_dir):
    """Kinds of docket papers, early volumes, and whether a title bears a cite."""
    said = [
        "Petition for a writ of certiorari", "Reply of petitioner", "Brief of respondent", "Brief of amicus curiae States",
        "Waiver of right of respondent to respond", "Transcript of hearing", "Letter",
    ]
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text_of = F.get(F.array(*map(F.lit, said)), (k % 7).cast("int"))
    title = F.format_string("Roe v. Wade, %d U. S. %d (1973)", F.col("p_size"), k + 1)
    asked = F.format_string("%d US %d", F.col("p_size"), k + 1 + k % 2)
    return p.select(
        k.alias("id"), documents.paper_kind(text_of).alias("kind"),
        documents.official_volume(F.lit("Wall."), F.col("p_size")).alias("official"), documents.bears(title, asked).alias("bears"),
    )


@query("""
select p_partkey as id, '410 U.S. ' || p_partkey as head, '(' || p_size || ')|(citing A (B))' as notes, '“a ' || p_size || '” ‘b’ it’s' as curly from part
""")
def citation_tails(spark, sf_dir):
    """Trailing parentheticals split off, straight quotes made curly."""
    p = table(spark, sf_dir, "part")
    tail = documents.trailing_parentheticals(F.format_string("410 U.S. %d (%d) (citing A (B))", "p_partkey", "p_size"))
    curly = documents.curl_quotes(F.format_string("\"a %d\" 'b' it's", "p_size"))
    return p.select(F.col("p_partkey").alias("id"), tail["head"].alias("head"), F.array_join(tail["notes"], "|").alias("notes"), curly.alias("curly"))


@query("""
with s as (select p_brand as section, count(*) as n from part group by 1)
select section, '0,1,2,3,3,4,0,0,0,0|0,1,2,2,1,0,1,1,0' as levels, n from s
""")
def statute_indent(spark, sf_dir):
    """Levels of statute paragraphs from their enumerators."""
    first = ["(a)(1) x", "(2) x", "(A) x", "(i) x", "(ii)(I) x", "(II) x", "(b) x", "plain", "(aa) x", "(c) x"]
    second = ["(a) x", "(1) x", "(A) x", "(B) x", "(2) x", "(b) x", "(1) x", "plain", "(c) x"]
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("section")).agg(F.count("*").alias("n"))
    out = p
    for name, marks in (("one", first), ("two", second)):
        rows = p.select("section", F.posexplode(F.array(*map(F.lit, marks))).alias("o", "text"))
        found = documents.statute_levels(rows, "section", "o", "text")
        out = out.join(found.select("section", F.array_join(F.col("levels").cast("array<string>"), ",").alias(name)), "section")
    return out.select("section", F.concat_ws("|", "one", "two").alias("levels"), "n")


@query()
def page_text(spark, sf_dir):
    """Blocks of marked-up pages in order, with their links."""
    return documents.page_blocks(table(spark, sf_dir, "pages")).withColumn("links", F.array_join("links", " "))
