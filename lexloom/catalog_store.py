"""Registered queries of the store's sources and sinks, and of text repairs.

Files are written to the shared folder and read back, so that what is compared went
through the format.
"""

from __future__ import annotations

import base64
import gzip
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.catalog import query
from lexloom.functions import cites, text
from lexloom.operators import resolve
from lexloom.plans import synth
from lexloom.plans.synth import CITATIONS, OPINIONS, table
from lexloom.session import shared_dir
from lexloom.sources import store
from lexloom.streaming.ingest import ingest


def _fresh(spark, name: str) -> str:
    """A new folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _lines(spark, sf_dir):
    """Records of parts as JSON lines; each eleventh is cut off, each thirteenth has
    no id, and each seventh comes twice."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), "p_name")
    record = F.to_json(F.struct(F.when(F.col("n") % 13 != 0, F.col("n").cast("string")).alias("scholar_id"), F.col("p_name").alias("name"), F.array(F.lit("1 U.S. 2")).alias("cites")))
    line = F.when(F.col("n") % 11 == 0, F.left(record, F.lit(12))).otherwise(record)
    twice = F.when(F.col("n") % 7 == 0, F.array(line, line)).otherwise(F.array(line))
    return part.select("n", F.explode(twice).alias("value"))


_GOOD = "p_partkey % 11 <> 0 and p_partkey % 13 <> 0"


@query(f"""
select cast(p_partkey as varchar) as scholar_id, p_name as name from part where {_GOOD}
""")
def store_read(spark, sf_dir):
    """Records of JSON lines, the first of each id; lines that can't be read are set
    aside."""
    path = _fresh(spark, "lines")
    _lines(spark, sf_dir).select("value").write.text(path)
    return store.read_jsonl(spark, path)[0].select("scholar_id", "name")


@query(f"""
with f as (select case when p_partkey % 2 = 0 then 'first' else 'second' end as run, p_partkey from part)
select run, count(*) filter ({_GOOD}) as added, cast(sum(case when {_GOOD} then 0 when p_partkey % 7 = 0 then 2 else 1 end) as bigint) as bad from f group by run
""")
def store_ingest(spark, sf_dir):
    """Two loads of a growing folder: what each added, and how many bad lines."""
    path = _fresh(spark, "inbox")
    lines, rows = _lines(spark, sf_dir), []
    for k, run in enumerate(("first", "second")):
        lines.where(F.col("n") % 2 == k).select("value").write.mode("append").text(path)
        rows.append((run, *ingest(spark, path, f"{path}-store", f"{path}-checkpoint")))
    return spark.createDataFrame(rows, "run string, added long, bad long")


@query(f"""
with {OPINIONS}, {CITATIONS}
select distinct scholar_id, vol, regexp_replace(lower(canon), '[^a-z0-9]', '', 'g') as key, page from citations join opinions using (scholar_id)
""")
def store_tables(spark, sf_dir):
    """The citation index of records, spellings folded."""
    c = synth.citations(spark, sf_dir)
    held = c.groupBy("scholar_id").agg(F.collect_list(F.concat_ws(" ", "vol", "reporter", "page")).alias("cites"))
    records = synth.opinions(spark, sf_dir).join(held, "scholar_id")
    return store.citations_table(records).select("scholar_id", "vol", "key", "page")


@query(f"""
with {OPINIONS}
select scholar_id, case when party % 3 = 0 then 'note ' || party when party % 3 = 1 then null else court end as court from opinions
""")
def store_attach(spark, sf_dir):
    """A field set on some records and cleared on others."""
    o = synth.opinions(spark, sf_dir)
    facts = o.where("party % 3 < 2").select("scholar_id", F.when(F.col("party") % 3 == 0, F.concat(F.lit("note "), F.col("party").cast("string"))).alias("court"))
    return store.attach(o, facts, "court").select("scholar_id", "court")


@query("""
select p_partkey as scholar_id, case when p_partkey % 2 = 0 then '1 U.S. 2; 93 S. Ct. ' || p_partkey else '1 U.S. 2' end as cites from part
""")
def store_parallel_cites(spark, sf_dir):
    """A parallel citation added to a record that lacks it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scholar_id"), F.array(F.lit("1 U.S. 2")).alias("cites"))
    fact = F.when(F.col("scholar_id") % 2 == 0, F.concat(F.lit("93 S. Ct. "), F.col("scholar_id").cast("string"))).otherwise("1 US 2")
    return store.add_parallel_cite(p, p.select("scholar_id", fact.alias("cite"))).select("scholar_id", F.array_join("cites", "; ").alias("cites"))


@F.pandas_udf(T.StringType())
def _packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: base64.b64encode(gzip.compress(t.encode())).decode())


@query("""
select doc_id, coalesce(text, '') as whole, case when doc_id % 5 = 0 then null else 'x' end as broken from documents
""")
def packed_text(spark, sf_dir):
    """Packed texts read back; what isn't packed gives null."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = d.select("doc_id", _packed("text").alias("p"), F.when(F.col("doc_id") % 5 == 0, "no base64!").otherwise(_packed(F.lit("x"))).alias("q"))
    return rows.select("doc_id", store.unpack("p").alias("whole"), store.unpack("q").alias("broken"))


@query("""
select 'page' as kind, p_size as vol, cast(p_partkey as int) as first, 's' || p_partkey as value from part where p_partkey % 3 = 0
union all select 'volume', p_size, cast(p_partkey as int), cast(p_partkey + 1 as varchar) from part where p_partkey % 3 = 1
union all select 'start', p_size, cast(p_partkey as int), '19' || (p_size + 10) from part where p_partkey % 3 = 2 and p_size < 50
union all select 'start', p_size, cast(p_partkey as int), null from part where p_partkey % 3 = 2 and p_size >= 50
""")
def tagged_index(spark, sf_dir):
    """A tab-separated index whose rows name their kind."""
    path, n, size = _fresh(spark, "index"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    year = F.when(F.col("p_size") < 50, F.concat(F.lit("19"), (F.col("p_size") + 10).cast("string"))).otherwise("unknown")
    line = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("\t", F.lit("p"), size, n, (F.col("p_partkey") + 1).cast("string"), F.lit("7"), F.concat(F.lit("s"), n)))
        .when(F.col("p_partkey") % 3 == 1, F.concat_ws("\t", F.lit("v"), size, n, (F.col("p_partkey") + 1).cast("string")))
        .otherwise(F.concat_ws("\t", F.lit("d"), size, n, year))
    )
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    read = store.read_tagged(spark, path)
    one = lambda t, kind, first, value: t.select(F.lit(kind).alias("kind"), "vol", F.col(first).alias("first"), F.col(value).cast("string").alias("value"))
    return one(read["pages"], "page", "first", "scan").unionByName(one(read["volumes"], "volume", "first", "last")).unionByName(one(read["starts"], "start", "page", "year"))


@query("""
select 'row' as kind, count(*) as n from part where p_partkey % 4 <> 0 union all select 'bad', count(*) from part where p_partkey % 4 = 0
""")
def plain_index(spark, sf_dir):
    """A uniform index, compressed; lines that don't fit it are set aside."""
    path = _fresh(spark, "granules")
    year = F.when(F.col("p_partkey") % 4 == 0, "soon").otherwise("1990")
    table(spark, sf_dir, "part").select(F.concat_ws("\t", F.col("p_size").cast("string"), F.col("p_name"), year).alias("value")).write.option("compression", "gzip").text(path)
    rows, bad = store.read_index(spark, path, "vol int, name string, year int")
    return rows.agg(F.lit("row").alias("kind"), F.count("name").alias("n")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("value").alias("n")))


@query("""
select p_partkey as id, case p_partkey % 3 when 0 then 'U.S.|U. S.|US|U.S. Rep.|United States Reports' when 1 then 'F.2d|F. 2d|Fed. 2d|Fed.2d' else 'Unknown Rep.' end as variants,
       p_partkey % 3 <> 2 or p_partkey % 2 = 0 as is_case, case p_partkey % 3 when 0 then 'us' when 1 then 'f2d' else 'unknownrep' end as key from part
""")
def reporter_spellings(spark, sf_dir):
    """All spellings of a reporter, and whether it reports cases."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    written = F.get(F.array(*map(F.lit, ("u.s.", "FED 2D", "Unknown Rep."))), (F.col("id") % 3).cast("int"))
    odd = F.when((F.col("id") % 3 == 2) & (F.col("id") % 2 == 1), "Harv. L. Rev.").otherwise(written)
    return p.select("id", F.array_join(cites.reporter_variants(written), "|").alias("variants"), cites.is_case_reporter(odd).alias("is_case"), cites.reporter_key(written).alias("key"))


@query("""
select p_partkey as id, '42 U.S.C. §' || chr(160) || p_partkey || ' and ¶' || chr(160) || '3' as bound, 'jurisdiction of part ' || p_partkey as joined, 'a & b "' || p_partkey || '"' as clean,
       'plain |[' || p_partkey || ']| rest' as runs, 'note  and   ' || p_partkey as blanked from part
""")
def text_repairs(spark, sf_dir):
    """Signs bound, words joined, markup read, note marks blanked."""
    n = F.col("p_partkey").cast("string")
    runs = text.mark_runs(F.concat(F.lit("plain <mark>"), n, F.lit("</mark> rest")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        text.bind_signs(F.concat(F.lit("42 U.S.C. § "), n, F.lit(" and ¶  3"))).alias("bound"),
        text.dehyphenate(F.concat(F.lit("juris-\ndiction of part "), n)).alias("joined"),
        text.clean_passage(F.concat(F.lit(" <i>a</i> &amp; b\n &quot;"), n, F.lit("&quot;"))).alias("clean"),
        F.array_join(F.transform(runs, lambda r: F.when(r["hl"], F.concat(F.lit("["), r["text"], F.lit("]"))).otherwise(r["text"])), "|").alias("runs"),
        text.blank_marks(F.concat(F.lit("note¹ and ²³"), n)).alias("blanked"),
    )


@query("""
with s as (select p_partkey as slip_id, p_size % 10 as filed, '19-' || (p_partkey % 40) as docket, p_partkey as seq from part),
w as (select p_partkey as request, p_size % 10 as filed, '19-' || (p_partkey % 40) as docket, p_partkey % 4 as form from part),
m as (select request, slip_id, seq, case when form = 0 then 0 when w.docket = s.docket then 1000 else 0 end as score, form, w.docket = s.docket as same from w join s on w.filed = s.filed)
select request, slip_id, cast(score + 30 as double) as score from m qualify row_number() over (partition by request order by score desc, seq) = 1
""")
def slip_match(spark, sf_dir):
    """The slip opinion of the same date that matches by docket, else by name."""
    part = table(spark, sf_dir, "part")
    docket = F.concat(F.lit("19-"), (F.col("p_partkey") % 40).cast("string"))
    slips = part.select(F.col("p_partkey").alias("slip_id"), (F.col("p_size") % 10).alias("filed"), docket.alias("docket"), F.lit("").alias("cite"), F.lit("Roe v. Wade, Inc.").alias("name"), F.col("p_partkey").alias("seq"))
    asked = part.select(F.col("p_partkey").alias("request"), (F.col("p_size") % 10).alias("filed"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(docket).alias("docket"), F.lit("").alias("cite"), F.lit("ROE v. WADE").alias("name"))
    return resolve.slip_match(asked, slips)


@query("""
with c as (select p_partkey as k, p_size as age, 'old ' || p_partkey as v from part where p_partkey % 3 <> 0), f as (select p_partkey as k, 'new ' || p_partkey as v from part where p_partkey % 4 <> 0)
select coalesce(c.k, f.k) as k, case when age <= 30 then c.v when f.v is not null then f.v else c.v end as v,
       case when age <= 30 then 'cache' when f.v is not null then 'fresh' else 'stale' end as origin from c full join f using (k)
""")
def cache_rows(spark, sf_dir):
    """Cached rows within their time, else fresh ones, else stale ones."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    now = F.timestamp_seconds(F.lit(1_000_000))
    saved = part.where("k % 3 <> 0").select("k", F.concat(F.lit("old "), F.col("k").cast("string")).alias("v"), F.timestamp_seconds(1_000_000 - F.col("p_size")).alias("at"))
    fresh = part.where("k % 4 <> 0").select("k", F.concat(F.lit("new "), F.col("k").cast("string")).alias("v"), now.alias("at"))
    return store.fresh_or_stale(fresh, saved, ["k"], "at", now, 30).select("k", "v", "origin")
