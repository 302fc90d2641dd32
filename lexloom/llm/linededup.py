"""Line dedup across documents with DataFrame functions only.

Lines are hashed to 128 bits and the table of (hash, document, position) is
range-partitioned by hash with a secondary sort by document and position, so a
running window streams over each hash and names its first document. What comes
back per document is a sparse bitmap of dropped lines (60 lines a word, words
without a drop left out), never text.

Hot lines. A frequent-items sketch names at most ``HOT_LINES`` hashes. Those go
round the sorted table: their first document comes from an aggregation that
combines on the map side, and is broadcast (at most ``HOT_LINES`` rows). Both
ways are exact, whatever the sketch names.

Defined cases: a null text is one empty line. A row without an id is kept whole
and hides no other line. Rows that repeat an id count as one document, each is
judged on its own lines. An empty table gives an empty result. Columns other
than id and text are kept by the stage, whatever their names, and ignored
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.session import stage

HOT_LINES = 1000
WORD = 60
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; ASCII strings take the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``id, text_hash, drops``: array of (word, mask), one bit a dropped line.

    Only documents that lose a line have a row.
    """
    key = ascii_lower(F.btrim("line", F.lit(STRIP)))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where("id is not null")
        .select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "text_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "text_hash", "pos")
    )
    rows = stage(rows, "lines")
    hot = F.broadcast(
        rows.agg(F.expr(f"approx_top_k(h1, {HOT_LINES}, {HOT_LINES * 10})").alias("top"))
        .select(F.explode("top").alias("t"))
        .where("t.count > 1")
        .select(F.col("t.item").alias("h1"))
    )
    cold = rows.join(hot, "h1", "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    run = Window.partitionBy("h1", "h2").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    cold = cold.withColumn("first", F.first("id").over(run))
    warm = rows.join(hot, "h1", "left_semi")
    firsts = warm.groupBy("h1", "h2").agg(F.min("id").alias("first"))
    warm = warm.join(F.broadcast(firsts), ["h1", "h2"])
    keep = ["id", "text_hash", "pos", "first"]
    return (
        cold.select(keep)
        .unionByName(warm.select(keep))
        .where("id > first")
        .groupBy("id", "text_hash", F.expr(f"pos div {WORD}").cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("mask"))
        .groupBy("id", "text_hash")
        .agg(F.collect_list(F.struct("word", "mask")).alias("drops"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``row`` (struct of all columns of ``docs``), ``n_lines, n_dropped`` and
    ``kept`` (text)."""
    drops = line_drops(docs, id_col, text_col, min_chars).select("id", "text_hash", F.map_from_entries("drops").alias("drops"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(drops, ["id", "text_hash"], "left")
    own = F.col(f"row.`{text_col}`")

    def stays(_, i):
        mask = F.coalesce(F.element_at("drops", (i / F.lit(WORD)).cast("int")), F.lit(0).cast("long"))
        return F.call_function("getbit", mask, i % F.lit(WORD)) == 0

    kept = F.when(F.col("drops").isNull(), F.coalesce(own, F.lit(""))).otherwise(F.array_join(F.filter(_lines(own), stays), "\n"))
    lost = F.aggregate(F.map_values("drops"), F.lit(0).cast("long"), lambda n, m: n + F.bit_count(m))
    return joined.select(
        "row",
        F.size(_lines(own)).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0).cast("long")).alias("n_dropped"),
        kept.alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: line dedup over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its repeated lines gone."""
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    old = {c: F.col(f"row.`{c}`") for c in docs.columns}
    return dedup_lines(docs).select(
        *[(F.when(changed, new[c]).otherwise(x) if c in new else x).alias(c) for c, x in old.items()]
    )


SQL = r"""
with l as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
        from documents)
), f as (
  select key, min(doc_id) as first from l where length(key) >= 10 group by key
), m as (
  select l.doc_id, l.pos, l.line, coalesce(l.doc_id > f.first, false) as gone
  from l left join f on l.key = f.key
)
select doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
