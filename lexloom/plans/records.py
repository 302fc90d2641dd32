"""Records of the store from opinions' pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import captions, dates, text
from lexloom.plans import extract

#: Letters of a page in which its header's citation stands.
HEADER = 8192


def from_pages(pages: DataFrame, key: str) -> DataFrame:
    """``key, scholar_id, name, cite, decided``: the id in the address, the caption,
    the first citation of the header, and its labelled date. ``pages``: key, url,
    html."""
    head = text.clean_passage(F.left("html", F.lit(HEADER)))
    name = text.clean_passage(F.regexp_extract("html", r'(?is)<h3[^>]*id="gsl_case_name"[^>]*>(.*?)</h3>', 1))
    rows = pages.select(key, captions.identity(F.col("url")).alias("scholar_id"), name.alias("name"), head.alias("head"))
    dated = F.regexp_extract("head", r"(?i)\b(?:decided|filed|released|entered)\b[:,]?\s+((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})", 1)
    found = extract.links(rows.select(F.col(key).alias("doc_id"), F.col("head").alias("text"))).where("kind = 'cite'")
    first = found.groupBy("doc_id").agg(F.min_by(F.concat_ws(" ", "vol", "reporter", "page"), "start").alias("cite"))
    return rows.join(first.withColumnRenamed("doc_id", key), key, "left").select(key, "scholar_id", "name", "cite", dates.long_date(dated).alias("decided"))
