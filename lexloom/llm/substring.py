"""Substring dedup by super-k-mers over word windows.

A window is 20 words in a row. A word goes if it lies in a window whose words
also start earlier: in a smaller document, or earlier in the same one. Windows
reach their bucket inside super-k-mers (see ``superkmer``). In a bucket, equal
strings are all settled but the earliest; strings of one minimiser that differ
are opened into windows, which are sorted, and of equal windows all but the first
settle their words.

Defined cases: a null text has no words. A row without an id loses nothing and
hides nothing. Rows of one id are ordered by a hash of their text, and rows equal
in both are one document, judged once for all of them. Empty tables give empty
results; columns other than id and text are kept by ``remove_repeats`` and
ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import superkmer
from lexloom.llm.workers import resting
from lexloom.session import stage

WINDOW, GRAM = 20, 4
SEGMENT_WORDS = 200_000


def segments(text: str) -> Iterator[tuple[int, bytes]]:
    words = text.encode("utf-8", "replace").split()
    for at in range(0, len(words) - WINDOW + 1, SEGMENT_WORDS):
        yield at, b" ".join(words[at : at + SEGMENT_WORDS + WINDOW - 1])


SCHEME = superkmer.Scheme(k=WINDOW, m=GRAM, parts=WINDOW - GRAM + 1, words=True, segments=segments)


def settle(pieces, ids, hashes):
    """Of equal strings in a flush the earliest travels; the others go whole,
    but those of rows equal in id and text, which are one document."""
    best: dict[bytes, int] = {}
    order = np.lexsort((pieces.start, hashes[pieces.row], ids[pieces.row])) if len(pieces.row) else np.zeros(0, int)
    lost = []
    strings = pieces.strings
    rows, starts = pieces.row.tolist(), pieces.start.tolist()
    for x in order.tolist():
        y = best.setdefault(strings[x], x)
        if y != x and (starts[x] != starts[y] or ids[rows[x]] != ids[rows[y]] or hashes[rows[x]] != hashes[rows[y]]):
            lost.append(x)
    chosen = np.fromiter(best.values(), np.int64, len(best))
    lost = np.array(lost, np.int64)
    row = pieces.row[lost]
    return chosen, np.zeros(len(strings), np.int64), (ids[row], hashes[row], pieces.start[lost], pieces.n[lost] + WINDOW - 1)


def resolve(parts: Iterator) -> Iterator[list[list[int]]]:
    best: dict[bytes, tuple[int, int, int, int, int]] = {}
    gone: list[tuple[int, int, int, int]] = []
    for table, strings in parts:
        for s, key, i, th, start, n in zip(strings, *table[:5].tolist(), strict=True):
            mine = (i, th, start, n, key)
            other = best.setdefault(s, mine)
            if other is mine:
                continue
            if mine[:3] < other[:3]:
                best[s], mine = mine, other
            elif mine[:3] == other[:3]:
                continue
            gone.append((mine[0], mine[1], mine[2], mine[3] + WINDOW - 1))
    groups: dict[int, list[bytes]] = {}
    for s, entry in best.items():
        groups.setdefault(entry[4], []).append(s)
    for own in groups.values():
        if len(own) < 2:
            continue
        windows = []
        for s in own:
            i, th, start, n, _ = best[s]
            gaps = np.flatnonzero(np.frombuffer(s, np.uint8) == 32).tolist()
            begins, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(s)]
            windows += [(s[begins[j] : ends[j + WINDOW - 1]], i, th, start + j) for j in range(n)]
        windows.sort()
        for before, now in zip(windows, windows[1:], strict=False):
            if before[0] == now[0]:
                gone.append((*now[1:], WINDOW))
    if gone:
        yield list(zip(*gone, strict=True))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, text``: th tells apart rows of one id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def spans(docs: DataFrame, scheme, settle_fn, resolve_fn, name: str) -> DataFrame:
    """``id, th, spans`` (array of start and n) of a table from ``keyed``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = superkmer.dealt(docs, scheme, settle_fn, resolve_fn, total)
    return stage(found, name).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, text, spans``: the word spans of each text that go (null: none)."""
    rows = keyed(docs, id_col, text_col)
    return rows.join(spans(rows, SCHEME, settle, resolve, "word-spans"), ["id", "th"], "left")


def marked(n: int, found: pa.Scalar) -> np.ndarray:
    """A flag for each of ``n`` tokens: does it lie in a span?"""
    edges = np.zeros(n + 1, np.int64)
    items = found.values
    a, m = (items.field(c).to_numpy(zero_copy_only=False) for c in range(2))
    np.add.at(edges, a, 1)
    np.add.at(edges, np.minimum(a + m, n), -1)
    return np.cumsum(edges[:-1]) > 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: substring dedup of the whole of ``documents``."""
    rows = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_gone, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode("utf-8", "replace").split()
                n_words.append(len(words))
                gone = 0
                if found.is_valid and len(found.values):
                    flags = marked(len(words), found)
                    gone = int(flags.sum())
                    words = [w for w, f in zip(words, flags.tolist(), strict=True) if not f]
                n_gone.append(gone)
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return rows.select("id", "text", "spans").mapInArrow(resting(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text``: each text's words that stay, joined by blanks."""
    rows = repeated(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode("utf-8", "replace").split()
                if found.is_valid and len(found.values):
                    words = [w for w, f in zip(words, marked(len(words), found).tolist(), strict=True) if not f]
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["id", "text"])

    return rows.select("id", "text", "spans").mapInArrow(resting(run), "id long, text string")


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), win as (
  select doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') as k
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 19)) as i from w where len(ws) >= 20)
), late as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from win) where r > 1
), gone as (
  select distinct doc_id, unnest(generate_series(i, i + 19)) as p from late
), word as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w
), kept as (
  select word.doc_id, count(*) as n, string_agg(word, ' ' order by word.p) as text
  from word left join gone on word.doc_id = gone.doc_id and word.p = gone.p where gone.p is null group by word.doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""
