"""Suffix-array dedup of byte strings.

A byte goes if it lies in a string of 200 bytes that also starts anywhere else.
Strings reach their shard inside super-k-mers over bytes (see ``superkmer``):
two equal strings of 200 bytes share their minimiser, so no match is lost
between shards. A super-k-mer that comes alone by its minimiser matches nothing.
In a shard, super-k-mers that share a minimiser are joined into one text, equal
ones entered once with their count. Induced sorting gives its suffix array, and
the permuted common prefixes say which 200-byte strings stand in two of them.

Equal strings of 200 bytes have their minimiser at the same place, so they agree
from some multiple of ``STEP`` bytes before it on, over ``COMMON`` bytes. A
super-k-mer that agrees so with no other of its minimiser matches nothing and stays
out of the text.

Defined cases: a null text is empty. A row without an id loses nothing and hides
nothing. Rows equal in id and text are one document, judged once for all of them;
rows of one id with different texts are different documents. Matches never cross
rows. Empty tables give empty results; columns other than id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import superkmer
from lexloom.llm.sais import common_prefixes, suffix_array
from lexloom.llm.substring import keyed, marked, spans
from lexloom.llm.workers import resting

WINDOW, GRAM, PARTS = 200, 24, 16
SEGMENT = 2 << 20
SHARD = 2 << 20
#: Places before the minimiser that are tried, and the bytes that a match has there.
STEP = 44
COMMON = WINDOW - STEP
#: Bytes that UTF-8 never holds: between strings, and at the end of a shard.
GAP, END = 0xFF, 0xFE


def segments(text: str) -> Iterator[tuple[int, bytes]]:
    raw = text.encode("utf-8", "replace")
    for at in range(0, len(raw) - WINDOW + 1, SEGMENT):
        yield at, raw[at : at + SEGMENT + WINDOW - 1]


SCHEME = superkmer.Scheme(k=WINDOW, m=GRAM, parts=PARTS, words=False, segments=segments)


def settle(pieces, ids, hashes):
    """Equal strings of a flush all go; one of them travels for the others."""
    first: dict[bytes, int] = {}
    many = np.zeros(len(pieces.strings), np.int64)
    lost = []
    rows, starts = pieces.row.tolist(), pieces.start.tolist()
    for x, s in enumerate(pieces.strings):
        y = first.setdefault(s, x)
        if y != x and (starts[x] != starts[y] or ids[rows[x]] != ids[rows[y]] or hashes[rows[x]] != hashes[rows[y]]):
            if not many[y]:
                lost.append(y)
            many[y] = 1
            lost.append(x)
    lost = np.array(lost, np.int64)
    row = pieces.row[lost]
    return np.fromiter(first.values(), np.int64, len(first)), many, (ids[row], hashes[row], pieces.start[lost], pieces.n[lost] + WINDOW - 1)


def resolve(parts: Iterator) -> Iterator[list]:
    seen: dict[bytes, tuple] = {}
    gone: list[tuple[int, int, int, int]] = []
    several: set[int] = set()
    by_key: dict[int, int] = {}
    for table, strings in parts:
        for s, key, i, th, start, n, many, place in zip(strings, *table.tolist(), strict=True):
            mine = (i, th, start, n, key, many, place)
            other = seen.setdefault(s, mine)
            if other is mine:
                if by_key.setdefault(key, 0):
                    several.add(key)
                by_key[key] = 1
                continue
            if mine[:3] == other[:3] and not (many or other[5]):
                continue
            if not many:
                gone.append((i, th, start, n + WINDOW - 1))
            if not other[5]:
                gone.append((other[0], other[1], other[2], other[3] + WINDOW - 1))
                seen[s] = (*other[:5], 1, other[6])
    if gone:
        yield list(zip(*gone, strict=True))
    # Strings that share a minimiser with others stay together in one text.
    rest = sorted(((e[4], s, e) for s, e in seen.items() if e[4] in several), key=lambda x: x[0])
    del seen
    held, size = [], 0
    for _, group in groupby(rest, key=lambda x: x[0]):
        if size > SHARD:
            yield from shard(held)
            held, size = [], 0
        own = meeting(list(group))
        held += own
        size += sum(len(x[1]) + 1 for x in own)
    if held:
        yield from shard(held)


def meeting(group: list[tuple]) -> list[tuple]:
    """Of strings of one minimiser those that can have 200 bytes in common with
    another: a match of which ``left`` bytes lie before the minimiser holds the
    ``COMMON`` bytes from ``left`` rounded down to ``STEP`` before it."""
    keep = bytearray(len(group))
    for left in range(0, WINDOW - GRAM, STEP):
        first: dict[bytes, int] = {}
        for x, (_, s, entry) in enumerate(group):
            at = entry[6] - left
            if at >= 0 and at + COMMON <= len(s):
                y = first.setdefault(s[at : at + COMMON], x)
                if y != x:
                    keep[x] = keep[y] = 1
    return [x for x, k in zip(group, keep, strict=True) if k]


def repeats(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the strings in their joined text, a flag a position: the 200
    bytes from here also start elsewhere in the text)."""
    raw = np.frombuffer(bytes([GAP]).join(strings) + bytes([GAP, END]), np.uint8)
    size = np.array([len(s) for s in strings])
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    text = raw.astype(np.uint16) + 1
    text[-1] = 0
    order = suffix_array(text, 257)
    phi, shared = common_prefixes(raw, order, starts, 2 * WINDOW)
    left = np.repeat(starts + size, size + 1) - np.arange(len(raw) - 1)
    whole = np.append(left >= WINDOW, False)
    hit = np.flatnonzero((shared >= WINDOW) & whole)
    flags = np.zeros(len(raw), bool)
    flags[hit] = True
    flags[phi[hit]] = True
    return starts, flags


def shard(held: list[tuple]) -> Iterator[list]:
    strings = [s for _, s, _ in held]
    starts, flags = repeats(strings)
    gone = []
    for base, (_, _, (i, th, start, n, _, many, _)) in zip(starts.tolist(), held, strict=True):
        own = flags[base : base + n]
        if many or not own.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).tolist()
        gone += [(i, th, start + a, b - a + WINDOW - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    if gone:
        yield list(zip(*gone, strict=True))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, text, spans``: the byte spans of each text that go (null: none)."""
    rows = keyed(docs, id_col, text_col)
    return rows.join(spans(rows, SCHEME, settle, resolve, "byte-spans"), ["id", "th"], "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: suffix-array dedup of the whole of ``documents``."""
    rows = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_gone, n_spans, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "replace")
                n_bytes.append(len(raw))
                gone = runs = 0
                if found.is_valid and len(found.values):
                    flags = marked(len(raw), found)
                    gone = int(flags.sum())
                    runs = int(flags[0]) + int((flags[1:] & ~flags[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~flags].tobytes()
                n_gone.append(gone)
                n_spans.append(runs)
                kept.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_gone, n_spans)), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("id", "text", "spans").mapInArrow(
        resting(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (
  select doc_id, i, md5(array_slice(b, i, i + 199)) as k
  from (select doc_id, b, unnest(generate_series(1, octet_length(b) - 199)) as i from d where octet_length(b) >= 200)
), often as (select k from w group by k having count(*) > 1
), hit as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as opens from w semi join often on w.k = often.k
), part as (select doc_id, i, sum(opens) over (partition by doc_id order by i) as run from hit
), run as (select doc_id, min(i) as a, max(i) + 199 as z from part group by doc_id, run
), cut as (
  select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as a, a - 1 as z from run
  union all select doc_id, max(z) + 1, null from run group by doc_id
), left_over as (
  select d.doc_id, string_agg(case when coalesce(cut.z, octet_length(b)) >= cut.a then hex(array_slice(b, cut.a, coalesce(cut.z, octet_length(b)))) else '' end, '' order by cut.a) as h
  from cut join d using (doc_id) group by d.doc_id
), total as (select doc_id, cast(sum(z - a + 1) as bigint) as n, count(*) as runs from run group by doc_id)
select d.doc_id, octet_length(b) as n_bytes, coalesce(n, 0) as n_removed, coalesce(runs, 0) as n_spans, sha256(case when h is null then b else unhex(h) end) as kept_sha256
from d left join total using (doc_id) left join left_over using (doc_id)
"""
