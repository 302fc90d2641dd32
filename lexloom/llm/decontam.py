"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items go into one suffix automaton over word numbers. The
words of a document stream through it; the matching length after each word says
how many words end there that also stand in some item. A window is ``window``
item words; a match of that length or more covers them all. An item of fewer
words is one window and counts where its last word is reached in a state whose
suffix chain holds that whole item.

Stretches in which no window can lie are not walked: every two neighbours of a
window of two words or more are neighbours in some item, so a stretch ends
where the automaton knows no such pair.

Items are taken in blocks of at most ``BLOCK_WORDS`` words. One automaton at a
time stands on the driver and in a broadcast; with several blocks, each block's
hits are written as rows of the texts that have any, by a 128-bit hash of the
text, and its broadcast goes before the next block is read. A last pass joins
the hits by that hash. With one block, one pass does all.

Defined cases: null and empty texts and items have no words. Rows without an id
are judged like others. Repeated rows are judged one by one. Repeated items count
once for an id. An item without an id hits words like any other; all such items
together count as one item, which has no name in the list. With no items no word
is hit. Columns other than id and text are kept by the stage, whatever their
names, and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.workers import resting
from lexloom.session import share, shared, stage

BLOCK_WORDS = 1_000_000
WINDOW = 10


def _table() -> bytes:
    """A-Z to lower case; ASCII that is neither a letter nor a digit to a blank."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isascii() and c.isalnum() else 32
    return bytes(out)


TABLE = _table()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton of word-number sequences."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items = [name for name, _ in items]
        numbered = []
        for _, seq in items:
            numbered.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in seq])
        for seq in numbered:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        ends: dict[int, set[int]] = {}
        whole: dict[int, set[int]] = {}
        for k, seq in enumerate(numbered):
            state = 0
            for n, w in enumerate(seq, 1):
                state = self.next[state][w]
                ends.setdefault(state, set()).add(k)
                if n == len(seq) and n < window:
                    whole.setdefault(state, set()).add(k)
        self._finish(ends, whole, numbered)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(-1)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def _finish(self, ends, whole, numbered) -> None:
        """Per state: the items whose windows end there, and the short items
        whose whole sequence is a suffix there, as (length, item)."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        # A window ends in one chain of states; its items stand at the chain's
        # shortest state that is as long as a window, and nowhere else.
        top = [0] * len(self.next)
        for s in reversed(order):
            if self.length[s] >= self.window:
                top[s] = top[self.link[s]] or s
        self.top = top
        self.holders: dict[int, set[int]] = {}
        for s, ks in ends.items():
            if top[s]:
                self.holders.setdefault(top[s], set()).update(ks)
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in reversed(order):
            above = self.short.get(self.link[s], ())
            own = tuple((len(numbered[k]), k) for k in sorted(whole.get(s, ())))
            if above or own:
                self.short[s] = above + own
        self.least = min((len(seq) for seq in numbered if seq), default=0)
        self.least = min(self.least, self.window)
        self.singles = any(len(seq) == 1 for seq in numbered)
        base = len(self.vocabulary) + 1
        pairs = {a * base + b for seq in numbered for a, b in zip(seq, seq[1:], strict=False)}
        self.base, self.pairs = base, np.array(sorted(pairs), dtype=np.int64)

    def hits(self, seq: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """A flag a word, and the items with an occurring window."""
        flags = np.zeros(len(seq) + 1, dtype=np.int32)
        found: set[int] = set()
        if not self.least or len(seq) < self.least:
            return flags[:-1].astype(bool), found
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in seq], dtype=np.int64)
        if self.singles:
            stretches = np.flatnonzero(ids)
            cut = np.flatnonzero(np.diff(stretches) != 1) + 1
            parts = [(p[0], p[-1] + 1) for p in np.split(stretches, cut) if len(p)]
        else:
            known = ids[:-1] * self.base + ids[1:]
            known[(ids[:-1] == 0) | (ids[1:] == 0)] = -1
            at = np.searchsorted(self.pairs, known)
            at[at == len(self.pairs)] = 0
            ok = np.flatnonzero(self.pairs[at] == known) if len(self.pairs) else np.zeros(0, np.int64)
            cut = np.flatnonzero(np.diff(ok) != 1) + 1
            need = self.least - 1
            parts = [(p[0], p[-1] + 2) for p in np.split(ok, cut) if len(p) >= need and len(p)]
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for begin, end in parts:
            state, matched = 0, 0
            for i, w in enumerate(ids[begin:end].tolist(), int(begin)):
                while state and w not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    matched += 1
                if matched >= window:
                    flags[i + 1 - matched] += 1
                    flags[i + 1] -= 1
                    found |= self.holders[self.top[state]]
                for n, k in self.short.get(state, ()):
                    if n <= matched:
                        flags[i + 1 - n] += 1
                        flags[i + 1] -= 1
                        found.add(k)
        return np.cumsum(flags[:-1]) > 0, found


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """One automaton a block of items, in the order of their ids. Items reach
    the driver one partition at a time and leave it as automata."""
    held, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    for row in rows.toLocalIterator():
        seq = words(row["text"])
        if not seq:
            continue
        if held and size + len(seq) > block_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((row["id"], seq))
        size += len(seq)
    if held:
        yield Automaton(held, window)


def _runs(flags: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge.tolist()


Judged = tuple[list[int], list[np.ndarray], list[set]]


def _judge(automaton: Automaton, texts: list[str | None]) -> Judged:
    """Number of words, flags and names of the items of each text."""
    counts, flags, names = [], [], []
    for text in texts:
        seq = words(text)
        own, ks = automaton.hits(seq)
        counts.append(len(seq))
        flags.append(own)
        names.append({automaton.items[k] for k in ks})
    return counts, flags, names


def _block_hits(texts: DataFrame, automaton: Automaton) -> DataFrame:
    """``h1, h2, runs, items`` of the texts that a block's items hit, staged."""
    held = share(texts.sparkSession, automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(held)
        for batch in batches:
            _, flags, names = _judge(own, batch.column(2).to_pylist())
            hit = [k for k, f in enumerate(flags) if f.any()]
            runs = pa.array([_runs(flags[k]) for k in hit], pa.list_(pa.int32()))
            items = pa.array([list(names[k]) for k in hit], pa.list_(pa.string()))
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), runs, items], names=["h1", "h2", "runs", "items"])

    found = texts.mapInArrow(resting(run), "h1 long, h2 long, runs array<int>, items array<string>")
    out = stage(found.groupBy("h1", "h2").agg(F.first("runs").alias("runs"), F.first("items").alias("items")), "block-hits")
    held.unpersist()
    return out


def _through(docs: DataFrame, text_col: str, blocks: Iterator[Automaton], window: int, finish: Callable, schema) -> DataFrame:
    """``finish(batch of docs, texts, judged)`` over all rows of ``docs``."""
    one = next(blocks, None) or Automaton([], window)
    other = next(blocks, None)
    at = docs.columns.index(text_col)
    if other is None:
        held = share(docs.sparkSession, one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared(held)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield finish(batch, texts, _judge(own, texts))

        return docs.mapInArrow(resting(run), schema)
    text = F.col(f"`{text_col}`")
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    texts = docs.select(*hashes, text.alias("text"))
    found = [_block_hits(texts, one)]
    del one
    while other is not None:
        found.append(_block_hits(texts, other))
        other = next(blocks, None)
    every = reduce(DataFrame.unionByName, found).groupBy("h1", "h2").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    rows = docs.select(F.struct("*").alias("row"), *hashes).join(every, ["h1", "h2"], "left").select("row", "runs", "items")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.RecordBatch.from_struct_array(batch.column(0))
            texts = row.column(at).to_pylist()
            counts = [len(words(t)) for t in texts]
            flags = []
            for n, runs in zip(counts, batch.column(1).to_pylist(), strict=True):
                flags.append(np.zeros(n, bool))
                for a, b in zip((runs or ())[::2], (runs or ())[1::2], strict=True):
                    flags[-1][a:b] = True
            yield finish(row, texts, (counts, flags, [set(x or ()) for x in batch.column(2).to_pylist()]))

    return rows.mapInArrow(resting(joined), schema)


def _runs(flags: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge.tolist()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id, n_words, runs`` (begin and end word of each hit run, flat) and
    ``items`` (ids with an occurring window; null stands for those without one)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def finish(batch: pa.RecordBatch, _, judged: Judged) -> pa.RecordBatch:
        counts, flags, names = judged
        runs = pa.array([_runs(f) for f in flags], pa.list_(pa.int32()))
        listed = pa.array([list(x) for x in names], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, listed], names=["id", "n_words", "runs", "items"])

    blocks = automata(items, window=window, block_words=block_words)
    return _through(docs, "text", blocks, window, finish, f"id {kind}, n_words long, runs array<int>, items array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: contamination of the whole of ``documents`` by ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = F.expr("aggregate(transform(runs, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (n, x) -> n + x)")
    return (
        contamination(docs, items)
        .withColumn("n_hit", n_hit)
        .select(
            F.col("id").alias("doc_id"),
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, min_words: int = WINDOW, max_share: float = 0.8, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the spans of ``min_words`` hit words or more (a run made
    of short whole items counts too), and without documents of which more than
    ``max_share`` is hit. A span goes with the blanks that follow it."""
    at = docs.columns.index(text_col)
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def finish(batch: pa.RecordBatch, before: list[str | None], judged: Judged) -> pa.RecordBatch:
        texts, keep = list(before), []
        columns = list(batch.columns)
        sizes = columns[size].to_pylist() if size is not None else None
        for i, (n, flags) in enumerate(zip(*judged[:2], strict=True)):
            hit = int(flags.sum())
            keep.append(hit <= max_share * n)
            if hit and keep[-1]:
                texts[i] = _without(before[i], _runs(flags))
                if sizes:
                    sizes[i] = len(texts[i])
        columns[at] = pa.array(texts, pa.string())
        if sizes is not None:
            columns[size] = pa.array(sizes, columns[size].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    blocks = automata(items, window=min_words, block_words=block_words)
    return _through(docs, text_col, blocks, min_words, finish, docs.schema)


def _without(text: str, runs: list[int]) -> str:
    """The text without the words of the runs and what stands between them."""
    raw = text.encode("utf-8", "replace")
    flat = np.frombuffer(raw.translate(TABLE), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False])).astype(np.int8)))
    starts, ends = edge[::2].tolist(), edge[1::2].tolist()
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
        while at < len(raw) and raw[at : at + 1] == b" ":
            at += 1
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), win as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') as k
  from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) as i from b where len(ws) > 0)
), sizes as (select distinct n from win
), d as (
  select doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as k
  from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from w, sizes where len(ws) >= n)
), m as (select d.doc_id, d.i, d.n, win.item_id from d join win on d.n = win.n and d.k = win.k
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from m) group by doc_id
), its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id
)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, coalesce(hit.n_hit, 0) as n_hit, coalesce(its.n_items, 0) as n_items,
       sha256(coalesce(its.items, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated
from w left join hit using (doc_id) left join its using (doc_id)
"""
