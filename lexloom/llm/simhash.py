"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are counted bit by bit over word shingles. For the join, each
distinct fingerprint is entered into ``budget + 1`` tries, one a rotation of its
bits. Fingerprints that differ in at most ``budget`` bits agree on the whole top
block of one rotation at least, so the pair meets inside one subtree there, and
each subtree is a bucket for one task. Inside, node pairs go down the trie
together: a step adds the bits in which the two nodes differ, and a pair over
budget is dropped with all below it. A bucket hands on a spanning star for each
local component rather than its pairs; the stars are joined over buckets by
large-star and small-star rounds on DataFrames. At most 2081 distinct
fingerprints lie within two bits of another, which bounds a node's pairs.

Defined cases: a null text has no words and fingerprint zero, linked like any
other. A row without an id gets a fingerprint and no component. Repeated ids
are one document per distinct fingerprint. Empty tables give empty results;
columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.workers import resting
from lexloom.session import stage, unstage

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FRONTIER = 1 << 17
#: Fingerprints of a task of the join.
ROWS = 2_000_000


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(bytes.maketrans(UPPER, LOWER)).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, seed) for g in shingles(text, width)], dtype="<u8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp`` (the unsigned fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(resting(run), "id long, fp long")


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each pair the smaller label, until nothing changes."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            down = labels[labels]
            if np.array_equal(down, labels):
                break
            labels[:] = down


def trie_pairs(keys: np.ndarray, budget: int, top: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct 64-bit keys within ``budget`` bits, for
    keys that agree on their ``top`` leading bits. A trie node is a range of the
    sorted keys; a frontier holds node pairs of one depth, in blocks."""
    if len(keys) < 2:
        return
    group = keys >> np.uint64(64 - top) if top else np.zeros(len(keys), np.uint64)
    cuts = np.flatnonzero(np.diff(group)) + 1
    lo = np.concatenate(([0], cuts))
    hi = np.concatenate((cuts, [len(keys)]))
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(top, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, cost = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            for part in (slice(None, half), slice(half, None)):
                stack.append((depth, alo[part], ahi[part], blo[part], bhi[part], cost[part]))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            near &= i != j
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, cost = (x[~single] for x in (alo, ahi, blo, bhi, cost))
        if not len(alo) or depth == 64:
            continue
        # Where the subtrees' shared bits end, the next level splits each node.
        bit = np.uint64(1) << np.uint64(63 - depth)
        ones = np.concatenate(([0], np.cumsum((keys & bit) != 0)))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = (alo == blo) & (ahi == bhi)
        children = [
            (alo, amid, blo, bmid, cost, None),
            (amid, ahi, bmid, bhi, cost, None),
            (alo, amid, bmid, bhi, cost + 1, None),
            (amid, ahi, blo, bmid, cost + 1, ~same),
        ]
        parts = []
        for a0, a1, b0, b1, c, also in children:
            ok = (a1 > a0) & (b1 > b0) & (c <= budget) & ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
            if also is not None:
                ok &= also
            parts.append([x[ok] for x in (a0, a1, b0, b1, c)])
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(merged[0]):
            stack.append((depth + 1, *merged))


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if not by else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def local_stars(fp: np.ndarray, rep: np.ndarray, budget: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest rep, rep) of each component inside the buckets of ``fp``."""
    order = np.argsort(fp, kind="stable")
    fp, rep = fp[order], rep[order]
    labels = np.arange(len(fp))
    held, size = [], 0
    for pair in trie_pairs(fp, budget, top):
        held.append(pair)
        size += len(pair[0])
        if size > 1 << 20:
            merge_labels(labels, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        merge_labels(labels, *(np.concatenate(x) for x in zip(*held, strict=True)))
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, rep)
    centre = least[labels]
    out = centre != rep
    return centre[out], rep[out]


def links(classes: DataFrame, budget: int = 2) -> DataFrame:
    """Edges ``a, b`` that span the components of each bucket.

    ``classes`` holds ``fp, rep``, one row a distinct fingerprint.
    """
    blocks = budget + 1
    width = 64 // blocks
    entered = classes.select(
        "fp", "rep", F.explode(F.array([F.lit(b) for b in range(blocks)])).alias("turn")
    ).withColumn("top", F.expr(f"shiftrightunsigned(shiftleft(fp, turn * {width}) | shiftrightunsigned(fp, 64 - turn * {width}), {64 - width})"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        fp, rep, turn = (table.column(c).to_numpy() for c in ("fp", "rep", "turn"))
        for t in range(blocks):
            own = turn == t
            a, b = local_stars(_rotate(fp[own].view(np.uint64), t * width), rep[own], budget, width)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # A task holds its rows; their number follows the data.
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * classes.count() // ROWS + 1)
    return entered.repartition(tasks, "turn", "top").select("fp", "rep", "turn").mapInArrow(resting(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge: the smallest node that
    can be reached. Rounds of large-star and small-star; each is staged."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = stage(small, "edges")
        sign = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        unstage(now)
        now = after
        if sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = sign


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """``id, fp, component``."""
    prints = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    classes = stage(classes, "classes")
    found = components(links(classes, budget))
    labelled = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(labelled, "fp", "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprints and components of the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
