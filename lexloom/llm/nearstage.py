"""Near-duplicates for the pipeline: SimHash tries, completed by an exact join.

Near copies share five-word shingles with a Jaccard similarity of 0.8 or more.
Links come from two sources, and each is decided on the whole sets of shingles:

* SimHash over the five-word shingles and the binary trie self-join of ``simhash``
  within ``BUDGET`` bits, which finds most near copies with one small row a text.
* What lies beyond that budget. Shingles are 64-bit hashes, in one order for all
  texts: those that a sample of texts often holds come last, the others by hash.
  Of two sets that are similar enough, the larger has a common shingle among its
  first fifth in that order, and the smaller among its first ninth, so texts meet
  in buckets by these shingles. In a bucket, pairs go that their sizes or the
  places of the common shingle rule out; none of these rules loses a pair.

Groups are the components of the links; the document with the smallest id of a
group stays. Equal texts (equal lower-cased words) are one class before any join,
so a large group of copies enters once. The trie's links are decided first, then
neighbours by size in the buckets, then those further apart (``REACH``), and each
round takes only pairs whose texts are in different components so far, so a large
group of near copies gives few pairs and not the square of its size.

The texts of the classes are written once. Pairs first meet with histograms of
their shingles (counts by the hash's first byte): the smaller counts add up to at
least what two sets share, so pairs that fall short go without a loss. Shingle sets
are made only for the texts of the pairs that are left.

Defined cases: texts without words are copies of each other; a text of fewer than
five words is one shingle. Rows without an id stay. Rows that repeat an id and a
text are one document and stay or go together; rows of one id with different texts
are different documents. Columns other than doc_id and text are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import simhash
from lexloom.llm.simhash import LOWER, UPPER, components
from lexloom.llm.superkmer import mix
from lexloom.llm.workers import resting
from lexloom.session import share, shared, stage, unstage

WIDTH, BUDGET = 5, 3
#: Texts whose shingles are counted for the order, and how many are kept as frequent.
SAMPLE, FREQUENT = 8_000, 1 << 16
#: Rows of a task, and classes of shingles by which pairs are ruled out early.
ROWS, BITS = 2_000_000, 512
#: How far apart by size the texts of a round's pairs are, in their buckets.
REACH = ((1, 1), (2, 8), (9, None))
#: Pairs of sets that are in a Python worker at once.
BATCH = 256
#: A list of texts to look up is broadcast up to so many rows (16 bytes each).
LOOKUP = 1_000_000
#: A count that may be larger than it says; such a pair is not ruled out.
FULL = 65535
U = np.uint64


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(bytes.maketrans(UPPER, LOWER)).split()


def _grams(words: list[bytes]) -> np.ndarray:
    """The shingles by hash, repeats included, in the order of the text."""
    if not words:
        return np.zeros(0, U)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], U)
    n = max(1, len(hashes) - WIDTH + 1)
    grams = np.zeros(n, U)
    for k in range(min(WIDTH, len(hashes))):
        grams = mix(grams + hashes[k : k + n] + U(k + 1))
    return grams


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles by hash, in the order of the hashes."""
    return np.unique(_grams(_words(text)))


def profiles(docs: DataFrame) -> DataFrame:
    """``id, th, c1, c2, fp`` of ``id, th, text``: two hashes of the words, and the
    SimHash of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, prints = [], []
            for text in batch.column(2):
                words = _words(text.as_py())
                whole.append(xxhash.xxh3_128_intdigest(b" ".join(words)))
                prints.append(simhash.majority(_grams(words)))
            c1, c2 = ([(x >> by & (1 << 64) - 1) - (1 << 63) for x in whole] for by in (64, 0))
            fp = np.array(prints, U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(fp)], names=["id", "th", "c1", "c2", "fp"])

    return docs.mapInArrow(resting(run), "id long, th long, c1 long, c2 long, fp long")


def sets(texts: DataFrame) -> DataFrame:
    """``rep, grams`` of ``rep, text``, without texts that have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "grams"])
            yield out.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    return texts.mapInArrow(resting(run), "rep long, grams binary")


def frequent(texts: DataFrame) -> np.ndarray:
    """Shingles that a sample of the texts holds often, the rarer first. Only the
    order of shingles depends on it, and so the work, but no result."""
    every = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], names=["gram"])

    part = texts.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("text").mapInArrow(resting(run), "gram long")
    top = part.groupBy("gram").count().where("count > 2").orderBy(F.desc("count"), "gram").limit(FREQUENT).select("gram")
    return top.toArrow().column(0).to_numpy().view(U)[::-1]


def probe_length(n):
    """How many first shingles of the larger set meet one of the smaller's."""
    return n - (4 * n + 4) // 5 + 1


def index_length(n):
    """How many first shingles of the smaller set are enough for that."""
    return n - (8 * n + 8) // 9 + 1


def entries(texts: DataFrame, often) -> DataFrame:
    """``gram, rep, n, place``: each set's first shingles, its size, their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared(often)
        by = np.argsort(last, kind="stable")
        known = last[by]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                grams, reps, sizes, places = [], [], [], []
                for rep, text in zip(batch.column(0)[at : at + 512].to_pylist(), batch.column(1)[at : at + 512], strict=True):
                    g = shingles(text.as_py())
                    n = len(g)
                    if not n:
                        continue
                    k = probe_length(n)
                    if len(known):
                        where = np.minimum(np.searchsorted(known, g), len(known) - 1)
                        common = known[where] == g
                        if common.any():
                            g = np.concatenate((g[~common], g[common][np.argsort(by[where[common]], kind="stable")]))
                    grams.append(g[:k])
                    reps.append(np.full(k, rep, np.int64))
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
                if not reps:
                    continue
                columns = [np.concatenate(x) for x in (grams, reps, sizes, places)]
                columns[0] = columns[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "rep", "n", "place"])

    return texts.select("rep", "text").mapInArrow(resting(run), "gram long, rep long, n int, place int")


def _sorted(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """The columns of a partition, by gram, size and rep."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return None
    table = pa.Table.from_batches(rows)
    found = {c: table.column(c).to_numpy() for c in table.column_names if c != "bits"}
    if "bits" in table.column_names:
        found["bits"] = np.frombuffer(b"".join(table.column("bits").to_pylist()), U).reshape(-1, BITS // 64)
    order = np.lexsort((found["rep"], found["n"], found["gram"]))
    return {c: x[order] for c, x in found.items()}


def buckets(rows: DataFrame, tasks: int) -> DataFrame:
    """Of ``entries`` those whose gram more than one text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _sorted(batches)
        if found is None:
            return
        same = found["gram"][1:] == found["gram"][:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        names = ["gram", "rep", "n", "place"]
        yield pa.RecordBatch.from_arrays([pa.array(found[c][many]) for c in names], names=names)

    return rows.repartition(tasks, "gram").mapInArrow(resting(run), "gram long, rep long, n int, place int")


def candidates(rows: DataFrame, tasks: int, nearest: int, furthest: int | None) -> DataFrame:
    """Pairs ``a, b`` that may be similar, of texts in one bucket and in different
    components (column ``own``), from ``nearest`` to ``furthest`` places apart by
    size (null: however far). A class that only one of two texts has (column
    ``bits``) stands for a shingle that the other lacks, so pairs with too many of
    those go without a loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _sorted(batches)
        if found is None:
            return
        gram, rep, n, place, own, bits = (found[c] for c in ("gram", "rep", "n", "place", "own", "bits"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        # The smaller of a pair comes first, and meets with its first ninth.
        small = np.flatnonzero(place < index_length(n))
        step = 1
        while len(small) and (furthest is None or step <= furthest):
            small = small[small + step < len(gram)]
            other = small + step
            # Sizes only grow from here, so a text too large ends the search.
            ok = (gram[small] == gram[other]) & (5 * n[small] >= 4 * n[other])
            small, other = small[ok], other[ok]
            if step >= nearest:
                most = np.minimum(place[small], place[other]) + 1 + np.minimum(n[small] - place[small], n[other] - place[other]) - 1
                good = (9 * most >= 4 * (n[small] + n[other])) & (own[small] != own[other])
                i, j = small[good], other[good]
                lacks = [np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1).astype(np.int64) for x, y in ((i, j), (j, i))]
                good = 9 * np.minimum(n[i] - lacks[0], n[j] - lacks[1]) >= 4 * (n[i] + n[j])
                a, b = rep[i[good]], rep[j[good]]
                if len(a):
                    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            step += 1

    return rows.repartition(tasks, "gram").mapInArrow(resting(run), "a long, b long").distinct()


def histograms(texts: DataFrame) -> DataFrame:
    """``rep, counts, bits`` of texts that have words: how many shingles begin with
    each byte, as 256 16-bit numbers, and which of ``BITS`` classes they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bits = [], []
            for text in batch.column(1):
                grams = shingles(text.as_py())
                counts = np.bincount((grams >> U(56)).astype(np.int64), minlength=256)
                found.append(np.minimum(counts, FULL).astype(np.uint16).tobytes() if len(grams) else None)
                classes = np.zeros(BITS, bool)
                classes[(grams % U(BITS)).astype(np.int64)] = True
                bits.append(np.packbits(classes).tobytes())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(bits, pa.binary())], names=["rep", "counts", "bits"])
            yield out.filter(out.column(1).is_valid())

    return texts.mapInArrow(resting(run), "rep long, counts binary, bits binary")


def possible(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs that the histograms don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, 256).astype(np.int64) for k in (2, 3))
                most = np.minimum(x, y).sum(axis=1)
                keep = (9 * most >= 4 * (x.sum(axis=1) + y.sum(axis=1))) | (x == FULL).any(axis=1) | (y == FULL).any(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    x, y = (counts.select(F.col("rep").alias(c), F.col("counts").alias(f"c{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ca", "cb").mapInArrow(resting(run), "a long, b long")


def chosen(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The texts of the listed reps."""
    reps = stage(reps.distinct(), "reps")
    small = reps.count() <= LOOKUP
    return texts.join(F.broadcast(reps) if small else reps, "rep", "left_semi").select("rep", "text")


def similar(pairs: DataFrame, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a similarity of 0.8 or more, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                ga, gb = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(ga, gb, assume_unique=True))
                keep.append(9 * both >= 4 * (len(ga) + len(gb)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stage(possible(pairs, counts), "possible")
    held = stage(sets(chosen(texts, pairs.select(F.explode(F.array("a", "b")).alias("rep")))), "sets")
    x, y = held.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), held.select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "ga", "gb")
    conf, key = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH))
    try:
        return stage(both.mapInArrow(resting(run), "a long, b long"), "similar")
    finally:
        conf.set(key, before)
        unstage(held)
        unstage(pairs)


def links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` of similar texts, of the same components as all of them.
    ``texts`` (``rep, text``) is a staged table, which goes; ``prints`` holds
    ``rep, fp``."""
    classes = prints.groupBy("fp").agg(F.min("rep").alias("rep"))
    same = prints.join(classes.withColumnRenamed("rep", "b"), "fp").select(F.col("rep").alias("a"), "b").where("a <> b")
    near = simhash.links(classes, BUDGET).unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = stage(near.distinct(), "near")
    often = share(texts.sparkSession, frequent(texts))
    # A text has about a shingle for six letters, and enters with a fifth of them.
    letters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), letters // 30 // ROWS + 1)
    met = stage(buckets(entries(texts, often), tasks), "met")
    meeting = met.select("rep").union(near.select("a")).union(near.select("b"))
    counts = stage(histograms(chosen(texts, meeting)), "histograms")
    found = similar(near, counts, texts)
    for nearest, furthest in REACH:
        joined = components(found)
        own = met.join(joined, met.rep == joined.node, "left").select("gram", "rep", "n", "place", F.coalesce("component", "rep").alias("own"))
        pairs = candidates(own.join(counts.select("rep", "bits"), "rep"), tasks, nearest, furthest)
        found = found.unionByName(similar(pairs, counts, texts))
        unstage(joined)
    for done in (near, met, counts, texts):
        unstage(done)
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, component``: the smallest id of each document's group."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = stage(profiles(rows), "profiles")
    reps = found.groupBy("c1", "c2").agg(F.min(F.struct("id", "th", "fp")).alias("r")).select(F.col("c1").alias("rep"), "r.id", "r.th", "r.fp")
    reps = stage(reps, "reps")
    texts = stage(rows.join(reps.select("rep", "id", "th"), ["id", "th"]).dropDuplicates(["id", "th"]).select("rep", "text"), "texts")
    joined = components(links(texts, reps.select("rep", "fp")))
    labelled = found.join(joined, found.c1 == joined.node, "left").select("id", "th", F.coalesce("component", "c1").alias("label"))
    least = labelled.groupBy("label").agg(F.min("id").alias("component"))
    return labelled.join(least, "label").select("id", "th", "component")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest id stays."""
    gone = groups(docs).where("id <> component").select("id", "th").distinct()
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), th.alias("th"))
    return rows.join(gone, ["id", "th"], "left_anti").select("row.*")
