"""Super-k-mers: runs of windows that share a minimiser travel as one string.

A window is ``k`` tokens in a row. Its minimiser is the leftmost of its grams of
``m`` tokens with the smallest hash, so equal windows have equal minimisers at the
same place in the window. Consecutive windows with the same minimiser occurrence
make one super-k-mer: a packed string of their tokens, sent to the bucket of the
minimiser's hash. Equal windows therefore meet in one bucket.

Before the shuffle, equal strings of one flush (``FLUSH`` bytes of text) are
combined: one of them travels, the others are settled on the spot. A minimiser
that comes with many different strings is hot (a shared passage in ever new
surroundings). A first pass finds those over the whole table, from the strings whose
hash falls into one of ``ONE_IN`` classes, and their windows are dealt anew: windows
of words by a hash of the whole window, windows of bytes by the minimiser's place
and by the least grams in two further orders. Equal windows still meet, and cutting
changes which strings travel, not which windows are compared, so the list of hot
minimisers may be cut off at ``HOT`` entries.

A bucket of more than ``HOLD`` unpacked bytes is settled in several rounds, each over
the minimisers of one class; what waits is compressed.

Hashes route; strings are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.workers import resting

FLUSH = 2 << 20
BUCKET_BYTES = 16 << 20
#: Hot minimisers: how many at most, from how many different strings on, and the
#: share of the strings that is counted.
HOT, HOT_STRINGS, ONE_IN = 10_000, 4096, 64
HOLD = 48 << 20
SCHEMA = "bucket int, blob binary, id long, th long, start long, n long"
U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    out, span = a, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out


def least_at(a: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """The least mixed value of the ``w`` from each of the sorted places ``at``, each
    stretch of places on its own."""
    cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
    parts = [sliding_min(mix(a[at[x] : at[y - 1] + w]), w) for x, y in zip(cuts, cuts[1:], strict=False)]
    return np.concatenate(parts)


class Powers:
    """Powers of the hash base and of its inverse, as long as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, FLUSH + (1 << 16))
            self.up, self.down = np.full(n, _B, U), np.full(n, _B_INVERSE, U)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)
        return self.up, self.down


@dataclass
class Scheme:
    """What tokens and windows are. ``segments`` yields (first token, bytes) of a
    text, each holding whole windows; tokens are words between blanks or bytes."""

    k: int
    m: int
    parts: int
    words: bool
    segments: Callable[[str], Iterator[tuple[int, bytes]]]


@dataclass
class Pieces:
    """Super-k-mers of one flush; ``row`` is the number of the text, ``place`` that
    of the minimiser's first byte in the string (words: 0, not used)."""

    key: np.ndarray
    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    place: np.ndarray
    strings: list[bytes]
    content: np.ndarray


def cut(scheme: Scheme, held: list[tuple[int, int, bytes]], powers: Powers, hot: np.ndarray, counting: bool = False) -> Pieces:
    """Super-k-mers of the held segments (row, first token, bytes). For ``counting``
    with a hash of each in place of its string."""
    k, m = scheme.k, scheme.m
    raw = (b"\n" if scheme.words else b"\xff").join(s for _, _, s in held)
    buffer = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(s) for _, _, s in held])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    up, down = powers.get(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, U)
    np.cumsum((buffer.astype(U) + U(1)) * up[: len(buffer)], out=sums[1:])
    if scheme.words:
        gaps = np.flatnonzero((buffer == 32) | (buffer == 10))
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(buffer)]))
        first = np.searchsorted(starts, begins)
        counts = np.diff(np.concatenate((first, [len(starts)])))
        gram = (sums[ends[m - 1 :]] - sums[starts[: len(starts) - m + 1]]) * down[starts[: len(starts) - m + 1]]
    else:
        starts, ends, first, counts = None, None, begins, sizes
        gram = (sums[m:] - sums[:-m]) * down[: len(buffer) - m + 1]
    gram = mix(gram)
    place = (gram & ~U((1 << 28) - 1)) | np.arange(len(gram), dtype=U)
    at = (sliding_min(place, k - m + 1) & U((1 << 28) - 1)).astype(np.int32)
    del place
    # A window counts where it lies inside its segment.
    windows = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(held), dtype=np.int32), windows)
    offset = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(windows) - windows).astype(np.int32), windows)
    window = first.astype(np.int32)[owner] + offset
    minimiser = at[window]
    key = gram[minimiser]
    new = np.ones(len(window), bool)
    if len(window):
        new[1:] = (minimiser[1:] != minimiser[:-1]) | (owner[1:] != owner[:-1])
        if len(hot):
            where = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            is_hot = hot[where] == key
            if is_hot.any():
                at_hot = window[is_hot]
                if scheme.words:
                    again = (sums[ends[at_hot + k - 1]] - sums[starts[at_hot]]) * down[starts[at_hot]]
                else:
                    span = -(-(k - m + 1) // scheme.parts)
                    again = ((minimiser[is_hot] - at_hot) // span).astype(U)
                    for turn in (1, 2):
                        again = mix(again + least_at(gram + U(turn), at_hot, k - m + 1))
                key[is_hot] = mix(key[is_hot] + again)
                new[1:] |= is_hot[1:] & (key[1:] != key[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.concatenate((head, [len(window)])))
    a, b = window[head], window[head] + n + k - 2
    lo, hi = (starts[a], ends[b]) if scheme.words else (a, b + 1)
    content = mix((sums[hi] - sums[lo]) * down[lo]) if counting else np.zeros(0, U)
    strings = [] if counting else [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
    owner = owner[head]
    rows = np.array([r for r, _, _ in held])
    bases = np.array([o for _, o, _ in held])
    inside = np.zeros(len(head), np.int64) if scheme.words else (minimiser[head] - a).astype(np.int64)
    return Pieces(key[head], rows[owner], bases[owner] + offset[head], n, inside, strings, content)


def flushes(scheme: Scheme, batches: Iterator[pa.RecordBatch], hot: np.ndarray, counting: bool = False) -> Iterator[tuple[Pieces, np.ndarray, np.ndarray]]:
    """Pieces of flush after flush, with the ids and text hashes of their rows."""
    powers = Powers()
    held: list[tuple[int, int, bytes]] = []
    ids: list[int] = []
    hashes: list[int] = []
    size = 0
    for batch in batches:
        for i, th, text in zip(*(batch.column(c) for c in range(3)), strict=True):
            i, th = i.as_py(), th.as_py()
            if i is None:
                continue
            ids.append(i)
            hashes.append(th)
            for base, raw in scheme.segments(text.as_py() or ""):
                held.append((len(ids) - 1, base, raw))
                size += len(raw) + 1
                if size >= FLUSH:
                    yield cut(scheme, held, powers, hot, counting), np.array(ids), np.array(hashes)
                    held, size = [], 0
            if not held and len(ids) > 1:
                ids, hashes = [], []
    if held:
        yield cut(scheme, held, powers, hot, counting), np.array(ids), np.array(hashes)


def hot_keys(docs: DataFrame, scheme: Scheme) -> np.ndarray:
    """Minimisers with ``HOT_STRINGS`` different strings or more, as far as one
    string in ``ONE_IN`` tells; the most frequent ``HOT`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, _, _ in flushes(scheme, batches, np.zeros(0, U), True):
            own = np.flatnonzero(pieces.content % U(ONE_IN) == 0)
            found = np.unique(np.stack((pieces.key[own], pieces.content[own])), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["key", "content"])

    rows = docs.mapInArrow(resting(run), "key long, content long").distinct().groupBy("key").agg(F.count("*").alias("n"))
    rows = rows.where(F.col("n") >= HOT_STRINGS // ONE_IN)
    keys = [r["key"] for r in rows.orderBy(F.desc("n"), "key").limit(HOT).collect()]
    return np.sort(np.array(keys, np.int64).view(U))


def pack(pieces: Pieces, ids: np.ndarray, hashes: np.ndarray, many: np.ndarray, chosen: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, compressed blob) of the chosen pieces."""
    bucket = (pieces.key[chosen] % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    chosen, bucket = chosen[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for part in np.split(chosen, edges):
        if not len(part):
            continue
        own = [pieces.strings[x] for x in part.tolist()]
        row = pieces.row[part]
        table = np.stack(
            [pieces.key[part].view(np.int64), ids[row], hashes[row], pieces.start[part], pieces.n[part], many[part], pieces.place[part] << 32 | np.array([len(s) for s in own])]
        ).astype(np.int64)
        # Columns, byte by byte of each number, compress better than rows.
        head = np.ascontiguousarray(table.view(np.uint8).reshape(7, -1, 8).transpose(0, 2, 1)).tobytes()
        raw = len(own).to_bytes(8, "little") + head + b"".join(own)
        yield int(pieces.key[part[0]] % U(buckets)), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The seven columns (key, id, hash, start, n, many, place) and the strings."""
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    table = np.array(np.frombuffer(raw, np.uint8, n * 56, 8).reshape(7, 8, n).transpose(0, 2, 1), order="C").view(np.int64).reshape(7, n)
    ends = (np.cumsum(table[6] & 0xFFFFFFFF) + 8 + n * 56).tolist()
    table[6] >>= 32
    return table, [raw[a:b] for a, b in zip([8 + n * 56, *ends[:-1]], ends, strict=True)]


def rounds(blobs: list[bytes]) -> Iterator[Iterator[tuple[np.ndarray, list[bytes]]]]:
    """A bucket's columns and strings, in as many rounds as its size asks for; a
    minimiser's strings are all in one of them."""
    n = -(-sum(int.from_bytes(b[:8], "little") for b in blobs) // HOLD)

    def part(turn: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        for blob in blobs:
            table, strings = unpack(blob)
            if n > 1:
                own = np.flatnonzero((table[0].view(U) >> U(40)) % U(n) == U(turn))
                table, strings = table[:, own], [strings[k] for k in own.tolist()]
            yield table, strings

    return (part(turn) for turn in range(n))


def dealt(docs: DataFrame, scheme: Scheme, settle: Callable, resolve: Callable, total_bytes: int) -> DataFrame:
    """``id, th, start, n``: token spans that go, by text.

    ``settle(pieces, ids, hashes)`` combines a flush: it gives the pieces that
    travel, a flag a piece (stands for several equal ones) and the spans settled.
    ``resolve(parts)`` yields the spans settled in a bucket.
    """
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_keys(docs, scheme))
    buckets = max(8, -(-total_bytes * 7 // 2 // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, ids, hashes in flushes(scheme, batches, hot.value):
            chosen, many, spans = settle(pieces, ids, hashes)
            packed = list(pack(pieces, ids, hashes, many, chosen, buckets))
            if packed:
                none = pa.nulls(len(packed), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary()), none, none, none, none],
                    names=["bucket", "blob", "id", "th", "start", "n"],
                )
            if len(spans[0]):
                to = pa.array((spans[0] % buckets).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [to, pa.nulls(len(to), pa.binary()), *(pa.array(x.astype(np.int64)) for x in spans)],
                    names=["bucket", "blob", "id", "th", "start", "n"],
                )

    def settle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def out(spans):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in spans], names=["id", "th", "start", "n"])

        for batch in batches:
            done = batch.filter(batch.column(1).is_null())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(c) for c in range(2, 6)], names=["id", "th", "start", "n"])
            batch = batch.filter(batch.column(1).is_valid())
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and blobs:
                    for part in rounds(blobs):
                        yield from map(out, resolve(part))
                    blobs = []
                now = b
                blobs.append(blob)
        for part in rounds(blobs):
            yield from map(out, resolve(part))

    sent = docs.mapInArrow(resting(send), SCHEMA).repartition(min(buckets, 1 << 20), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(resting(settle_buckets), "id long, th long, start long, n long")
