"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are of type S (smaller than the next) or L. The leftmost S suffixes of
their runs (LMS) are sorted by their substrings and named; where names repeat, the
string of names is sorted by the same function; the order of all suffixes is induced
from theirs, first L from left to right, then S from right to left.

Inducing works on arrays. Letters are taken in batches of neighbours (one letter
each where there are few): a batch's suffixes known so far are put in order, and
their predecessors of the wanted type are dealt to the batches of their letters in
that order. Predecessors inside the batch come after what arrived before it, in the
order of those that they precede; a batch in which those have such predecessors
again is halved, down to a single letter, where they form waves. So the order is
that of a scan one by one, and the number of steps follows the text.
"""

from __future__ import annotations

import numpy as np

#: Up to so many letters each is a batch of its own.
FEW = 512
NONE = np.zeros(0, np.int64)


def batch_width(n: int, size: int) -> int:
    """Letters of a batch: few enough batches to be worth an array each, and enough
    that a batch rarely holds several suffixes in a row."""
    return 1 if size <= FEW else -(-size // max(16, round(2 * n ** (1 / 3))))


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S. The last letter is the only least."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        less, same = text[:-1] < text[1:], text[:-1] == text[1:]
        differs = np.where(same, n - 2, np.arange(n - 1))
        out[:-1] = less[np.minimum.accumulate(differs[::-1])[::-1]]
    return out


def _before(scan: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The predecessors of the wanted type, in order."""
    p = scan[scan > 0] - 1
    return p[want[p]]


def _merged(own: np.ndarray, rest: np.ndarray, key: np.ndarray) -> np.ndarray:
    """By key, and of a key first ``own``, then ``rest``."""
    both = np.concatenate((own, rest))
    last = np.zeros(len(both), np.int64)
    last[len(own) :] = 1
    return both[np.argsort(key[both] * 2 + last, kind="stable")]


def _one_letter(lo: int, own: np.ndarray, rest: np.ndarray, key: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    waves, out, wave = [own], [], own
    while len(wave):
        p = _before(wave, want)
        same = key[p] == lo
        out.append(p[~same])
        wave = p[same]
        if len(wave):
            waves.append(wave)
    out.append(_before(rest, want))
    return np.concatenate(waves), np.concatenate(out)


def _batch(lo: int, hi: int, own: np.ndarray, rest: np.ndarray, key: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One batch of keys: ``own`` are its suffixes of the wanted type in order of
    arrival, ``rest`` those of the other type by key. Gives all of the wanted type,
    by key, and the predecessors that belong to later batches, in order."""
    if hi - lo == 1:
        return _one_letter(lo, own, rest, key, want)
    own = own[np.argsort(key[own], kind="stable")]
    p = _before(_merged(own, rest, key), want)
    inside = p[key[p] < hi]
    if not len(inside):
        return own, p
    again = _before(inside, want)
    if (key[again] < hi).any():
        mid = (lo + hi) // 2
        first, out = _batch(lo, mid, own[key[own] < mid], rest[key[rest] < mid], key, want)
        here = key[out] < hi
        second, further = _batch(mid, hi, np.concatenate((own[key[own] >= mid], out[here])), rest[key[rest] >= mid], key, want)
        return np.concatenate((first, second)), np.concatenate((out[~here], further))
    own = np.concatenate((own, inside))
    own = own[np.argsort(key[own], kind="stable")]
    p = _before(_merged(own, rest, key), want)
    return own, p[key[p] >= hi]


def _scan(key: np.ndarray, size: int, start: np.ndarray, rest: np.ndarray, want: np.ndarray) -> np.ndarray:
    """All suffixes of the wanted type, by key: ``start`` are known from the
    beginning, ``rest`` are those of the other type, by key."""
    # A letter that follows itself makes rows of any length, so it is a batch of its own.
    alone = np.unique(key[1:][key[1:] == key[:-1]])
    edges = np.unique(np.concatenate((np.arange(0, size, batch_width(len(key), size)), alone, alone + 1, [size])))
    edges = edges[edges <= size]
    batch_of = np.searchsorted(edges, np.arange(size), side="right") - 1
    batches = len(edges) - 1
    queue: list[list[np.ndarray]] = [[] for _ in range(batches)]

    def deal(found: np.ndarray) -> None:
        if not len(found):
            return
        to = batch_of[key[found]]
        order = np.argsort(to, kind="stable")
        found, to = found[order], to[order]
        parts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
        for x, y in zip(parts, parts[1:], strict=False):
            queue[to[x]].append(found[x:y])

    deal(start)
    cuts = np.searchsorted(key[rest], edges)
    limits = edges.tolist()
    out = []
    for b in range(batches):
        arrived = np.concatenate(queue[b]) if queue[b] else NONE
        queue[b] = []
        others = rest[cuts[b] : cuts[b + 1]]
        if len(arrived) or len(others):
            own, further = _batch(limits[b], limits[b + 1], arrived, others, key, want)
            out.append(own)
            deal(further)
    return np.concatenate(out) if out else NONE


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes from that of the LMS suffixes ``seeds``."""
    letters = text.astype(np.int64)
    large = _scan(letters, size, NONE, seeds, ~is_s)
    back = size - 1 - letters
    small = _scan(back, size, np.array([len(text) - 1]), large[::-1], is_s)
    return _merged(large, small[::-1], letters)


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, by place in the text, and how many."""
    rank = np.empty(len(text), np.int64)
    rank[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms) + 1, 1)[rank[order]]
    a, b = order[:-1], order[1:]
    same = length[:-1] == length[1:]
    live, step = np.flatnonzero(same), 0
    while len(live):
        ok = text[a[live] + step] == text[b[live] + step]
        same[live[~ok]] = False
        live = live[ok]
        step += 1
        live = live[length[live] > step]
    names = np.concatenate(([0], np.cumsum(~same)))
    out = np.empty(len(lms), np.int64)
    out[rank[order]] = names
    return out, int(names[-1]) + 1


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """``text`` ends in the only 0; letters are below ``size``."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    is_s = types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    seeds = lms[np.argsort(text[lms], kind="stable")]
    found = induce(text, is_s, seeds, size)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    names, count = _names(text, lms, found[is_lms[found]])
    order = np.argsort(names) if count == len(lms) else suffix_array(names, count)
    return induce(text, is_s, lms[order], size)


def common_prefixes(raw: np.ndarray, order: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each position, the suffix before it in the order and the
    length of their common prefix, up to ``limit`` past a start.

    A position whose letter before equals that before its phi has one less than
    the position before it; the others, and ``starts``, are compared eight bytes
    at a time. ``raw`` are the bytes, whose last is unlike all others.
    """
    n = len(raw)
    phi = np.empty(n, np.int64)
    phi[order[1:]], phi[order[0]] = order[:-1], -1
    p = np.arange(n)
    derived = (p > 0) & (phi > 0)
    derived[derived] = (raw[p[derived] - 1] == raw[phi[derived] - 1]) & (phi[p[derived] - 1] == phi[derived] - 1)
    derived[starts] = False
    at = np.flatnonzero(~derived & (phi >= 0))
    padded = np.concatenate((raw, np.zeros(limit + 16, np.uint8)))
    eight = np.ndarray((n + limit + 8,), "<u8", padded, strides=(1,))
    value = np.zeros(n, np.int64)
    a, b, live = at, phi[at], np.arange(len(at))
    found = np.full(len(at), limit, np.int64)
    for step in range(0, limit, 8):
        x = eight[a[live] + step] ^ eight[b[live] + step]
        ends = x != 0
        low = x[ends] & (~x[ends] + np.uint64(1))
        found[live[ends]] = step + (np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        live = live[~ends]
        if not len(live):
            break
    value[at] = found
    source = np.maximum.accumulate(np.where(derived, 0, p))
    return phi, np.maximum(value[source] - (p - source), 0)
