"""Resolution operators on small tables that the driver's tables don't have."""

import random
import re
import time

import pytest

from lexloom import catalog
from lexloom.operators import resolve

SHARED = [f"s{k}" for k in range(132)]


@pytest.mark.parametrize("size", [20, 40, 60, 80, 100, 120, 140])
def test_shared_shingles_at_the_floor(spark, size):
    common = SHARED[: size * 55 // 100]
    rows = [(k, common + [f"o{k}x{j}" for j in range(size - len(common))]) for k in range(2)]
    found = resolve.shared_shingles(spark.createDataFrame(rows, "id long, g array<string>"), "id", "g", 0.55).collect()
    assert [(r.a, r.b, r.shared) for r in found] == [(0, 1, len(common))]


def test_shingles_of_all_languages(spark, tmp_path):
    """Every pair and every copy is found, whatever the language."""
    base = {k: " ".join(f"l{k}w{j}" for j in range(40)) for k in range(3)}
    rows = []
    for k, lang in enumerate(("en", "de", None)):
        rows += [(10 * k, base[k], lang), (10 * k + 1, base[k], lang), (10 * k + 2, base[k] + " tail", lang), (10 * k + 3, f"alone a{k} b{k} c{k}", lang)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(r.a, r.b) for r in catalog.queries()["shingle_containment"](spark, str(tmp_path)).collect()}
    classes = {r.doc_id: r.class_id for r in catalog.queries()["shingle_classes"](spark, str(tmp_path)).collect()}
    assert pairs == {(0, 2), (10, 12), (20, 22)}
    assert classes == {d: d - (d % 10 == 1) for d, _, _ in rows}


def brute(rows, n, scoped=False):
    """Sets of ``n``-word shingles and the overlap of two of them, plainly."""
    sets = {}
    for r in rows:
        ws = re.findall("[a-z0-9]+", (r[1] or "").lower())
        sets[r[0]] = frozenset(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return sets, lambda a, b: len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))


def edited(count, seed):
    """Texts with copies and edits, of few and of many words, empty ones and nulls."""
    rng, texts = random.Random(seed), [None, "", "one two", "Ä€ x—Y z0 \U0001f600w K k"]
    while len(texts) < count:
        ws = [f"w{rng.randrange(9 if len(texts) % 5 == 0 else 400)}" for _ in range(rng.choice((7, 30, 90)))]
        for _ in range(rng.choice((1, 2, 5))):
            texts.append(rng.choice((" ", "; ", "\n")).join(w if rng.random() > 0.06 else w.upper() + "x" for w in ws))
            texts.append(" ".join(ws))
    return [(k, t) for k, t in enumerate(texts)]


def test_alike_texts(spark):
    """Equal to all pairs of sets; no string of a text is dealt out."""
    rows = edited(240, 1)
    sets, overlap = brute(rows, 4)
    least = {}
    for k, s in sets.items():
        if s:
            least[s] = min(least.get(s, k), k)
    ids = sorted(least.values())
    want = {(a, b, len(sets[a] & sets[b]), overlap(a, b)) for a in ids for b in ids if a < b and overlap(a, b) >= 0.55}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resolve.alike_texts(docs, "doc_id", "text", 4, 0.55)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


@pytest.mark.parametrize("kind", ["long", "string"])
def test_revisions_of_copies(spark, kind):
    """Many copies on both sides of a date: each old one gets the last new one, and
    copies don't meet each other one by one."""
    rows = [(k, t, (k * 7) % 3, k % 2 == 0, [] if k % 4 < 2 else [str(k % 3)]) for k, t in edited(160, 2)]
    rows += [(1000 + k, " ".join(f"c{j}" for j in range(12)), 5, k % 2 == 0, []) for k in range(6000)]
    sets, overlap = brute(rows[:-6000], 7)
    name = int if kind == "long" else "{:05d}".format
    want = {}
    for a, _, f0, r0, d0 in rows[:-6000]:
        meets = [(overlap(a, b), b) for b, _, f1, r1, d1 in rows[:-6000] if sets[a] and sets[b] and f0 == f1 and not r0 and r1 and not (d0 and d1 and d0 != d1)]
        if meets and max(meets)[0] >= 0.55:
            want[name(a)] = (name(max(meets)[1]), max(meets)[0])
    want |= {name(1000 + k): (name(6998), 1.0) for k in range(1, 6000, 2)}
    records = spark.createDataFrame([(name(k), *r) for k, *r in rows], f"scholar_id {kind}, text string, filed int, reported boolean, dockets array<string>")
    began = time.time()
    got = {r.old_id: (r.new_id, r.similarity) for r in resolve.revisions(records).collect()}
    assert got == want and len(want) > 3010 and time.time() - began < 60
