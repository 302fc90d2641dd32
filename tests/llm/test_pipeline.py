"""The pipeline's stages, each against what it should do to planted rows."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import nearstage

WORDS = [f"w{k}" for k in range(300)]


def test_near_dedup_keeps_one_of_a_group(spark):
    base = " ".join(WORDS)
    near = " ".join(w if k not in (50, 150) else f"x{k}" for k, w in enumerate(WORDS))
    clean = [" ".join(f"v{j}x{k}" for k in range(200)) for j in range(20)]
    texts = [base, near, base, *clean, "", None]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in nearstage.near_dedup_stage(spark, docs, "").collect())
    assert kept == [0, *range(3, 24)]


def test_stages_and_columns(spark, tmp_path):
    base = " ".join(WORDS)
    rows = [(k, f"{base} tail{k}" if k < 2 else " ".join(f"d{k}w{j}" for j in range(40)), "en", "s", 1) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"d7w{j}" for j in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    left = {r.doc_id: r.text for r in now.collect()}
    assert set(left) == set(range(30)) - {1} and left[7].startswith("d7w12 ") and left[8] == rows[8][1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 29


def near_fixture():
    """Texts with copies that have a block appended, cut or replaced, or words
    changed here and there, around a similarity of 0.8 on both sides."""
    rng = np.random.default_rng(11)
    texts = []
    for size, vocabulary in ((60, 40), (300, 200), (300, 10_000), (900, 60)):
        for _ in range(6):
            ws = [f"w{x}" for x in rng.integers(0, vocabulary, size)]
            fresh = [f"z{x}" for x in rng.integers(0, 1 << 30, size)]
            texts.append(ws)
            for share in (0.05, 0.1, 0.15, 0.2, 0.24, 0.26, 0.3):
                k = int(size * share)
                texts += [ws + fresh[:k], ws[k:], ws[: size // 2] + fresh[: k // 2] + ws[size // 2 + k // 2 :]]
            for k in (1, 2, 4, 7, 9):
                at = set(rng.choice(size, k * size // 300 + 1, replace=False).tolist())
                texts.append([fresh[j] if j in at else w for j, w in enumerate(ws)])
    return [" ".join(ws) for ws in texts]


def near_brute(texts):
    grams = [{tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for ws in map(str.split, texts)]
    return {(i, j) for i in range(len(grams)) for j in range(i + 1, len(grams)) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])}


def test_near_pairs_against_all_pairs(spark):
    texts = near_fixture()
    want = near_brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    counts = nearstage.histograms(docs).cache()
    often = nearstage.share(spark, nearstage.frequent(docs))
    met = nearstage.buckets(nearstage.entries(docs, often), 4)
    own = met.withColumn("own", met.rep).join(counts.select("rep", "bits"), "rep")
    got = {(r.a, r.b) for r in nearstage.similar(nearstage.candidates(own, 4, 1, None), counts, docs).collect()}
    assert len(want) > 400 and got == want


def test_near_groups_against_all_pairs(spark):
    texts = near_fixture()
    label = list(range(len(texts)))
    pairs = near_brute(texts)
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component for r in nearstage.groups(docs).collect()} == dict(enumerate(label))


def test_near_dedup_of_a_repeated_id(spark):
    """Rows of one id with different texts are different documents."""
    one, two = ([f"{c}{k}" for k in range(200)] for c in "ab")
    near = lambda ws: " ".join(w if k != 90 else "other" for k, w in enumerate(ws))
    rows = [(1, " ".join(one), "x"), (1, " ".join(two), "x"), (2, near(one), "x"), (3, near(two), "x"), (4, "c d", "x"), (None, " ".join(one), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    assert sorted((r.id, r.component) for r in nearstage.groups(docs).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = nearstage.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 4]


CLASHES = ("_runs", "_items", "_n_words", "_score", "_id", "_hash", "_drops", "_kept", "_th", "id", "th", "row", "text_hash", "h1", "h2", "drops", "n_lines", "kept", "rep", "toxic")


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns with the names that stages use inside stay as they are and change nothing."""
    base = " ".join(WORDS)
    rows = [(k, f"{base} tail{k}\nshared line of text {k % 3}" if k % 4 == 0 else " ".join(f"d{k}w{j}" for j in range(40)) + "\nshared line of text 1", "en", "s", 1) for k in range(12)]
    rows += [(None, None, None, None, None), (3, "", "en", "s", 0)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, " ".join(f"d7w{j}" for j in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = plain.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    show = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, more, str(tmp_path))
        assert out.columns == more.columns, name
        assert show(out) == show(step(spark, plain, str(tmp_path))), name
        assert {tuple(r) for r in out.select(*CLASHES).distinct().collect()} == {("clash",) * len(CLASHES)}, name
    last = corpus_pipeline.STAGES[-1][1](spark, more, str(tmp_path))
    assert last.count() == len(rows)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, str(tmp_path)).count() == 0, name
