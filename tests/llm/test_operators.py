"""Each operator against a brute-force version on small tables with odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe, decontam, fingerprint, linededup, pii, sais, simhash, substring, suffixdedup, toxicity, urlfilter

BASE = " ".join(f"w{k} alpha{k % 7}" for k in range(60))
TEXTS = [
    BASE,
    BASE.replace("w30", "other"),
    BASE,
    None,
    "",
    "short",
    "a b c\n  Shared LINE of text \nx\nshared line of text\n\n",
    "shared line of text\nshared line of text",
    "é" * 130 + " Ünïcode " + "日本" * 80,
    "é" * 130 + " ünïcode " + "日本" * 80,
    "ab " * 200,
    "mail me@x.org or +1 (22) 333-4444, 10.0.0.256 1.2.3.4 x 4242 4242 4242 4242",
]


def table(spark, texts=TEXTS, first=0):
    rows = [(first + k, t, "en", f"s{k % 2}", 7, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, h1 string")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    table(spark).repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(1, " ".join(f"w{k} alpha{k % 7}" for k in range(8))), (2, "Short"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    table(spark).limit(0).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("module", [pii, linededup, urlfilter, toxicity, decontam, fingerprint, substring, suffixdedup, simhash, bpe])
def test_empty_tables(spark, empty, module):
    assert module.query(spark, empty).count() == 0


def test_line_dedup(spark, sf):
    strip = lambda s: s.strip(" \t\n\x0b\x0c\r")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    lines = [(t or "").split("\n") for t in TEXTS]
    first = {}
    for i, ls in enumerate(lines):
        for x in ls:
            k = lower(strip(x))
            if len(k) >= 10:
                first.setdefault(k, i)
    want = {}
    for i, ls in enumerate(lines):
        kept = [x for x in ls if first.get(lower(strip(x)), i) == i]
        want[i] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.query(spark, sf).collect()}
    assert got == want


def test_decontamination(spark, sf):
    got = {r.doc_id: r for r in decontam.query(spark, sf).collect()}
    assert got[0].n_hit == 16 and got[0].contaminated and got[0].items_sha256 == sha("1")
    assert got[5].n_hit == 1 and got[5].items_sha256 == sha("2")
    assert got[3].n_words == 0 and not got[3].contaminated and got[11].n_hit == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: r.text for r in decontam.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert 5 not in left and left[0].startswith("w8 alpha1 w9") and left[11] == TEXTS[11] and left[3] is None


def test_automaton_against_all_windows():
    rng = np.random.default_rng(4)
    items = [(str(k), [b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 9))]) for k in range(8)]
    for window in (2, 4):
        a = decontam.Automaton(items, window)
        for _ in range(60):
            doc = [b"%d" % x for x in rng.integers(0, 4, rng.integers(0, 30))]
            flags, names = np.zeros(len(doc), bool), set()
            for name, seq in items:
                n = min(window, len(seq))
                wins = {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)}
                for i in range(len(doc) - n + 1):
                    if tuple(doc[i : i + n]) in wins:
                        flags[i : i + n] = True
                        names.add(name)
            got, found = a.hits(doc)
            assert got.tolist() == flags.tolist() and {a.items[k] for k in found} == names


def test_substring_dedup(spark, sf):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        ws = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", t or "") if w]
        gone = set()
        for k in range(len(ws) - 19):
            w = tuple(ws[k : k + 20])
            if w in seen:
                gone |= set(range(k, k + 20))
            seen.add(w)
        kept = [w for k, w in enumerate(ws) if k not in gone]
        want[i] = (len(ws), len(gone), sha(" ".join(kept)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.query(spark, sf).collect()} == want


def test_suffix_dedup(spark, sf):
    raw = [(t or "").encode() for t in TEXTS]
    count = collections.Counter(x[k : k + 200] for x in raw for k in range(len(x) - 199))
    want = {}
    for i, x in enumerate(raw):
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if count[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i] = (len(x), int(gone.sum()), runs, sha(bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.query(spark, sf).collect()} == want


@pytest.mark.parametrize("width", [None, 1, 7, 500])
def test_induced_sorting(monkeypatch, width):
    """With batches as usual, of one letter, of few, and of all."""
    if width:
        monkeypatch.setattr(sais, "batch_width", lambda n, size: width)
    rng = np.random.default_rng(2)
    for size in (2, 3, 60, 400):
        for n in (0, 1, 5, 80, 300):
            text = np.append(rng.integers(1, size, n), 0).astype(np.uint16)
            assert sais.suffix_array(text, size).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
    text = np.array([1, 2] * 90 + [0], np.uint16)
    assert sais.suffix_array(text, 3).tolist() == sorted(range(181), key=lambda i: text[i:].tolist())


def test_simhash(spark, sf):
    import xxhash

    def fp(t):
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        ws = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", ws) if w]
        grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fp(t) for t in TEXTS]
    label = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in enumerate(prints)}


def test_trie_pairs_against_all_pairs():
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    keys = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centre]))
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(keys, 2) for i, j in zip(np.minimum(a, b), np.maximum(a, b), strict=True)}
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 2}
    assert got == want


def test_fingerprints(spark, sf):
    t = [x or "" for x in TEXTS]
    edited = [x[: len(x) - len(x) // 2] + t[(k + 1) % len(t)][: len(x) // 2] for k, x in enumerate(t)]
    got = {r.doc_id: r for r in fingerprint.query(spark, sf).collect()}
    assert [got[k].edited_sha256 for k in range(len(t))] == [sha(x) for x in edited]
    assert got[0].fingerprint == got[2].fingerprint and got[3].fingerprint == got[4].fingerprint == ""
    assert got[3].near_next == 1.0 and got[2].near_next == 0.0 and got[0].near_next > 0.5


def test_pii(spark, sf):
    got = {r.doc_id: r for r in pii.query(spark, sf).collect()}
    r = got[11]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.startswith("email:5:13,ip:")
    assert got[3].spans == "" and got[3].base_sha256 == sha("")


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def pii_brute(text):
    """The contract's base spans by plain patterns."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if holds(m.group())] for k, (p, holds) in kinds.items()}


def test_pii_base_spans_against_plain_patterns(spark, tmp_path):
    rng = np.random.default_rng(5)
    parts = ["a", "b@", "@c.d", ".", "-", "+", "1", "22", "4242", " ", "\n", "(", ")", "é", "日", "255", "256.", "0", "x.y@z.co.uk", "+1 (22) 333-4444", "4242 4242 4242 4242", "1.2.3.4"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(1500)] + [None, "", "@", "+", "1" * 5000 + " " + "9.9." * 900]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.query(spark, str(tmp_path)).collect():
        want = pii_brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want.values()], texts[r.doc_id]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, x in want.items() for a, b in x)), texts[r.doc_id]
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{a}:{b}" for k, x in want.items() for a, b in x}


def test_pii_learns_patterns(spark):
    """Words on the left, shape, and words on the right; and a fifth kind."""
    texts = [f"foo badge number {k}.{k}.2.3 end" for k in range(1, 60)] + ["the badge number 77-xk-99 end", "another word 77-zz-98 here"]
    key = lambda k: sha(str(k))[:40]
    texts += [f"some words {4539148803436400 + k} to say" for k in range(200)] + [f'x token = "{key(k)}"' for k in range(20)] + [f'y token = "{key(3).upper()}"!!', "version 3 of 2020"]
    rows = {r.id: r.added for r in pii.extract(table(spark, texts)).collect()}
    assert [(a.kind, a.start, a.end) for a in rows[59]] == [("ip", 17, 25)] and rows[60] == []
    assert all(rows[k] == [] for k in range(59)) and [(a.kind, a.start, a.end) for a in rows[261]] == [("secret", 11, 51)]
    assert [(a.kind, a.start, a.end) for a in rows[281]] == [("secret", 11, 51)] and rows[282] == []


def test_pii_long_text(spark):
    """Many identifiers in one text: all found, and at a cost about in proportion."""
    n = 20_000
    text = " ".join(f"10.0.{k % 256}.{k // 256 % 256} a{k}@x.org w{k}" for k in range(n))
    found = pii.base_spans(table(spark, [text]), "doc_id", "text").select(F.size("ip"), F.size("email"), F.size("seen")).first()
    assert tuple(found) == (n, n, 3 * n)


def test_url_filter(spark):
    pages = [
        (1, "https://Example.com/en/77?x", None), (2, "http://a.net/de/1", '<a href="http://good.org/x">'), (3, "http://b.org/es/2", ""),
        (4, "http://bad.org/fr/", '<a href="//b.org/q">'), (5, None, "x"), (6, "no url", "x"), (7, "http://good.org/fr/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df).collect()}
    assert got[1] == ("example.com", "/en/77", "example.com/en/7", "allow") and got[2][2:] == ("net/de/", "allow")
    assert got[3][2:] == ("org/es/", "block") and got[4][3] == "block" and got[7][3] == "allow"
    assert got[5] == ("", "", None, "allow") and got[6][:2] == ("", "")


def test_url_ranks_against_power_iteration(spark):
    """Trust and distrust on a random host graph, and the verdicts that follow."""
    rng = np.random.default_rng(6)
    hosts = [f"h{k}.net" for k in range(40)]
    links = [(int(a), int(b)) for a, b in rng.integers(0, 40, (160, 2)) if a != b]
    pages, n = [], np.zeros((40, 40))
    for k, (a, b) in enumerate(links):
        path = {0: "de/x", 1: "xx"}[a % 2] if a % 5 else "de/"
        pages.append((k, f"http://{hosts[a]}/{path}", f'<a href="http://{hosts[b]}/y">'))
        n[a, b] += 1
    rules = (("allow", "h0.net/"), ("allow", "h5.net/"), ("block", "h1.net/"), ("block", "h7.net/"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: (r.trust, r.distrust, r.host_verdict) for r in urlfilter.host_verdicts(df, rules, tolerance=1e-9).collect()}
    want = {}
    for kind, seeds, m in (("trust", (0, 5), n), ("distrust", (1, 7), n.T)):
        seed = np.array([sum(a == k for a, _ in links) if k in seeds else 0 for k in range(40)], float)
        seed /= seed.sum()
        out = m.sum(axis=1, keepdims=True)
        move = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        rank = seed.copy()
        for _ in range(300):
            rank = 0.15 * seed + 0.85 * (rank @ move)
        want[kind] = rank
    for k, host in enumerate(hosts):
        trust, distrust = want["trust"][k], want["distrust"][k]
        if trust + distrust > 1e-12:
            assert np.allclose(got[host][:2], (trust, distrust), atol=1e-7), host
            if abs(trust - distrust) > 1e-6:
                assert got[host][2] == ("block" if distrust > trust else "allow")
        else:
            assert host not in got or max(got[host][:2]) < 1e-7
    verdicts = {(r.host, r.rule is None): r.verdict for r in urlfilter.filter_urls(df, rules, tolerance=1e-9).collect()}
    assert {v for (h, free), v in verdicts.items() if not free} == {"allow", "block"} and verdicts["h1.net", False] == "block"


def test_toxicity(spark):
    texts = [f"you are a total zorgle{k % 3} friend" if k % 2 else "a calm and quiet day at the sea" for k in range(400)] + [None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(docs, labels)
    rows = {r.id: r.score for r in toxicity.score(docs, grammar).collect()}
    assert all((rows[k] >= 0.5) == bool(k % 2) for k in range(400)) and rows[400] == rows[401] < 0.5


def test_toxicity_grammar():
    grammar = toxicity.Grammar({"zorg": 4.0, "blah$": 3.5})

    def labels(text):
        return {name: round(x, 2) for (name, _, _), x in zip(toxicity.LABELS, grammar.features(text), strict=True) if x}

    assert labels("you zorgle") == labels("the zorgling is you") == {"targeted": 4.0}
    assert labels("zorgle, zorgle zorg") == {"insult": 4.0} and labels("zorgle. A zorg") == {"insult": 8.0}
    assert labels("not a zorgle") == {"negated": 4.0} and labels("blah blahx") == {"insult": 3.5}
    assert labels('he said zorgle') == labels('a "zorgle" b') == {"reported": 4.0}
    assert labels("i will kill") == labels("you might kill them") == {"threat": 4.0} and labels("kill time") == {}
    score = lambda t: float(grammar.score(np.array([grammar.features(t)]))[0])
    assert score("you zorgle") > score("zorgle") > score("not a zorgle") and score("zorgle") > score("he said zorgle") > score("")
    long = ("word " * 400_000 + ". ") + "you zorgle. " * 3 + "x" * 3_000_000
    assert labels(long) == {"targeted": 12.0}
    # The composed transducer gives what the chain gives one by one.
    rng = np.random.default_rng(3)
    for _ in range(200):
        clause = "".join(rng.choice(list("IKTNRWQo"), 12))
        for machines, table in ((toxicity.AFTER, grammar.after), (toxicity.BEFORE, grammar.before)):
            out = clause
            for m in machines:
                left, now = 0, ""
                for c in out:
                    left, c = m.step(left, c)
                    now += c
                out = now
            assert "".join(toxicity.run(table, clause)) == out


def test_bpe_matches_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library, ours = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.read_vocabulary(path))
    texts = [*TEXTS, "a<|endoftext|>b", "Σας İstanbul ß ﬀ x²", "don't I'LL 12ab  …—", "\x00\x1c z", "q" * 3000]
    for text, (n, ids, decoded) in zip(texts, ours.encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, BASE), (1, BASE), (None, BASE), (2, BASE), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None, None), (1, "http://a.b/c", "x"), (None, "http://a.b/c", "x"), (1, "http://a.b/c", "x"), (2, "", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for module in (pii, linededup, urlfilter, toxicity, decontam, fingerprint, substring, suffixdedup, simhash, bpe):
        assert module.query(spark, str(tmp_path)).count() == 5, module.__name__
    kept = {(r.doc_id, r.n_removed) for r in substring.query(spark, str(tmp_path)).collect()}
    assert kept == {(1, 0), (None, 0), (2, 120)}


def test_substring_repeated_rows_in_one_flush(spark, tmp_path):
    rows = [(1, BASE), (1, BASE), (None, BASE), (2, BASE), (1, BASE), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((r.doc_id or 0, r.n_removed) for r in substring.query(spark, str(tmp_path)).collect()))
    assert found == [(0, 0), (0, 0), (1, 0), (1, 0), (1, 0), (2, 120)]


def exact_jaccard(a, b):
    x, y = (collections.Counter(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) for t in (a, b))
    return (x & y).total() / (x | y).total()


def test_fingerprints_estimate_generalised_jaccard(spark):
    """Rates of equal entries against the exact similarity, for light and heavily
    skewed weights, within the sampling error of 40 pairs of 64 entries."""
    cases = [(300, 1000, 0, 0), (300, 1000, 0, 300), (40, 100, 0, 40), (200, 30, 15, 0), (0, 400, 100, 20), (300, 4000, 4000, 300), (200, 0, 0, 50)]
    texts, exact = [], []
    for case in cases:
        for k in range(40):
            shared = [f"s{k}x{j}" for j in range(case[0])]
            phrase = [f"p{k}", f"q{k}"]
            a, b = shared + phrase * case[1], shared + phrase * case[2] + [f"o{k}x{j}" for j in range(case[3])]
            texts += [a, b]
            exact.append(exact_jaccard(a, b))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = fingerprint.fingerprints(docs).where("id % 2 = 0").orderBy("id").select(fingerprint.likeness(F.col("own"), F.col("next")).alias("rate"))
    rates = np.array([r.rate for r in found.collect()]).reshape(len(cases), 40)
    exact = np.array(exact).reshape(len(cases), 40)
    for k, case in enumerate(cases):
        p = exact[k].mean()
        assert abs(rates[k].mean() - p) < 3 * (p * (1 - p) / fingerprint.ENTRIES / 40) ** 0.5 + 0.003, case
        assert np.abs(rates[k] - exact[k]).max() < 4.5 * (p * (1 - p) / fingerprint.ENTRIES) ** 0.5 + 0.02, case


def test_decontamination_items_without_id(spark, tmp_path):
    import duckdb

    passage = [" ".join(f"n{j}x{k}" for k in range(14)) for j in range(3)]
    docs = [(1, f"a b {passage[0]} c"), (2, f"{passage[1]} {passage[2]} {passage[0]}"), (3, "n0x1 n0x2"), (4, f"{passage[2]} d"), (5, None)]
    items = [(None, passage[0]), (None, passage[1]), (7, passage[2]), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in decontam.query(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(decontam.SQL).fetchall()) and [r[2] for r in got] == [14, 42, 0, 14, 0]
    left = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert {r.doc_id: r.text for r in left.collect()} == {3: "n0x1 n0x2", 5: None}


def test_decontamination_in_blocks(spark):
    """Items in many blocks, repeated and missing ids, against one block."""
    rng = np.random.default_rng(8)
    items = [(None if k % 7 == 0 else k // 2, " ".join(f"b{x}" for x in rng.integers(0, 30, rng.integers(1, 25)))) for k in range(40)]
    docs = [(k, " ".join(f"b{x}" for x in rng.integers(0, 30, 60)) + " " + items[k % 40][1]) for k in range(60)] + [(None, "b1 b2"), (3, None)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for words in (1_000_000, 60):
        rows = decontam.contamination(docs, items, window=4, block_words=words).collect()
        found[words] = sorted((r.id or -1, r.n_words, tuple(r.runs), tuple(sorted(x or "" for x in set(r["items"])))) for r in rows)
        left = decontam.decontaminate(docs.withColumn("h1", F.lit("clash")), items, min_words=4, block_words=words)
        assert left.columns == ["doc_id", "text", "h1"]
        found[words].append(sorted((r.doc_id or -1, r.text or "") for r in left.collect()))
    assert found[60] == found[1_000_000]


@pytest.mark.parametrize("module", [substring, suffixdedup])
def test_hot_passage_in_many_surroundings(spark, tmp_path, monkeypatch, module):
    """A passage that hundreds of documents hold between words of their own: the
    same result with every minimiser hot, with none, and in many rounds a bucket."""
    from lexloom.llm import superkmer

    rng = np.random.default_rng(12)
    passage = " ".join(f"p{k}" for k in range(70))
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 60, n))
    texts = [f"{words(int(rng.integers(5, 60)))} {passage if k % 3 else passage[40:]} {words(int(rng.integers(5, 60)))}" for k in range(150)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = []
    for strings, one_in, hold in ((1, 1, 48 << 20), (1 << 40, 64, 48 << 20), (1, 1, 4000)):
        monkeypatch.setattr(superkmer, "HOT_STRINGS", strings)
        monkeypatch.setattr(superkmer, "ONE_IN", one_in)
        monkeypatch.setattr(superkmer, "HOLD", hold)
        if hold == 4000:
            keyed = substring.keyed(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text")
            assert len(superkmer.hot_keys(keyed, module.SCHEME)) > 100
        found.append(sorted(tuple(r) for r in module.query(spark, str(tmp_path)).collect()))
    assert found[0] == found[1] == found[2] and sum(r[2] for r in found[0]) > 5000
