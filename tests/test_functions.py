import base64
import gzip
import json

from pyspark.sql import functions as F

from lexloom.functions import cites, dates, names, parentheticals, text
from lexloom.operators import lookup, resolve, windows
from lexloom.plans import extract
from lexloom.sources import store


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_reporters_and_cites(spark):
    r = one(
        spark,
        cites.canonical_reporter(F.lit("Fed. 2d")), cites.reporter_key(F.lit("U. S.")), cites.reporter_slug(F.lit("S.Ct.")),
        cites.parse_cite(F.lit("410 U. S. 113")), cites.parse_cite(F.lit("no cite")), cites.is_case_reporter(F.lit("Harv. L. Rev.")),
        cites.dedupe_cites(F.array(F.lit("1 U.S. 2"), F.lit("1 US 2"), F.lit("x"), F.lit("X"))),
    )
    assert r[0] == "F.2d" and r[1] == "us" and r[2] == "s-ct"
    assert (r[3]["vol"], r[3]["key"], r[3]["page"]) == (410, "us", 113) and r[4] is None and r[5] is False
    assert r[6] == ["1 U.S. 2", "x"]


def test_names(spark):
    r = one(
        spark,
        names.parties(F.lit("Customer#100 v. NATION_21")), names.tokens(F.lit("The Acme Co. of Ohio, Acme")),
        names.overlap_score(F.lit("Roe v. Wade"), F.lit("Jane Roe v. Henry Wade")), names.overlap_score(F.lit("Roe v. Wade"), F.lit("A v. B")),
        names.name_match(F.lit("smith"), F.lit("Smiths v. Jones")), names.safe_stem(F.lit('a/b:  "c". ')), names.tokens(F.lit(None).cast("string")),
    )
    assert r[0] == ["customer 100", "nation 21"] and r[1] == ["acme", "co", "ohio"]
    assert r[2] == 1.0 and r[3] == 0.0 and r[4] == 0.7 and r[5] == "a b c" and r[6] == []


def test_dates_and_text(spark):
    r = one(
        spark,
        dates.long_date(F.lit("Decided Sept. 5, 1973.")), dates.long_date(F.lit("none")), dates.to_roman(F.lit(1994)), dates.from_roman(F.lit("xiv")),
        dates.from_roman(F.lit("hello")), dates.ordinal(F.lit(112)), text.mark_runs(F.lit("a <mark>b</mark> c")),
        text.containment(F.array().cast("array<string>"), F.array(F.lit("a"))), text.word_shingles(F.lit("a b c d"), 3), text.word_shingles(F.lit(None).cast("string"), 3),
    )
    assert r[0] == "1973-09-05" and r[1] is None and r[2] == "MCMXCIV" and r[3] == 14 and r[4] is None and r[5] == "112th"
    assert [(x["text"], x["hl"]) for x in r[6]] == [("a ", False), ("b", True), (" c", False)]
    assert r[7] == 0.0 and r[8] == ["a b c", "b c d"] and r[9] == []


def test_extract_edges(spark):
    t = "Foo, 1 U.S. 2, 3 (1800).\n\nId. at 4. 9 F.2d, at 10. Id. at 11. See 42 U.S.C. § 5. Id."
    rows = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    found = extract.links(rows).orderBy("doc_id", "start").collect()
    assert [(x["kind"], x["value"]) for x in found] == [("cite", "1 U.S. 2@3"), ("usc", "42:5:")]
    assert extract.links(rows.limit(0)).count() == 0


def test_interval_join_open_and_empty(spark):
    index = spark.createDataFrame([(1, 5), (1, 100)], "vol int, first int")
    points = spark.createDataFrame([(1, 1), (1, 5), (1, 99), (1, 5000), (2, 7)], "vol int, page int")
    got = {(x["vol"], x["page"]): x["first"] for x in lookup.nearest(points, index, ["vol"], "page", "first").collect()}
    assert got == {(1, 1): None, (1, 5): 5, (1, 99): 5, (1, 5000): 100, (2, 7): None}
    assert lookup.nearest(points.limit(0), index, ["vol"], "page", "first").count() == 0


def test_cascade_and_chain(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "request string")
    first = spark.createDataFrame([("a", 1), ("a", 2)], "request string, found int")
    second = spark.createDataFrame([("a", 3)], "request string, found int")
    got = {x["request"]: x["found"] for x in resolve.cascade(asked, [first, second]).collect()}
    assert got == {"a": 3, "b": None}
    seq = spark.createDataFrame([("d", k, v, 1.0) for k, v in enumerate([1, 9, 2, 3])], "doc string, at int, v int, w double")
    kept = [x["kept"] for x in windows.monotonic(seq, "doc", "at", "v", "w").orderBy("at").collect()]
    assert kept == [True, False, True, True]


def test_store_round_trip(spark, tmp_path):
    packed = base64.b64encode(gzip.compress("héllo".encode())).decode()
    lines = [json.dumps({"v": 10, "scholar_id": "12345678901234567890", "name": "A v. B", "cites": ["1 U.S. 2", "1 US 2"], "html_gz": packed}), "{bad", json.dumps({"scholar_id": "2"}), json.dumps({"scholar_id": "2", "name": "later"})]
    (tmp_path / "o.jsonl").write_text("\n".join(lines))
    good, bad = store.read_jsonl(spark, str(tmp_path))
    rows = {x["scholar_id"]: x for x in good.withColumn("html", store.unpack("html_gz")).collect()}
    assert set(rows) == {"12345678901234567890", "2"} and rows["2"]["name"] is None and bad.count() == 1
    assert rows["12345678901234567890"]["html"] == "héllo" and rows["2"]["html"] is None
    assert [(x["vol"], x["key"], x["page"]) for x in store.citations_table(good).collect()] == [(1, "us", 2)]
    store.build(good, str(tmp_path / "built"))
    assert spark.read.parquet(str(tmp_path / "built" / "opinions")).count() == 2


def test_stream_ingest(spark, tmp_path):
    from lexloom.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text('{"scholar_id": "1"}\n{"scholar_id": "2"}\n')
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert ingest(*args)[0] == 2
    (src / "b.jsonl").write_text('{"scholar_id": "2"}\n{"scholar_id": "3"}\n')
    assert ingest(*args)[0] == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_party_rules_by_hand(spark):
    """Stop words, one split at the first "v.", entity words, the floor of a score."""
    score = lambda a, b: names.overlap_score(F.lit(a), F.lit(b))
    r = one(
        spark,
        names.tokens(F.lit("State v. Roe")), names.tokens(F.lit("In the Matter of an Ex parte A. People on Rel Doe")),
        names.parties(F.lit("A & B v. C vs. D")), score("United States v. Smith", "United States v. Jones"),
        score("Fitch", "NetChoice, LLC v. Fitch"), score("NetChoice", "NetChoice, LLC v. Fitch"), score("Roe v. Wade Big Long", "Roe Small Tiny v. Wade"),
        score("Alpha Beta Gamma v. Delta Eps Zeta", "Alpha v. Delta"),
    )
    assert r[0] == ["roe"] and r[1] == ["rel", "doe"] and r[2] == ["a b", "c vs d"]
    assert r[3] == 0.5 and r[4] == r[5] == 1.0 and abs(r[6] - 2 / 3) < 1e-9 and r[7] == 0.0


def test_name_search_by_hand(spark):
    m = lambda q, n: names.name_match(F.lit(q), F.lit(n))
    r = one(
        spark, m("Hadley v Baxendale", "Hadley v. Baxendale"), m("Entick", "Entick v Carrington"), m("pinnel", "Pinnel's Case"), m("bury", "Canterbury v X"),
        m("Carrington Entick", "Entick v Carrington"), m("v the", "Entick v Carrington"), m("Smith & Co", "Smith and Co"), m("pinn", "Pinnels"),
    )
    assert list(r) == [1.0, 0.9, 0.9, 0.0, 0.7, 0.0, 1.0, 0.0]


def test_back_references_by_hand(spark):
    """Gaps, quotations, records, blank lines, statutes and parallel citations."""
    texts = {
        1: "Roe, 410 U.S. 113 (1973). " + "x" * 899 + " Id. at 120.",
        2: "Roe, 410 U.S. 113 (1973). " + "x" * 870 + " Id. at 120.",
        3: "Roe, 410 U.S. 113 (citing Poe, 9 U.S. 115). Id. at 120.",
        4: "Roe, 410 U.S. 113. J.A. 12. Id. at 120.",
        5: "Roe, 410 U.S. 113.\n \nId. at 120.",
        6: "Roe, 410 U.S. 113; 42 U.S.C. § 1983. Id. at 120. Id.",
        7: "A, 1 U.S. 10. B, 2 U.S. 300. C, 3 U.S. 400. D, 4 U.S. 500. E, 5 U.S. 600. Id. at 11.",
        8: "Morgan, 536 U.S. 101, 122 S. Ct. 2061, 153 L. Ed. 2d 106 (2002). Id. at 115.",
        9: "Roe, 410 U.S. 113. Id. at 112. Id. at 214. Id. at 213.",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {k: [] for k in texts}
    for x in extract.links(rows).where("kind = 'id'").orderBy("doc_id", "start").collect():
        found[x.doc_id].append(x.value)
    roe = "410 U.S. 113@120"
    assert found == {1: [], 2: [roe], 3: [roe], 4: [], 5: [], 6: [roe], 7: [], 8: ["536 U.S. 101@115"], 9: ["410 U.S. 113@213"]}


def test_parentheticals_by_hand(spark):
    ranks = {
        "[hereinafter X]": 0, "En banc": 1, "Roberts, C.J., concurring in the judgment": 2, "per curiam": 4, "Per Curiam, dissenting": 2, "separate opinion": 2,
        "holding that Roe, J., erred": 13, "emphasis and alteration in original": 5, "all emphasis omitted": 6, "footnotes and citations omitted": 7,
        "citations omitted": 8, "parties omitted": 13, "quoting X": 10, "quotings": 13, "last visited May 1": 12,
    }
    rows = spark.createDataFrame([(k,) for k in ranks], "t string").select("t", parentheticals.rank(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == ranks
