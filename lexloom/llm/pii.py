"""Personal data by bootstrapped contextual extraction, on DataFrame functions.

Base entities come from four patterns and their checks; they are the seeds, with
long lower-case hexadecimal keys as seeds of a fifth kind, ``secret``. Every other
token that looks like an identifier (it holds a digit or an at sign) is a
candidate. An occurrence stands in lexical patterns: the two words before it; the
word before and the word after it; its shape (digits and letters told apart, with
their lengths); the word before or after it with its collapsed shape.

Patterns and instances (distinct values) form a graph that is scored in rounds. A
pattern's confidence for a kind is the mean score of its instances (``SMOOTH``
added to their number). A seed's score is 1 for its kind and 0 for the others; a
candidate's is ``DAMPING`` times the confidence of its best pattern, of those with
``SUPPORT`` different seeds of the kind. So a candidate never counts like a seed,
and a pattern in which the share f of the instances are seeds settles near
f / (f + 0.1 (1 - f)). Rounds end when no score moves by ``TOLERANCE``; damping
bounds their number. Candidates whose best pattern reaches ``ACCEPT`` are added
under its kind, as are the seeds of ``secret``.

The patterns are written so that each text is read once from left to right
(possessive runs, starts only where a run starts or the last match ended), with
the same leftmost matches as the plain ones. Offsets are running sums inside the
row, by doubling, so n matches cost n log n; nothing is cut short. Texts are read
once: their spans and occurrences, which hold hashes in place of words, are
written to a table that all later steps use. Pattern and instance sums combine on
the map side; joins with their sums are split by Spark where a pattern is hot.

Defined cases: a null text is empty and has no spans. A row without an id has its
own base spans, and its occurrences count like others; added spans are matched to
rows by id and text, so rows that repeat an id get those of their own text (and
rows without an id those of all with the same text). Empty tables give empty
results; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import stage, unstage

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SMOOTH, DAMPING, ACCEPT, SUPPORT, TOLERANCE = 2.0, 0.9, 0.8, 5, 0.02
#: Rows of a file of the graph and its scores.
ROWS = 500_000
_LOCAL = "[A-Za-z0-9._%+-]"
#: One reading of each of the contract's patterns, with its first-letter guard.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
#: The part of a token from its first to its last letter or digit.
CORE = r"[0-9A-Za-z+](?:.*[0-9A-Za-z])?"
SECRET = r"^(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+$"
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array of int: ``op`` over each element and all before it. Rounds of
    twice the reach, so n log n steps."""
    rounds = F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def further(acc, j):
        return F.transform(acc, lambda x, i: op(x, F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), j).cast("int")), F.lit(0)))).cast("array<int>")

    return F.aggregate(rounds, xs.cast("array<int>"), further)


def _holds(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _holds(kind, s["value"])


def _tag(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind"))


def _may_hold(kind: str, text: Column) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _placed(pieces: Column, matches: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(match, its end, its number)`` of each match, in code points."""
    sizes = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
    return let(running(sizes, lambda a, b: a + b), lambda ends: F.transform(matches, lambda m, i: body(m, F.get(ends, i), i)))


def _span(m: Column, end: Column, _) -> Column:
    return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))


def found(text: Column, pattern: str, may: Column) -> Column:
    """array<struct<start, end, value>> of the pattern's matches in code points."""
    every = let(F.split(text, pattern, -1), lambda ps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: _placed(ps, ms, _span)))
    return F.when(may, every).otherwise(F.array().cast(f"array<{SPAN}>"))


def _words(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """The last word before, the last but one, and the first after, lower-cased
    (words before are spelled backwards), without marks around them."""
    back = F.lower(F.reverse(before))
    edge = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}=:]+|[^\p{L}\p{N}=:]+$", "")
    return (
        edge(F.regexp_extract(back, r"^\s*+(\S++)", 1)),
        edge(F.regexp_extract(back, r"^\s*+\S++\s++(\S++)", 1)),
        edge(F.regexp_extract(F.lower(after), r"^\s*+(\S++)", 1)),
    )


def tokens(text: Column) -> Column:
    """array<struct<start, end, value, last, other, next>>: tokens that look like
    identifiers, with the words around them."""

    def context(ps, ms):
        def body(m, end, i):
            at = lambda xs, k: F.coalesce(F.get(xs, i + k), F.lit(""))
            before = F.concat(at(ms, -2), at(ps, -1), at(ms, -1), at(ps, 0))
            last, other, after = _words(before, F.concat(at(ps, 1), at(ms, 1)))
            return F.struct(
                (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"), last.alias("last"), other.alias("other"), after.alias("next")
            )

        return _placed(ps, ms, body)

    every = let(F.split(text, TOKEN, -1), lambda ps: let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda ms: context(ps, ms)))
    kind = "array<struct<start:int,end:int,value:string,last:string,other:string,next:string>>"
    return F.when(text.rlike("[0-9@]"), every).otherwise(F.array().cast(kind))


def _seen(own: Column, base: Column) -> Column:
    """The tokens that no base span covers from before, with the span that starts
    in them, if any: array<struct<token, span>>. Tokens and spans go in order of
    their starts; what covers a token is the largest end so far, and the span
    that starts in a token comes right after it."""
    token_events = F.transform(own, lambda t, i: F.struct(t["start"].alias("start"), F.lit(0).alias("span"), t["end"].alias("end"), i.alias("at")))
    span_events = F.transform(base, lambda b, i: F.struct(b["start"].alias("start"), F.lit(1).alias("span"), b["end"].alias("end"), i.alias("at")))

    def joined(events):
        ends = F.transform(events, lambda e: F.when(e["span"] == 1, e["end"]).otherwise(0))

        def body(reach):
            def one(e, i):
                after = F.get(events, i + 1)
                starts = (after["span"] == 1) & (after["start"] < e["end"])
                free = (e["span"] == 0) & (F.coalesce(F.get(reach, i - 1), F.lit(0)) <= e["start"])
                return F.struct(free.alias("free"), F.get(own, e["at"]).alias("token"), F.when(starts, F.get(base, after["at"])).alias("span"))

            return F.filter(F.transform(events, one), lambda x: x["free"])

        return let(running(ends, F.greatest), body)

    return let(F.array_sort(F.concat(token_events, span_events)), joined)


def _collapsed(shape: Column) -> Column:
    return F.regexp_replace(shape, r"(.)\1+", "$1+")


def _occurrence(x: Column) -> Column:
    """struct<kind, start, end, instance, patterns> of a token and its span."""
    token, span = x["token"], x["span"]
    core = F.regexp_extract(token["value"], CORE, 0)
    # A span that goes on after its token has no shape and no word after it.
    within = span.isNull() | (span["end"] <= token["end"])
    value = F.coalesce(span["value"], core)
    start = F.coalesce(span["start"], token["start"] + F.instr(token["value"], core) - 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    kind = F.coalesce(span["kind"], F.when(value.rlike(SECRET), F.lit("secret")))
    last, other, after = token["last"], token["other"], token["next"]
    patterns = F.array_compact(
        F.array(
            F.when((last != "") & (other != ""), F.xxhash64(F.lit(1), other, last)),
            F.when(within & (last != "") & (after != ""), F.xxhash64(F.lit(2), last, after)),
            F.when(within, F.xxhash64(F.lit(3), shape)),
            F.when(within & (last != ""), F.xxhash64(F.lit(4), last, _collapsed(F.lower(shape)))),
            F.when(within & (after != ""), F.xxhash64(F.lit(5), after, _collapsed(F.lower(shape)))),
        )
    )
    return F.struct(
        kind.alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), F.xxhash64(F.lower(value)).alias("instance"), patterns.alias("patterns")
    )


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, hash``, for each kind its base spans (start, end) and ``seen``: the
    occurrences, array<struct<kind, start, end, instance, patterns>>."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    for kind in KINDS:
        rows = rows.withColumn(kind, F.filter(found(text, PATTERNS[kind], _may_hold(kind, text)), _check(kind)))
    tagged = [F.transform(F.col(k), _tag(k)) for k in KINDS]
    # A span inside an earlier one (digits of a phone number) is no seed of its own.
    occurrences = let(tokens(text), lambda own: let(F.concat(*tagged), lambda base: F.transform(_seen(own, base), _occurrence)))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,instance:bigint,patterns:array<bigint>>>")
    return rows.select(
        "id",
        F.xxhash64(text).alias("hash"),
        F.when(text.rlike("[0-9@]"), occurrences).otherwise(empty).alias("seen"),
        *[F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS],
    )


def discover(seen: DataFrame) -> DataFrame:
    """``instance, found`` of the candidates that the rounds accept. ``seen``:
    ``kind, instance, patterns``."""
    seeds = seen.where("kind is not null").groupBy("instance").agg(*[F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k) for k in ALL_KINDS])
    graph = seen.select(F.explode("patterns").alias("pattern"), "instance").distinct()
    support = (
        graph.join(seeds, "instance").groupBy("pattern").agg(*[F.sum(k).alias(f"{k}_seeds") for k in ALL_KINDS])
        .where(F.greatest(*[f"{k}_seeds" for k in ALL_KINDS]) >= SUPPORT)
    )
    # Only patterns with enough seeds can ever score; the rest of the graph is cut off.
    held = F.struct(*[F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in ALL_KINDS])
    able = F.struct(*[(F.col(f"{k}_seeds") >= SUPPORT).alias(k) for k in ALL_KINDS])
    graph = graph.join(support, "pattern").join(seeds, "instance", "left").select("pattern", "instance", able.alias("able"), F.col(ALL_KINDS[0]).isNotNull().alias("seed"), held.alias("held"))
    graph = stage(graph, "pii-graph")
    # Tables of the rounds have as many files as their rows need, not one a task.
    files = graph.count() // ROWS + 1
    scores = graph.groupBy("instance").agg(F.max("seed").alias("seed"), *[F.max(f"held.{k}").alias(k) for k in ALL_KINDS], F.lit(0.0).alias("moved"))
    scores = stage(scores.select("*", *[F.lit(0.0).alias(f"{k}_conf") for k in ALL_KINDS]).coalesce(files), "pii-scores")
    while True:
        patterns = (
            graph.select("pattern", "instance", "able").join(scores.select("instance", *ALL_KINDS), "instance").groupBy("pattern")
            .agg(F.max("able").alias("able"), *[(F.sum(k) / (F.count("*") + SMOOTH)).alias(f"{k}_mean") for k in ALL_KINDS])
            .select("pattern", *[F.when(F.col(f"able.{k}"), F.col(f"{k}_mean")).otherwise(0.0).alias(f"{k}_conf") for k in ALL_KINDS])
        )
        best = graph.select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg(*[F.max(f"{k}_conf").alias(f"{k}_conf") for k in ALL_KINDS])
        new = [F.when(F.col("seed"), F.col(k)).otherwise(F.col(f"{k}_conf") * DAMPING) for k in ALL_KINDS]
        moved = F.greatest(*[F.abs(n - F.col(k)) for n, k in zip(new, ALL_KINDS, strict=True)])
        after = scores.select("instance", "seed", *ALL_KINDS).join(best, "instance").select(
            "instance", "seed", *[n.alias(k) for n, k in zip(new, ALL_KINDS, strict=True)], moved.alias("moved"), *[f"{k}_conf" for k in ALL_KINDS]
        )
        after = stage(after.coalesce(files), "pii-scores")
        unstage(scores)
        scores = after
        if (scores.agg(F.max("moved")).first()[0] or 0.0) < TOLERANCE:
            break
    unstage(graph)
    # A seed's value where no pattern of its kind fits (in capitals, say) counts too.
    score = {k: F.when(F.col("seed"), F.col(k)).otherwise(F.col(f"{k}_conf")) for k in ALL_KINDS}
    top = F.greatest(*score.values())
    best_kind = F.coalesce(*[F.when(x == top, F.lit(k)) for k, x in score.items()])
    return scores.where(top >= ACCEPT).select("instance", best_kind.alias("found"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, <kind>`` (base spans of each kind)``, added``: array<struct<kind,
    start, end>> of the spans that the method found."""
    spans = stage(base_spans(docs, id_col, text_col), "pii-spans")
    seen = spans.where(F.size("seen") > 0).select("id", "hash", F.explode("seen").alias("s")).select("id", "hash", "s.*")
    span = lambda kind: F.struct(F.col(kind).alias("kind"), "start", "end").alias("span")
    learned = seen.where("kind is null").join(discover(seen), "instance").select("id", "hash", span("found"))
    added = (
        learned.unionByName(seen.where("kind = 'secret'").select("id", "hash", span("kind")))
        .groupBy("id", "hash").agg(F.collect_set("span").alias("added"))
        .select(F.col("id").alias("added_id"), F.col("hash").alias("added_hash"), "added")
    )
    joined = spans.drop("seen").join(added, F.col("id").eqNullSafe(F.col("added_id")) & (F.col("hash") == F.col("added_hash")), "left")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select("id", *KINDS, F.coalesce("added", empty).alias("added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: personal data in the whole of ``documents``."""
    rows = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda kind: lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])
    base = F.array_join(F.concat(*[F.transform(F.col(k), text(k)) for k in KINDS]), ",")
    own = lambda kind: F.transform(F.filter("added", lambda a: a["kind"] == kind), lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end")))
    every = F.concat(*[F.transform(F.array_sort(F.concat(F.col(k), own(k)) if k in KINDS else own(k)), text(k)) for k in ALL_KINDS])
    n_base = sum((F.size(k) for k in KINDS[1:]), F.size(KINDS[0]))
    return rows.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (n_base + F.size("added")).cast("long").alias("n_spans"),
    )
