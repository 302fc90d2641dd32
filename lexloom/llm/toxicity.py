"""Toxicity by a weighted finite-state pattern grammar.

A clause is scored by a chain of transducers:

* The lexicon maps a word's letters to a class (insult, threat verb, target,
  negation, reporting verb, intent, quotation mark, clause end, other). It is a trie
  whose arcs are letters; insult stems end in a weight, their learned log odds.
* Right contexts run from the clause's end: an insult or a threat verb with a target
  after it becomes a targeted one.
* Left contexts run from its start: negation and reported speech (a reporting verb
  before, or quotation marks around) turn an insult into a negated or reported one,
  a target before turns it into a targeted one, intent or a target before a threat
  verb make a threat. These are scopes of a few words, each a small transducer from
  class to class; they are composed into one before any text is read.

What comes out is one label a word: insult, targeted, negated, reported, threat. A
clause's weight for a label is the largest lexicon weight that carries it, so a
clause counts once however often it repeats a word; a document's is the sum over its
clauses. The labels' arcs have weights of their own, from a logistic regression that
leans to the priors below where there is nothing to learn from.

Learning uses labelled rows whose crc32(id as text) mod 5 is not 0, and of these
at most ``SAMPLE`` (by the order of a hash of the id, so the choice doesn't
change with the layout of the table). Their ids and labels are broadcast (bound:
``SAMPLE`` rows). A word's beginnings of ``STEM`` letters or more and the whole word
are stems, words over ``LONG`` letters only whole; there is no bound on how many the
lexicon holds, but chance must not explain them.

Defined cases: null and empty texts match nothing and get the score of the bare
intercept. Without labels of both kinds the weights are the priors below. Rows
without an id are scored and are not held out. Repeated rows are scored one by
one; of several labels for an id the largest counts. Other columns are ignored
or, in the stage, kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.workers import resting
from lexloom.session import share, shared

SAMPLE = 40_000
STEM, LONG = 4, 40
MIN_TOXIC = 4
MIN_LOG_ODDS = 3.0
#: Evidence for a stem: log of a million, and three more.
EVIDENCE = 17.0
#: Characters of a text that are read at once, up to the clause end after them.
SEGMENT = 1 << 20
#: Words whose class is kept.
KNOWN = 200_000

#: Closed word classes of the grammar, in the corpus's four languages.
CLASSES = {
    "T": "you your yours yourself u ur they them he him she her people these those this that du dich dir dein deine ihr euch sie er tu te toi ton ta vous votre il elle ils elles tú tu usted ustedes él ella ellos",
    "N": "not no never neither nor none without isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine keinen nie niemals weder ohne pas jamais aucun aucune sans ni no nunca jamás tampoco sin ningún ninguna",
    "R": "said says say saying called calls call told tells tell wrote writes claimed claims quoted quotes reported reports sagte sagt sagen nannte nennt schrieb behauptet dit disent appelé appelle écrit dijo dice dicen llamó llama escribió",
    "W": "will shall gonna going should must werde werden wirst soll vais va allons vas voy vamos debe",
    "K": "kill hurt destroy murder beat burn stab shoot die attack smash töten umbringen verletzen sterben schlagen tuer frapper mourir brûler détruire matar morir herir golpear quemar destruir",
}
#: Classes that words have (I: insult, Q: quotation mark, o: other) and those that
#: contexts give: J targeted, M negated, P reported, L threat verb before a target,
#: H threat.
ALPHABET = "IKTNRWQoJMPLH"
#: Label, its class, the prior weight of its arcs.
LABELS = (("threat", "H", 2.6), ("negated", "M", 0.8), ("reported", "P", 0.8), ("targeted", "J", 2.6), ("insult", "I", 2.0))
#: Weight of a threat verb in the lexicon, where insults have their log odds.
VERB = 4.0
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]|[\"“”«»„]")
CLAUSE = re.compile(r"[^.]*[IK][^.]*")
END = re.compile(r"[.!?;:\n]")
PRIOR_BIAS = -3.0


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; false where there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Scope:
    """A transducer: within ``reach`` words after one of ``marks``, the classes of
    ``change`` come out changed. With ``toggle`` a mark opens and the next closes."""

    marks: str
    reach: int
    change: tuple[tuple[str, str], ...]
    toggle: bool = False

    def step(self, left: int, symbol: str) -> tuple[int, str]:
        """From the words that are left of the scope: those after, and the output."""
        out = dict(self.change).get(symbol, symbol) if left else symbol
        if symbol in self.marks:
            return (0 if self.toggle and left else self.reach), out
        return (left if self.toggle else max(left - 1, 0)), out


def compose(machines: Iterable[Scope]) -> list[dict[str, tuple[int, str]]]:
    """One transducer for a chain, each reading what the one before it writes:
    state -> class -> (state, class). State 0 is the start; only states that can be
    reached are there."""
    machines = tuple(machines)
    number, table = {(0,) * len(machines): 0}, []
    waiting = list(number)
    while waiting:
        state = waiting.pop(0)
        row = {}
        for symbol in ALPHABET:
            out, after = symbol, []
            for machine, left in zip(machines, state, strict=True):
                left, out = machine.step(left, out)
                after.append(left)
            to = tuple(after)
            if to not in number:
                number[to] = len(number)
                waiting.append(to)
            row[symbol] = (number[to], out)
        table.append(row)
    return table


#: Read from the end of a clause, then from its start.
AFTER = (Scope("T", 4, (("I", "J"),)), Scope("T", 4, (("K", "L"),)))
BEFORE = (
    Scope("N", 4, (("I", "M"), ("J", "M"))),
    Scope("R", 5, (("I", "P"), ("J", "P"))),
    Scope("Q", 1, (("I", "P"), ("J", "P")), toggle=True),
    Scope("T", 5, (("I", "J"), ("L", "H"))),
    Scope("W", 4, (("K", "H"), ("L", "H"))),
)


def run(table: list[dict[str, tuple[int, str]]], string: Iterable[str]) -> list[str]:
    state, out = 0, []
    for symbol in string:
        state, label = table[state][symbol]
        out.append(label)
    return out


class Lexicon:
    """The letters' transducer: a trie with classes and weights at its ends. A stem
    fits all words that begin with it, a word with ``$`` only itself."""

    def __init__(self, stems: dict[str, float]):
        self.arcs: list[dict[str, int]] = [{}]
        self.stem: dict[int, tuple[str, float]] = {}
        self.word: dict[int, tuple[str, float]] = {}
        for stem, weight in stems.items():
            (self.word if stem.endswith("$") else self.stem)[self._enter(stem.removesuffix("$"))] = ("I", weight)
        for kind, words in CLASSES.items():
            for w in words.split():
                self.word.setdefault(self._enter(w), (kind, VERB))

    def _enter(self, letters: str) -> int:
        at = 0
        for c in letters:
            if c not in self.arcs[at]:
                self.arcs[at][c] = len(self.arcs)
                self.arcs.append({})
            at = self.arcs[at][c]
        return at

    def read(self, word: str) -> tuple[str, float]:
        """Class and weight: of the whole word, else of its longest stem."""
        at, found = 0, ("o", 0.0)
        for c in word:
            at = self.arcs[at].get(c, -1)
            if at < 0:
                return found
            found = self.stem.get(at, found)
        return self.word.get(at, found)


class Grammar:
    """Lexicon and contexts, and the weights of the labels."""

    def __init__(self, stems: dict[str, float], weights: list[float] | None = None, bias: float = PRIOR_BIAS):
        self.lexicon = Lexicon(stems)
        self.weights = weights or [w for _, _, w in LABELS]
        self.bias = bias
        self.after, self.before = compose(AFTER), compose(BEFORE)
        self.known: dict[str, str] = {}

    def _class(self, token: str) -> str:
        if len(token) == 1 and not token.isalpha():
            found = "Q" if token in "\"“”«»„" else "."
        else:
            found = self.lexicon.read(token)[0]
        if len(self.known) > KNOWN:
            self.known.clear()
        if len(token) <= LONG:
            self.known[token] = found
        return found

    def labels(self, clause: str) -> list[str]:
        """The clause's classes after all contexts."""
        return run(self.before, run(self.after, clause[::-1])[::-1])

    def features(self, text: str | None) -> list[float]:
        """Weight of each label, summed over clauses."""
        out = dict.fromkeys((c for _, c, _ in LABELS), 0.0)
        known, text, at = self.known, (text or "").lower(), 0
        while at < len(text):
            cut = END.search(text, at + SEGMENT)
            end = cut.end() if cut else len(text)
            tokens = TOKEN.findall(text, at, end)
            at = end
            string = "".join([known.get(t) or self._class(t) for t in tokens])
            if "I" not in string and "K" not in string:
                continue
            for m in CLAUSE.finditer(string):
                best: dict[str, float] = {}
                for token, label in zip(tokens[m.start() : m.end()], self.labels(m.group()), strict=True):
                    if label in out:
                        best[label] = max(best.get(label, 0.0), self.lexicon.read(token)[1])
                for label, weight in best.items():
                    out[label] += weight
        return list(out.values())

    def score(self, feature_rows: np.ndarray) -> np.ndarray:
        z = np.log1p(feature_rows) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """``id, text, toxic`` of the rows to learn from."""
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic in (0, 1)")
        .where(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")


def _stems(text: str | None) -> set[str]:
    """A text's words (with ``$``) and their beginnings."""
    out = set()
    for w in set(TOKEN.findall((text or "").lower())):
        if w[0].isalpha():
            out.add(w + "$")
            out.update(w[:k] for k in range(STEM, len(w) + 1 if len(w) <= LONG else 0))
    return out


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Stems whose documents are mostly toxic, with their log odds, as far as chance
    doesn't explain it: the log likelihood ratio against the share of toxic
    documents must reach ``EVIDENCE``, which allows for a million stems that are
    tried. A stem goes when a shorter kept stem covers it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            n = [0, 0]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[toxic] += 1
                for s in _stems(text):
                    counts.setdefault(s, [0, 0])[toxic] += 1
            counts[""] = n
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                names=["stem", "clean", "toxic"],
            )

    counted = (
        rows.select("text", "toxic").mapInArrow(resting(work), "stem string, clean long, toxic long")
        .groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(f"stem = '' or toxic >= {MIN_TOXIC} and clean * 10 <= toxic")
        .collect()
    )
    total = [r for r in counted if not r["stem"]]
    if not total:
        return {}
    n0, n1 = total[0]["clean"], total[0]["toxic"]
    odds = {r["stem"]: float(np.log((r["toxic"] + 0.5) / (n1 + 1)) - np.log((r["clean"] + 0.5) / (n0 + 1))) for r in counted if r["stem"]}
    share_toxic = n1 / max(n0 + n1, 1)
    kept: dict[str, float] = {}
    for r in sorted((r for r in counted if r["stem"]), key=lambda r: (len(r["stem"]), r["stem"])):
        stem, n = r["stem"], r["toxic"] + r["clean"]
        ratio = r["toxic"] * np.log(r["toxic"] / n / share_toxic) + (r["clean"] * np.log(r["clean"] / n / (1 - share_toxic)) if r["clean"] else 0.0)
        if odds[stem] >= MIN_LOG_ODDS and ratio >= EVIDENCE and not any(stem[:k] in kept for k in range(STEM, len(stem))):
            kept[stem] = odds[stem]
    return kept


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Grammar:
    """The grammar with its lexicon and weights, learned off the held-out rows."""
    rows = labelled(docs, labels, id_col, text_col, sample)
    grammar = Grammar(learn_stems(rows))
    held = share(docs.sparkSession, grammar)
    width = len(LABELS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared(held)
        for batch in batches:
            x = [g.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = (
        rows.select("text", "toxic").mapInArrow(resting(work), "x array<double>, toxic int")
        .groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    )
    kinds = {r["toxic"] for r in seen}
    if kinds == {0, 1}:
        x = np.log1p(np.array([r["x"] for r in seen]).reshape(-1, width))
        y = np.array([r["toxic"] for r in seen], dtype=float)
        n = np.array([r["count"] for r in seen], dtype=float)
        grammar.weights, grammar.bias = fit(x, y, n, [w for _, _, w in LABELS])
        grammar.known = {}
    return grammar


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: list[float], ridge: float = 1.0, steps: int = 50) -> tuple[list[float], float]:
    """Logistic regression by Newton steps, ``ridge`` holding weights to the priors;
    ``n`` counts equal rows."""
    a = np.hstack([x, np.ones((len(x), 1))])
    rest = np.array([*prior, 0.0])
    w = np.array([*prior, PRIOR_BIAS])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (n * (y - p)) - penalty @ (w - rest))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1].tolist(), float(w[-1])


def _scores(grammar: Grammar, texts: pa.Array) -> np.ndarray:
    return grammar.score(np.array([grammar.features(t.as_py()) for t in texts]).reshape(-1, len(LABELS)))


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``."""
    held = share(docs.sparkSession, grammar)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared(held)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(g, batch.column(1)))], names=["id", "score"])

    return docs.mapInArrow(resting(work), f"id {docs.schema['id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, grammar: Grammar, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without those that score ``least`` or more."""
    held, at = share(docs.sparkSession, grammar), docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared(held)
        for batch in batches:
            yield batch.filter(pa.array(_scores(g, batch.column(at)) < least))

    return docs.mapInArrow(resting(work), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: scores the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grammar = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, grammar).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    return reject(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
