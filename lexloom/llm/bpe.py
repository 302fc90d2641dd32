"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct new words of a batch go into a trie. A depth-first walk gives each
prefix one state: the last token of its encoding, and how many symbols that
token takes. The last token of a prefix is the longest vocabulary entry at its
end that may stand after the last token of the prefix before it; two tokens may
stand together if the merges leave them so when run over both. A state also keeps
the longest end of its prefix that begins an entry: no entry that ends one symbol
later can begin before it. A prefix that
many words share is therefore encoded once, and the encoding of a word is read
off the states of its own path. Its last letter carries the end-of-word mark and
is a symbol of its own.

Texts are normalised and cut as the vocabulary file states: canonical
composition, runs of white space to a blank, lower case letter by letter, then
contractions, runs of letters, single digits and runs of other marks. The
special tokens are cut out of the raw text first. Without a decoder in the file
decoding joins the token strings by blanks.

Words are kept between the slices of a task in two generations of ``CACHE_BYTES``
together: the older goes when the newer is full, and words met again move up. Of the
prefixes only those of at most ``KEEP`` symbols are kept; longer ones live on the
path being walked, so a word of a million letters costs memory in proportion. Long
texts are cut into blocks at white space, where no piece can be cut, so none is ever
held as pieces whole. The encoder goes with its task. The vocabulary (fixed size,
about 2 MB as a file) is read on the driver, the entries that merges can make are
found there, and both are broadcast. The library's tokenizer is made by the first
text that needs it.

Defined cases: a null text is empty and has no tokens. Rows are encoded one by
one whatever their id; repeated rows give repeated results; columns other than
id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm.workers import resting

#: Bound on what the kept words of a worker take, by estimate.
CACHE_BYTES = 128 << 20
#: Symbols of the longest prefix that is kept, pairs of tokens that are kept.
KEEP, PAIRS = 5, 400_000
#: Characters of a slice of texts, and of a block of a text.
SLICE_CHARS, BLOCK = 2 << 20, 1 << 20
BLANK = re.compile("[ \t\n\r]")
#: Letters of the fast path's texts after lower-casing, and marks it may hold.
LETTERS, MARKS = "a-zß-öø-ɏ", "\u2010-\u2027\u2030-\u203b\u20ac"
#: Texts whose cut doesn't depend on the version of the Unicode tables: ASCII,
#: composed Latin letters (but for the one that lower-cases to two) and MARKS.
PLAIN = re.compile(f"[\x00-\x7fÀ-ÖØ-öø-įı-ɏ{MARKS}]*")
#: Fixed value: the cut pattern of the vocabulary file on such texts.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t-\r {LETTERS}0-9]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse_vocabulary(f.read())


def parse_vocabulary(text: str) -> dict:
    found = json.loads(text)
    model = found["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {
        "file": text,
        "vocab": model["vocab"],
        "merges": merges,
        "suffix": model.get("end_of_word_suffix") or "",
        "special": {t["content"]: t["id"] for t in found["added_tokens"]},
    }


def prepared(text: str) -> dict:
    """The vocabulary with what an encoder would find out about it first."""
    data = parse_vocabulary(text)
    encoder = Encoder(data)
    return data | {"made": (encoder.ids, encoder.halves, encoder.known)}


class Encoder:
    """Encodes words over a vocabulary; see the module's text."""

    def __init__(self, data: dict):
        self.suffix = data["suffix"]
        self.vocab: dict[str, int] = data["vocab"]
        self.special = data["special"]
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        self.rank = {pair: k for k, pair in enumerate(data["merges"])}
        self.numbers: dict = {}
        self.states: dict[str, tuple[int, int, int]] = {}
        self._shared: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        self.forget()
        self._pairs: dict[tuple[int, int], bool] = {}
        if "made" in data:
            self.ids, self.halves, self.known = data["made"]
        else:
            # A token that merges cannot make of its own symbols never comes out.
            made = {a + b for a, b in data["merges"]}
            base = set(self.symbols) | {s + self.suffix for s in self.symbols}
            self.halves: dict[str, tuple[str, str]] = {}
            self.ids = {t: i for t, i in self.vocab.items() if (t in made or t in base) and self._made(t)}
            # Ids of the tokens, -1 for what only begins one.
            self.known = dict.fromkeys((t[:n] for t in self.ids for n in range(1, len(t))), -1) | self.ids
        self._spines: tuple[dict, dict] = ({}, {})
        self.file = data["file"]
        self.byte_of = {c: b for b, c in enumerate(self.symbols)}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.file)

    def forget(self) -> None:
        """Begin a generation of words; special tokens stand as their ids."""
        self.older = self.numbers
        self.numbers = {i: (1, str(i), self.token_of[i]) for i in self.special.values()}
        self.held = 0
        if len(self.states) > PAIRS:
            self.states.clear()

    def _split(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = list(token[: -len(self.suffix)])
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _made(self, token: str) -> bool:
        """Do the merges, lowest rank first and leftmost first, make the token of its
        symbols? Notes the halves of its last merge."""
        rank, parts = self.rank, self._split(token)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in rank:
                return False
            parts[best : best + 2] = [pair[0] + pair[1]]
            self.halves[parts[best]] = pair
        return True

    def _spine(self, token: int, side: int) -> tuple[list[str], list[int]]:
        """What stands at an edge of the token (0: left, 1: right) while its merges
        run, and the ranks of the merges that change it. A merge's rank is above
        those that made its halves, so they run in this order."""
        found = self._spines[side].get(token)
        if found is None:
            parts, ranks = [self.token_of[token]], [1 << 30]
            while pair := self.halves.get(parts[-1]):
                parts.append(pair[side])
                ranks.append(self.rank[pair])
            found = self._spines[side][token] = (parts[::-1], [*ranks[:0:-1], 1 << 30])
        return found

    def _fits(self, left: int, right: int) -> bool:
        """May the right token follow the left one? Not if a merge over their border
        comes before the next merge at the left one's end, and not after the next at
        the right one's start: equal merges run from left to right."""
        found = self._pairs.get((left, right))
        if found is None:
            (xs, after_x), (ys, after_y) = self._spine(left, 1), self._spine(right, 0)
            rank, i, j, found = self.rank, 0, 0, True
            while True:
                over, x, y = rank.get((xs[i], ys[j]), 1 << 30), after_x[i], after_y[j]
                if over < x and over <= y and over < 1 << 30:
                    found = False
                    break
                if x == y == 1 << 30:
                    break
                if x <= y:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            self._pairs[left, right] = found
        return found

    def learn(self, new: list[str]) -> None:
        """Encode words that aren't known yet. Sorted words are the trie's leaves
        in depth-first order: a step back to the prefix shared with the word
        before, then down the word's own path. ``states`` are the trie's nodes by
        prefix and stay for later batches."""
        names, suffix, states = self.symbols, self.suffix, self.states
        spelled = sorted(("".join([names[b] for b in w.encode("utf-8")]), w) for w in new)
        stack: list[tuple[int, int, int]] = []
        before = ""
        for path, word in spelled:
            inner = path[:-1]
            shared = 0
            for x, y in zip(before, inner):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del stack[shared:]
            for n in range(shared + 1, len(inner) + 1):
                if n > KEEP:
                    stack.append(self._last(inner, n, stack, ""))
                    continue
                prefix = inner[:n]
                state = states.get(prefix)
                if state is None:
                    state = states[prefix] = self._last(inner, n, stack, "")
                stack.append(state)
            before = inner
            self._read_off(word, stack, self._last(path, len(path), stack, suffix))

    def _last(self, path: str, n: int, stack: list[tuple[int, int, int]], tail: str) -> tuple[int, int, int]:
        """(last token, its symbols, symbols of the longest known end) of the first
        ``n`` symbols and a tail."""
        get, pairs, longest = self.known.get, self._pairs, 0
        for at in range(n - 1 - stack[n - 2][2] if n > 1 else 0, n):
            token = get(path[at:n] + tail)
            if token is None:
                continue
            longest = longest or n - at
            if token < 0:
                continue
            if not at:
                break
            left = stack[at - 1][0]
            fits = pairs.get((left, token))
            if self._fits(left, token) if fits is None else fits:
                break
        else:
            raise ValueError(f"no token ends {path[:n]!r}")
        state = (token, n - at, longest)
        return self._shared.setdefault(state, state)

    def _read_off(self, word: str, stack: list[tuple[int, int, int]], last: tuple[int, int, int]) -> None:
        token, size, _ = last
        out, at = [token], len(stack) + 1 - size
        while at:
            token, size, _ = stack[at - 1]
            out.append(token)
            at -= size
        out.reverse()
        found = self.numbers[word] = (len(out), " ".join(map(str, out)), " ".join(map(self.token_of.__getitem__, out)))
        self.held += 400 + 2 * len(word) + 2 * len(found[1])

    def pieces(self, text: str) -> list[str]:
        """Words of the text; a special token stands as its id."""
        if self.cut is None or "<|" not in text:
            return self._pieces(text)
        out: list = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self._pieces(part)
        return out

    def _pieces(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PIECE.findall(text.lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        byte_of = self.byte_of
        return [bytes([byte_of[c] for c in piece]).decode("utf-8") for piece, _ in found]

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids, decoded text) of each text."""
        out: list[list] = [[0, [], []] for _ in texts]
        for k, n, ids, decoded in self.blocks(texts):
            out[k][0] += n
            if n:
                out[k][1].append(ids)
                out[k][2].append(decoded)
        return [(n, " ".join(ids), " ".join(decoded)) for n, ids, decoded in out]

    def blocks(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, str, str]]:
        """(place of the text, number of ids, ids, decoded text) of each block of
        each text, in order."""
        held, size = [], 0
        for k, text in enumerate(texts):
            for block in _blocks(text or ""):
                held.append((k, self.pieces(block)))
                size += len(block)
                if size >= SLICE_CHARS:
                    yield from self._slice(held)
                    held, size = [], 0
        yield from self._slice(held)

    def _slice(self, held: list[tuple[int, list]]) -> Iterator[tuple[int, int, str, str]]:
        numbers, older = self.numbers, self.older
        missing = set().union(*[ws for _, ws in held]).difference(numbers)
        again = missing & older.keys()
        for w in again:
            found = numbers[w] = older[w]
            self.held += 400 + 2 * len(w) + 2 * len(found[1])
        self.learn(list(missing - again))
        for k, ws in held:
            yield k, *self._join(ws)
        if self.held > CACHE_BYTES // 2:
            self.forget()

    def _join(self, ws: list) -> tuple[int, str, str]:
        if not ws:
            return 0, "", ""
        counts, ids, decoded = zip(*map(self.numbers.__getitem__, ws), strict=True)
        return sum(counts), " ".join(ids), " ".join(decoded)


def decode(ids: list[int], encoder: Encoder) -> str:
    """The token strings joined by blanks, special tokens included."""
    return " ".join(encoder.token_of[i] for i in ids)


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK and (blank := BLANK.search(text, at + BLOCK)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` and, with ``full``, ``ids``
    (array of int) and ``decoded``."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(prepared(f.read()))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            counts = [0] * batch.num_rows
            digests = [[hashlib.sha256() for _ in counts] for _ in range(2)]
            wholes: list[list[list[str]]] = [[[] for _ in counts] for _ in range(2)]
            for k, n, *found in encoder.blocks(t.as_py() for t in batch.column(1)):
                for kind, part in enumerate(found if n else ()):
                    digests[kind][k].update((" " * bool(counts[k]) + part).encode("utf-8"))
                    if full:
                        wholes[kind][k].append(part)
                counts[k] += n
            out = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array([d.hexdigest() for d in ds], pa.string()) for ds in digests)]
            if full:
                out += [pa.array([[int(i) for x in xs for i in x.split()] for xs in wholes[0]], pa.list_(pa.int32())), pa.array([" ".join(xs) for xs in wholes[1]], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return docs.mapInArrow(resting(run), schema)


def _default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """op10: encodes and decodes the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, vocabulary or _default_vocabulary()).withColumnRenamed("id", "doc_id")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, _default_vocabulary()).withColumnRenamed("id", "doc_id")
