"""Work that operators leave out, with results against brute force."""

import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from lexloom.llm import bpe, suffixdedup, superkmer


def test_suffix_array_only_of_strings_that_can_match(monkeypatch):
    """A passage too short to match stands in every text; some texts also share up
    to 300 bytes around it, on either side."""
    chance = random.Random(5)
    letters = lambda n: "".join(chance.choices("abcdefgh", k=n))
    passage, before, after, texts = letters(60), letters(300), letters(300), []
    for k in range(240):
        if k % 4:
            texts.append(letters(250) + passage + letters(250))
        else:
            left = chance.randrange(0, 300)
            right = max(0, min(299, chance.randrange(100, 180) - left))
            texts.append(letters(200) + before[300 - left :] + passage + after[:right] + letters(200))
    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array([0] * 240), pa.array(texts)], names=["id", "th", "text"])
    parts, entered, whole = [], [], suffixdedup.repeats
    for pieces, ids, hashes in superkmer.flushes(suffixdedup.SCHEME, iter([batch]), np.zeros(0, np.uint64)):
        chosen, many, _ = suffixdedup.settle(pieces, ids, hashes)
        parts += [superkmer.unpack(blob) for _, blob in superkmer.pack(pieces, ids, hashes, many, chosen, 1)]
    sharing = collections.Counter(key for table, _ in parts for key in table[0].tolist())
    monkeypatch.setattr(suffixdedup, "repeats", lambda strings: entered.extend(strings) or whole(strings))
    got = {(i, p) for spans in suffixdedup.resolve(iter(parts)) for i, _, start, n in zip(*spans, strict=True) for p in range(start, start + n)}
    places = collections.defaultdict(list)
    for i, text in enumerate(texts):
        for p in range(len(text) - 199):
            places[text[p : p + 200]].append((i, p))
    assert got == {(i, q) for found in places.values() if len(found) > 1 for i, p in found for q in range(p, p + 200)}
    assert got and 2 * len(entered) < sum(n for n in sharing.values() if n > 1)


def test_encoder_of_a_prepared_vocabulary(monkeypatch):
    """Tasks neither run the merges of the vocabulary nor parse it for the library,
    and try few ends of a word; the ids are the library's."""
    path, chance = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    with open(path, encoding="utf-8") as f:
        data = bpe.prepared(f.read())
    words = ["".join(chance.choices("etaoinshrdlué", k=chance.randrange(1, 30))) for _ in range(2000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 2000, 50)]
    library = bpe.Tokenizer.from_file(path)
    want = [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]

    class Counted(dict):
        tries = 0

        def get(self, key, default=None):
            Counted.tries += 1
            return super().get(key, default)

    monkeypatch.setattr(bpe.Encoder, "_made", None)
    monkeypatch.setattr(bpe, "Tokenizer", None)
    encoder = bpe.Encoder(data)
    encoder.known = Counted(encoder.known)
    assert [ids for _, ids, _ in encoder.encode(texts)] == want
    assert Counted.tries < 6 * sum(map(len, words))
