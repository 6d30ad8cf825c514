import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orbitweave.llm.bpe import LONG_PRETOKEN, SHARDS, Automaton, Encoder, Lexicon, Vocabulary, compile_lexicon, decode, encode, encoded_digests, frequent_words, lexicon_file, shard_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = Vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def automaton(words):
    return Automaton(compile_lexicon([w.encode() for w in words], *VOCABULARY.words(words)))


def lexicon(words):
    shards = {}
    for w in words:
        shards.setdefault(shard_of(w), []).append(w)
    body = lexicon_file([(s, compile_lexicon([w.encode() for w in ws], *VOCABULARY.words(ws)).tobytes()) for s, ws in sorted(shards.items())])
    return Lexicon(np.frombuffer(body, np.int32))


@pytest.mark.parametrize("words", [[], [" a"], [" the", " then", " other", " mother", " été", " bother", "\n"]])
def test_transducer_finds_its_words_only(words):
    lex = automaton(words)
    found = lex.find([w.encode() for w in words] + [b"", b" th", b" thenx", b"zzz"])
    assert sorted(found[: len(words)]) == list(range(len(words)))
    assert (found[len(words) :] == -1).all()
    for w, p in zip(words, found):
        start = lex.ends[p - 1] if p else 0
        assert lex.ids[start : lex.ends[p]].tolist() == LIBRARY.encode(w, add_special_tokens=False).ids


def test_transducer_is_minimal():
    words = [a + b for a in ("x", "y", "z") for b in ("ing", "ed", "")]
    assert automaton(words).states == 6  # root, after x/y/z, i, in, e and the end: suffixes are shared


TEXT = st.text(alphabet=st.sampled_from(list("abcdeé ÀÉ\t\n\r '’st12٣½.,!?  　\x1c\x85漢字🙂​")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "<|endof", "  it's  we'll "]), min_size=1, max_size=5))
def test_encodes_as_the_library_does(texts):
    for lex in (None, lexicon([" a", " é", "e", "\n", " ab"])):
        ids, counts = Encoder(VOCABULARY, lex).encode(texts)
        ends = np.cumsum(counts)
        for t, n, end in zip(texts, counts, ends):
            assert ids[end - n : end].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_lexicon_of_shards_finds_each_word_with_its_ids():
    words = [" the", " then", " été", " 漢字", " 🙂", " x" * 2, "\n"]
    others = [" th", "", " zebra", "the"]
    known, ids, sizes = lexicon(words).find(others + words)
    assert sorted(known.tolist()) == [i + len(others) for i in range(len(words))]
    for i, part in zip(known, np.split(ids, np.cumsum(sizes))):
        assert part.tolist() == LIBRARY.encode((others + words)[i], add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "the" * 900, "".join(random.Random(1).choice("etaoinshr") for _ in range(9000)), "é" * 4000 + " " + "x" * 2048])
def test_long_runs_merge_as_in_the_library(text):
    assert len(text) >= LONG_PRETOKEN
    ids, counts = Encoder(VOCABULARY, None).encode(["short", text, "the end"])
    assert ids[counts[0] : counts[0] + counts[1]].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_frequent_words_are_the_most_frequent_and_know_their_shard(spark):
    texts = ["a a a a b b b c c 漢 漢 🙂 🙂 été été zz"] * 3
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    found = {r.word: r.shard for r in frequent_words(docs, 100).collect()}
    assert set(found) == {" a", " b", " c", " 漢", " 🙂", " été", " zz"}
    assert all(s == shard_of(w) < SHARDS for w, s in found.items())
    assert {r.word for r in frequent_words(docs, 2).collect()} == {" a", " b"}


def test_digests_and_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "<|endoftext|>", "aaaa" * 9000, "the cat\n\n  sat", "x" * 3 + "é" * 50]
    texts += [" ".join(rng.choice(["the", "thinning", "été", "o'clock", "42"]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "no id", "x", 5), (3, "<|endoftext|>", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, *_ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in encoded_digests(docs, lexicon_words=3).collect()), key=key) == sorted(want, key=key)
    back = {r.doc_id: r.text for r in decode(encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_empty_table_and_null_ids(spark):
    assert encoded_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert decode(spark.createDataFrame([(1, None), (2, [255])], "doc_id long, ids array<int>")).collect()[0].text is None
