"""BPE encoding and decoding with a minimal acyclic transducer as lexicon (operator 3).

Frequent words of the corpus, counted by Spark, are compiled in tasks into minimal automata, one for the words of each
shard of first characters, whose arcs carry additive outputs: the sum along a word's path is its place in a table of token
ids. The automata are one file of 32-bit integers in the shared folder, which Spark hands to the executors and which they
map into memory. Words that it lacks are merged exactly, by the tokenizer's own merge ranks.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.session import durable, shared_file

#: Words that the lexicon holds at most; bounds the automaton to a few MB at any corpus size.
LEXICON_WORDS = 250_000
#: Longest word, in characters, that the lexicon takes up.
LEXICON_CHARS = 40
#: Automata of the lexicon; a word is in the one that its first character after the blank names.
SHARDS = 64
#: Pretokens from this many bytes on are merged one by one with a heap, in n log n.
LONG_PRETOKEN = 2048
#: Distinct words that a task remembers before it starts afresh.
REMEMBERED = 250_000
#: Texts' bytes that a task encodes at once, and at least one text.
CHUNK_BYTES = 2_000_000

# White space of the tokenizer's pattern, and the pattern by which it splits a text before merging.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A word here: what stands between white space, with one blank before it; no pretoken crosses its ends.
WORD = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and that byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        raw = lambda s: bytes(byte_of[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = s.encode() if s in self.special else raw(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.first = np.array([vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.by_key: dict[int, int] | None = None
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; beyond all ranks where the vocabulary has no such merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of non-empty pretokens: flat ids, and how many each has. Long ones are merged apart from the others."""
        long = [i for i, p in enumerate(pretokens) if len(p) >= LONG_PRETOKEN]
        if not long:
            return self.merge_together(pretokens)
        apart = {i: self.merge_long(pretokens[i]) for i in long}
        ids, sizes = self.merge_together([p for i, p in enumerate(pretokens) if i not in apart])
        parts, ends = iter(np.split(ids, np.cumsum(sizes))), range(len(pretokens))
        found = [apart[i] if i in apart else next(parts) for i in ends]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def merge_long(self, pretoken: bytes) -> np.ndarray:
        """Token ids of one pretoken: a heap holds its pairs by rank, then place, and neighbours are linked."""
        ids = self.first[np.frombuffer(pretoken, np.uint8)]
        ranks = np.append(self.rank_of(ids[:-1], ids[1:]), len(self.keys))
        now, n, none = ranks.tolist(), len(ids), len(self.keys)
        heap = [(r << 40) + i for i, r in enumerate(now) if r < none]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank_by_key()

        def meet(i: int) -> None:
            j = after[i]
            now[i] = rank.get(ids[i] << 20 | ids[j], none) if j < n else none
            if now[i] < none:
                heapq.heappush(heap, (now[i] << 40) + i)

        while heap:
            r, i = divmod(heapq.heappop(heap), 1 << 40)
            if now[i] != r:  # the pair is gone
                continue
            j = after[i]
            ids[i], ids[j], now[j] = int(self.merged[r]), -1, none
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            meet(i)
            if before[i] >= 0:
                meet(before[i])
        return np.array([x for x in ids if x >= 0], np.int64)

    def rank_by_key(self) -> dict[int, int]:
        if self.by_key is None:
            self.by_key = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self.by_key

    def merge_together(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`merge` of pretokens side by side."""
        none, sizes = len(self.keys), np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        ids = self.first[np.frombuffer(b"".join(pretokens), np.uint8)]
        own = np.repeat(np.arange(len(pretokens)), sizes)
        ranks = np.full(len(ids), none)

        def rank(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at ``at``."""
            ranks[at] = none
            at = at[at < len(ids) - 1]
            at = at[own[at] == own[at + 1]]
            ranks[at] = self.rank_of(ids[at], ids[at + 1])

        rank(np.arange(len(ids)))
        done_ids, done_own = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(ids))))
            over = best == none
            if over.any():
                done_ids.append(ids[over])
                done_own.append(own[over])
            hit = np.flatnonzero(~over & (ranks == best))
            if len(hit):  # of pairs that overlap, every other one from the left
                run = np.concatenate(([True], np.diff(hit) > 1))
                first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
                ids[hit] = self.merged[ranks[hit]]
            keep = ~over
            keep[hit + 1] = False
            now = (np.cumsum(keep) - 1)[hit]
            ids, own, ranks = ids[keep], own[keep], ranks[keep]
            rank(np.concatenate((now, now[now > 0] - 1)))
        ids, own = np.concatenate(done_ids) if done_ids else ids, np.concatenate(done_own) if done_own else own
        order = np.argsort(own, kind="stable")
        return ids[order], np.bincount(own, minlength=len(pretokens))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words (no special tokens among them): flat ids, and how many each has."""
        split = regex.compile(PRETOKEN).findall
        parts = [[w.encode()] if w.isalpha() or w[:1] == " " and w[1:].isalpha() else [p.encode() for p in split(w)] for w in words]
        ids, sizes = self.merge([p for w in parts for p in w])
        ends = np.cumsum([len(w) for w in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends)).astype(np.int64)]
        return ids, np.diff(upto)


def compile_lexicon(words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The minimal acyclic transducer of ``words`` (distinct) with their token ids, as one array of integers.

    Layout: counts (states, arcs, words, ids), then by state whether a word ends there, by arc its key
    (state * 256 + byte, ascending), target and output, by word the end of its ids, and all ids, in word order.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    # States are (final, arcs) by number; equal ones are shared as soon as no later word can extend them.
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    so_far = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            shape = (final, tuple(arcs))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
            path[-1][1].append((so_far[len(path) - 1], known[shape]))

    for i in order:
        w = words[i]
        shared = len(os.path.commonprefix([so_far, w]))
        close(shared)
        path.extend((False, []) for _ in w[shared:])
        path[-1] = (True, path[-1][1])
        so_far = w
    close(0)
    states.append((path[0][0], tuple(path[0][1])))  # the root is the last state
    reach = np.zeros(len(states), np.int64)  # words that end below a state
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, t in arcs:
            keys.append(s * 256 + byte)
            targets.append(t)
            outputs.append(n)
            n += reach[t]
        reach[s] = n
    sized = np.asarray(sizes, np.int64)[order] if order else np.zeros(0, np.int64)
    flat = np.concatenate([ids[offsets[i] : offsets[i + 1]] for i in order]) if order else np.zeros(0, np.int64)
    head = [len(states), len(keys), len(words), len(flat)]
    return np.concatenate([np.asarray(x, np.int32) for x in (head, [f for f, _ in states], keys, targets, outputs, np.cumsum(sized), flat)])


class Automaton:
    """A compiled transducer; ``data`` may be a part of a memory map."""

    def __init__(self, data: np.ndarray):
        self.states, arcs, words, flat = map(int, data[:4])
        cuts = np.cumsum([4, self.states, arcs, arcs, arcs, words, flat])
        self.final, self.keys, self.targets, self.outputs, self.ends, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 where the lexicon lacks it; all words walk the automaton side by side."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        place = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return place
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        live, state, total = np.arange(n), np.full(n, self.states - 1, np.int64), np.zeros(n, np.int64)
        depth = 0
        while len(live):
            end = sizes[live] == depth
            at_end = end & (self.final[state] == 1)
            place[live[at_end]] = total[at_end]
            live, state, total = live[~end], state[~end], total[~end]
            if not len(live):
                break
            key = (state * 256 + flat[starts[live] + depth]).astype(np.int32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            live, at = live[on], at[on]
            state, total = self.targets[at].astype(np.int64), total[on] + self.outputs[at]
            depth += 1
        return place


def shard_of(word: str) -> int:
    """The automaton of a word that begins with a blank."""
    return ord(word[1]) % SHARDS if len(word) > 1 else 0


class Lexicon:
    """The automata of a file of :func:`lexicon_file`; ``data`` may be a memory map."""

    def __init__(self, data: np.ndarray):
        n = int(data[0])
        ends = np.cumsum(data[1 + n : 1 + 2 * n].astype(np.int64)) + 1 + 2 * n
        starts = ends - data[1 + n : 1 + 2 * n]
        self.parts = {int(s): Automaton(data[a:z]) for s, a, z in zip(data[1 : 1 + n], starts, ends, strict=True)}

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words that the lexicon has: their places in ``words``, their flat ids, and how many ids each has."""
        shards = np.fromiter(map(shard_of, words), np.int64, len(words))
        none = np.zeros(0, np.int64)
        found, ids, sizes = [none], [none], [none]
        for shard in np.unique(shards).tolist():
            if (part := self.parts.get(shard)) is None:
                continue
            mine = np.flatnonzero(shards == shard)
            place = part.find([words[i].encode() for i in mine])
            mine, place = mine[place >= 0], place[place >= 0]
            if len(mine):
                stop = part.ends[place].astype(np.int64)
                start = np.where(place > 0, part.ends[place - 1], 0).astype(np.int64)
                found.append(mine)
                ids.append(part.ids[spread(start, stop - start)].astype(np.int64))
                sizes.append(stop - start)
        return np.concatenate(found), np.concatenate(ids), np.concatenate(sizes)


class Encoder:
    """Encodes texts by lexicon, memory of what it met, and exact merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.sizes = [], []  # by blocks of words met together
        self.table: tuple[np.ndarray, np.ndarray] | None = None
        for s, i in self.vocabulary.special.items():
            self.number[s] = len(self.number)
            self.ids.append(np.array([i]))
            self.sizes.append(np.array([1]))

    def learn(self, words: list[str]) -> None:
        known, ids, sizes = self.lexicon.find(words) if self.lexicon is not None else (np.zeros(0, np.int64),) * 3
        rest = np.setdiff1d(np.arange(len(words)), known)
        if len(known):
            self.ids.append(ids)
            self.sizes.append(sizes)
        if len(rest):
            ids, sizes = self.vocabulary.words([words[i] for i in rest])
            self.ids.append(ids)
            self.sizes.append(sizes)
        for i in np.concatenate((known, rest)).tolist():
            self.number[words[i]] = len(self.number)
        self.table = None

    def split(self, text: str) -> list[str]:
        specials = self.vocabulary.specials
        if specials is None or not specials.search(text):
            return WORD.findall(text)
        return [w for i, part in enumerate(specials.split(text)) for w in ([part] if i % 2 else WORD.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many each text has."""
        words = [self.split(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.forget()
        new = set().union(*words).difference(self.number)
        if new:
            self.learn(sorted(new))
        if self.table is None:
            sizes = np.concatenate(self.sizes)
            self.ids, self.sizes = [np.concatenate(self.ids)], [sizes]
            self.table = np.cumsum(sizes) - sizes, sizes
        starts, sizes = self.table
        counts = np.fromiter(map(len, words), np.int64, len(words))
        met = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        each = sizes[met]
        upto = np.concatenate(([0], np.cumsum(each)))
        return self.ids[0][spread(starts[met], each)], np.diff(upto[np.concatenate(([0], np.cumsum(counts)))])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """(shard, word): the most frequent words of all texts, with the blank before them; ``most`` at most.

    They are all words down to some count, chosen on steps of counts, of which there are a few hundred at most.
    """
    word = F.explode(F.split("text", " ")).alias("word")
    counts = docs.select(word).filter(F.length("word").between(1, LEXICON_CHARS)).groupBy("word").count()
    counts = durable(counts.filter("count > 1").withColumn("step", F.floor(8 * F.log2("count")).cast("int")))
    left, least = most, 0
    for r in counts.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if r.words > left:
            least = r.step + 1
            break
        left -= r.words
    return counts.filter(F.col("step") >= least).select(F.pmod(F.ascii("word"), F.lit(SHARDS)).alias("shard"), F.concat(F.lit(" "), "word").alias("word"))


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary of a file, read once a process."""
    return Vocabulary(path)


def compiled(words: DataFrame, path: str) -> DataFrame:
    """(shard, body) of the shards of :func:`frequent_words`: each task compiles the automata of its shards.

    A shard has LEXICON_WORDS words at most. What the splitting into words would not give is left out.
    """

    def run(part: pa.Table) -> pa.Table:
        found = sorted(w for w in part.column("word").to_pylist() if WORD.fullmatch(w))
        body = compile_lexicon([w.encode() for w in found], *vocabulary_of(path).words(found))
        return pa.table({"shard": part.column("shard").slice(0, 1), "body": pa.array([body.tobytes()], pa.binary())})

    return words.groupBy("shard").applyInArrow(run, "shard int, body binary")


def lexicon_file(parts: list[tuple[int, bytes]]) -> bytes:
    """The shards' number, their names, their sizes in integers, and their automata."""
    head = [len(parts), *(s for s, _ in parts), *(len(b) // 4 for _, b in parts)]
    return np.array(head, np.int32).tobytes() + b"".join(b for _, b in parts)


def _encoder(vocabulary_path: str, lexicon_name: str) -> Encoder:
    return Encoder(vocabulary_of(vocabulary_path), Lexicon(np.memmap(SparkFiles.get(lexicon_name), np.int32, "r")))


def _chunks(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches (doc_id, text), at most about CHUNK_BYTES each, with their flat ids and where each row's begin and end."""
    encoder = None
    for b in batches:
        encoder = encoder or _encoder(path, name)
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        for i in range(b.num_rows):
            size += lengths[i]
            if size >= CHUNK_BYTES or i == b.num_rows - 1:
                part = b.slice(start, i + 1 - start)
                ids, counts = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield part, ids.astype(np.int32), np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                start, size = i + 1, 0


def _texts(ids: np.ndarray, ends: np.ndarray, table: list[bytes]) -> list[str]:
    """The text of each row's ids; bytes that are not UTF-8 become replacement characters."""
    return [b"".join(map(table.__getitem__, ids[a:z].tolist())).decode("utf-8", "replace") for a, z in zip(ends, ends[1:], strict=False)]


def _lexicon_of(docs: DataFrame, path: str, lexicon_words: int) -> str:
    """Compiles and shares the lexicon of ``docs``' frequent words; returns its name. The driver meets finished automata only."""
    parts = compiled(frequent_words(docs, lexicon_words), path).orderBy("shard").collect()  # SHARDS rows, some MB
    return shared_file(docs.sparkSession, "lexicon", lexicon_file([(r.shard, bytes(r.body)) for r in parts]))


def encode(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs`` (doc_id, text; other columns are not read), whole texts.

    ``path`` is a byte-level BPE file of the tokenizers library that each machine has. Ids are those that the library
    gives without added special tokens; the strings of special tokens in a text become their ids, as there. Null text:
    as empty, no ids. Repeated rows and null ids of documents pass through. The lexicon changes speed, not results.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    name = _lexicon_of(docs, path, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, ends in _chunks(batches, path, name):
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) with the text of each row's ids, special tokens as their strings; null ids: null text.

    Bytes that are not UTF-8 become replacement characters.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            table = table or vocabulary_of(path).bytes_of
            texts = []
            for ids in b.column(1):
                texts += _texts(ids.values.to_numpy(), np.array([0, len(ids)]), table) if ids.is_valid else [None]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, text): what :func:`decode` gives for :func:`encode`, by one Python worker a task instead of two."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    name = _lexicon_of(docs, path, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for part, ids, ends in _chunks(batches, path, name):
            table = table or vocabulary_of(path).bytes_of
            yield pa.record_batch(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(_texts(ids, ends, table), pa.string())], ["doc_id", "ids", "text"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def encoded_digests(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, by :func:`round_trip`."""
    both = round_trip(docs, path, lexicon_words)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
