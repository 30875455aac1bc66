"""Encoding a corpus with a public byte-level tokenizer.

The words of the corpus (the pieces that the tokenizer's pattern cuts) are counted; the most frequent ones, already
merged to ids, are compiled into a minimal acyclic transducer: words with the same endings share states, and the
outputs on the arcs add up to the place of the word's ids. The file is shipped to every executor once and memory-mapped
there. All distinct words of a batch walk the automaton together, a byte a step; words it doesn't hold are merged
exactly, by the ranks. The lexicon saves time only: any lexicon, an empty one too, gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.session import scratch_path, write_file

#: Fixed value: the pattern of the vocabulary files that cuts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie unless a query is told otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Words of the lexicon, the most frequent first; bounds what the driver compiles.
LEXICON = 50_000
#: Longest word, in bytes, that the lexicon takes.
LONGEST = 64
#: Merged words that a task remembers.
REMEMBERED = 200_000

_cut = regex.compile(PATTERN).findall


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: of all neighbouring parts the pair of least rank is joined, leftmost first, while there is one."""
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    end, before, after = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < size and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        j = after[i] if end[i] == middle else size
        if j >= size or end[j] != last:
            continue
        end[i], after[i], end[j] = last, after[j], -1
        if after[j] < size:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic transducer of distinct words, in one block of arrays: see Lexicon for its layout."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word: final, arcs (byte, state) so far
    last = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, arcs)))

    for k in order:
        word = words[k]
        close(len(os.path.commonprefix([word, last])))
        path += [[False, []] for _ in word[len(path) - 1 :]]
        path[-1][0], last = True, word
    close(0)
    start = freeze(*path[0])
    below = np.zeros(len(states), np.int64)  # words that end below a state
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):  # states come after those they lead to
        passed = int(final)
        for byte, to in arcs:
            keys.append(s * 256 + byte)
            targets.append(to)
            outputs.append(passed)
            passed += int(below[to])
        below[s] = passed
    flat = np.array([i for k in order for i in ids[k]], np.int64)
    offsets = np.append(0, np.cumsum([len(ids[k]) for k in order])).astype(np.int64)
    finals = np.array([f for f, _ in states], np.int64)
    head = np.array([start, len(keys), len(states), len(offsets), len(flat), max(map(len, words), default=0)], np.int64)
    return b"".join(np.asarray(x, np.int64).tobytes() for x in (head, keys, targets, outputs, finals, offsets, flat))


class Lexicon:
    """A compiled lexicon, memory-mapped. All numbers are 64-bit: start, sizes and longest word, then keys (state * 256
    + byte, ascending), targets and outputs of the arcs, final states, and the offsets and ids of the words in order."""

    def __init__(self, path: str):
        block = np.memmap(path, np.int64, "r")
        self.start, arcs, states, words, ids, self.longest = (int(x) for x in block[:6])
        cuts = np.cumsum([6, arcs, arcs, arcs, states, words, ids])
        self.keys, self.targets, self.outputs, self.finals, self.offsets, self.ids = (block[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1 where the lexicon doesn't hold it."""
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(len(words), self.start), np.zeros(len(words), np.int64)
        state[(size > self.longest) | (len(self.keys) == 0)] = -1
        for step in range(self.longest):
            on = np.flatnonzero((size > step) & (state >= 0))
            if not len(on):
                break
            key = state[on] * 256 + text[begin[on] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            number[on] += np.where(there, self.outputs[arc], 0)
            state[on] = np.where(there, self.targets[arc], -1)
        held = state >= 0
        held[held] = self.finals[state[held]] == 1
        return np.where(held, number, -1)


class Encoder:
    """Encodes batches of texts with a lexicon and the ranks."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        self.lexicon, self.ranks, self.merged = lexicon, ranks, {}

    def batch(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; null and empty texts have none."""
        pieces = [_cut(t) if t else [] for t in texts]
        codes: dict[str, int] = {}
        flat = np.array([codes.setdefault(p, len(codes)) for ps in pieces for p in ps], np.int64)
        words = [w.encode() for w in codes]
        number = self.lexicon.find(words)
        new: list[int] = []
        place, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        held = number >= 0
        place[held] = self.lexicon.offsets[number[held]]
        size[held] = self.lexicon.offsets[number[held] + 1] - place[held]
        for w in np.flatnonzero(~held):
            if (ids := self.merged.get(words[w])) is None:
                ids = merge(words[w], self.ranks)
                if len(self.merged) < REMEMBERED:
                    self.merged[words[w]] = ids
            place[w], size[w] = len(self.lexicon.ids) + len(new), len(ids)
            new += ids
        known = np.concatenate([self.lexicon.ids, np.array(new, np.int64)])
        sizes = size[flat]
        total = np.append(0, np.cumsum(sizes))
        values = known[np.repeat(place[flat] - total[:-1], sizes) + np.arange(total[-1])]
        ends = np.append(0, np.cumsum([len(ps) for ps in pieces]))
        return pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(values.astype(np.int32)))


def frequent_words(documents: DataFrame, text: str, most: int) -> list[str]:
    """The most frequent words of all texts, ties by the word itself; long ones are left to merging."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter(p for t in batch["text"] if isinstance(t, str) for p in _cut(t))
            short = [(w, n) for w, n in found.items() if len(w.encode()) <= LONGEST]
            yield pd.DataFrame(short, columns=["word", "n"])

    words = documents.select(F.col(text).alias("text")).where("text <> ''").mapInPandas(count, "word string, n long")
    return [r[0] for r in words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()]


def ship(spark: SparkSession, content: bytes, name: str) -> str:
    """Make content a file on every executor, also of those that join later; its name for SparkFiles."""
    name = f"{name}-{hashlib.sha256(content).hexdigest()[:24]}"
    if any(x.endswith(name) for x in spark.sparkContext.listFiles):
        return name
    path = f"{scratch_path(spark, 'ship')}/{name}"
    write_file(spark, path, content)
    spark.sparkContext.addFile(path)
    return name


def encode(documents: DataFrame, key: str, text: str, ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", lexicon: int = LEXICON) -> DataFrame:
    """key and ids (array of int): the ids of each text, no special tokens; the same for the same text.

    A null and an empty text both have an empty list. What looks like a special token is ordinary text. Every row is
    encoded whole, repeated and null keys too; other columns are ignored. ranks_path must be readable by the driver.
    """
    spark = documents.sparkSession
    ranks = read_ranks(ranks_path)
    words = [w.encode() for w in frequent_words(documents, text, lexicon)] if lexicon else []
    lexicon_file = ship(spark, compile_lexicon(words, [merge(w, ranks) for w in words]), "lexicon")
    with open(ranks_path, "rb") as f:
        ranks_file = ship(spark, f.read(), "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Lexicon(SparkFiles.get(lexicon_file)), read_ranks(SparkFiles.get(ranks_file)))
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.batch(batch.column(1).to_pylist())], ["key", "ids"])

    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)
