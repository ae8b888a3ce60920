"""Byte-level byte-pair encoding: texts are split into words by built-in functions, and words become ids by a table of merges.

The table is read from a vocabulary file into a DataFrame (rank, left_id, right_id, id) and is broadcast: it has a row for each
token. Words cross to Python in Arrow batches; each distinct word of a batch is merged once, and workers remember words. No text is
shuffled, so a common word is no hot key.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word pattern of these vocabularies, with Unicode white space spelled out. A run of blanks leaves its last one to the next word.
WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"

#: Words that a worker remembers.
MEMORY = 200_000


def byte_names() -> list[str]:
    """The character that stands for each byte in a vocabulary file: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens(token, id), merges(rank, left_id, right_id, id)) of a JSON vocabulary file."""
    model = spark.read.schema("model struct<vocab:map<string,long>,merges:array<array<string>>>").json(path, multiLine=True)
    tokens = model.select(F.explode("model.vocab").alias("token", "id"))
    merges = model.select(F.posexplode("model.merges").alias("rank", "m")).select("rank", F.col("m")[0].alias("l"), F.col("m")[1].alias("r"))
    of = lambda name, column: tokens.select(F.col("token").alias(name), F.col("id").alias(column))
    named = merges.withColumn("token", F.concat("l", "r")).join(of("l", "left_id"), "l").join(of("r", "right_id"), "r").join(tokens, "token")
    return tokens, named.select("rank", "left_id", "right_id", "id")


class BytePairs:
    """Words to ids by merges, the one of lowest rank first, of equal ones the leftmost."""

    def __init__(self, byte_ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        #: merges: (left id, right id) to (rank, id).
        self.byte_ids, self.merges = byte_ids, merges
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, tokens: DataFrame, merges: DataFrame) -> BytePairs:
        """From tables of a vocabulary's size."""
        names = byte_names()
        single = {r["token"]: r["id"] for r in tokens.where(F.length("token") == 1).collect()}
        return cls([single[c] for c in names], {(r["left_id"], r["right_id"]): (r["rank"], r["id"]) for r in merges.collect()})

    def merge(self, word: str) -> list[int]:
        """Neighbours wait in a heap by rank and place; a merged pair makes two new ones, so a word of n bytes takes n log n steps."""
        ids = [self.byte_ids[b] for b in word.encode()]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merges.get((a, b)))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # one of the two was merged meanwhile
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [i for i in ids if i >= 0]

    def ids(self, words: list[str]) -> list[list[int]]:
        if len(self.known) > MEMORY:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = self.merge(w)
        return [self.known[w] for w in words]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def list_ids(words: pa.Array, pairs: BytePairs) -> pa.Array:
    """Lists (for each text) of words to lists of ids; null is empty."""
    coded = words.flatten().dictionary_encode()
    known = pairs.ids(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.fromiter((i for k in known for i in k), np.int64, int(size.sum()))
    code = coded.indices.to_numpy()
    each = size[code]
    to = np.cumsum(each)
    start = (np.cumsum(size) - size)[code]
    ids = flat[np.repeat(start - (to - each), each) + np.arange(to[-1] if len(to) else 0)]
    per_text = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    bounds = np.concatenate([[0], np.concatenate([[0], to])[per_text.astype(np.int64)]])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))


def tokenizer(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function from a column of text arrays to the column of their ids (array<array<bigint>>); null texts have no ids."""
    held = spark.sparkContext.broadcast(BytePairs.of(*read_vocabulary(spark, path)))

    @F.arrow_udf("array<array<bigint>>")
    def encode(texts: pa.Array) -> pa.Array:
        inner = list_ids(texts.flatten(), held.value)
        ends = np.cumsum(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), inner)

    return lambda texts: encode(F.transform(texts, words_of))
