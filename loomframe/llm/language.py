"""Language identification as mixture inference.

A document's words are drawn from a mixture of languages: a word's likelihood in a language is that of its byte
trigrams (word edges included) under the language's trigram distribution, counted over all training documents. For
each document, expectation-maximisation estimates the language proportions; sets of the 1, 2, ... likeliest languages
are fitted again, until a set of more than LOOK is no better or all languages are in, and the set with the best
likelihood minus half a log(words) for each further language is kept.
The prediction is the language with the largest share, the score is that share.

The model has 2 ** BITS trigram buckets a language, whatever the corpus; it is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal, slices, table, text_bytes

BITS = 16
#: Language sets up to this size are fitted for every document, larger ones as long as they are better; a document's fit ends
#: when no share moves by more than STILL (the likelihood never falls, so it does); weight of a count not seen.
LOOK, STILL, ALPHA = 3, 1e-3, 0.05

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of each word byte, first index of each word, row of each word). A word is a run of ASCII letters and bytes over 127."""
    n = len(data)
    b = np.full(n + 2, 32, np.uint8)
    b[1:-1] = _FOLD[data]
    word = b[1:-1] != 32
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    left, right = b[:-2].astype(np.uint32), b[2:].astype(np.uint32)
    left[cut[:-1]] = 32  # neighbours in another document do not count
    right[cut[1:]] = 32
    x = (left << np.uint32(16)) | (b[1:-1].astype(np.uint32) << np.uint32(8)) | right
    x = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    at = np.flatnonzero(word)
    first = left[at] == 32
    row = np.searchsorted(offsets, at[first], side="right") - 1
    return x[at], np.flatnonzero(first), row


def trigram_counts(docs: DataFrame) -> pd.DataFrame:
    """docs(text, lang): (lang, gram, n), at most 2 ** BITS rows a language, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column(0))
                grams, first, row = _grams(data, offsets)
                langs, code = np.unique(np.array(part.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True) if part.num_rows else ([], None)
                of = np.repeat(code[row], np.diff(np.append(first, len(grams)))) if len(langs) else None
                for k, lang in enumerate(langs):
                    c = np.bincount(grams[of == k], minlength=1 << BITS)
                    total[lang] = total.get(lang, 0) + c
        for lang, c in total.items():
            g = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g, pa.int32()), "n": pa.array(c[g], pa.int64())})

    counted = docs.select("text", "lang").mapInArrow(frugal(count), "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


class Model:
    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.logp = np.zeros((len(self.langs), 1 << BITS), np.float32)
        for k, lang in enumerate(self.langs):
            own = counts[counts["lang"] == lang]
            c = np.full(1 << BITS, ALPHA)
            c[own["gram"].to_numpy()] += own["n"].to_numpy()
            self.logp[k] = np.log(c / c.sum())

    def proportions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """rows x languages: shares under the selected set; rows without a word are 0."""
        n, m = len(offsets) - 1, len(self.langs)
        out = np.zeros((n, m))
        grams, first, row = _grams(data, offsets)
        if not len(first) or not m:
            return out
        like = np.empty((len(first), m), np.float32)
        for k in range(m):
            like[:, k] = np.add.reduceat(self.logp[k][grams], first)
        top = like.max(axis=1)
        like = np.exp(np.maximum(like - top[:, None], -60))
        has, start, words = np.unique(row, return_index=True, return_counts=True)
        doc = np.repeat(np.arange(len(has)), words)

        def part(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(likelihoods, first word, document of each word, words) of some documents, given in order."""
            if len(of) == len(has):
                return like, start, doc, words
            some = np.zeros(len(has), bool)
            some[of] = True
            n = words[of]
            return like[some[doc]], np.cumsum(n) - n, np.repeat(np.arange(len(of)), n), n

        def fit(mask: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """EM over the languages in mask (some documents x languages): (shares, log likelihood)."""
            share = mask / mask.sum(axis=1, keepdims=True)
            left = np.flatnonzero(mask.sum(axis=1) > 1)
            while len(left):
                own, at, doc_, n = part(of[left])
                r = own * share[left].astype(np.float32)[doc_]
                r /= r.sum(axis=1, keepdims=True) + np.float32(1e-30)
                new = np.add.reduceat(r, at, axis=0, dtype=np.float64) / n[:, None]
                moved = np.abs(new - share[left]).max(axis=1) > STILL
                share[left] = new
                left = left[moved]
            own, at, doc_, _ = part(of)
            mix = (own * share.astype(np.float32)[doc_]).sum(axis=1, dtype=np.float64)
            return share, np.add.reduceat(np.log(mix + 1e-30), at)

        every, _ = fit(np.ones((len(has), m)), np.arange(len(has)))
        order = np.argsort(-every, axis=1, kind="stable")
        best, kept = np.full(len(has), -np.inf), every.copy()
        left = np.arange(len(has))
        for size in range(1, m + 1):
            mask = np.zeros((len(left), m))
            np.put_along_axis(mask, order[left, :size], 1.0, axis=1)
            share, ll = fit(mask, left)
            value = ll - 0.5 * (size - 1) * np.log(np.maximum(words[left], 2))
            better = value > best[left]
            best[left[better]] = value[better]
            kept[left[better]] = share[better]
            if size >= LOOK:
                left = left[better]
            if not len(left):
                break
        out[has] = kept
        return out


def is_test(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod `mod` = rest; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod)) == rest, F.lit(False))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs(text, keep...) to keep..., lang_pred, score, mixture (shares of the selected languages)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL("lang_pred string, score double, mixture map<string,double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                col = part.column(0)
                data, offsets = text_bytes(col)
                p = m.proportions(data, offsets)
                low = _ASCII[_FOLD[data]] if len(data) else np.zeros(0, bool)
                letters = np.diff(np.concatenate([[0], np.cumsum(low)])[offsets])
                pred, score, mix = [], [], []
                for i in range(part.num_rows):
                    lettered = letters[i] > 0 or any(c.isalpha() for c in col[i].as_py() or "")
                    if not lettered or not p.shape[1] or not p[i].any():
                        pred.append("und"), score.append(0.0), mix.append([])
                        continue
                    k = int(p[i].argmax())
                    pred.append(m.langs[k]), score.append(min(1.0, float(p[i, k])))
                    mix.append([(m.langs[j], float(p[i, j])) for j in np.flatnonzero(p[i])])
                arrays = [part.column(j) for j in range(1, part.num_columns)]
                arrays += [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "mixture"])

    return docs.select("text", *keep).mapInArrow(frugal(run), schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document.

    Trained on all documents with text and lang outside the held-out fold. Null or letterless text: `und`, 0; so is
    every document where there is nothing to train on. Null doc_id: not held out.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", is_test(F.col("doc_id"), 4, 2))
    model = Model(trigram_counts(d.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())))
    return predict(d, model, ["doc_id", "held_out"])
