"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, the share of lexicon hits near a second-person word, rates
of capitals, punctuation, obfuscation (digits or symbols inside words, stretched letters, hits after undoing them).

At most TRAIN_ROWS labelled rows (those with the smallest md5 of the id) are used, in two halves by hash: one for the
learned lexicon, one for the trees. Calibration is fitted to margins of trees grown without the row, in three folds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .boosting import Boosted, Isotonic
from .common import frugal, materialize, slices, small_batches, table
from .language import is_test

#: Bound of the labelled sample; entries of the learned lexicon at most; documents that an entry must be in.
TRAIN_ROWS, LEXICON, LEAST = 24_000, 4_000, 4

#: Common insults and second-person words; the learned lexicon adds what the labels show.
INSULTS = frozenset(
    "idiot idiots stupid dumb moron morons loser losers pathetic scum worthless trash garbage clown clowns disgusting filthy ugly "
    "hate jerk fool fools imbecile dimwit creep freak liar coward vermin pig pigs rat crap damn hell shut kill die bastard bitch "
    "dummkopf dumm blöd trottel versager abschaum müll widerlich erbärmlich wertlos hass arschloch halt maul schwein hässlich ekelhaft "
    "imbécile stupide débile minable ordure déchet dégoûtant pathétique nul crétin connard salaud merde haine laid porc "
    "idiota estúpido estúpida imbécil tonto basura escoria asqueroso patético inútil payaso perdedor odio cerdo feo mierda".split()
)
YOU = frozenset("you your yours yourself u ur ya du dich dir dein deine deiner euch ihr sie tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W_]+(?:[.*@$!_|'-]+[^\W_]+)*")
_STRETCH = re.compile(r"(.)\1\1+")
_JOIN = re.compile(r"[.*@$!_|'-]+")
_ODD = re.compile(r"[0-9*@$!_|]")
PREFIXES = (4, 5, 6)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def undo(word: str) -> str:
    """A word without joining symbols, leet digits and stretched letters."""
    return _STRETCH.sub(r"\1", _JOIN.sub("", word.translate(_LEET)))


def keys_of(words: set[str]) -> set[str]:
    """What the learned lexicon is learned from: words, and their first letters (for inflected and compound forms)."""
    out = set(words)
    for w in words:
        for n in PREFIXES:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


class Features:
    """A row of numbers for each text; weights: the learned lexicon, key to log odds."""

    names = "insults insult_density near_you you_density undone undone_density strong strong_density odds_mean odds_max weak_density capitals shouting marks exclaim question runs odd_words stretched digits length word_length".split()

    def __init__(self, weights: dict[str, float]):
        self.weights, self.cache = weights, {}

    def odds(self, w: str) -> float:
        v = self.cache.get(w)
        if v is None:
            get = self.weights.get
            v = max((x for x in (get(w), *(get(w[:n] + "*") for n in PREFIXES if len(w) > n)) if x is not None), key=abs, default=0.0)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[w] = v
        return v

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = words_of(text)
        n, size = max(1, len(words)), max(1, len(text))
        hits = [i for i, w in enumerate(words) if w in INSULTS]
        you = [i for i, w in enumerate(words) if w in YOU]
        near = sum(bisect_left(you, i - 5) < bisect_right(you, i + 5) for i in hits)
        odd = [w for w in words if not w.isalpha()]
        undone = sum(undo(w) in INSULTS for w in odd if _ODD.search(w) or _JOIN.search(w))
        odds = [self.odds(w) for w in words]
        strong = sum(x > 2 for x in odds)
        upper = sum(map(str.isupper, text))
        runs = len(_STRETCH.findall(text))
        marks = {c: text.count(c) for c in "!?.,;:*#@$%&"}
        return [
            len(hits), len(hits) / n, near / max(1, len(hits)), len(you) / n, undone, undone / n, strong, strong / n,
            sum(odds) / n, max(odds, default=0.0), sum(x < -1 for x in odds) / n, upper / size, sum(w.isupper() and len(w) > 2 for w in text.split()) / n if upper > 3 else 0.0,
            sum(marks.values()) / size, marks["!"] / size, marks["?"] / size, runs / size, len(odd) / n, runs / n, sum(map(text.count, "0123456789")) / size,
            math.log1p(len(words)), sum(map(len, words)) / n,
        ]


def _map_texts(df: DataFrame, keep: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """df(text, keep...): keep... (which may name the text) plus the columns that make()(texts) returns as a dict of arrays."""
    small_batches(df.sparkSession)
    added = StructType([*df.select(*keep).schema, *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                new = f(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(at[c]) for c in keep], *new.values()], names=[*keep, *new])

    sent = ["text", *[c for c in keep if c != "text"]]
    at = {c: i for i, c in enumerate(sent)}
    return df.select(*sent).mapInArrow(frugal(run), added)


class ToxicityModel:
    """Lexicon, trees and calibration; without two classes of labels a constant."""

    def __init__(self, weights: dict[str, float], trees: Boosted | None, scale: Isotonic | None, prior: float = 0.0):
        self.weights, self.trees, self.scale, self.prior = weights, trees, scale, prior

    def scores(self, texts: list[str | None], features: Features) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t) for t in texts], np.float64).reshape(len(texts), -1)
        return np.clip(self.scale(self.trees.margin(x)), 0, 1) if len(texts) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, limit: int = TRAIN_ROWS) -> ToxicityModel:
    """docs(doc_id, text), labels(doc_id, toxic); rows of the held-out fold, without label or text take no part.

    A doc_id labelled twice counts as toxic if any label says so; one given with several texts counts once, with the smallest, so the
    sample has `limit` rows at most. Where the half for the lexicon has one class only, trees are fitted without a lexicon.
    """
    spark = docs.sparkSession
    order = F.md5(F.col("doc_id").cast("string"))
    sample = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_test(F.col("doc_id"), mod, held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(order, "doc_id").limit(limit)
    part = F.pmod(F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string"))), F.lit(6))
    # at most `limit` rows of two numbers
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("part", part), "toxic_sample")

    def count() -> Callable:
        def f(texts: list[str | None]) -> dict:
            return {"keys": pa.array([list(keys_of(set(words_of(t or "")))) for t in texts], pa.list_(pa.string()))}

        return f

    lexicon = _map_texts(rows.where("part < 3"), ["toxic"], "keys array<string>", count).select("toxic", F.explode("keys").alias("key"))
    lexicon = lexicon.groupBy("key").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = {r["toxic"]: r["n"] for r in rows.where("part < 3").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    lexicon = lexicon.where(F.col("bad") + F.col("good") >= LEAST).withColumn("odds", odds).where("abs(odds) > 1")
    # the surest entries: log odds times the root of the support
    lexicon = lexicon.orderBy(F.desc(F.abs("odds") * F.sqrt(F.col("bad") + F.col("good"))), "key").limit(LEXICON)
    weights = {r["key"]: r["odds"] for r in lexicon.collect()} if n_bad and n_good else {}
    held_weights = spark.sparkContext.broadcast(weights)

    def feature() -> Callable:
        f = Features(held_weights.value)
        return lambda texts: {"x": pa.array([f(t) for t in texts], pa.list_(pa.float64()))}

    got = _map_texts(rows.where("part >= 3"), ["doc_id", "toxic", "part"], "x array<double>", feature).orderBy("doc_id", "part", "toxic").toPandas()
    x, y, fold = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, 1)), got["toxic"].to_numpy(np.float64), got["part"].to_numpy()
    if len(np.unique(y)) < 2:
        n = len(y) + n_bad + n_good
        return ToxicityModel({}, None, None, (y.sum() + n_bad) / n if n else 0.0)
    margin = np.zeros(len(y))
    for k in np.unique(fold):  # each row is calibrated by trees that have not seen it
        other = fold != k if len(np.unique(y[fold != k])) == 2 else np.ones(len(y), bool)
        margin[fold == k] = Boosted().fit(x[other], y[other]).margin(x[fold == k])
    trees, scale = Boosted().fit(x, y), Isotonic().fit(margin, y)
    return ToxicityModel(weights, trees, scale)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """keep... plus score and predicted for every row; a null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        m = held.value
        features = Features(m.weights)

        def f(texts: list[str | None]) -> dict:
            s = m.scores(texts, features)
            return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

        return f

    return _map_texts(docs, keep, "score double, predicted int", make)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity. Null doc_id: not held out. No labels: score 0.

    Null and empty texts have a score like others. A doc_id that is labelled twice is toxic if one label says so; repeated
    documents each have their row. An empty table gives no rows.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(d, table(spark, sf_dir, "labels"))
    return score(d.withColumn("held_out", is_test(F.col("doc_id"), 5, 0)), model, ["doc_id", "held_out"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go; the columns stay as they are.

    Null and empty texts are scored as empty. Without labels nothing goes. Repeated rows are judged alike.
    """
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    kept = score(docs.select("text", rest.alias("row")), model, ["text", "row"]).where("predicted = 0")
    return kept.select(*[F.col(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
