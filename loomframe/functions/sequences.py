"""Token sequences as arrays: sentinels, chat segments, label masks, truncation, padding, splicing. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token sentinels, sizes and chat markers.
IMAGE_TOKEN, IGNORE = -200, -100
IMAGE_TEXT = "<image>"
QUERY_TOKENS, QUERY_WIDTH, CHARS_PER_QUERY = 32, 768, 3
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"

Tokenize = Callable[[Column], Column]


def split_tokens(text: Column) -> Column:
    """A stand-in tokenizer: each word's length (tests need ids, not a vocabulary)."""
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.length(w).cast("long"))


def with_sentinels(chunks: Column, tokenize: Tokenize, sentinel: int = IMAGE_TOKEN) -> Column:
    """Token ids of text chunks with the sentinel between chunks."""
    return F.flatten(F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(F.array(F.lit(sentinel).cast("long")), tokenize(c))).otherwise(tokenize(c))))


def tokens_with_image(text: Column, has_image: Column, tokenize: Tokenize) -> Column:
    """The image mark is a sentinel only where the record has an image; elsewhere it is text."""
    return F.when(has_image, with_sentinels(F.split(text, IMAGE_TEXT, -1), tokenize)).otherwise(tokenize(text))


def chat_turns(turns: Column) -> Column:
    """Turns (from, value) without one leading turn that is not human; human is user, all others are assistant."""
    kept = F.when(F.get(turns, F.lit(0))["from"] != "human", F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)
    return F.transform(kept, lambda t: F.struct(F.when(t["from"] == "human", "user").otherwise("assistant").alias("role"), t["value"].alias("value")))


def render_chat(turns: Column) -> Column:
    """Turns (role, value) as chat text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN_OPEN), t["role"], F.lit("\n"), t["value"], F.lit(TURN_CLOSE))), "")


def render_prompt(prompt: Column) -> Column:
    return F.concat(F.lit(f"{TURN_OPEN}user\n"), prompt, F.lit(f"{TURN_CLOSE}{TURN_OPEN}assistant\n"))


def render_template(messages: Column, queries: int = QUERY_TOKENS, prompt: bool = False) -> Column:
    """Messages (role, content array of (type, text)): image items become `queries` image marks and a line end."""
    item = lambda c: F.when(c["type"] == "image", F.concat(F.repeat(F.lit(IMAGE_TEXT), F.lit(queries)), F.lit("\n"))).when(c["type"] == "text", c["text"]).otherwise("")
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(TURN_OPEN), m["role"], F.lit("\n"), F.array_join(F.transform(m["content"], item), ""), F.lit(TURN_CLOSE))), "")
    return F.concat(text, F.lit(f"{TURN_OPEN}assistant\n")) if prompt else text


def chat_segments(turns: Column, has_image: Column, tokenize: Tokenize) -> Column:
    """For each turn (role, value): ids, and labels in which only what the assistant says and its closing mark count."""
    ignore = lambda n: F.array_repeat(F.lit(IGNORE).cast("long"), n)

    def segment(t: Column) -> Column:
        prefix = tokenize(F.concat(F.lit(TURN_OPEN), t["role"], F.lit("\n")))
        body = tokens_with_image(t["value"], has_image, tokenize)
        suffix = tokenize(F.lit(TURN_CLOSE))
        said = F.concat(F.transform(body, lambda x: F.when(x == IMAGE_TOKEN, F.lit(IGNORE).cast("long")).otherwise(x)), suffix)
        labels = F.when(t["role"] == "assistant", said).otherwise(ignore(F.size(body) + F.size(suffix)))
        return F.struct(F.concat(prefix, body, suffix).alias("ids"), F.concat(ignore(F.size(prefix)), labels).alias("labels"))

    return F.transform(turns, segment)


def chat_pieces(turns: Column, has_image: Column) -> Column:
    """All turns (role, value) as an array of (text, said, image): what one tokenizer call takes, in order. `said` counts as a label, `image` is the sentinel."""
    piece = lambda text, said, image: F.struct(text.alias("text"), said.alias("said"), F.lit(image).alias("image"))

    def of(t: Column) -> Column:
        said = t["role"] == "assistant"
        chunks = F.when(has_image, F.split(t["value"], IMAGE_TEXT, -1)).otherwise(F.array(t["value"]))
        marked = F.flatten(F.transform(chunks, lambda c, i: F.when(i > 0, F.array(piece(F.lit(""), F.lit(False), True), piece(c, said, False))).otherwise(F.array(piece(c, said, False)))))
        head = piece(F.concat(F.lit(TURN_OPEN), t["role"], F.lit("\n")), F.lit(False), False)
        return F.concat(F.array(head), marked, F.array(piece(F.lit(TURN_CLOSE), said, False)))

    return F.flatten(F.transform(turns, of))


def assembled(pieces: Column, tokens: Column) -> tuple[Column, Column]:
    """(ids, labels) of pieces and their token ids: one sentinel for an image, labels only for what is said."""
    both = F.zip_with(pieces, tokens, lambda p, t: F.struct(p["said"].alias("said"), F.when(p["image"], F.array(F.lit(IMAGE_TOKEN).cast("long"))).otherwise(t).alias("ids")))
    labels = F.transform(both, lambda x: F.when(x["said"], x["ids"]).otherwise(F.array_repeat(F.lit(IGNORE).cast("long"), F.size(x["ids"]))))
    return F.flatten(F.transform(both, lambda x: x["ids"])), F.flatten(labels)


def joined(segments: Column) -> tuple[Column, Column]:
    """(ids, labels) of all segments."""
    return F.flatten(F.transform(segments, lambda s: s["ids"])), F.flatten(F.transform(segments, lambda s: s["labels"]))


def caption_sample(turns: Column, tokenize: Tokenize, eos: str = "<|im_end|>") -> tuple[Column, Column]:
    """(ids, labels) of the two-turn caption form: an image and the second turn's value; what the first says is ignored."""
    body = with_sentinels(F.array(F.lit(""), F.concat(turns[1]["value"], F.lit(eos))), tokenize)
    return body, F.transform(body, lambda x: F.when(x == IMAGE_TOKEN, F.lit(IGNORE).cast("long")).otherwise(x))


def truncate(a: Column, most: int | None) -> Column:
    return F.slice(a, 1, most) if most else a


def pad(a: Column, length: Column, value: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value).cast("long"), length - F.size(a)))


def attention_mask(a: Column, length: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1).cast("long"), F.size(a)), F.array_repeat(F.lit(0).cast("long"), length - F.size(a)))


def pad_left(a: Column, length: Column, value: int) -> Column:
    """Generation goes on at the right end, so a batch of prompts is padded at the left."""
    return F.concat(F.array_repeat(F.lit(value).cast("long"), length - F.size(a)), a)


def prompt_inputs(prompt: Column, has_image: Column, tokenize: Tokenize) -> tuple[Column, Column, Column]:
    """(ids, mask, labels) of an inference prompt: all of it is attended, none of it is a label."""
    ids = tokens_with_image(prompt, has_image, tokenize)
    return ids, F.transform(ids, lambda _: F.lit(1).cast("long")), F.transform(ids, lambda _: F.lit(IGNORE).cast("long"))


def splice(a: Column, block: Column, ids: Column) -> Column:
    """a with the place of the single image sentinel in ids replaced by block; unchanged without one, an error with two."""
    n = F.size(F.filter(ids, lambda x: x == IMAGE_TOKEN))
    at = F.array_position(ids, F.lit(IMAGE_TOKEN).cast("long")).cast("int")
    out = F.concat(F.slice(a, F.lit(1), F.greatest(at - 1, F.lit(0))), block, F.slice(a, F.greatest(at + 1, F.lit(1)), F.size(a)))
    return F.when(n == 0, a).when(n == 1, out).otherwise(F.raise_error(F.lit("more than one image in a sample")))


def splice_labels(labels: Column, ids: Column, queries: int = QUERY_TOKENS) -> Column:
    return splice(labels, F.array_repeat(F.lit(IGNORE).cast("long"), queries), ids)


def embeddable(ids: Column) -> Column:
    """Ids without negative sentinels."""
    return F.transform(ids, lambda x: F.greatest(x, F.lit(0).cast("long")))


def length_proxy(turns: Column, has_image: Column, queries: int = QUERY_TOKENS) -> Column:
    """Characters of all turns, and a share for an image."""
    n = F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + F.length(t["value"]))
    return n + F.when(has_image, F.lit(queries * CHARS_PER_QUERY)).otherwise(0)


def first_rows(features: Column, n: int = QUERY_TOKENS) -> Column:
    return F.slice(features, 1, n)


def zero_features(rows: int = QUERY_TOKENS, width: int = QUERY_WIDTH) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), rows)


def project(df: DataFrame, column: str, weight: np.ndarray, bias: np.ndarray, name: str = "projected") -> DataFrame:
    """df plus weight @ vector + bias for an array column (Arrow batches; the weights are a model's, of fixed size)."""
    held = df.sparkSession.sparkContext.broadcast((weight.astype(np.float64), bias.astype(np.float64)))

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        w, b = held.value
        return x.map(lambda v: None if v is None else (w @ np.asarray(v, np.float64) + b))

    return df.withColumn(name, apply(F.col(column)))


def project_small(vector: Column, weight: list[list[float]], bias: list[float]) -> Column:
    """The same in built-in functions, for few output dimensions."""
    rows = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in w]).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weight, bias, strict=True)])
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(vector, r["w"], lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x) + r["b"])
