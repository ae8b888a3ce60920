"""Model calls as an Arrow boundary: a backend maps batches of rows to replies; tests use a deterministic stub."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Backend(Protocol):
    def reply(self, batch: pd.DataFrame) -> list[str]:
        """A reply for each row."""


class Stub:
    """Replies that depend on the key only; keys with `bad` in them raise."""

    def __init__(self, key: str = "frame_path"):
        self.key = key

    def reply(self, batch: pd.DataFrame) -> list[str]:
        out = []
        for k in batch[self.key]:
            if "bad" in str(k):
                raise FileNotFoundError(k)
            out.append("Yes." if int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 2 else "No.")
        return out


def infer(rows: DataFrame, make: Callable[[], Backend], batch_size: int = 8, name: str = "reply") -> DataFrame:
    """rows plus the reply. The backend is made once a task; if a batch fails, each of its rows gets the error marker."""
    schema = StructType([*rows.schema, StructField(name, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for x in batches:
            for i in range(0, len(x), batch_size):
                part = x.iloc[i : i + batch_size]
                try:
                    replies = backend.reply(part)
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    replies = [f"__ERROR__: {type(e).__name__}: {e}"] * len(part)
                yield part.assign(**{name: replies})

    return rows.mapInPandas(run, schema)


def infer_once(rows: DataFrame, make: Callable[[], Backend], key: str, batch_size: int = 8, name: str = "reply") -> DataFrame:
    """The same, with each distinct key asked once (by its smallest row) and joined back."""
    asked = infer(rows.select(key).distinct(), make, batch_size, name)
    return rows.join(asked, key)


def in_chunks_of(rows: DataFrame, size: int) -> DataFrame:
    """A hint for backends whose batch is the Arrow batch."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    return rows


def encode_images(images: DataFrame, make: Callable[[], Callable[[bytes], list[list[float]]]], queries: int = 32) -> DataFrame:
    """images(image, idx, content): (image, idx, ok, features) with the first `queries` rows; unreadable images have ok false and null features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for x in batches:
            ok, out = [], []
            for content in x["content"]:
                try:
                    out.append([[float(v) for v in row] for row in encode(content)[:queries]])
                    ok.append(True)
                except Exception:  # noqa: BLE001
                    out.append(None)
                    ok.append(False)
            yield pd.DataFrame({"image": x["image"], "idx": x["idx"], "ok": ok, "features": out})

    return images.select("image", "idx", "content").mapInPandas(run, "image string, idx long, ok boolean, features array<array<float>>").where(F.col("image").isNotNull())
