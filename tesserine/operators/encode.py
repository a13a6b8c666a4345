"""Encoders: texts to vectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..config import DEFAULT


#: Words whose buckets a task keeps.
MEMO_WORDS = 500_000


def hashed_words(c: Column, dim: int = 64) -> Column:
    """A bag of lower-cased words, each in the bucket of its MD5, scaled to length 1; zeros without words, null for null.

    One pass over the words, in Arrow batches: counting buckets with built-in functions takes a pass for each bucket.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, int] = {}

        def bucket(word: str) -> int:
            k = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            if len(word) <= 64 and len(memo) < MEMO_WORDS:
                memo[word] = k
            return k

        def vector(text: str | None) -> np.ndarray | None:
            if text is None:
                return None
            # words stand between space, tab and newline only
            words = text.replace("\t", " ").replace("\n", " ").split(" ")
            n = np.bincount([memo[w] if w in memo else bucket(w) for w in words if w], minlength=dim).astype(float)
            length = math.sqrt(float((n * n).sum()))
            return n / length if length else n

        for batch in texts:
            yield batch.map(vector)

    return counted(F.lower(c))


def encode(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", rows: int = DEFAULT.embed.encode_rows, out: str = "embedding") -> DataFrame:
    """df with the vectors of a model that load() gives, once for each task; vectors of length 1, in single precision."""

    def run(batches):
        model = load()
        for batch in batches:
            found: list = []
            texts = batch[text].fillna("").tolist()
            for at in range(0, len(texts), rows):
                x = np.asarray(model(texts[at : at + rows]), np.float32)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                found += list(x / np.where(length == 0, 1, length))
            yield batch.assign(**{out: pd.Series(found, index=batch.index, dtype=object)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, `{out}` array<float>")
