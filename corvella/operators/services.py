"""Outside services as column functions, with deterministic stand-ins; a registry names them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

EMBEDDING_SIZE = 64

_EMBEDDERS: dict[str, Callable[[Column, str], Column]] = {}
_GENERATORS: dict[str, Callable[[Column], Column]] = {}
_VISION: dict[str, Callable[[Column], Column]] = {}


def _registered(table: dict[str, Callable], name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        table[name.upper()] = f
        return f

    return add


def embedder(name: str) -> Callable[[Column, str], Column]:
    return _EMBEDDERS[name.upper()]


def generator(name: str) -> Callable[[Column], Column]:
    return _GENERATORS[name.upper()]


def vision(name: str | None) -> Callable[[Column], Column]:
    """A reader of images; anything unknown gives the null reader and never an error."""
    return _VISION.get((name or "").upper(), _VISION["NULL"])


def register_embedder(name: str) -> Callable[[Callable], Callable]:
    return _registered(_EMBEDDERS, name)


def register_generator(name: str) -> Callable[[Callable], Callable]:
    return _registered(_GENERATORS, name)


def register_vision(name: str) -> Callable[[Callable], Callable]:
    return _registered(_VISION, name)


_WORD_CACHE = 200_000
_word_vectors: dict[str, np.ndarray] = {}


def _word_vector(word: str) -> np.ndarray:
    """Signed counts of a word's hashed character triples; remembered by the worker up to a fixed number of words."""
    found = _word_vectors.get(word)
    if found is None:
        if len(_word_vectors) >= _WORD_CACHE:
            _word_vectors.clear()
        found = np.zeros(EMBEDDING_SIZE, np.float32)
        padded = f" {word} "
        for k in range(len(padded) - 2):
            h = xxhash.xxh3_64_intdigest(padded[k : k + 3])
            found[h % EMBEDDING_SIZE] += 1 if h >> 63 else -1
        _word_vectors[word] = found
    return found


@pandas_udf(ArrayType(FloatType()))
def _hashed(text: pd.Series) -> pd.Series:
    out = np.zeros((len(text), EMBEDDING_SIZE), np.float32)
    for i, t in enumerate(text):
        words = (t or "").lower().split()
        if words:
            out[i] = np.sum([_word_vector(w) for w in words], axis=0)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return pd.Series(list(out / np.where(size == 0, 1, size)))


@register_embedder("hashed")
def hashed_embedding(text: Column, kind: str = "document") -> Column:
    """Signed counts of hashed character triples, scaled to length one; the same for documents and queries."""
    return _hashed(text)


@register_embedder("none")
def no_embedding(text: Column, kind: str = "document") -> Column:
    return F.lit(None).cast("array<float>")


@register_generator("extractive")
def extractive_answer(prompt: Column) -> Column:
    """The first passage of the prompt, in place of a written answer."""
    return F.nullif(F.regexp_extract(prompt, r"(?s)Passage: (.*?)(?:\n|$)", 1), F.lit(""))


@register_generator("none")
def no_answer(prompt: Column) -> Column:
    return F.lit(None).cast("string")


@register_vision("null")
def no_description(image: Column) -> Column:
    return F.lit(None).cast("string")


@register_vision("stub")
def described_by_digest(image: Column) -> Column:
    """A description made of the image's digest."""
    return F.concat(F.lit("image "), F.substring(F.sha2(image.cast("binary"), 256), 1, 8))
