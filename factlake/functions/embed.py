"""Text -> vector through a pluggable batch embedder."""

import re
from collections.abc import Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.scalars import blank_to_null
from factlake.schema import EMBED_CHUNK, VECTOR
from factlake.session import spread


class Embedder(Protocol):
    """Anything that turns a list of texts into as many vectors, in order."""

    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Deterministic offline embedder: signed, hashed word counts of unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.name = f"hashed-words-{dimensions}"
        self._slots: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        slot = self._slots.get(word)
        if slot is None:
            if len(self._slots) > 500_000:
                self._slots.clear()
            slot = self._slots[word] = crc32(word.encode()) % (2 * self.dimensions)
        return slot

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            counts = np.bincount(
                [self._slot(w) for w in words], minlength=2 * self.dimensions
            )
            out[row] = counts[: self.dimensions] - counts[self.dimensions:]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def embedded(texts: pa.Array, model: Embedder, chunk: int = EMBED_CHUNK) -> pa.Array:
    """The vectors of a batch of texts; one chunk of them at a time leaves the batch."""
    chunks = []
    for start in range(0, len(texts), chunk):
        some = texts.slice(start, chunk).to_pylist()
        for position, text in enumerate(some, start):
            if text is None or not text.strip():
                raise ValueError(f"cannot embed an empty text (row {position} of its batch)")
        vectors = np.asarray(model.embed(some)).astype("float32")
        offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
        chunks.append(pa.ListArray.from_arrays(offsets, np.ascontiguousarray(vectors).ravel()))
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(pa.float32()))


def embed_column(
    df: DataFrame,
    text_col: str,
    embedder: Embedder | None = None,
    chunk: int = EMBED_CHUNK,
    output: str = "embedding",
) -> DataFrame:
    """``df`` with a vector of ``text_col``; a blank text fails the job.

    Only the text travels to Python, the other columns stay where they are.
    Split blank texts off first with :func:`split_blank` to report them instead.
    """
    model = embedder or HashedWords()

    @F.arrow_udf(VECTOR)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield embedded(batch, model, chunk)

    rows = spread(df.drop(output) if output != text_col else df)
    return rows.withColumn(output, run(F.col(text_col)))


def split_blank(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that can be embedded, rows with an empty or blank text)."""
    blank = F.coalesce(blank_to_null(F.col(text_col)), F.lit("")) == ""
    return df.filter(~blank), df.filter(blank)
