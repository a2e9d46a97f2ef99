"""What the operators of this subpackage share: tables, words as arrays, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are worked on together until a chunk has this many bytes.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches, each of some CHUNK_BYTES of texts or of one longer text.

    Texts come as UTF-8 bytes, None where null.
    """
    for part, texts in slices(batches, text, CHUNK_BYTES):
        yield part, texts.to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches, each of at most so many bytes of texts or of one text, and their texts as bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(binary), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start), binary.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start), binary.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, offsets``: the words of all texts, and where each text's begin and end.

    Words are what lies between the separator bytes, with A-Z lower-cased.
    """
    joined = b" ".join([b"", *(t or b"" for t in texts), b" " * 8])
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = ~separator[data]
    # The text begins and ends outside of words, so edges are starts and ends in turn.
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    ends_of_text = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    offsets = np.searchsorted(starts, ends_of_text)
    data = _LOWER[data]
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    lengths = ends - starts
    hashes = mix((eight[starts] & _MASK[np.minimum(lengths, 8)]) ^ _mixed_lengths(lengths))
    at, done = np.flatnonzero(lengths > 8), 8
    while len(at):
        part = eight[starts[at] + done] & _MASK[np.minimum(lengths[at] - done, 8)]
        hashes[at] = mix(hashes[at] * _ODD + part)
        done += 8
        at = at[lengths[at] > done]
    return hashes, offsets


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LENGTHS = mix(np.arange(1024, dtype=np.uint64))


def _mixed_lengths(lengths: np.ndarray) -> np.ndarray:
    return _LENGTHS[np.minimum(lengths, len(_LENGTHS) - 1)]
