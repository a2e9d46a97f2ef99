"""An exact distribution over words by their bytes, for words that have no id of their own.

Every distinct word stays counted in Spark; from these counts come those of three bytes in
a row (two spaces before a word, one after it). The chance of a byte after two others mixes
the counts after both, after one, and of all, each by the share of its distinct followers,
down to an equal chance of 256 bytes, so that every string has a positive probability and
those of all strings sum to one. There are at most 2^24 counts of three bytes, however large
the corpus; none is left out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EDGE = 32
# Words are cut into runs of three bytes until so many are held.
_HELD = 4_000_000


def _codes(words: list) -> tuple[np.ndarray, np.ndarray]:
    """``codes, starts``: all words' runs of three bytes as numbers, and where each word's begin."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    # One code for each byte and for the space that ends its word.
    last = joined[1:]
    middle = joined[:-1]
    first = np.empty_like(last)
    first[1:] = joined[:-2]
    first[starts[:-1]] = _EDGE
    return first << 16 | middle << 8 | last, starts


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _count(batches, known):
    """Runs of three bytes of the words that are not ``known`` (sorted hashes)."""
    held, size = [], 0

    def flush():
        code, n = _sums(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    for batch in batches:
        word = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        n = batch.column(2).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~np.isin(word, known))
        if not len(other):
            continue
        codes, starts = _codes(batch.column(1).take(pa.array(other)).to_pylist())
        held.append((codes, np.repeat(n[other], np.diff(starts))))
        size += len(codes)
        if size > _HELD:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def learn_spelling(words: DataFrame, known: np.ndarray) -> "Spelling":
    """Of all counted ``words`` (``word long, spelled binary, n long``) but the ``known`` hashes."""
    counted = words.select("word", "spelled", "n").mapInArrow(partial(_count, known=np.sort(known)), "code long, n long")
    # At most 2^24 rows, by what three bytes can be.
    found = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return Spelling(found.column("code").to_numpy(), found.column("n").to_numpy())


class Spelling:
    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, counts = _sums(codes, counts) if len(codes) else (codes, counts)
        counts = counts.astype(np.float64)
        context, last = self.codes >> 8, self.codes & 255
        pairs = np.zeros((256, 256))
        np.add.at(pairs, (context & 255, last), counts)
        alone = self._mixed(pairs.sum(axis=0, keepdims=True), np.full((1, 256), 1 / 256))
        self.after_one = self._mixed(pairs, np.broadcast_to(alone, (256, 256)))
        self.contexts, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(self.contexts))
        kinds = np.bincount(at, minlength=len(self.contexts))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.seen = np.log(
                (counts + kinds[at] * self.after_one[context & 255, last]) / (total + kinds)[at])
            self.escape = np.log(kinds / (total + kinds))
        self.after_one = np.log(self.after_one)

    @staticmethod
    def _mixed(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Chances of each row's counts, mixed with ``below`` by the share of distinct ones."""
        kinds, total = (counts > 0).sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True)
        return np.where(total > 0, (counts + kinds * below) / np.maximum(total + kinds, 1), below)

    def log_chances(self, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each run of three after the two before it."""
        out = self.after_one[(codes >> 8) & 255, codes & 255]
        if not len(self.codes):
            return out
        context = codes >> 8
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        out = out + np.where(self.contexts[at] == context, self.escape[at], 0.0)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.seen[at], out)

    def log_probabilities(self, words: list) -> np.ndarray:
        """Of each word, a string of bytes without spaces, up to its end."""
        if not words:
            return np.zeros(0)
        codes, starts = _codes(words)
        return np.add.reduceat(self.log_chances(codes), starts[:-1])
