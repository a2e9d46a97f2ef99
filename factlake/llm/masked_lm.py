"""Masked pseudo-likelihood: a window network that predicts every word from both sides.

Words are counted over all documents, every distinct one with its spelling; the
most frequent (VOCABULARY - SHARED) have an id each. To the network the others are
SHARED ids by hash; together they are one event, "another word", and which other
word it is has its probability by ``spelling``, so every word of every text counts
as itself, seen or not. The network sums gated
embeddings of the WINDOW words on either side, applies tanh, and predicts the
masked word as its group and its place in the group, each by a softmax; both
together are an exact conditional distribution over the vocabulary.

Training is data-parallel in numpy and sees every document once: in round one
every task trains on one part of its documents from one start, the frequency of
each id whatever its neighbours, in round
two on the rest from the average; after each round the parameters are averaged
over tasks, weighted by the words they saw. They are summed per block of
parameters by Spark, so what is gathered grows with the number of tasks and no
node holds more than one model. A document's score ``text_log_likelihood`` is the
sum over its words of the log-probability (natural) of the word given its neighbours;
``log_likelihood`` is the same of the words' ids alone, which tells texts of rare
words hardly apart. Over all words the chances sum to less than one by what the
spelling gives to words that have an id.

Null texts and texts without words have no words and score 0. Every row is
scored by itself, so repeated rows and null ids keep their row; extra columns are
ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import chunks, word_hashes
from factlake.llm.spelling import Spelling, learn_spelling
from factlake.llm.toxicity_ftrl import _SEPARATOR
from factlake.session import materialize

GROUPS = 32
VOCABULARY = GROUPS * GROUPS
# Ids that words outside the vocabulary share by hash; one more id marks the edges.
SHARED = 64
# The groups of the shared ids: the chance of another word is the sum of theirs.
OPEN_GROUP = (VOCABULARY - SHARED) // GROUPS
WINDOW = 2
WIDTH = 8
BATCH = 8192
RATE = 0.15
# The part of the documents that round one trains on: one in so many, by hash.
FIRST_PART = 8
# Numbers of the model in one row while it is averaged.
BLOCK = 4096


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        """``hashes`` by descending frequency; neighbours in frequency share a group."""
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        shared = (VOCABULARY - SHARED + (hashes % np.uint64(SHARED)).astype(np.int64)).astype(np.int32)
        if not len(self.hashes):
            return shared
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], shared)


_LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACED = bytes(32 if separates else byte for byte, separates in enumerate(_SEPARATOR))


def spelled(texts: list) -> list:
    """The words of all texts as lower-case bytes, in the order of their hashes."""
    return b" ".join([t or b"" for t in texts]).translate(_SPACED).translate(_LOWERED).split()


def _count_words(batches):
    """Each task's words with their spelling and how often they occur, summed over runs of chunks."""
    held, size = [], 0

    def flush():
        words = np.concatenate([w for w, _, _ in held])
        bytes_of = [b for _, some, _ in held for b in some]
        values, first, at = np.unique(words, return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([n for _, _, n in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array([bytes_of[i] for i in first], pa.binary()), pa.array(counts)],
            ["word", "spelled", "n"],
        )

    for _, texts in chunks(batches, "text"):
        values, first, counts = np.unique(word_hashes(texts, _SEPARATOR)[0], return_index=True, return_counts=True)
        words = spelled(texts)
        held.append((values, [words[i] for i in first], counts))
        size += len(values)
        if size > 1_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def count_words(documents: DataFrame) -> DataFrame:
    """``word, spelled, n``: every distinct word of all documents, written once."""
    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _count_words, "word long, spelled binary, n long")
    return materialize(counted.groupBy("word", "spelled").agg(F.sum("n").alias("n")), "words")


def most_frequent(words: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The words that have an id each, and how often each id occurs."""
    top = (
        words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")
        .limit(VOCABULARY - SHARED).toPandas()
    )
    hashes = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    counts = np.zeros(VOCABULARY)
    # SHARED divides 2^64, so hashes with and without a sign share alike.
    shared = words.groupBy(F.pmod("word", F.lit(SHARED)).alias("at")).agg(F.sum("n").alias("n")).toPandas()
    counts[VOCABULARY - SHARED + shared["at"].to_numpy(dtype=np.int64)] = shared["n"]
    np.subtract.at(counts, VOCABULARY - SHARED + (hashes % np.uint64(SHARED)).astype(np.int64), top["n"].to_numpy())
    counts[:len(top)] = top["n"]
    return Vocabulary(hashes), counts


class WindowNetwork:
    """Parameters and arithmetic of the network, as one flat array of float32."""

    SHAPES = (
        ("embedding", (VOCABULARY + 1, WIDTH)), ("gate", (2 * WINDOW, WIDTH)), ("shift", (WIDTH,)),
        ("group", (WIDTH, GROUPS)), ("group_bias", (GROUPS,)),
        ("member", (GROUPS, WIDTH, GROUPS)), ("member_bias", (GROUPS, GROUPS)),
    )
    SIZE = sum(int(np.prod(shape)) for _, shape in SHAPES)

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(9)
            flat = np.concatenate([
                (np.ones(int(np.prod(shape))) if name == "gate" else
                 np.zeros(int(np.prod(shape))) if "bias" in name or name == "shift" else
                 rng.normal(0, 0.1, int(np.prod(shape)))) for name, shape in self.SHAPES
            ]).astype(np.float32)
        self.flat = flat.astype(np.float32, copy=True)
        at = 0
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + size].reshape(shape))
            at += size
        # Sums of squared gradients, for a rate per number.
        self.seen = np.full(self.SIZE, 1e-2, dtype=np.float32)

    @classmethod
    def by_frequency(cls, counts: np.ndarray) -> "WindowNetwork":
        """A network that starts from how often each id occurs."""
        network = cls()
        counts = counts.reshape(GROUPS, GROUPS) + 0.5
        network.group_bias[:] = np.log(counts.sum(axis=1) / counts.sum())
        network.member_bias[:] = np.log(counts / counts.sum(axis=1, keepdims=True))
        return network

    def _hidden(self, context):
        looked = self.embedding[context]
        return looked, np.tanh(np.einsum("nkd,kd->nd", looked, self.gate) + self.shift)

    @staticmethod
    def _log_softmax(x):
        x -= x.max(axis=1, keepdims=True)
        total = np.exp(x).sum(axis=1, keepdims=True)
        x -= np.log(total)
        return x

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target given its context; targets sorted by group."""
        return self.both(context, target)[0]

    def both(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each target's id, and of each target where all shared ids are one event."""
        _, hidden = self._hidden(context)
        group, member = np.divmod(target, GROUPS)
        rows = np.arange(len(target))
        groups = self._log_softmax(hidden @ self.group + self.group_bias)
        out = groups[rows, group]
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in range(GROUPS):
            a, b = ends[g], ends[g + 1]
            if b > a:
                inner = self._log_softmax(hidden[a:b] @ self.member[g] + self.member_bias[g])
                out[a:b] += inner[np.arange(b - a), member[a:b]]
        other = np.log(np.exp(groups[:, OPEN_GROUP:]).sum(axis=1))
        return out, np.where(group >= OPEN_GROUP, other, out)

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step on a batch of targets sorted by group."""
        n = np.float32(len(target))
        looked, hidden = self._hidden(context)
        group, member = np.divmod(target, GROUPS)
        rows = np.arange(len(target))
        error = np.exp(self._log_softmax(hidden @ self.group + self.group_bias))
        error[rows, group] -= 1
        step = WindowNetwork.__new__(WindowNetwork)
        step.flat = np.zeros(self.SIZE, dtype=np.float32)
        at = 0
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            setattr(step, name, step.flat[at:at + size].reshape(shape))
            at += size
        step.group[:] = hidden.T @ error
        step.group_bias[:] = error.sum(axis=0)
        back = error @ self.group.T
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in range(GROUPS):
            a, b = ends[g], ends[g + 1]
            if b > a:
                inner = np.exp(self._log_softmax(hidden[a:b] @ self.member[g] + self.member_bias[g]))
                inner[np.arange(b - a), member[a:b]] -= 1
                step.member[g] = hidden[a:b].T @ inner
                step.member_bias[g] = inner.sum(axis=0)
                back[a:b] += inner @ self.member[g].T
        back *= 1 - hidden * hidden
        step.shift[:] = back.sum(axis=0)
        step.gate[:] = np.einsum("nkd,nd->kd", looked, back)
        for k in range(2 * WINDOW):
            moved = back * self.gate[k]
            ids = context[:, k]
            for d in range(WIDTH):
                step.embedding[:, d] += np.bincount(ids, weights=moved[:, d], minlength=VOCABULARY + 1)
        step.flat /= n
        self.seen += step.flat * step.flat
        self.flat -= np.float32(rate) * step.flat / np.sqrt(self.seen)


def windows(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids on both sides of each word; the edge's id beyond its document."""
    n, counts = len(ids), np.diff(offsets)
    begin, end = np.repeat(offsets[:-1], counts), np.repeat(offsets[1:], counts)
    place = np.arange(n)
    out = np.full((n, 2 * WINDOW), VOCABULARY, dtype=np.int32)
    for k, gap in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        at = place + gap
        inside = (at >= begin) & (at < end)
        out[inside, k] = ids[at[inside]]
    return out


def _batches(ids, offsets):
    """Contexts and targets in batches whose targets are sorted by group."""
    context = windows(ids, offsets)
    for a in range(0, len(ids), BATCH):
        target = ids[a:a + BATCH]
        order = np.argsort(target // GROUPS, kind="stable")
        yield a + order, context[a:a + BATCH][order], target[order]


def _train(batches, vocabulary, start):
    """One task's parameters after its documents, in blocks, weighted by its words."""
    network, words = WindowNetwork(start), 0
    for _, texts in chunks(batches, "text"):
        hashes, offsets = word_hashes(texts, _SEPARATOR)
        ids = vocabulary(hashes)
        for _, context, target in _batches(ids, offsets):
            network.learn(context, target, RATE)
        words += len(ids)
    if words:
        weighted = network.flat.astype(np.float64) * words
        pieces = [weighted[a:a + BLOCK] for a in range(0, WindowNetwork.SIZE, BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([words] * len(pieces), type=pa.int64()),
             pa.array([p.tobytes() for p in pieces], type=pa.binary())],
            ["block", "words", "weighted"],
        )


def _average(frame):
    import pandas as pd

    total = sum(np.frombuffer(b, dtype=np.float64) for b in frame["weighted"])
    mean = (total / frame["words"].sum()).astype(np.float32)
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "mean": [mean.tobytes()]})


def _round(texts: DataFrame, vocabulary: Vocabulary, start: np.ndarray) -> np.ndarray:
    trained = texts.select("text").mapInArrow(
        partial(_train, vocabulary=vocabulary, start=start), "block int, words long, weighted binary"
    )
    # Few sums first, so that no task meets the models of all others.
    means = (
        trained.groupBy("block", F.pmod(F.xxhash64("weighted"), F.lit(16)).alias("part"))
        .applyInPandas(_sum, "block int, words long, weighted binary")
        .groupBy("block").applyInPandas(_average, "block int, mean binary").toPandas()  # one model
    )
    if not len(means):
        return start
    return np.concatenate([np.frombuffer(b, dtype=np.float32) for b in means.sort_values("block")["mean"]])


def _sum(frame):
    import pandas as pd

    total = sum(np.frombuffer(b, dtype=np.float64) for b in frame["weighted"])
    return pd.DataFrame({
        "block": [frame["block"].iloc[0]], "words": [int(frame["words"].sum())], "weighted": [total.tobytes()],
    })


def train(documents: DataFrame) -> tuple[Vocabulary, Spelling, np.ndarray]:
    """Vocabulary, spelling and parameters learnt from every document."""
    texts = documents.filter(F.col("text").isNotNull()).select(
        F.col("text").cast("string").alias("text"), (F.pmod(F.xxhash64("text"), F.lit(FIRST_PART)) == 0).alias("first")
    )
    words = count_words(texts)
    vocabulary, counts = most_frequent(words)
    spelling = learn_spelling(words, vocabulary.hashes)
    flat = _round(texts.filter("first"), vocabulary, WindowNetwork.by_frequency(counts).flat)
    return vocabulary, spelling, _round(texts.filter("not first"), vocabulary, flat)


def _score(batches, model):
    vocabulary, spelling, flat = model.value
    network = WindowNetwork(flat)
    for batch, texts in chunks(batches, "text"):
        hashes, offsets = word_hashes(texts, _SEPARATOR)
        ids = vocabulary(hashes)
        each, open_ = np.zeros(len(ids)), np.zeros(len(ids))
        for order, context, target in _batches(ids, offsets):
            each[order], open_[order] = network.both(context, target)
        other = np.flatnonzero(ids >= VOCABULARY - SHARED)
        _, first, at = np.unique(hashes[other], return_index=True, return_inverse=True)
        words = spelled(texts)
        open_[other] += spelling.log_probabilities([words[i] for i in other[first]])[at]
        counts = np.diff(offsets)
        columns = []
        for found in (each, open_):
            total = np.concatenate([[0.0], np.cumsum(found)])
            sums = np.where(counts > 0, np.minimum(total[offsets[1:]] - total[offsets[:-1]], 0.0), 0.0)
            columns += [pa.array(sums), pa.array(sums / np.maximum(counts, 1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts.astype(np.int64)), *columns],
            ["doc_id", "n_words", "log_likelihood", "per_word", "text_log_likelihood", "text_per_word"],
        )


def score_documents(documents: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_words, log_likelihood, per_word, text_log_likelihood, text_per_word`` for
    each row of ``documents``, by a model of ``learn_from`` (``documents`` itself unless given)."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents if learn_from is None else learn_from))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(
        partial(_score, model=model),
        "doc_id long, n_words long, log_likelihood double, per_word double, "
        "text_log_likelihood double, text_per_word double",
    )
