"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs
with one word between, hashed to BITS bits. The regression learns with a rate
per coordinate and an L1 penalty, so most weights stay exactly zero; the ones
left, a bounded table, go to every worker, and each whole text is scored in one
pass over its words.

It is fitted on at most SAMPLE labelled rows, chosen by hash from the fold that
is not held out; a label, language, source or id is never a feature. Documents
without words get the score of no features. Rows with several labels count as
toxic if one says so; null labels are left out. Without any labels every score
is one half and the prediction 1 by the stated rule. Each row is scored by
itself, so repeated rows, null ids and null texts keep their row; extra columns
are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import chunks, held_out, mix, word_hashes

SAMPLE = 1 << 15
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.01
# Words are letters, digits and bytes of other characters.
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """``slots, text``: hashed features of all texts, repeats included."""
    hashes, offsets = word_hashes(texts, _SEPARATOR)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    slots, owners = [hashes], [text]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xE7037ED1A0B428DB)):
        if len(hashes) > gap:
            same = text[gap:] == text[:-gap]
            slots.append((mix(hashes[:-gap] ^ np.uint64(salt)) + hashes[gap:])[same])
            owners.append(text[gap:][same])
    return (mix(np.concatenate(slots)) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """Weights by the follow-the-regularised-leader proximal update."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)  # the last one is the bias
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(
            np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        )

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, 1 << BITS)
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        squared = error * error
        self.z[at] += error - (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += squared


def _learn(batches):
    """One pass over the sample, chunk by chunk, each visited twice."""
    model = Ftrl()
    for batch, texts in chunks(batches, "text"):
        labels = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
        slots, owner = features(texts)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
        rows = [np.unique(slots[order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for _ in range(2):
            for row, label in zip(rows, labels, strict=True):
                model.learn(row, label)
    w = model.weights()
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(w[some])], ["slot", "weight"])


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """``slots, weights`` that are not zero; at most 2 ** BITS + 1."""
    spark = documents.sparkSession
    h = F.xxhash64("doc_id", F.lit(3))
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(h, "doc_id").limit(sample)
    )
    rows = known.collect()  # at most the sample's ids
    chosen = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, toxic int")
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(
        F.broadcast(chosen), "doc_id"
    )
    # One task learns from the bounded sample, in an order that no location decides.
    found = (
        texts.repartition(1).sortWithinPartitions(h, "doc_id", F.xxhash64("text")).select("text", "toxic")
        .mapInArrow(_learn, "slot int, weight double").toPandas()
    )
    return found["slot"].to_numpy(dtype=np.int64), found["weight"].to_numpy(dtype=np.float64)


def _score(batches, slots, weights):
    table = np.zeros((1 << BITS) + 1)
    table[slots] = weights
    for batch, texts in chunks(batches, "text"):
        found, owner = features(texts)
        heavy = table[found] != 0
        # Distinct features: most slots have no weight, so few are left to sort.
        pairs = np.unique((owner[heavy].astype(np.int64) << (BITS + 1)) | found[heavy])
        total = table[1 << BITS] + np.bincount(
            pairs >> (BITS + 1), weights=table[pairs & ((1 << (BITS + 1)) - 1)], minlength=len(texts)
        )
        score = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``documents``."""
    slots, weights = fit_toxicity(documents, labels)
    asked = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return asked.mapInArrow(
        partial(_score, slots=slots, weights=weights),
        "doc_id long, held_out boolean, score double, predicted int",
    )
