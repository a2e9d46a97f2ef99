"""Quality: naive Bayes support vectors, a linear hinge-loss model over scaled n-gram indicators.

A text is a run of tokens: words (letters, digits and bytes beyond ASCII) and
runs of marks. Its features are the distinct ones among its tokens and pairs of
neighbouring tokens in lower case, and among the pairs and runs of four of its
tokens' shapes (lower, capital, all capitals, mixed, digits, the same as the
last word, or the marks themselves), hashed to BITS bits. Each indicator is
scaled by the log ratio of its smoothed shares in the classes; a support vector
machine is fitted to the scaled rows by dual coordinate descent until no step
moves the dual by more than TOLERANCE, and its weights are drawn towards their
mean size, so that the ratios themselves keep a say. A logistic curve fitted to
margins of rows that a first fit did not see turns margins into scores.

Fitted on a bounded sample, which one task holds: at most SAMPLE labelled rows
by hash from the fold that is not held out, and no more of them than have
MOST_FEATURES features together. The weights, 2 ** BITS numbers of four bytes, go
to every worker and each whole text is scored in one pass. Labels, language, source
and id are never features.

Defined cases. Null texts are empty; texts without tokens get the score of no
features. Labels of one id count as 1 if one of them is; null labels and ids are
left out. Rows that repeat an id and text are learnt from once and each keep
their row in the result. Without labels of both classes every score is the
smoothed share of label 1, one half without any. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import _LOWER, _MASK, _ODD, _mixed_lengths, chunks, held_out, mix

SAMPLE = 1 << 14
MOST_FEATURES = 1 << 24
BITS = 20
SMOOTHING, COST, KEPT = 1.0, 0.1, 0.75
TOLERANCE, MOST_EPOCHS = 0.01, 40
# What a byte belongs to: 0 white space and controls, 1 words, 2 marks.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[:33] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[48:58] = 1
_LOWEST, _CAPITAL, _CAPITALS, _MIXED, _DIGITS, _AGAIN = (np.uint64(i) for i in range(1, 7))
_SALTS = [np.uint64(i) for i in (0x632BE59BD9B4E019, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hashes, shapes, text`` of all tokens, in order."""
    joined = b" ".join([b"", *(t or b"" for t in texts), b" " * 8])
    data = np.frombuffer(joined, dtype=np.uint8)
    kind = _CLASS[data]
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = edges[kind[edges] > 0]
    ends = np.append(edges, len(kind))[np.searchsorted(edges, starts) + 1]
    lengths = ends - starts
    lowered = _LOWER[data]
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=lowered, strides=(1,))
    hashes = mix((eight[starts] & _MASK[np.minimum(lengths, 8)]) ^ _mixed_lengths(lengths))
    at, done = np.flatnonzero(lengths > 8), 8
    while len(at):
        part = eight[starts[at] + done] & _MASK[np.minimum(lengths[at] - done, 8)]
        hashes[at] = mix(hashes[at] * _ODD + part)
        done += 8
        at = at[lengths[at] > done]
    ends_of_text = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends_of_text)))
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags[data])])
    upper, digit = sums(_UPPER), sums(_DIGIT)
    n_upper, n_digit = upper[ends] - upper[starts], digit[ends] - digit[starts]
    shapes = np.where(n_upper == 0, _LOWEST, _MIXED)
    shapes[(n_upper == 1) & (_UPPER[data[starts]] == 1)] = _CAPITAL
    shapes[(n_upper == lengths) & (lengths > 1)] = _CAPITALS
    shapes[n_digit > 0] = _DIGITS
    word = kind[starts] == 1
    shapes[~word] = hashes[~word]
    words = np.flatnonzero(word)
    same = (hashes[words[1:]] == hashes[words[:-1]]) & (text[words[1:]] == text[words[:-1]])
    shapes[words[1:][same]] = _AGAIN
    return hashes, shapes, text


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """``slots, text`` of the distinct features of each text, by text and slot."""
    hashes, shapes, text = tokens(texts)
    found, owners = [mix(hashes ^ _SALTS[0])], [text]
    for values, n, salt in ((hashes, 2, _SALTS[1]), (shapes, 2, _SALTS[2]), (shapes, 4, _SALTS[3])):
        if len(values) >= n:
            m = len(values) - n + 1
            run = values[:m] ^ salt
            for i in range(1, n):
                run = mix(run) + values[i:m + i]
            same = text[:m] == text[n - 1:]
            found.append(mix(run)[same])
            owners.append(text[:m][same])
    slots = np.concatenate(found) >> np.uint64(64 - BITS)
    pairs = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | slots)
    return (pairs & np.uint64((1 << BITS) - 1)).astype(np.int32), (pairs >> np.uint64(BITS)).astype(np.int64)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, slots: int) -> np.ndarray:
    """Of each slot, the log of its smoothed share in class 1 over that in class 0."""
    def shares(label):
        some = [r for r, y in zip(rows, labels, strict=True) if y == label]
        counts = SMOOTHING + np.bincount(np.concatenate(some), minlength=slots)
        return counts / counts.sum()

    return np.log(shares(1) / shares(0))


def dual_descent(
    rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, slots: int, cost: float = COST,
    tolerance: float = TOLERANCE, epochs: int = MOST_EPOCHS,
) -> tuple[np.ndarray, np.ndarray]:
    """``weights, alphas`` of least ``|w|^2 / 2 + cost * sum of hinge losses``; the last weight is the bias.

    One dual variable is set to its best value at a time, in a new order each
    round; the classes' losses weigh the same in all.
    """
    n = len(rows)
    y = np.where(labels == 1, 1.0, -1.0)
    most = cost * n / (2 * np.maximum(np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()), 1))
    weights, alphas = np.zeros(slots + 1), np.zeros(n)
    squares = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            at, x = rows[i], values[i]
            gradient = y[i] * (float(weights[at] @ x) + weights[slots]) - 1
            before = alphas[i]
            after = min(max(before - gradient / squares[i], 0.0), most[i])
            if after != before:
                step = (after - before) * y[i]
                weights[at] += step * x
                weights[slots] += step
                alphas[i] = after
                worst = max(worst, abs(after - before) * squares[i])
        if worst <= tolerance:
            break
    return weights, alphas


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, slots: int) -> np.ndarray:
    """Weights of plain indicators: ratios times drawn-in support vector weights, then the bias."""
    ratios = log_ratios(rows, labels, slots)
    weights, _ = dual_descent(rows, [ratios[r] for r in rows], labels, slots)
    seen = np.zeros(slots, dtype=bool)
    seen[np.concatenate(rows)] = True
    size = np.abs(weights[:slots][seen]).mean() if seen.any() else 0.0
    drawn = np.where(seen, (1 - KEPT) * size + KEPT * weights[:slots], 0.0)
    return np.append(drawn * ratios, weights[slots])


def margins(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([weights[r].sum() + weights[-1] for r in rows])


def fit_curve(found: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and place of the logistic curve of least log loss, by Newton steps, with softened labels."""
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(float(np.abs(found).mean()), 1e-9)
    x = np.stack([found / scale, np.ones(len(found))], axis=1)
    at = np.zeros(2)

    def loss(a):
        z = x @ a
        return float((np.logaddexp(0, z) - goal * z).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0] / scale), float(at[1])


def _rows_of(batches):
    """The features of each labelled text, as one list."""
    for batch, texts in chunks(batches, "text"):
        slots, owner = features(texts)
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(slots))],
            ["doc_id", "blob", "quality", "slots"],
        )


def _learn(batches, most):
    rows, labels, total = [], [], 0
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("slots"))
        offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        quality = np.asarray(batch.column(batch.schema.get_field_index("quality")))
        for i in range(batch.num_rows):
            row = flat[offsets[i]:offsets[i + 1]]
            if total and total + len(row) > most:
                break
            rows.append(row.copy())
            labels.append(int(quality[i]))
            total += len(row)
        else:
            continue
        break
    y = np.array(labels)
    if 0 < y.sum() < len(y):
        # A fifth of each class is not seen by the fit that the curve is made from.
        order = np.concatenate([np.flatnonzero(y == 0), np.flatnonzero(y == 1)])
        apart = np.zeros(len(y), dtype=bool)
        apart[order[::5]] = True
        seen, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
        if 0 < y[seen].sum() < len(seen):
            first = fit_rows([rows[i] for i in seen], y[seen], 1 << BITS)
            slope, place = fit_curve(margins(first, [rows[i] for i in rest]), y[rest])
        else:
            slope, place = 1.0, 0.0
        weights = fit_rows(rows, y, 1 << BITS) * max(slope, 0.0)
        weights[-1] += place
    else:
        weights = np.zeros((1 << BITS) + 1)
        weights[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()])], ["weights"])


def fit_quality(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES,
) -> np.ndarray:
    """A weight for each slot, then the bias; the logistic of a text's sum is its score."""
    spark = documents.sparkSession
    h = F.xxhash64("doc_id", F.lit(12))
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .orderBy(h, "doc_id").limit(sample)
    ).collect()  # at most the sample's ids
    chosen = spark.createDataFrame([tuple(r) for r in known], "doc_id long, quality int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("blob"), text.alias("text")
    ).join(F.broadcast(chosen), "doc_id")
    found = (
        rows.select("doc_id", "blob", "quality", "text")
        .mapInArrow(_rows_of, "doc_id long, blob long, quality int, slots array<int>")
        .groupBy("doc_id", "blob").agg(F.first("quality").alias("quality"), F.first("slots").alias("slots"))
        # Ids that have many texts give no more rows than the sample's size.
        .withColumn("h", h).orderBy("h", "doc_id", "blob").limit(sample)
    )
    # One task learns from the bounded sample, in an order that no location decides.
    model = (
        found.repartition(1).sortWithinPartitions("h", "doc_id", "blob").select("quality", "slots")
        .mapInArrow(partial(_learn, most=most_features), "weights binary").toArrow()
    )
    if not model.num_rows:
        return np.zeros((1 << BITS) + 1, dtype="<f4")
    return np.frombuffer(model.column("weights")[0].as_py(), dtype="<f4")


def _score(batches, weights, threshold):
    table = weights.astype(np.float64)
    for batch, texts in chunks(batches, "text"):
        found, owner = features(texts)
        total = table[-1] + np.bincount(owner, weights=table[found], minlength=len(texts))
        score = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``documents``."""
    weights = fit_quality(documents, labels)
    asked = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return asked.mapInArrow(
        partial(_score, weights=weights, threshold=threshold),
        "doc_id long, held_out boolean, score double, predicted int",
    )
