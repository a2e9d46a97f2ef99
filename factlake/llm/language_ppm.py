"""Language identification by prediction by partial matching.

Per language a variable-order tree of byte contexts is counted on labelled texts
and then frozen. Escape probabilities follow method C with exclusion: in a
context seen ``n`` times with ``d`` different followers a follower seen ``c``
times has ``c / (n + d)``, and the rest goes to the next shorter context, to the
symbols not seen here. A text's code length under each language is exact for
that model; the shortest wins, and the score is its share in the posterior under
equal priors.

Bytes are folded to SYMBOLS symbols: letters without case, one symbol for white
space, digits and other ASCII each, and every non-ASCII byte its own. The order
is the same whatever the languages. Since statistics are frozen, the chance of
every n-gram seen and the escape of every context seen are sorted arrays, which
each task builds from the counts; n-grams of a text are looked up once each.

The classifier is fitted on at most SAMPLE documents per language, chosen by
hash from the fold that is not held out; languages are all values of ``lang``
there. Every document is scored on its whole text.

Null texts and texts without a letter are ``und`` with score 0. Empty tables,
or no labelled text at all, give ``und`` for every row. Each row is answered by
itself, so repeated ids and rows and null ids need no care; extra columns are
ignored. Equal code lengths go to the language that sorts first.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import chunks, held_out
from factlake.session import materialize

SAMPLE = 2048
SYMBOLS = 29 + 128
ORDER = 3
_LETTER = re.compile(rb"[A-Za-z]")


def byte_symbols() -> np.ndarray:
    """The symbol of each byte: white space, letters, digits, others; then the non-ASCII bytes."""
    to = np.full(256, 28, dtype=np.uint8)
    to[128:] = 29 + np.arange(128)
    to[[9, 10, 11, 12, 13, 32]] = 0
    for letter in range(26):
        to[65 + letter] = to[97 + letter] = 1 + letter
    to[48:58] = 27
    return to


def _codes(symbols: np.ndarray, order: int) -> np.ndarray:
    """The number of each symbol with the ``order`` symbols before it."""
    code = symbols.astype(np.int32)
    padded = np.concatenate([np.zeros(order, np.int32), code])
    total = code.copy()
    for k in range(1, order + 1):
        total += padded[order - k:len(padded) - k] * np.int32(SYMBOLS ** k)
    return total


class FrozenContexts:
    """One language: chances of the n-grams seen and escapes of the contexts seen, order by order."""

    def __init__(self, codes: np.ndarray, times: np.ndarray, order: int):
        self.levels: list[tuple] = []
        for k in range(order + 1):
            # N-grams of the k symbols just before and the symbol itself.
            grams, at = np.unique(codes % SYMBOLS ** (k + 1), return_inverse=True)
            c = np.bincount(at, weights=times)
            contexts, of = np.unique(grams // SYMBOLS, return_inverse=True)
            n, d = np.bincount(of, weights=c), np.bincount(of)
            shorter = self.chances(grams % SYMBOLS ** k) if k else np.full(len(grams), 1 / SYMBOLS)
            # With every symbol seen nothing escapes.
            some = d < SYMBOLS
            mass = np.where(some, np.maximum(1 - np.bincount(of, weights=shorter), 1e-300), 1.0)
            d = np.where(some, d, 0)
            self.levels.append((grams, c / (n + d)[of], contexts, d / (n + d) / mass))

    def chances(self, codes: np.ndarray) -> np.ndarray:
        """Of each code's symbol after its context."""
        out = np.full(len(codes), 1 / SYMBOLS)
        for k, (grams, chance, contexts, escape) in enumerate(self.levels):
            if not len(grams):
                break
            asked = codes % SYMBOLS ** (k + 1)
            at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
            before = np.minimum(np.searchsorted(contexts, asked // SYMBOLS), len(contexts) - 1)
            rest = np.where(contexts[before] == asked // SYMBOLS, escape[before], 1.0) * out
            out = np.where(grams[at] == asked, chance[at], rest)
        return out


def ppm_lengths(counts: np.ndarray, order: int) -> np.ndarray:
    """Code lengths in bits, ``(SYMBOLS ** order, SYMBOLS)``, from counts of that shape."""
    seen = np.flatnonzero(counts)
    frozen = FrozenContexts(seen, counts.reshape(-1)[seen], order)
    return -np.log2(frozen.chances(np.arange(SYMBOLS ** (order + 1)))).reshape(-1, SYMBOLS)


class PpmModel:
    """Frozen statistics of all languages, sent to every worker."""

    def __init__(self, languages: list[str], frequent: list[int], order: int):
        """``frequent`` bytes need no mention: every non-ASCII byte has a symbol."""
        self.languages, self.order = languages, order
        self.symbols = byte_symbols()
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.frozen = None

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of n-grams, one column per language."""
        if self.frozen is None:
            self.frozen = [FrozenContexts(grams, times, self.order) for grams, times in self.counts]
        out = np.empty((len(codes), len(self.languages)), dtype=np.float32)
        for i, language in enumerate(self.frozen):
            out[:, i] = -np.log2(language.chances(codes))
        return out

    def __getstate__(self):
        return {**self.__dict__, "frozen": None}

    def score(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        data = np.frombuffer(b"".join((t or b"") + b" " * self.order for t in texts), dtype=np.uint8)
        ends = np.cumsum([len(t or b"") + self.order for t in texts])
        # Whole texts, in pieces that stay small; the padding of the text before is the first context.
        symbols = self.symbols[data]
        bits = np.zeros((len(texts), len(self.languages)))
        step = 1 << 18
        text_start = np.concatenate([[0], ends[:-1]])
        for begin in range(0, len(symbols), step):
            lead = min(begin, self.order)
            codes = _codes(symbols[begin - lead:begin + step], self.order)[lead:]
            inside = np.searchsorted(ends, [begin, begin + len(codes) - 1], side="right")
            first, last = int(inside[0]), int(inside[1])
            cuts = np.maximum(text_start[first:last + 1] - begin, 0)
            seen, at = np.unique(codes, return_inverse=True)
            bits[first:last + 1] += np.add.reduceat(self.lengths(seen)[at], cuts, axis=0, dtype=np.float64)
        best = bits.argmin(axis=1)
        gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) * np.log(2), 700)
        share = 1 / np.exp(-gap).sum(axis=1)
        return [
            (self.languages[b], float(s)) if has_letter(t) else ("und", 0.0)
            for t, b, s in zip(texts, best.tolist(), share.tolist(), strict=True)
        ]


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fit_languages(documents: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> PpmModel:
    """A model of the languages of ``documents`` outside the held-out fold."""
    learn = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # The document with the smallest hash in each of the sample's slots.
    h = F.xxhash64("doc_id", F.lit(8))
    chosen = (
        learn.select("lang", "doc_id", h.alias("h"))
        .groupBy("lang", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min(F.struct("h", "doc_id")).alias("one"))
        .select("lang", F.col("one.doc_id").alias("doc_id"))
    )
    ids = materialize(chosen, "language-sample")  # at most sample ids per language
    texts = learn.select("lang", "doc_id", "text").join(F.broadcast(ids), ["lang", "doc_id"], "left_semi")
    counted = (
        texts.select("lang", "text").groupBy("lang")
        .applyInPandas(partial(_counts_of, order=order), "lang string, model binary")
    )
    import pickle

    parts = {r["lang"]: pickle.loads(r["model"]) for r in counted.collect()}
    return _joined(parts, order)


def _counts_of(frame, order):
    """One language's counts of byte n-grams; the sample bounds the group."""
    import pickle

    import pandas as pd

    grams = np.zeros(0, dtype=np.uint64)
    times = np.zeros(0, dtype=np.int64)
    held, size = [], 0

    def merge():
        nonlocal grams, times, held, size
        found, n = np.unique(np.concatenate(held), return_counts=True)
        both = np.concatenate([grams, found])
        weight = np.concatenate([times, n])
        grams, at = np.unique(both, return_inverse=True)
        times = np.bincount(at, weights=weight).astype(np.int64)
        held, size = [], 0

    for text in frame["text"]:
        data = np.frombuffer(b" " * order + text.encode(), dtype=np.uint8).astype(np.uint64)
        code = np.zeros(len(data) - order, dtype=np.uint64)
        for k in range(order + 1):
            code = (code << np.uint64(8)) | data[k:len(data) - order + k]
        held.append(code)
        size += len(code)
        if size > 4_000_000:
            merge()
    if held:
        merge()
    return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "model": [pickle.dumps((grams, times))]})


def _joined(parts: dict, order: int) -> PpmModel:
    """One model of all languages from their counts of byte n-grams."""
    model = PpmModel(sorted(parts), [], order)
    for language in model.languages:
        grams, times = parts[language]
        code = np.zeros(len(grams), dtype=np.int64)
        for k in range(order + 1):
            byte = (grams >> np.uint64(8 * (order - k))) & np.uint64(255)
            code = code * SYMBOLS + model.symbols[byte.astype(np.int64)]
        some, at = np.unique(code, return_inverse=True)
        total = np.bincount(at, weights=times)
        model.counts.append((some.astype(np.int32), total.astype(np.int32)))
    return model


def _score(batches, model):
    # The arrays are built by each task and go with it: a worker keeps no memory for later stages.
    for batch, texts in chunks(batches, "text"):
        answers = model.score(texts)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns - 1)),
             pa.array([a[0] for a in answers], type=pa.string()), pa.array([a[1] for a in answers], type=pa.float64())],
            [*batch.schema.names[:-1], "lang_pred", "score"],
        )


def predict_language(documents: DataFrame, model: PpmModel | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``documents``."""
    model = model or fit_languages(documents)
    asked = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return asked.mapInArrow(
        partial(_score, model=model),
        "doc_id long, held_out boolean, lang_pred string, score double",
    )


def _keep(batches, model, least):
    """The rows whose text is in a language of the model, by at least this posterior."""
    for batch, texts in chunks(batches, "text"):
        answers = model.score(texts)
        yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in answers], type=pa.bool_()))


def keep_known_languages(documents: DataFrame, model: PpmModel | None = None, least: float = 0.5) -> DataFrame:
    """``documents`` without the rows that no language fits: no letter, or no clear winner."""
    model = model or fit_languages(documents)
    return documents.mapInArrow(partial(_keep, model=model, least=least), documents.schema)
