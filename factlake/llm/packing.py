"""Order-preserving packing of tokenised documents into sequences by dynamic programming.

Documents stay in the order of their table. Within a task the tokens of its
documents form one stream, and the cuts of the stream are chosen so that padding
plus penalties for cutting inside a document (less at the end of a sentence) are
least: ``f(j) = penalty(j) + min f(i) + size - (j - i)`` over the cuts ``i`` at
most ``size`` tokens before ``j``, where the minimum comes from a queue kept in
ascending order. Cuts may lie at the ends of documents and sentences and, in
sentences longer than STRIDE tokens, every STRIDE tokens. The stream is decided
in runs of RUN tokens; what the last sequence of a run would hold goes on into
the next, so a run costs no padding and memory is bounded by a run and the
longest document. The last tokens of a task, fewer than a sequence, are cut into
pieces whose lengths are powers of two, which need no padding.

Null texts are empty and have the end token alone. Every row is packed by
itself, so repeated ids and texts, null ids and extra columns need no care. An
empty table gives no pieces. A text may be longer than a sequence.

Texts are split at ASCII white space, some megabytes at a time, and only distinct
letters, marks and other words meet the tokeniser, which splits there too. With a
tokeniser of another form texts are tokenised whole.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import slices

SIZE = 2048
RUN = 1 << 20
STRIDE = 24
SENTENCE_PENALTY, INSIDE_PENALTY = 0.5, 2.0
# Texts are split and tokenised together until they have this many bytes.
TOGETHER = 1 << 20
# What a task keeps of words that it tokenised.
MOST_BYTES = 1 << 22
_END = r'(?:[.!?]["\)]?|[。！？])$'
# A word of letters with marks behind them, which the tokeniser splits there. It writes some letters
# of Indian scripts, Hebrew forms and U+0130 with a combining mark, which would go with the marks.
_LETTERS_AND_MARKS = r"^(?P<letters>[^\PL\x{130}\x{900}-\x{fff}\x{fb1d}-\x{fb4f}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
# Tokenisers of this form take each run of letters as one word, in any case.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gathered(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``begin``, one after the other."""
    after = np.cumsum(sizes)
    return np.repeat(begin - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)


def _runs(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of the sizes, one after the other, those of the numbers ``at``, and their sizes."""
    begin, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
    return values[_gathered(begin, sizes)], sizes


class WordTokens:
    """Token ids of texts, with what their words consist of tokenised once.

    Letters and the marks behind them are tokenised apart, so words in any case
    and with any marks share their letters' ids. What was tokenised is kept until
    it has MOST_BYTES; then only what the last texts had stays.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        form = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        # Of another tokeniser it is not known where texts may be split.
        self.by_words = form == [_NORMALIZER, _SPLIT] and all(
            re.fullmatch(r"[^\w\s]+\w\S*", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()
        )
        self.names = pa.array([], type=pa.large_string())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[list[int]]:
        """The ids of each part; one of letters alone is a single word of the model."""
        units = [w if w.isascii() and w.isalpha() else None for w in parts]
        letters = [i for i, w in enumerate(parts) if units[i] is None and w.isalpha()]
        for at in (letters[i:i + 2000] for i in range(0, len(letters), 2000)):
            normal = self.tokenizer.normalizer.normalize_str(" ".join([parts[i] for i in at]))
            spelled = self.bytes.pre_tokenize_str(normal)[0][0].split("\u0120")
            normal = normal.split(" ")
            if len(normal) == len(spelled) == len(at):
                for i, word, unit in zip(at, normal, spelled, strict=True):
                    # A letter may become one with a mark, at which the tokeniser splits.
                    units[i] = unit if word.isalpha() else None
        word = self.tokenizer.model.tokenize
        found = [[t.id for t in word(unit)] if unit is not None else None for unit in units]
        others = [i for i, unit in enumerate(units) if unit is None]
        for i, ids in zip(others, self._encode([parts[i] for i in others]), strict=True):
            found[i] = ids
        return found

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Where the distinct parts are kept."""
        at = np.array(pc.fill_null(pc.index_in(parts, value_set=self.names), -1), dtype=np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = parts.take(pa.array(missing))
            at[missing] = len(self.names) + np.arange(len(missing))
            found = self._encode_parts(new.to_pylist())
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum()))
            self.names = pa.concat_arrays([self.names, new])
            self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids)
        if self.names.nbytes + self.sizes.nbytes + self.ids.nbytes > MOST_BYTES:
            self.ids, self.sizes = _runs(self.ids, self.sizes, at)
            self.names, at = parts, np.arange(len(parts))
        return at

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other; each text's size; where sentences end."""
        if not self.by_words:
            found = self._encode(texts.to_pylist())
            return (np.array([i for ids in found for i in ids], dtype=np.uint32),
                    np.array([len(ids) for ids in found], dtype=np.int64), np.zeros(0, np.int64))
        # Other white space stays inside words and is left to the tokeniser.
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, np.asarray(coded.indices)
        halves = pc.extract_regex(words, _LETTERS_AND_MARKS)
        known = halves.is_valid()
        letters = pc.if_else(known, pc.ascii_lower(halves.field("letters")), words)
        marks = pc.if_else(known, halves.field("marks"), "")
        parts = pa.concat_arrays([letters, marks.cast(letters.type)]).dictionary_encode()
        number = self._numbers(parts.dictionary)[np.asarray(parts.indices)].reshape(2, -1)
        # Of each distinct word, then of each word.
        ids, sizes = _runs(self.ids, self.sizes, number.T.reshape(-1))
        ids, sizes = _runs(ids, sizes.reshape(-1, 2).sum(axis=1), at)
        after = np.cumsum(sizes)
        ends = after[np.asarray(pc.match_substring_regex(words, _END))[at]]
        bounds = np.append(0, after)[np.append(0, np.cumsum(np.asarray(pc.list_value_length(split))))]
        return ids, np.diff(bounds), ends


def choose_cuts(places: list[int], penalties: list[float], size: int, last_free: bool) -> list[int]:
    """The cheapest cuts of ``[0, places[-1])`` at some of the ascending ``places``.

    No gap between places exceeds ``size``. With ``last_free`` the sequence that
    ends at the last place costs no padding.
    """
    # With key(i) = cost(i) + place(i), the best i for any j is the one of least key in the window,
    # and key(j) = size + penalty(j) + that key.
    at = [0, *places]
    last = len(places)
    keys, back = [0.0] * (last + 1), [-1] * (last + 1)
    # A queue of places by their keys, both ascending from head to tail.
    least, where, index, head, tail = [0.0] * (last + 1), [0] * (last + 1), [0] * (last + 1), 0, 0
    for j in range(1, last + (not last_free)):
        place = at[j]
        earliest = place - size
        while where[head] < earliest:
            head += 1
        back[j] = index[head]
        keys[j] = key = least[head] + size + penalties[j - 1]
        while tail >= head and least[tail] >= key:
            tail -= 1
        tail += 1
        least[tail], where[tail], index[tail] = key, place, j
    if last_free:
        near = range(bisect_left(at, at[last] - size, 0, last), last)
        back[last] = min(near, key=lambda i: (keys[i] - at[i], i))
    cuts, j = [], last
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


class _Stream:
    """The tokens of a task that are not yet packed, and the sequences packed so far."""

    def __init__(self, size: int, first_sequence: int, with_ids: bool):
        self.size, self.sequence, self.with_ids = size, first_sequence, with_ids
        self.ids = np.zeros(0, dtype=np.uint32)
        self.docs: list[tuple] = []  # place of the first token held, its place in the document, doc_id, tokens
        self.sentences = np.zeros(0, dtype=np.int64)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray, sentences: np.ndarray):
        base = len(self.ids)
        starts = np.cumsum(lengths) - lengths
        self.docs.extend(
            (base + a, 0, d, n) for a, d, n in zip(starts.tolist(), doc_ids, lengths.tolist(), strict=True)
        )
        self.ids = np.concatenate([self.ids, ids])
        self.sentences = np.concatenate([self.sentences, base + sentences])

    def _candidates(self):
        ends = np.array([d[0] for d in self.docs[1:]] + [len(self.ids)], dtype=np.int64)
        places = np.union1d(ends, self.sentences[(self.sentences > 0) & (self.sentences < len(self.ids))])
        before = np.concatenate([[0], places[:-1]])
        gaps = places - before
        steps = (gaps - 1) // STRIDE
        inside = np.repeat(before, steps) + STRIDE * (1 + _gathered(np.zeros_like(steps), steps))
        penalties = np.concatenate([np.where(np.isin(places, ends), 0.0, SENTENCE_PENALTY),
                                    np.full(len(inside), INSIDE_PENALTY)])
        places = np.concatenate([places, inside])
        order = np.argsort(places, kind="stable")
        return places[order].tolist(), penalties[order].tolist()

    def pack(self, last: bool):
        """Pieces of the sequences that are decided; with ``last``, of all tokens."""
        if not len(self.ids):
            return None
        places, penalties = self._candidates()
        cuts = choose_cuts(places, penalties, self.size, True)
        if last:
            start, end = (cuts[-2] if len(cuts) > 1 else 0), cuts[-1]
            tail, at = [], start
            for bit in range((end - start).bit_length() - 1, -1, -1):
                if (end - start) >> bit & 1:
                    at += 1 << bit
                    tail.append(at)
            cuts = cuts[:-1] + tail
        else:
            cuts = cuts[:-1]
        if not cuts:
            return None
        done = cuts[-1]
        doc_at = np.array([d[0] for d in self.docs], dtype=np.int64)
        bounds = np.unique(np.concatenate([[0], doc_at[doc_at < done], cuts]))
        begin, end = bounds[:-1], bounds[1:]
        doc = np.searchsorted(doc_at, begin, side="right") - 1
        opened = np.concatenate([[0], cuts])
        sequence = np.searchsorted(opened, begin, side="right") - 1
        inside = np.array([d[1] for d in self.docs], dtype=np.int64)[doc] + begin - doc_at[doc]
        data = memoryview(self.ids[:done].astype("<u4").tobytes())
        crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        columns = [
            pa.array([self.docs[i][2] for i in doc.tolist()], type=pa.int64()), pa.array(inside),
            pa.array(end - begin), pa.array(crcs, type=pa.int64()),
            pa.array(np.array([d[3] for d in self.docs], dtype=np.int64)[doc]),
            pa.array(self.sequence + sequence), pa.array(begin - opened[sequence]),
        ]
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        if self.with_ids:
            columns.append(pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), pa.array(self.ids[:done].astype(np.int32))
            ))
            names.append("ids")
        self.sequence += len(cuts)
        # What is left goes on at place 0.
        first = int(np.searchsorted(doc_at, done, side="right") - 1)
        kept = self.docs[first:]
        if kept and kept[0][0] < done:
            place, into, name, tokens = kept[0]
            kept[0] = (done, into + done - place, name, tokens)
        self.docs = [(p - done, i, d, n) for p, i, d, n in kept if p < len(self.ids)]
        self.sentences = self.sentences[self.sentences > done] - done
        self.ids = self.ids[done:]
        return pa.RecordBatch.from_arrays(columns, names)


def _together(batches):
    """Numbers and texts of rows that have some TOGETHER bytes, however the batches are dealt."""
    held, size = [], 0
    for part, texts in slices(batches, "text", TOGETHER):
        held.append((part.column(0), texts))
        size += texts.nbytes
        if size >= TOGETHER // 2:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    texts = pa.concat_arrays([t for _, t in held])
    try:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
    except pa.ArrowInvalid:
        texts = pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], type=pa.large_string())
    return pa.concat_arrays([n for n, _ in held]), texts


def _pack(batches, tokenizer, size, end_id, with_ids):
    # The words go with their task.
    tokens = WordTokens(tokenizer)
    # A task numbers its sequences from its own place on.
    stream = _Stream(size, TaskContext.get().partitionId() << 36, with_ids)
    for names, texts in _together(batches):
        ids, lengths, sentences = tokens(texts)
        bounds = np.cumsum(lengths)
        ids = np.insert(ids, bounds, np.uint32(end_id))
        text_of = np.searchsorted(bounds, sentences, side="left")
        stream.add(names.to_pylist(), ids, lengths + 1, sentences + text_of)
        if len(stream.ids) >= RUN:
            if (packed := stream.pack(False)) is not None:
                yield packed
    if (packed := stream.pack(True)) is not None:
        yield packed


def pack_documents(
    documents: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = 1, with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    ``tokenizer`` is the path of a tokenizer file, which every executor has.
    Each document ends with ``end_id``. ``ids`` are the piece's token ids, left
    out without ``with_ids``; ``ids_crc32`` is their checksum.
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(
        partial(_pack, tokenizer=tokenizer or default_tokenizer(), size=size, end_id=end_id, with_ids=with_ids),
        SCHEMA + (", ids array<int>" if with_ids else ""),
    )
