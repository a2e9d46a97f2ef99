"""Source divergence audit: hash-consed segment trees over term ids, priced pair by pair.

Each language keeps the terms of enough of its documents, and each source of a
language is compared with every other one, and with the language, by the
smoothed shares ``1 + floor(ONE * (count + 5) / (N + 5 * V))`` of those terms.

The kept terms of a language are dealt by hash to blocks of about BLOCK counts.
Within a block, terms are numbered in their order and every source's counts
become a segment tree over the numbers. Nodes are hash-consed: equal subtrees of
counts, of one source or several, are one node, so the long runs of zeros of a
small source are one node a level. Two trees are walked down together, from the
pair of their roots to pairs of children; equal pairs of nodes meet in one entry
with the number of places it stands for, so each is opened and, at the leaves,
priced once per pair of trees. Walks go level by level for many pairs of sources
at a time. The sums of the blocks give a pair's value; all arithmetic is exact.

Texts are read once: tasks count terms per language and source, send a count at
most once per FLUSH distinct terms, and a term's counts meet only as sums. A
language with many sources is dealt further, by the lower source of a pair, so
that a task holds one block of counts and the pairs of about TILE sources. The
pairs themselves are the result asked for, as many as sources by sources.

Defined cases. Null text, lang and source read as ''; a row is a document, so
repeated rows count each. A text without terms adds its group and nothing else;
a language without kept terms has V = 0 and pairs of value 0; a source that is
alone in its language has no rows. Ties in value go by the item's bytes. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.llm.common import chunks
from factlake.session import materialize, spread

LEAST_DOCUMENTS, SMOOTHING, ONE, TOP = 30, 5, 1_000_000_000, 50
# Counts to a block; sources to a tile; distinct terms that a task holds before it sends them.
BLOCK, TILE, FLUSH = 1 << 20, 256, 1 << 18
# Pairs of nodes that are walked together.
WALK = 1 << 20
# Letters A-Z in lower case, white space for what separates terms.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
COUNTS = "lang string, source string, term binary, n long, documents long"


def _counts(batches):
    """Per group and term: occurrences and documents. The empty term counts the group's documents."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def sent():
        for (lang, source), (n, documents) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()), pa.array(list(n.values()), pa.int64()),
                pa.array([documents[t] for t in terms], pa.int64()),
            ], ["lang", "source", "term", "n", "documents"])

    for batch, texts in chunks(batches, "text"):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            n, documents = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = text.translate(_TERMS).split()
            n.update(terms)
            documents.update(set(terms))
            n[b""] += 1
            size += len(n) - before
        if size > FLUSH:
            yield from sent()
            held, size = {}, 0
    yield from sent()


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, documents``, one row per group and term; term '' holds the group's documents."""
    read = documents.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")
    ))
    found = spread(read).mapInArrow(_counts, COUNTS)
    return found.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents")
    )


def share(count: np.ndarray, whole) -> np.ndarray:
    """``1 + floor(ONE * (count + SMOOTHING) / whole)`` exactly, three digits at a time."""
    out, rest = np.zeros_like(count), count + SMOOTHING
    whole = np.broadcast_to(whole, count.shape)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return 1 + out


class Forest:
    """Hash-consed segment trees of several sources over the same term ids.

    ``levels[0]`` are the distinct counts, 0 first; a node of a level above is a
    row of two nodes below, of which node 0 is the one of zeros only.
    """

    def __init__(self, source: np.ndarray, term: np.ndarray, count: np.ndarray, sources: int, terms: int):
        values = np.unique(np.append(count, 0))
        self.levels = [values]
        node = np.searchsorted(values, count)
        order = np.lexsort((term, source))
        source, place, node = source[order], term[order], node[order]
        width = terms
        while width > 1:
            # The other child of a lone node is the zero node.
            parent = (source.astype(np.int64) * (width // 2 + 1)) + place // 2
            firsts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, int)
            children = np.zeros((len(firsts), 2), dtype=np.int64)
            at = np.cumsum(np.append(True, parent[1:] != parent[:-1])) - 1 if len(parent) else np.zeros(0, int)
            children[at, place % 2] = node
            distinct, node = np.unique(np.concatenate([[[0, 0]], children]), axis=0, return_inverse=True)
            node = node.reshape(-1)[1:]
            self.levels.append(distinct)
            source, place, width = source[firsts], place[firsts] // 2, (width + 1) // 2
        self.roots = np.zeros(sources, dtype=np.int64)
        self.roots[source] = node
        self.padded = 1 << (len(self.levels) - 1)
        self.opened = 0

    def prices(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray, terms: int) -> np.ndarray:
        """For each pair of sources, the sum of differences of their shares over all terms."""
        pair = np.arange(len(left))
        a, b, times = self.roots[left], self.roots[right], np.ones(len(left), dtype=np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            self.opened += len(a)
            children = self.levels[level]
            pair, a, b, times = _together(
                np.concatenate([pair, pair]), np.concatenate([children[a, 0], children[a, 1]]),
                np.concatenate([children[b, 0], children[b, 1]]), np.concatenate([times, times]),
                len(left), len(self.levels[level - 1]),
            )
        counts = self.levels[0]
        self.opened += len(a)
        priced = np.abs(share(counts[a], whole[left[pair]]) - share(counts[b], whole[right[pair]])) * times
        total = np.zeros(len(left), dtype=np.int64)
        np.add.at(total, pair, priced)
        # The tree is padded with zeros to a power of two.
        none = np.zeros(len(left), dtype=np.int64)
        return total - (self.padded - terms) * np.abs(share(none, whole[left]) - share(none, whole[right]))


def _together(pair, a, b, times, pairs, nodes):
    """Equal entries as one, with the sum of their places."""
    if not len(pair):
        return pair, a, b, times
    # One number for an entry where it fits.
    fits = pairs * nodes * nodes < 1 << 62
    order = np.argsort((pair * nodes + a) * nodes + b, kind="stable") if fits else np.lexsort((b, a, pair))
    pair, a, b, times = pair[order], a[order], b[order], times[order]
    new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return pair[new], a[new], b[new], np.add.reduceat(times, new)


def _audit(key, counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Rows of one block: prices of the pairs whose lower source is of this tile, terms of the tile's sources."""
    names = groups.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    whole = np.asarray(groups.column("whole"))[order]
    own = np.asarray(groups.column("own"))[order]
    number = {n: i for i, n in enumerate(names)}
    terms, term = np.unique(np.array(counts.column("term").to_pylist() or [""], dtype=object), return_inverse=True)
    term = term.reshape(-1)[:counts.num_rows]
    terms = terms if counts.num_rows else terms[:0]
    source = np.array([number[s] for s in counts.column("source").to_pylist()], dtype=np.int64)
    count = np.asarray(counts.column("n")).astype(np.int64)
    out = []
    left, right = _pairs(np.flatnonzero(own), len(names))
    if len(terms):
        forest = Forest(source, term, count, len(names), len(terms))
        # Walks hold at most some entries for each count of the two sources, and for each distinct node.
        weight = np.bincount(source, minlength=len(names)) + 2 * len(forest.levels)
        ends = np.cumsum(weight[left] + weight[right])
        cuts = np.searchsorted(ends, np.arange(WALK, ends[-1], WALK)) if len(ends) else []
        parts = zip(np.split(left, cuts), np.split(right, cuts), strict=True)
        value = np.concatenate([np.zeros(0, np.int64), *(forest.prices(a, b, whole, len(terms)) for a, b in parts)])
    else:
        value = np.zeros(len(left), dtype=np.int64)
    out.append(_rows(key, names, "pair", np.append(left, right), [names[i] for i in np.append(right, left).tolist()],
                     np.append(value, value)))
    mine = np.flatnonzero(own[source])
    if len(mine):
        total = np.zeros(len(terms), dtype=np.int64)
        np.add.at(total, term, count)
        language = np.asarray(groups.column("language"))[0]
        above = share(count[mine], whole[source[mine]]) - share(total[term[mine]], language)
        mine, above = mine[above > 0], above[above > 0]
        # Terms are numbered in the order of their characters, which is that of their bytes.
        ranked = np.lexsort((term[mine], -above, source[mine]))
        mine, above = mine[ranked], above[ranked]
        opened = np.flatnonzero(np.append(True, source[mine][1:] != source[mine][:-1])) if len(mine) else np.zeros(0, int)
        place = np.arange(len(mine)) - np.repeat(opened, np.diff(np.append(opened, len(mine))))
        mine, above = mine[place < top], above[place < top]
        out.append(_rows(key, names, "term", source[mine], terms[term[mine]].tolist(), above))
    return pa.concat_tables(out)


def _pairs(lower: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``lower`` with every greater number below ``n``."""
    sizes = n - 1 - lower
    left = np.repeat(lower, sizes)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _rows(key, names, part, source, items, value) -> pa.Table:
    n = len(value)
    lang = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
    return pa.table({
        "lang": pa.array([lang] * n, pa.string()),
        "source": pa.array([names[i] for i in source.tolist()], pa.string()),
        "part": pa.array([part] * n, pa.string()), "item": pa.array(items, pa.string()),
        "value": pa.array(value, pa.int64()),
    })


def audit_sources(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and each source's most outstanding terms."""
    counts = materialize(term_counts(documents), "term-counts")
    groups = counts.filter(F.length("term") == 0).select("lang", "source")
    held = counts.filter(F.length("term") > 0)
    kept = materialize(
        held.groupBy("lang", "term").agg(F.sum("documents").alias("documents"))
        .filter(F.col("documents") >= least_documents).select("lang", "term"), "kept-terms"
    )
    entries = materialize(
        held.join(kept, ["lang", "term"], "left_semi").select("lang", "source", F.col("term").cast("string").alias("term"), "n"),
        "kept-counts",
    )
    languages = materialize(
        groups.groupBy("lang").agg(F.count("*").alias("sources"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
        .join(entries.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("counts")), "lang", "left")
        .select(
            "lang", (F.coalesce("n", F.lit(0)) + SMOOTHING * F.coalesce("v", F.lit(0))).alias("language"),
            (SMOOTHING * F.coalesce("v", F.lit(0))).alias("smooth"),
            F.ceil(F.coalesce("counts", F.lit(1)) / block).cast("int").alias("blocks"),
            F.ceil(F.col("sources") / tile).cast("int").alias("tiles"),
        ), "languages",
    )
    tile_of = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = (
        entries.join(languages, "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
        .withColumn("tile", numbers("tiles")).select("lang", "block", "tile", "source", "term", "n")
    )
    norms = (
        groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .join(languages, "lang")
        .withColumn("home", tile_of)
        .withColumn("block", numbers("blocks")).withColumn("tile", numbers("tiles"))
        .select("lang", "block", "tile", "source", (F.coalesce("n", F.lit(0)) + F.col("smooth")).alias("whole"),
                "language", (F.col("home") == F.col("tile")).alias("own"))
    )
    at = ("lang", "block", "tile")
    found = dealt.groupBy(*at).cogroup(norms.groupBy(*at)).applyInArrow(
        partial(_audit, top=top), "lang string, source string, part string, item string, value long"
    )
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select(
        "lang", "source", "part", "item", "value", "rank"
    )
