"""N-gram Jaccard join: documents whose shingle sets are nearly equal, as components.

The shingles of a document are hashed to 64 bits and kept as a set in one global
order: by how often they were seen more than once in a task, then by hash, so
common ones come last. Documents with equal sets are one node. Two sets that
link share one of their first ``n - ceil(0.85 n) + 1`` shingles; only those
travel. The join runs in rounds over groups that share such a shingle:

* first each set is tried against the smallest document of its groups, then,
  while large groups are left, against neighbours in changing random orders.
  These rounds only save work: sets that are in one component already are never
  compared again;
* then every pair of different components that still shares a first shingle
  and whose number of shared ones does not rule a link out is compared.

So no pairs of a large group of near copies are listed, and no link between
different components is lost. Pairs are verified in blocks: the sets to compare
with one probe form a trie (sorted rows; a row shares its longest common prefix
with the row above), which is walked once. Overlaps of a shared prefix are
counted once, and a subtree is left as soon as its overlap plus the smaller
remaining length cannot reach what a link needs.

Empty and null texts have no shingles and link with nothing. A null ``doc_id``
gets a null component. Rows that repeat a ``doc_id`` are one document with the
links of all of them; each row keeps its own ``n_shingles``. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import chunks, mix, word_hashes
from factlake.session import materialize

WORDS = 4
NUMERATOR = 85
# The shingles ranked as common: at most so many, seen this often in a task's run.
COMMON = 1 << 19
SEEN = 2
# A block that is verified in one call.
BLOCK_SETS, BLOCK_SHINGLES = 64, 1 << 18
BUCKET_SHINGLES = 1 << 21
# Neighbours are tried in at most ROUNDS rounds, while there are more pairs than this per row.
ROUNDS, PAIRS_PER_ROW = 4, 1000
# Sets of groups up to this size are paired per shared shingle, those of larger ones with all first shingles at hand.
SMALL_GROUP = 64
_FILTER_WORDS = 1 << 17


def long_shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of ``words`` words."""
    n = len(hashes) - words + 1
    if n <= 0:
        return hashes[:0]
    long = hashes[:n].copy()
    for k in range(1, words):
        long *= np.uint64(0xD6E8FEB86659FD93)
        long += hashes[k:n + k]
    return mix(long)


def shingle_sets(texts: list, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, offsets``: each text's distinct shingles, ascending."""
    hashes, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    long = long_shingles(hashes, words)
    sets = []
    for a, m in zip(offsets[:-1].tolist(), counts.tolist(), strict=True):
        if m >= words:
            row = np.sort(long[a:a + m - words + 1])
            new = row[1:] != row[:-1]
            sets.append(row if new.all() else row[np.concatenate([[True], new])])
        elif m:
            whole = np.array([m], dtype=np.uint64)
            for h in hashes[a:a + m]:
                whole = whole * np.uint64(0xA0761D6478BD642F) + h
            sets.append(mix(whole))
        else:
            sets.append(hashes[:0])
    ends = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else hashes[:0]), ends


def _common_in_task(batches, words):
    """Shingles seen at least SEEN times in a task's run, and how often."""
    held, size = [], 0

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= SEEN
        return pa.RecordBatch.from_arrays(
            [pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "n"]
        )

    met: set[int] = set()
    for _, texts in chunks(batches, "text"):
        # Copies in a run count once. Runs of words across two texts count too: any one order will do.
        texts = [t for t in texts if t and (h := hash(t)) not in met and not met.add(h)]
        hashes = long_shingles(word_hashes(texts)[0], words)
        held.append(hashes)
        size += len(hashes)
        if size > 4_000_000:
            yield flush()
            held, size, met = [], 0, set()
    if held:
        yield flush()


class _Order:
    """The global order of shingles: common ones last, by count, then by hash."""

    def __init__(self, common: np.ndarray, levels: np.ndarray):
        order = np.argsort(common)
        # Frequencies to a power of two are enough to put rare ones first.
        self.common, self.levels = common[order], levels[order].astype(np.uint8)
        self.seen = None

    def __getstate__(self):
        return {**self.__dict__, "seen": None}

    def _maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Where a hash may be a common one, by its last bits."""
        if self.seen is None:
            self.seen = np.zeros(1 << 22, dtype=bool)
            self.seen[self.common & np.uint64((1 << 22) - 1)] = True
        return np.flatnonzero(self.seen[hashes & np.uint64((1 << 22) - 1)])

    def count(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), dtype=np.uint8)
        if len(self.common):
            maybe = self._maybe(hashes)
            at = np.minimum(np.searchsorted(self.common, hashes[maybe]), len(self.common) - 1)
            found[maybe] = np.where(self.common[at] == hashes[maybe], self.levels[at], 0)
        return found

    def sort(self, hashes: np.ndarray) -> np.ndarray:
        """Ascending hashes in the global order."""
        counts = self.count(hashes)
        return hashes[np.argsort(counts, kind="stable")] if counts.any() else hashes


def _prefixes(batches, words, numerator, order):
    """Per document its set's size, fingerprint and first shingles."""
    for batch, texts in chunks(batches, "text"):
        hashes, ends = shingle_sets(texts, words)
        sizes = np.diff(ends)
        counts = order.count(hashes)
        lengths = np.where(sizes > 0, sizes - (numerator * sizes + 99) // 100 + 1, 0)
        filled = np.flatnonzero(sizes)
        one, two = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        some = np.zeros(len(sizes), dtype=bool)
        if len(filled):
            # Two sums of a finaliser each; empty sets have none.
            one[filled] = np.add.reduceat(mix(hashes), ends[:-1][filled])
            two[filled] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1][filled])
            some[filled] = np.logical_or.reduceat(counts > 0, ends[:-1][filled])
        keep = []
        for a, b, n, ranked in zip(ends[:-1].tolist(), ends[1:].tolist(), lengths.tolist(), some.tolist(), strict=True):
            row = hashes[a:b]
            keep.append((row[np.argsort(counts[a:b], kind="stable")] if ranked else row)[:n])
        flat = np.concatenate(keep) if keep else hashes[:0]
        offsets = np.cumsum([0, *lengths.tolist()]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(one.view(np.int64)),
             pa.array(two.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
            ["doc_id", "n_shingles", "one", "two", "prefix"],
        )


def _slots():
    """Two bits of a document's id in a filter of _FILTER_WORDS words of 64 bits."""
    h = F.xxhash64("doc_id")
    return F.pmod(h, F.lit(64 * _FILTER_WORDS)), F.pmod(F.shiftright(h, 30), F.lit(64 * _FILTER_WORDS))


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of 1 MB over a column of ids, whatever their number.

    Where it fills up at a large number of ids, more documents pass it; the
    join on the ids behind it stays exact.
    """
    slots = ids.select(F.explode(F.array(*_slots())).alias("slot"))
    found = slots.groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")
    ).toPandas()  # at most _FILTER_WORDS rows
    words = np.zeros(_FILTER_WORDS, dtype=np.int64)
    words[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return words.view(np.uint64)


def _wanted_sets(batches, words, order, passing):
    """The whole sets, in the global order, of the documents that pass the filter."""
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        for name in ("one", "two"):
            slot = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.uint64)
            keep &= (passing[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        batch = batch.filter(pa.array(keep))
        for part, texts in chunks([batch], "text"):
            hashes, ends = shingle_sets(texts, words)
            counts = order.count(hashes)
            blobs = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                row, c = hashes[a:b], counts[a:b]
                blobs.append((row[np.argsort(c, kind="stable")] if c.any() else row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(blobs, type=pa.binary())], ["doc_id", "shingles"]
            )


class TrieWalk:
    """Overlaps of one probe with the sets of a trie, found in one walk.

    The sets are rows in lexicographic order of the global order; a row's node
    path up to its longest common prefix with the row above is shared with it.
    """

    def __init__(self, probe: np.ndarray):
        self.members = np.sort(probe)
        self.n = len(probe)

    def linked(self, rows: list[np.ndarray], numerator: int) -> list[bool]:
        """Whether each set links with the probe; ``rows`` in lexicographic order."""
        answer, above = [], None
        path = np.zeros(1, dtype=np.int64)  # overlap of the probe with the first d shingles
        for row in rows:
            m = len(row)
            need = -(-numerator * (self.n + m) // (100 + numerator))
            if 100 * min(self.n, m) < numerator * max(self.n, m):
                above = None
                answer.append(False)
                continue
            shared = 0
            if above is not None:
                k = min(len(path) - 1, m)
                differ = np.flatnonzero(above[:k] != row[:k])
                shared = int(differ[0]) if len(differ) else k
            path = path[:shared + 1]
            # What is missed already bounds the overlap of every set below this node.
            step, dead = 64, False
            while len(path) <= m:
                depth = len(path) - 1
                if path[-1] + min(m - depth, self.n - path[-1]) < need:
                    dead = True
                    break
                part = row[depth:depth + step]
                at = np.minimum(np.searchsorted(self.members, part), self.n - 1)
                path = np.concatenate([path, path[-1] + np.cumsum(self.members[at] == part)])
                step *= 2
            answer.append(not dead and bool(path[m] >= need))
            above = row
        return answer


def _verify_bucket(frame, numerator):
    """The links of some blocks: each one's probe against a trie of its sets."""
    import pandas as pd

    blocks: dict = {}
    for probe, block, doc_id, shingles in zip(
        frame["probe"].tolist(), frame["block"].tolist(), frame["doc_id"].tolist(), frame["shingles"], strict=True
    ):
        probes, sets = blocks.setdefault((probe, block), ([], []))
        row = np.frombuffer(shingles, dtype=np.uint64)
        if doc_id == probe:
            probes.append(row)
        else:
            sets.append((row, doc_id))
    links = set()
    for (probe, _), (probes, sets) in blocks.items():
        if len(sets) > 1:
            sets.sort(key=lambda x: x[0].astype(">u8").tobytes())
        for one in probes:
            linked = TrieWalk(one).linked([s for s, _ in sets], numerator)
            links.update((probe, i) for (_, i), yes in zip(sets, linked, strict=True) if yes)
    return pd.DataFrame(sorted(links), columns=["src", "dst"], dtype=np.int64)


class _Join:
    def __init__(self, documents: DataFrame, words: int, numerator: int):
        self.documents = documents.filter(F.col("doc_id").isNotNull()).select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
        )
        self.words, self.numerator = words, numerator
        counted = materialize(
            self.documents.select("text").mapInArrow(partial(_common_in_task, words=words), "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n"))
            .select("token", F.ceil(F.log2(F.col("n") + 1)).cast("int").alias("level")), "common-shingles"
        )
        # As many of the highest levels, whole, as make at most COMMON shingles.
        lowest, total = 64, 0
        for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 64 rows
            total += row["count"]
            if total > COMMON:
                break
            lowest = row["level"]
        common = counted.filter(F.col("level") >= lowest).toPandas()
        self.order = _Order(
            common["token"].to_numpy(dtype=np.int64).view(np.uint64), common["level"].to_numpy(dtype=np.int64)
        )
        self.sets = materialize(self.documents.mapInArrow(
            partial(_prefixes, words=words, numerator=numerator, order=self.order),
            "doc_id long, n_shingles long, one long, two long, prefix array<long>",
        ), "shingle-sets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``src, dst`` of those pairs ``probe, doc_id, n`` whose whole sets link."""
        sizes = pairs.groupBy("probe").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
        blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES))
        dealt = materialize(pairs.join(sizes, "probe").select(
            "probe", F.pmod(F.xxhash64("doc_id"), blocks).alias("block"), "doc_id", "n"
        ), "to-verify")
        wanted = dealt.select("probe", "block", "doc_id").union(
            dealt.select("probe", "block", F.col("probe").alias("doc_id")).distinct()
        )
        passing = _filter_of(wanted.select("doc_id"))
        # Whole blocks are taken together, some BUCKET_SHINGLES at a time.
        total = dealt.agg(F.sum("n")).first()[0] or 0
        buckets = max(64, -(-total // BUCKET_SHINGLES))
        bucket = F.pmod(F.xxhash64("probe", "block"), F.lit(buckets)).alias("bucket")
        one, two = _slots()
        sets = self.documents.select("doc_id", "text", one.alias("one"), two.alias("two")).mapInArrow(
            partial(_wanted_sets, words=self.words, order=self.order, passing=passing),
            "doc_id long, shingles binary",
        )
        numerator = self.numerator

        def verified(frame):
            return _verify_bucket(frame, numerator)

        links = wanted.join(sets, "doc_id").groupBy(bucket).applyInPandas(verified, "src long, dst long")
        return materialize(links.distinct(), "links")

    def possible(self, left: str, right: str, shared: Column) -> Column:
        """Whether sets of these sizes can link if so many first shingles are shared.

        A common shingle that is not among the first of both lies behind the
        first ones of the set whose first ones end earlier, be it either.
        """
        n, m, top = F.col(left), F.col(right), self.numerator
        rest = lambda size: F.ceil(top * size / 100) - 1  # noqa: E731 - what lies behind the first ones
        need = F.ceil(top * (n + m) / (100 + top))
        return (100 * F.least(n, m) >= top * F.greatest(n, m)) & (shared + F.greatest(rest(n), rest(m)) >= need)


def ngram_jaccard_components(documents: DataFrame, words: int = WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``documents``.

    Two documents link when ``100 * intersection >= numerator * union`` of their
    sets of ``words``-word shingles; a component is named after its smallest id.
    """
    join = _Join(documents, words, numerator)
    same = ["n_shingles", "one", "two"]
    nodes = materialize(
        join.sets.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("node")), "nodes"
    )
    entries = (
        join.sets.join(nodes.select(F.col("node").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
        .dropDuplicates(["doc_id", *same])
        .select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("place", "token"))
    )
    group = Window.partitionBy("token")
    shared = materialize(
        entries.withColumn("rows", F.count(F.lit(1)).over(group))
        .withColumn("hub", F.min(F.struct("doc_id", "n")).over(group))
        .filter("rows > 1"),
        "shared-shingles",
    )
    links = join.verify(_best_probe(join, shared.select(
        "doc_id", "n", F.col("hub.doc_id").alias("probe"), F.col("hub.n").alias("m")
    ))).union(_sets_of_one_id(join, nodes))
    labels = _components(links)
    mixed = materialize(_mixed(shared, labels), "mixed-groups")
    few = PAIRS_PER_ROW * shared.count()
    for round_ in range(ROUNDS):
        # Pairs that comparing all would meet; while they are many, link neighbours first.
        if (mixed.agg(F.sum("size")).first()[0] or 0) <= few:
            break
        turn = group.orderBy(F.xxhash64("doc_id", F.lit(round_)), "doc_id")
        beside = mixed.withColumn("others", F.array(*(
            F.lag(F.struct("doc_id", "n", "component"), k).over(turn) for k in (1, 2, 3)
        ))).select("doc_id", "n", "component", F.explode("others").alias("other")).filter("other.component <> component")
        tried = join.verify(_best_probe(join, beside.select(
            "doc_id", "n", F.col("other.doc_id").alias("probe"), F.col("other.n").alias("m")
        )))
        found = tried.count()
        if not found:
            break
        links = materialize(links.union(tried), "links")
        labels = _components(links)
        before, mixed = mixed, materialize(_mixed(shared, labels), "mixed-groups")
        # Where neighbours no longer shrink the groups, more rounds would not either.
        if 10 * mixed.count() > 9 * before.count():
            break
    pairs = _pairs_of_small_groups(join, mixed).union(_pairs_of_large_groups(join, mixed)).distinct()
    last = join.verify(pairs.select("probe", "doc_id", "n"))
    labels = _components(links.union(last)) if last.limit(1).count() else labels
    named = nodes.join(labels, "node", "left").select(
        *same, F.coalesce("component", "node").alias("component_id")
    )
    known = join.sets.select("doc_id", *same).join(named, same, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    nameless = documents.filter(F.col("doc_id").isNull()).select(F.col("text").cast("string").alias("text"))
    counted = nameless.mapInArrow(partial(_count_only, words=words), "n_shingles long")
    return known.union(counted.select(
        F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long")
    ))


def _sets_of_one_id(join: _Join, nodes: DataFrame) -> DataFrame:
    """``src, dst``: links between the nodes of the sets of rows that repeat an id, one document all."""
    same = ["n_shingles", "one", "two"]
    some = join.sets.filter("n_shingles > 0").select("doc_id", F.struct(*same).alias("set"))
    several = some.groupBy("doc_id").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low <> high")
    several = materialize(several.select("doc_id"), "ids-of-several-sets")
    found = join.sets.filter("n_shingles > 0").join(several, "doc_id").join(nodes, same).select("doc_id", "node")
    first = found.groupBy("doc_id").agg(F.min("node").alias("src"))
    return materialize(
        found.join(first, "doc_id").filter("node <> src").select("src", F.col("node").alias("dst")).distinct(),
        "links-of-one-id",
    )


def _meeting(numerator: int) -> str:
    """The condition under which two entries of different components can be of one link."""
    return (
        "a.token = b.token and a.doc_id < b.doc_id and a.component <> b.component "
        f"and 100 * least(a.n, b.n) >= {numerator} * greatest(a.n, b.n) "
        "and least(a.place, b.place) + least(a.n - a.place, b.n - b.place) "
        f">= ceil({numerator} * (a.n + b.n) / {100 + numerator})"
    )


def _pairs_of_small_groups(join: _Join, mixed: DataFrame) -> DataFrame:
    """``probe, doc_id, n`` of pairs whose small groups in common are enough for a link.

    A pair that also shares a large group may have too few here; it is found there.
    """
    small = mixed.filter(F.col("size") <= SMALL_GROUP)
    return (
        small.alias("a").join(small.alias("b"), F.expr(_meeting(join.numerator)))
        .groupBy(F.col("a.doc_id").alias("probe"), F.col("b.doc_id").alias("doc_id"))
        .agg(F.count(F.lit(1)).alias("shared"), F.first("a.n").alias("m"), F.first("b.n").alias("n"))
        .filter(join.possible("n", "m", F.col("shared"))).select("probe", "doc_id", "n")
    )


def _pairs_of_large_groups(join: _Join, mixed: DataFrame) -> DataFrame:
    """The same for pairs that share a large group, with all their first shingles compared at once."""
    large = mixed.filter(F.col("size") > SMALL_GROUP)
    firsts = join.sets.select("doc_id", F.col("n_shingles").alias("n"), "prefix").join(
        large.select("doc_id").distinct(), "doc_id", "left_semi"
    ).dropDuplicates(["doc_id", "n", "prefix"])
    large = large.join(firsts, ["doc_id", "n"])
    top = join.numerator
    enough = (
        f"size(array_intersect(a.prefix, b.prefix)) + ceil({top} * greatest(a.n, b.n) / 100) - 1 "
        f">= ceil({top} * (a.n + b.n) / {100 + top})"
    )
    return large.alias("a").join(large.alias("b"), F.expr(f"{_meeting(top)} and {enough}")).select(
        F.col("a.doc_id").alias("probe"), F.col("b.doc_id").alias("doc_id"), F.col("b.n").alias("n")
    )


def _count_only(batches, words):
    for _, texts in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.diff(shingle_sets(texts, words)[1]).astype(np.int64))], ["n_shingles"]
        )


def _best_probe(join: _Join, tries: DataFrame) -> DataFrame:
    """Per document the probe with which it shares most first shingles, if a link is possible."""
    counted = tries.filter("doc_id <> probe").groupBy("doc_id", "probe").agg(
        F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("m").alias("m")
    ).filter(join.possible("n", "m", F.col("shared")))
    return counted.groupBy("doc_id").agg(
        F.min(F.struct((-F.col("shared")).alias("rank"), "probe", "n")).alias("best")
    ).select("best.probe", "doc_id", "best.n")


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups that hold documents of different components."""
    group = Window.partitionBy("token")
    return (
        shared.drop("hub", "rows")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .withColumn("lowest", F.min("component").over(group))
        .withColumn("highest", F.max("component").over(group))
        .withColumn("size", F.count(F.lit(1)).over(group))
        .filter("lowest <> highest").drop("lowest", "highest")
    )


def one_of_each_group(documents: DataFrame, words: int = 5, numerator: int = 80) -> DataFrame:
    """``documents`` with the smallest ``doc_id`` of each component, one row of it.

    Of rows that repeat the id the one with the smallest hash stays. Rows without
    an id belong to no component and stay, but equal ones once.
    """
    components = ngram_jaccard_components(documents, words, numerator)
    first = components.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    key = F.xxhash64(*documents.columns)
    named = "row_key"
    while named in documents.columns:
        named += "_"
    rows = documents.select(F.col("doc_id").cast("long").alias("row_id"), key.alias("row_key"))
    kept = (
        rows.groupBy("row_id").agg(F.min("row_key").alias("row_key"))
        .join(first, F.col("row_id") == F.col("kept_id"), "left_semi").select("row_key")
        .union(rows.filter("row_id is null").select("row_key")).distinct()
    )
    return (
        documents.withColumn(named, key)
        .join(materialize(kept.withColumnRenamed("row_key", named), "kept"), named, "left_semi")
        .dropDuplicates([named]).drop(named)
    )


def _components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest id reachable over ``src - dst``.

    In each round a node hears its neighbours' labels and its label's label, so
    long chains close in few rounds; every round is written, which cuts the lineage.
    """
    both = materialize(links.select("src", "dst").union(links.select("dst", "src")).distinct(), "edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("heard")).select(
        "node", F.least("node", "heard").alias("component"), F.lit(True).alias("changed")
    )
    while True:
        labels = materialize(labels, "labels")
        if not labels.filter("changed").limit(1).count():
            return labels.select("node", "component")
        known = labels.select("node", "component")
        heard = (
            both.join(known, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        onward = known.select(F.col("node").alias("component"), F.col("component").alias("next"))
        least = F.least("component", "heard", F.coalesce("next", "component"))
        labels = (
            known.join(heard, "node", "left").join(onward, "component", "left")
            .select("node", least.alias("component"), (least < F.col("component")).alias("changed"))
        )
