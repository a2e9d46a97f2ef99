"""Vector code compression by product codebooks with memoised grid cells.

A vector becomes integers floor(SCALE * x), cut into PARTS equal consecutive
parts; each part is written as the index of its nearest entry in the codebook of
its place. To find that entry, a part is hashed to its coarse grid cell of CELL
units a side. Of an entry, the least and the greatest squared distance to any
point of the cell's box are known; an entry whose least distance is above the
smallest greatest distance of all can be nearest to no point of the box. The
entries left are kept per cell for the task's life, and only those are compared
exactly with the parts of that cell. Ties go to the lower index. A task's cells
are forgotten at MOST_CELLS, which costs time, never a result.

Codebooks start as the parts of the ENTRIES smallest ids and are moved ROUNDS
times to the floor of their parts' mean; every kept vector counts. A task sends
at most one sum per place and entry, so neither equal vectors nor a hot label
meet in one task, and what reaches the driver is the size of the codebooks.

Defined cases. Vectors that are null or hold null or non-finite components are
dropped; an empty vector has no parts to write and is dropped as well. Rows with
equal ids all stay; among them the smaller vector comes first, null ids come
last. With fewer rows than ENTRIES the codebooks have one entry per row. The
width is that of the first vector; widths that PARTS doesn't divide are cut at
i * width // PARTS. A vector of another width, or with a component beyond
2 ** 27 units, whose squared distances leave 64 bits, cannot be coded: it keeps
its row with a null code and error and moves no entry. Null labels count as
equal. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.session import materialize

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
# A cell's side, in units; a task forgets its cells of one place beyond MOST_CELLS.
CELL = 32
MOST_CELLS = 1 << 13
LARGEST = float(1 << 27)


class GridCells:
    """The codebook of one place, with the entries that may be nearest in each cell."""

    def __init__(self, entries: np.ndarray, cell: int = CELL):
        self.entries, self.cell = entries, cell
        self.known: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.evaluated = 0

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell, the ascending entries that no other one dominates across its box."""
        out = []
        for some in np.array_split(cells, max(1, len(cells) // 4096)):
            low = (some * self.cell)[:, None, :]
            high = low + (self.cell - 1)
            below, above = low - self.entries[None], self.entries[None] - high
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
            may = least <= most.min(1)[:, None]
            row, entry = np.nonzero(may)
            out.extend(np.split(entry, np.searchsorted(row, np.arange(1, len(some)))))
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``index, squared distance`` of each row's nearest entry."""
        cells, cell_of = np.unique(parts // self.cell, axis=0, return_inverse=True)
        cell_of = cell_of.reshape(-1)
        if len(self.known) > MOST_CELLS:
            self.known.clear()
            self.lists.clear()
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            first = len(self.lists)
            self.lists.extend(self._candidates(cells[new]))
            self.known.update((keys[i], first + n) for n, i in enumerate(new))
        lists = [self.lists[self.known[k]] for k in keys]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        # One row for each part and entry of its cell, in the entries' order.
        per = sizes[cell_of]
        starts = np.cumsum(per) - per
        of = np.repeat(np.arange(len(parts)), per)
        entry = np.concatenate(lists)[np.arange(len(of)) - np.repeat(starts - begin[cell_of], per)]
        self.evaluated += len(of)
        distance = ((parts[of] - self.entries[entry]) ** 2).sum(1)
        least = np.minimum.reduceat(distance, starts)
        # The first of the least ones has the lowest index.
        at = np.flatnonzero(distance == least[of])
        first = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]
        return entry[first], least


def bounds(width: int, parts: int = PARTS) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer components of the rows that can be coded, and where those rows are."""
    lengths = np.diff(np.asarray(column.offsets))
    usable = lengths == width
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if not usable.all():
        flat = flat[np.repeat(usable, lengths)]
    scaled = np.floor(flat.reshape(-1, width) * SCALE)
    fits = (np.abs(scaled) <= LARGEST).all(1)
    return scaled[fits].astype(np.int64), np.flatnonzero(usable)[fits]


def _cells(codebooks: list[np.ndarray]) -> list[GridCells]:
    return [GridCells(book) for book in codebooks]


def _sums(batches, codebooks, width):
    """Per place and entry: how many parts are nearest to it, and their sums."""
    books, at = _cells(codebooks), bounds(width, len(codebooks))
    counts = [np.zeros(len(b), dtype=np.int64) for b in codebooks]
    sums = [np.zeros_like(b) for b in codebooks]
    for batch in batches:
        vectors, _ = _units(batch.column(0), width)
        if len(vectors):
            for p, book in enumerate(books):
                part = vectors[:, at[p]:at[p + 1]]
                index, _ = book.nearest(part)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                np.add.at(sums[p], index, part)
    rows = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
    yield pa.RecordBatch.from_arrays([
        pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()),
        pa.array([int(counts[p][e]) for p, e in rows], pa.int64()),
        pa.array([sums[p][e].tolist() for p, e in rows], pa.list_(pa.int64())),
    ], ["part", "entry", "n", "total"])


def _codes(batches, codebooks, width):
    books, at = _cells(codebooks), bounds(width, len(codebooks))
    digits = np.array([f"{i:02x}" for i in range(max(len(b) for b in codebooks))], dtype="S2")
    for batch in batches:
        vectors, rows = _units(batch.column(2), width)
        code = np.full(batch.num_rows, None, dtype=object)
        error = np.zeros(batch.num_rows, dtype=np.int64)
        if len(vectors):
            found = [book.nearest(vectors[:, at[p]:at[p + 1]]) for p, book in enumerate(books)]
            letters = np.stack([digits[index] for index, _ in found], axis=1)
            code[rows] = [r.tobytes().decode("ascii") for r in letters]
            error[rows] = sum(distance for _, distance in found)
        uncoded = np.ones(batch.num_rows, dtype=bool)
        uncoded[rows] = False
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=uncoded)],
            ["vec_id", "label", "code", "error"],
        )


def _kept(embeddings: DataFrame, vector: str) -> DataFrame:
    components = F.col(vector).cast("array<double>")
    finite = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(
        F.col(vector).isNotNull() & (F.size(components) > 0) & F.coalesce(finite, F.lit(False))
    ).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), components.alias("vector")
    )


def learn_codebooks(
    embeddings: DataFrame, vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS,
    parts: int = PARTS,
) -> list[np.ndarray]:
    """The codebook of each place, of at most ``entries`` rows; none for an empty table."""
    kept = _kept(embeddings, vector)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return []
    width = len(first[0]["vector"])
    begun = pa.array([r["vector"] for r in first], pa.list_(pa.float64()))
    units, _ = _units(begun, width)
    if not len(units):
        return []
    at = bounds(width, parts)
    codebooks = [units[:, at[p]:at[p + 1]] for p in range(parts)]
    for _ in range(rounds):
        # Sums of a table's parts may leave 64 bits, so they are added as decimals.
        found = (
            kept.select("vector").mapInArrow(
                partial(_sums, codebooks=codebooks, width=width), "part int, entry int, n long, total array<long>"
            )
            .select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
            .groupBy("part", "entry", "place")
            .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
            .collect()
        )  # at most a row for each number of the codebooks
        codebooks = [book.copy() for book in codebooks]
        for r in found:
            codebooks[r["part"]][r["entry"], r["place"]] = int(r["x"]) // r["n"]
    return codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist()).encode()).hexdigest()


def write_codes(embeddings: DataFrame, codebooks: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """``vec_id, label, code, error`` of each kept row."""
    kept = _kept(embeddings, vector)
    label = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    if not codebooks:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"),
                           F.lit(None).cast("long").alias("error"))
    width = sum(book.shape[1] for book in codebooks)
    return kept.mapInArrow(partial(_codes, codebooks=codebooks, width=width), schema)


def code_digest(coded: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """The contract's columns. ``label_error`` is null where a label's sum leaves 64 bits."""
    coded = materialize(coded, "codes")
    # Sums are made per task before they meet; a hot label is one row from each task.
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(
        F.col("label").alias("of"), F.col("total").try_cast("long").alias("label_error")
    )
    return coded.join(materialize(total, "label-errors"), F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256")
    )
