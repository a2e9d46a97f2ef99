"""The numeric inner step of the similarity joins: one block against one block.

Spark decides which rows meet which probes; the functions here only multiply
two bounded matrices and keep, per probe (and per label), the best hits.
"""

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute

from factlake.functions.vectors import SIMILARITY_DECIMALS

HIT_SCHEMA = "query_id string, id string, label string, similarity double, ord long"
EDGE_SCHEMA = "src string, dst string"

_CELLS_PER_STEP = 4_000_000
# Bounds of similarities that are held at once, and their error in single precision at most.
_BOUNDS_PER_STEP = 1 << 20
_BOUND_ERROR = 2e-5
# Pairs that are not worth a filter, and the share of pairs that a filter may let through.
_FEW_PAIRS = 1 << 16
_MOST_LEFT = 0.02
# Rows that are compared in full before bounds are tried again; twice as many each time.
_FIRST_ROWS = 2048
_LEADING = (8, 16, 32)
_WIDEST = 256
_HITS_BEFORE_COMPACTION = 400_000


def unit_matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column and a mask of those with a length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 1)), np.zeros(0, dtype=bool)
    items = column.flatten()
    # With NULLs or uneven lengths the numbers could shift between rows unseen.
    if column.null_count or items.null_count or len(set(pa.compute.list_value_length(column).to_pylist())) > 1:
        raise ValueError("vectors must be given, whole and of one length")
    flat = items.to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = norms > 0
    return matrix / np.where(usable, norms, 1.0)[:, None], usable


def _optional(table, name, fill, dtype):
    if name not in table.column_names:
        return None
    return table.column(name).to_pandas().fillna(fill).to_numpy(dtype=dtype)


def _places(table) -> pd.Series:
    """What rows and probes share to meet: the pivot inside a cell, else the part."""
    return table.column("pivot" if "pivot" in table.column_names else "part").to_pandas()


def _asked(table) -> dict:
    """The probes of each place; a probe in a cell lists the pivots that it asks."""
    if "pivots" not in table.column_names:
        part = table.column("part").to_pandas()
        return {k: np.asarray(v) for k, v in part.groupby(part).indices.items()}
    lists = table.column("pivots").combine_chunks()
    if not len(lists):
        return {}
    pivot = lists.flatten().to_numpy(zero_copy_only=False)
    probe = lists.value_parent_indices().to_numpy(zero_copy_only=False)
    order = np.argsort(pivot, kind="stable")
    pivot, probe = pivot[order], probe[order]
    starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
    return dict(zip(pivot[starts].tolist(), np.split(probe, starts[1:])))


class _Filter:
    """Upper bounds of the similarities of a group of probes, in single precision.

    Rotated so that the leading numbers hold most, two unit vectors have a product of at
    most that of their leading numbers and that of the lengths of what follows. Only pairs
    whose bound reaches what the probe asks for are multiplied in full.
    """

    def __init__(self, probes: "Probes", queries: np.ndarray, bound: np.ndarray, vectors: np.ndarray):
        self.turned, self.rows = probes.turned[queries], probes.turn(vectors)
        self.least = np.minimum(bound, 4.0) - _BOUND_ERROR
        width = self.turned.shape[1]
        some = slice(None, None, max(1, len(queries) // 1024)), slice(None, None, max(1, len(vectors) // 256))
        self.width, self.left = width, 1.0
        lowest = np.inf
        for leading in (*(n for n in _LEADING if n < width), width):
            left = float((self._rows(some[1], leading) @ self._asked(some[0], leading) > 0).mean())
            # In nanoseconds of a pair, as measured: the product, the search for what is left, the full product.
            cost = 0.02 * leading + 150 * left
            if cost < lowest:
                lowest, self.width, self.left = cost, leading, left
        if self.left <= _MOST_LEFT:
            self.asked = self._asked(slice(None), self.width)
            self.given = self._rows(slice(None), self.width)

    def _rows(self, which, leading: int) -> np.ndarray:
        rows = self.rows[which]
        return np.column_stack([
            rows[:, :leading], np.sqrt(np.square(rows[:, leading:]).sum(axis=1)), np.ones(len(rows))
        ]).astype(np.float32)

    def _asked(self, which, leading: int) -> np.ndarray:
        asked = self.turned[which]
        return np.ascontiguousarray(np.column_stack([
            asked[:, :leading], np.sqrt(np.square(asked[:, leading:]).sum(axis=1)), -self.least[which]
        ]).astype(np.float32).T)

    def left_of(self, start: int, end: int, first: int) -> np.ndarray:
        """Whether each row of a run may reach each probe from the ``first`` on."""
        return self.given[start:end] @ self.asked[:, first:] > 0


def _marked(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and columns that are marked, found eight at a time since few are."""
    flat = near.reshape(-1)
    whole = len(flat) - len(flat) % 8
    at = np.flatnonzero(flat[:whole].view(np.uint64))
    inside, bit = np.nonzero(flat[:whole].reshape(-1, 8)[at])
    found = np.concatenate([at[inside] * 8 + bit, whole + np.flatnonzero(flat[whole:])])
    return np.divmod(found, near.shape[1])


@dataclass
class Probes:
    """The query side of a block."""

    ids: np.ndarray
    parts: dict
    vectors: np.ndarray
    threshold: np.ndarray
    floor: np.ndarray
    limit: np.ndarray
    before: np.ndarray | None
    scope: np.ndarray | None
    after: np.ndarray | None = None

    @cached_property
    def axes(self) -> np.ndarray | None:
        """The probes' principal axes; wide vectors are left as they are."""
        if self.vectors.shape[1] > _WIDEST:
            return None
        return np.linalg.eigh(self.vectors.T @ self.vectors)[1][:, ::-1]

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        return vectors if self.axes is None else vectors @ self.axes

    @cached_property
    def turned(self) -> np.ndarray:
        return self.turn(self.vectors)

    @classmethod
    def of(cls, table: pa.Table) -> "Probes":
        vectors, usable = unit_matrix(table.column("vec"))
        size = table.num_rows

        def column(name, fill, dtype=float):
            found = _optional(table, name, fill, dtype)
            return np.full(size, fill, dtype=dtype) if found is None else found

        threshold = np.where(usable, column("threshold", -2.0), np.inf)
        return cls(
            ids=table.column("query_id").to_pandas().to_numpy(dtype=object),
            parts=_asked(table),
            vectors=vectors,
            threshold=threshold,
            floor=column("floor", -2.0),
            limit=column("limit", 1, np.int64),
            before=_optional(table, "before", np.iinfo(np.int64).max, np.int64),
            after=_optional(table, "after", np.iinfo(np.int64).min, np.int64),
            scope=_optional(table, "scope", 0, np.int64),
        )


class _Scopes:
    """The lists of scopes of some rows."""

    def __init__(self, column, n_scopes: int):
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        self.lengths = np.diff(lists.offsets.to_numpy())
        self.values = lists.flatten().to_numpy()
        self.n_scopes = max(n_scopes, int(self.values.max(initial=0)) + 1)

    def mask(self, rows: np.ndarray) -> np.ndarray:
        """Whether each of ``rows`` lies in each scope."""
        lengths = self.lengths[rows]
        before = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(self.starts[rows] - before, lengths)
        mask = np.zeros((len(rows), self.n_scopes), dtype=bool)
        mask[np.repeat(np.arange(len(rows)), lengths), self.values[at]] = True
        return mask


class BestHits:
    """Keeps the best ``limit`` hits per probe and label over many blocks."""

    def __init__(self, probes: Probes, by_order: bool = False, exclude_self: bool = False):
        self.probes = probes
        self.by_order = by_order
        self.exclude_self = exclude_self
        self.floor = probes.floor.copy()
        self.parts: list[pd.DataFrame] = []
        self.pending = 0

    def add(self, table: pa.Table) -> None:
        probes = self.probes
        vectors, usable = unit_matrix(table.column("vec"))
        ids = table.column("id").to_pandas().to_numpy(dtype=object)
        part = _places(table)
        labels = _optional(table, "label", "", object)
        order = _optional(table, "ord", 0, np.int64)
        until = _optional(table, "until", np.iinfo(np.int64).max, np.int64)
        scopes = None
        if probes.scope is not None:
            scopes = _Scopes(table.column("scopes"), int(probes.scope.max(initial=0)) + 1)
        by = [part] if labels is None else [part, pd.Series(labels)]
        id_rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        for key, rows in part.groupby(by if len(by) > 1 else part).indices.items():
            queries = probes.parts.get(key[0] if len(by) > 1 else key)
            if queries is None:
                continue
            rows = rows[usable[rows]]
            rest = (vectors, ids, id_rank, labels, order, until, scopes)
            start, run = 0, _FIRST_ROWS
            # What the first rows bring raises the floors, so that bounds may rule out the others.
            while start < len(rows):
                if (len(rows) - start) * len(queries) > _FEW_PAIRS and self._sift(rows[start:], queries, *rest):
                    break
                end, step = min(len(rows), start + run), max(1, _CELLS_PER_STEP // len(queries))
                for at in range(start, end, step):
                    self._match(rows[at:min(end, at + step)], queries, *rest)
                start, run = end, 2 * run
                if start < len(rows) and labels is None and not self.by_order:
                    self._compact()

    def _sift(self, rows, queries, vectors, ids, id_rank, labels, order, until, scopes) -> bool:
        """Add the best hits of rows of one label where bounds leave few pairs; else False."""
        probes = self.probes
        if order is not None and probes.before is not None:
            # Only rows before a probe count, so later probes are a run at the end.
            queries = queries[np.argsort(probes.before[queries], kind="stable")]
            rows = rows[np.argsort(order[rows], kind="stable")]
        bound = np.maximum(probes.threshold[queries], self.floor[queries]) - 1e-8
        sieve = _Filter(probes, queries, bound, vectors[rows])
        if sieve.left > _MOST_LEFT:
            return False
        start = 0
        while start < len(rows):
            first = 0
            if order is not None and probes.before is not None:
                first = int(np.searchsorted(probes.before[queries], order[rows[start]], side="right"))
                if first == len(queries):
                    break
            end = start + max(1, _BOUNDS_PER_STEP // (len(queries) - first))
            some, asking = rows[start:end], queries[first:]
            near = sieve.left_of(start, end, first)
            start = end
            if np.count_nonzero(near) > 4 * _MOST_LEFT * near.size:
                self._match(some, asking, vectors, ids, id_rank, labels, order, until, scopes)
                continue
            at, q = _marked(near)
            r, q = some[at], asking[q]
            if scopes is not None and len(r):
                keep = scopes.mask(some)[at, probes.scope[q]]
                r, q = r[keep], q[keep]
            if order is not None and probes.before is not None:
                keep = order[r] < probes.before[q]
                r, q = r[keep], q[keep]
            if order is not None and probes.after is not None:
                keep = order[r] > probes.after[q]
                r, q = r[keep], q[keep]
            if until is not None and probes.before is not None:
                keep = until[r] >= probes.before[q]
                r, q = r[keep], q[keep]
            similarity = np.round(np.einsum("ij,ij->i", vectors[r], probes.vectors[q]), SIMILARITY_DECIMALS)
            self._keep(r, q, similarity, ids, id_rank, labels, order)
        return True

    def _match(self, rows, queries, vectors, ids, id_rank, labels, order, until, scopes) -> None:
        """Add the best hits of some rows of one label."""
        probes = self.probes
        limit = probes.limit[queries]
        products = vectors[rows] @ probes.vectors[queries].T
        bound = np.maximum(probes.threshold[queries], self.floor[queries]) - 1e-8
        near = products > bound
        if self.by_order:
            # Thinning by order keeps the first marked ones, so only hits may be marked.
            exact = np.round(products, SIMILARITY_DECIMALS)
            near &= (exact > probes.threshold[queries]) & (exact >= self.floor[queries])
        if scopes is not None:
            # Few pairs are near, so only those are looked up.
            pairs = np.flatnonzero(near)
            r, q = np.divmod(pairs, len(queries))
            near.ravel()[pairs] = scopes.mask(rows)[r, probes.scope[queries][q]]
        if order is not None and probes.before is not None:
            near &= order[rows][:, None] < probes.before[queries][None, :]
        if order is not None and probes.after is not None:
            near &= order[rows][:, None] > probes.after[queries][None, :]
        if until is not None and probes.before is not None:
            near &= until[rows][:, None] >= probes.before[queries][None, :]
        self._thin(near, order[rows] if self.by_order else products, limit + self.exclude_self)
        flat = np.flatnonzero(near)
        similarity = np.round(products.ravel()[flat], SIMILARITY_DECIMALS)
        r, q = np.divmod(flat, len(queries))
        self._keep(rows[r], queries[q], similarity, ids, id_rank, labels, order)

    def _keep(self, r, q, similarity, ids, id_rank, labels, order) -> None:
        """Add the best hits per probe of some pairs of one label."""
        probes = self.probes
        keep = (similarity > probes.threshold[q]) & (similarity >= self.floor[q])
        if self.exclude_self:
            keep &= ids[r] != probes.ids[q]
        r, q, similarity = r[keep], q[keep], similarity[keep]
        if not len(r):
            return
        best = np.lexsort((id_rank[r], order[r] if self.by_order else -similarity, q))
        r, q, similarity = r[best], q[best], similarity[best]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < probes.limit[q]
        r, q, similarity = r[keep], q[keep], similarity[keep]
        self.parts.append(pd.DataFrame({
            "q": q,
            "id": ids[r],
            "label": "" if labels is None else labels[r],
            "similarity": similarity,
            "ord": 0 if order is None else order[r],
            "labelled": labels is not None,
        }))
        self.pending += len(r)
        if self.pending > max(_HITS_BEFORE_COMPACTION, 4 * int(probes.limit.sum())):
            self._compact()

    def _thin(self, near: np.ndarray, key: np.ndarray, limit: np.ndarray) -> None:
        """Unmark what cannot be among a probe's best, so a crowd of hits stays cheap."""
        crowded = np.flatnonzero(near.sum(axis=0) > 4 * limit)
        if not len(crowded):
            return
        at = int(limit[crowded].max()) - 1
        if at >= len(near):
            return
        if self.by_order:
            column = np.where(near[:, crowded], key[:, None], np.iinfo(np.int64).max)
            near[:, crowded] &= column <= np.partition(column, at, axis=0)[at]
        else:
            column = np.where(near[:, crowded], -key[:, crowded], np.inf)
            near[:, crowded] &= column <= np.partition(column, at, axis=0)[at] + 1e-8

    def _compact(self) -> None:
        if not self.parts:
            return
        hits = pd.concat(self.parts, ignore_index=True)
        first, up = ("ord", True) if self.by_order else ("similarity", False)
        hits = hits.sort_values(["q", "label", first, "id"], ascending=[True, True, up, True])
        rank = hits.groupby(["q", "label"], sort=False).cumcount().to_numpy()
        limit = self.probes.limit[hits["q"].to_numpy()]
        hits = hits[rank < limit]
        if not self.by_order and not hits["labelled"].any():
            # A probe with all its hits only wants ones at least as good.
            last = hits[rank[rank < limit] == limit[rank < limit] - 1]
            at = last["q"].to_numpy()
            self.floor[at] = np.maximum(self.floor[at], last["similarity"].to_numpy())
        self.parts = [hits]
        self.pending = 0

    def result(self) -> pa.Table:
        self._compact()
        schema = pa.schema([
            ("query_id", pa.string()), ("id", pa.string()), ("label", pa.string()),
            ("similarity", pa.float64()), ("ord", pa.int64()),
        ])
        if not self.parts:
            return schema.empty_table()
        hits = self.parts[0]
        return pa.table({
            "query_id": self.probes.ids[hits["q"].to_numpy()],
            "id": hits["id"].to_numpy(),
            "label": hits["label"].to_numpy(),
            "similarity": hits["similarity"].to_numpy(),
            "ord": hits["ord"].to_numpy(),
        }, schema=schema)


def spanning_edges(table: pa.Table, probes: Probes) -> pa.Table:
    """A spanning forest of the match graph of a block, at most rows + probes edges.

    Whoever is connected by matches inside the block is connected by these
    edges, so components come out the same without listing every pair.
    """
    vectors, usable = unit_matrix(table.column("vec"))
    ids = table.column("id").to_pandas().to_numpy(dtype=object)
    part = _places(table)
    src, dst = [], []
    for key, all_rows in part.groupby(part).indices.items():
        queries = probes.parts.get(key)
        if queries is None:
            continue
        all_rows = all_rows[usable[all_rows]]
        step = max(1, _CELLS_PER_STEP // len(queries))
        for start in range(0, len(all_rows), step):
            rows = all_rows[start:start + step]
            products = vectors[rows] @ probes.vectors[queries].T
            match = products > probes.threshold[queries] - 1e-8
            flat = np.flatnonzero(match)
            exact = np.round(products.ravel()[flat], SIMILARITY_DECIMALS)
            match.ravel()[flat] = exact > probes.threshold[queries][flat % len(queries)]
            matched_rows = np.flatnonzero(match.any(axis=1))
            matched_queries = np.flatnonzero(match.any(axis=0))
            match = match[np.ix_(matched_rows, matched_queries)]
            row_label = np.arange(len(matched_rows))
            query_label = np.full(len(matched_queries), len(matched_rows))
            changed = len(matched_rows) > 0
            while changed:
                heard = np.where(match, row_label[:, None], len(matched_rows)).min(axis=0)
                query_label = np.minimum(query_label, heard)
                told = np.where(match, query_label, len(matched_rows)).min(axis=1)
                changed = (told < row_label).any()
                row_label = np.minimum(row_label, told)
            names = ids[rows[matched_rows]]
            src += [names, probes.ids[queries[matched_queries]]]
            dst += [names[row_label], names[query_label]]
    schema = pa.schema([("src", pa.string()), ("dst", pa.string())])
    if not src:
        return schema.empty_table()
    nodes, root = _roots(np.concatenate(src), np.concatenate(dst))
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"src": nodes[child], "dst": nodes[root[child]]}, schema=schema)


def _roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and, per node, the position of its component's first."""
    codes, nodes = pd.factorize(np.concatenate([src, dst]))
    a, b = codes[: len(src)], codes[len(src):]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return nodes, root
