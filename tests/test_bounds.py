"""Bounds in single precision leave few pairs to multiply, and never lose a hit."""

import numpy as np
import pyarrow as pa
import pytest

from factlake.operators import kernel, simjoin
from factlake.operators.kernel import BestHits, Probes


def _lists(matrix):
    starts = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(starts, pa.array(matrix.astype(np.float32).ravel()))


def _sides(width, rng):
    rows = rng.normal(size=(900, width))
    rows[1::9] = rows[::9] + 0.02 * rng.normal(size=rows[::9].shape)
    rows[2::9] = rows[::9]
    rows[5] = 0
    probes = np.concatenate([rows[::3], rng.normal(size=(100, width))])
    table = pa.table({
        "id": [f"r{i:04d}" for i in range(len(rows))], "part": ["p"] * len(rows), "vec": _lists(rows),
        "ord": rng.permutation(len(rows)), "label": [("own", "other")[i % 2] for i in range(len(rows))],
    })
    asked = pa.table({
        "query_id": [f"q{i:04d}" for i in range(len(probes))], "part": ["p"] * len(probes), "vec": _lists(probes),
        "threshold": np.full(len(probes), 0.95), "limit": np.full(len(probes), 2), "before": rng.permutation(len(probes)) * 2,
    })
    return table, asked


def _hits(table, asked, by_order):
    found = BestHits(Probes.of(asked), by_order)
    found.add(table)
    names = ["query_id", "label", "ord", "similarity", "id"]
    return found.result().select(names).sort_by([(n, "ascending") for n in names]).to_pylist()


@pytest.mark.parametrize("width", [3, 64, 300])
@pytest.mark.parametrize("by_order", [False, True])
@pytest.mark.parametrize("columns", [["id", "part", "vec"], ["id", "part", "vec", "ord"], ["id", "part", "vec", "ord", "label"]])
def test_bounds_find_what_full_products_find(width, by_order, columns, monkeypatch):
    table, asked = _sides(width, np.random.default_rng(width))
    if by_order and "ord" not in columns:
        pytest.skip("an order is needed")
    if "ord" not in columns:
        asked = asked.drop_columns("before")
    table = table.select(columns)
    quick = _hits(table, asked, by_order)
    monkeypatch.setattr(kernel, "_FEW_PAIRS", 1 << 60)
    assert quick == _hits(table, asked, by_order)
    assert quick


def test_far_pairs_are_not_multiplied_in_full(monkeypatch):
    table, asked = _sides(64, np.random.default_rng(1))
    full = []
    matched = BestHits._match
    monkeypatch.setattr(BestHits, "_match", lambda self, rows, queries, *rest: (
        full.append(len(rows) * len(queries)), matched(self, rows, queries, *rest)))
    assert _hits(table.select(["id", "part", "vec"]), asked.drop_columns("before"), False)
    assert sum(full) == 0


def test_floors_of_the_first_rows_spare_the_others(monkeypatch):
    rng = np.random.default_rng(2)
    rows, probes = rng.normal(size=(9000, 64)), rng.normal(size=(200, 64))
    table = pa.table({"id": [f"r{i:04d}" for i in range(9000)], "part": ["p"] * 9000, "vec": _lists(rows)})
    asked = pa.table({
        "query_id": [f"q{i:04d}" for i in range(200)], "part": ["p"] * 200, "vec": _lists(probes),
        "threshold": np.full(200, 0.1), "limit": np.full(200, 3),
    })
    full = []
    matched = BestHits._match
    monkeypatch.setattr(BestHits, "_match", lambda self, rows, queries, *rest: (
        full.append(len(rows) * len(queries)), matched(self, rows, queries, *rest)))
    quick = _hits(table, asked, False)
    assert 0 < sum(full) < 9000 * 200 / 2
    monkeypatch.setattr(kernel, "_FEW_PAIRS", 1 << 60)
    assert quick == _hits(table, asked, False)


def test_a_block_keeps_the_hits_of_some_probes_at_a_time(monkeypatch):
    table, asked = _sides(64, np.random.default_rng(3))
    table, asked = table.select(["id", "part", "vec"]), asked.drop_columns("before")
    whole = _hits(table, asked, False)
    asking = []
    of = Probes.of
    monkeypatch.setattr(simjoin, "_HITS_AT_ONCE", 50)
    monkeypatch.setattr(simjoin.Probes, "of", lambda part: (asking.append(part.num_rows), of(part))[1])
    names = ["query_id", "label", "ord", "similarity", "id"]
    found = simjoin._block_hits(table, asked, False, False).select(names)
    assert found.sort_by([(n, "ascending") for n in names]).to_pylist() == whole
    assert sum(asking) == asked.num_rows and max(asking) <= 25
    assert simjoin._block_hits(table, asked.slice(0, 0), False, False).num_rows == 0
    assert simjoin._block_hits(table.slice(0, 0), asked, False, False).num_rows == 0
