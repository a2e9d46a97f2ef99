"""Divergence of sources, quality and vector codes against plain versions, and their odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_cases import CASES, frame

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from factlake.session import ship_package

    ship_package(spark)


def audit(rows, least, top):
    """The contract, word by word."""
    terms = lambda t: [m.translate({c: c + 32 for c in range(65, 91)}) for m in
                       re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(lang or "", source or "", terms(text)) for _, text, lang, source, *_ in rows]
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        documents[lang].update(set(words))
        counts[lang, source].update(words)
    out = {}
    for lang in documents.keys() | {r[0] for r in rows}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum((Counter({t: c[t] for t in kept}) for c in groups.values()), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            found = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", found)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(items[:top if part == "term" else None], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def sourced(cases, sources="abcdefg"):
    return [(d, t, lang, sources[i % len(sources)] if i % 5 else None) for i, (d, t, lang) in enumerate(cases * 3)]


@pytest.mark.parametrize("least,block,tile", [(2, 1 << 20, 256), (2, 7, 2), (1, 40, 3), (99, 10, 1)])
def test_audit(spark, least, block, tile):
    from factlake.llm.source_divergence import audit_sources

    rows = sourced([(d, t, lang) for d, t, lang in CASES])
    got = audit_sources(frame(spark, rows), least_documents=least, top=3, block=block, tile=tile).collect()
    assert {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got} == audit(rows, least, 3)
    assert len(got) == len({tuple(r)[:4] for r in got})


def test_audit_of_nothing(spark):
    from factlake.llm.source_divergence import audit_sources

    assert audit_sources(frame(spark, [])).count() == 0
    assert audit_sources(frame(spark, [(1, "a b", "en", "x")]), least_documents=1).count() == 0


def test_counts_are_sent_in_parts(spark, monkeypatch):
    from factlake.llm import source_divergence

    monkeypatch.setattr(source_divergence, "FLUSH", 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["s"] * 3, "text": ["a b a", "", "b"]})
    sent = [r for b in source_divergence._counts(iter([batch, batch])) for r in b.to_pylist()]
    total = Counter()
    for r in sent:
        total[r["term"]] += r["n"]
    assert total == {b"a": 4, b"b": 4, b"": 6}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.lists(st.dictionaries(st.integers(0, 39), st.integers(1, 9), max_size=20), min_size=2, max_size=5))
def test_walks_price_every_term(terms, trees):
    from factlake.llm.source_divergence import Forest, _pairs, share

    trees = [{t % terms: n for t, n in tree.items()} for tree in trees]
    flat = [(s, t, n) for s, tree in enumerate(trees) for t, n in tree.items()]
    source, term, count = (np.array([f[i] for f in flat], dtype=np.int64) for i in range(3))
    whole = np.array([sum(tree.values()) + 5 * terms for tree in trees], dtype=np.int64)
    forest = Forest(source, term, count, len(trees), terms)
    left, right = _pairs(np.arange(len(trees)), len(trees))
    dense = np.zeros((len(trees), terms), dtype=np.int64)
    for s, t, n in flat:
        dense[s, t] = n
    p = share(dense, whole[:, None])
    assert forest.prices(left, right, whole, terms).tolist() == np.abs(p[left] - p[right]).sum(1).tolist()


def test_equal_pairs_of_nodes_are_opened_once():
    from factlake.llm.source_divergence import Forest

    terms = 1 << 14
    source, term = np.array([0, 1, 1]), np.array([5, 5, 9000])
    forest = Forest(source, term, np.array([2, 2, 7]), 3, terms)
    whole = np.array([2, 9, 0]) + 5 * terms
    forest.prices(np.array([0]), np.array([1]), whole, terms)
    assert forest.opened < 100


def test_shares_are_exact_for_large_counts():
    from factlake.llm.source_divergence import share

    counts = np.array([0, 1, 10 ** 12, 8 * 10 ** 15], dtype=np.int64)
    whole = 8 * 10 ** 15 + 12345
    assert share(counts, whole).tolist() == [1 + 10 ** 9 * (int(c) + 5) // whole for c in counts]


def plain_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode())


def plain_features(text):
    """Distinct tokens, pairs and runs of shapes, as sets of tuples."""
    found, shapes, last = plain_tokens(text), [], None
    for t in found:
        low = t.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        upper = sum(65 <= c <= 90 for c in t)
        if not re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            shapes.append(low)
            continue
        shapes.append("again" if low == last else "digits" if re.search(rb"[0-9]", t) else
                      "capitals" if upper == len(t) > 1 else "capital" if upper == 1 and 65 <= t[0] <= 90 else
                      "mixed" if upper else "lower")
        last = low
    low = [t.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for t in found]
    runs = lambda x, n, kind: {(kind, *x[i:i + n]) for i in range(len(x) - n + 1)}
    return runs(low, 1, "t") | runs(low, 2, "t") | runs(shapes, 2, "s") | runs(shapes, 4, "s")


def test_features_are_those_of_plain_sets():
    from factlake.llm.quality_nbsvm import features

    texts = [t.encode() if t is not None else None for _, t, *_ in CASES] + [b"a1 AA!! AA!! Aa aB bb bb bb | x", b"!"]
    slots, owner = features(texts)
    names = {}
    for i, text in enumerate(texts):
        want = plain_features(text.decode() if text is not None else None)
        got = slots[owner == i]
        assert len(got) == len(set(got.tolist())) == len(want)
        alone, _ = features([text])
        assert alone.tolist() == got.tolist()
        for w in want:
            names.setdefault(w, set()).update(got.tolist())
    # A feature that several texts share has a slot that all of them have.
    shared = plain_features("one two three")
    for a in ("zero one two three four", "one two three"):
        assert set(features([b"one two three"])[0].tolist()) <= set(features([a.encode()])[0].tolist()) and shared


def test_log_ratios():
    from factlake.llm.quality_nbsvm import log_ratios

    rows = [np.array([0, 1]), np.array([1, 2]), np.array([1])]
    got = log_ratios(rows, np.array([1, 0, 1]), 4)
    one, zero = [2, 3, 1, 1], [1, 2, 2, 1]
    assert got == pytest.approx([math.log((a / 7) / (b / 6)) for a, b in zip(one, zero, strict=True)])


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1000))
def test_dual_descent_closes_the_gap(seed):
    """Primal and dual value meet, so no other weights have a smaller loss."""
    from factlake.llm.quality_nbsvm import dual_descent

    rng = np.random.default_rng(seed)
    n, slots, cost = 30, 12, 0.5
    rows = [np.flatnonzero(rng.random(slots) < 0.4) for _ in range(n)]
    values = [rng.normal(size=len(r)) for r in rows]
    labels = np.append(rng.integers(0, 2, n - 2), [0, 1])
    weights, alphas = dual_descent(rows, values, labels, slots, cost, 1e-9, 5000)
    y = np.where(labels == 1, 1, -1)
    x = np.zeros((n, slots + 1))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
    x[:, slots] = 1
    most = cost * n / (2 * np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()))
    assert (alphas >= 0).all() and (alphas <= most + 1e-12).all()
    assert weights == pytest.approx((alphas * y) @ x)
    primal = weights @ weights / 2 + (most * np.maximum(0, 1 - y * (x @ weights))).sum()
    dual = alphas.sum() - weights @ weights / 2
    assert primal - dual < 1e-4 * max(1, primal)


def test_curve_is_the_least_log_loss():
    from factlake.llm.quality_nbsvm import fit_curve

    rng = np.random.default_rng(3)
    found = rng.normal(size=400) * 3
    labels = (rng.random(400) < 1 / (1 + np.exp(-(0.8 * found - 0.5)))).astype(int)
    slope, place = fit_curve(found, labels)
    goal = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / (400 - labels.sum() + 2))
    loss = lambda a, b: (np.logaddexp(0, a * found + b) - goal * (a * found + b)).sum()
    assert all(loss(slope, place) <= loss(slope + d, place + e) for d in (-.01, 0, .01) for e in (-.01, 0, .01))


LABEL = "doc_id long, quality int, toxic int"


def test_quality(spark):
    from factlake.llm.quality_nbsvm import features, fit_quality, score_quality

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = [(100 + i, " ".join((word() + ("!!" if i % 3 == 0 else "")) for _ in range(20)), "en") for i in range(90)]
    marks = frame(spark, [(100 + i, int(i % 3 != 0), None) for i in range(90)] + [(100, None, 1), (None, 0, 0), (7, 1, 0)],
                  LABEL)
    docs = frame(spark, list(CASES) + rows + rows[:3])
    got = score_quality(docs, marks).toPandas()
    assert len(got) == len(CASES) + 93 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["doc_id"].between(100, 189) & got["held_out"]]
    assert len(held) > 5 and (held["predicted"] == (held["doc_id"] % 3 != 1)).all()
    for doc, out in zip(got["doc_id"], got["held_out"], strict=True):
        assert out == (doc == doc and zlib.crc32(str(int(doc)).encode()) % 5 == 0)
    # Each score is that of the text's features alone.
    *table, bias = fit_quality(docs, marks).tolist()
    texts = {d: t for d, t, _ in [*CASES, *rows]}
    for r in got.dropna().itertuples():
        z = bias + sum(table[s] for s in features([(texts[int(r.doc_id)] or "").encode()])[0].tolist())
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))))


def test_quality_without_much_to_learn(spark):
    from factlake.llm.quality_nbsvm import score_quality

    none = score_quality(frame(spark, CASES), frame(spark, [], LABEL)).toPandas()
    assert len(none) == len(CASES) and (none["score"] == 0.5).all()
    one = score_quality(frame(spark, CASES), frame(spark, [(4, 1, 0), (6, 1, 0), (9, 1, 1)], LABEL)).toPandas()
    assert one["score"].nunique() == 1 and (one["score"] > 0.5).all()
    assert score_quality(frame(spark, []), frame(spark, [(4, 1, 0), (6, 0, 0)], LABEL)).count() == 0


def test_quality_sample_is_bounded(spark):
    """Many texts of one id count by row, and what the task holds by its features."""
    from factlake.llm.quality_nbsvm import _learn, score_quality

    docs = frame(spark, [(4, f"text {i} " * 5, "en") for i in range(50)] + [(6, "other!!", "en")])
    got = score_quality(docs, frame(spark, [(4, 1, 0), (6, 0, 0)], LABEL)).toPandas()
    assert len(got) == 51
    import pyarrow as pa

    def batches():
        yield pa.RecordBatch.from_pydict({"quality": pa.array([1, 0], pa.int32()),
                                          "slots": pa.array([[1, 2], [3]], pa.list_(pa.int32()))})
        yield pa.RecordBatch.from_pydict({"quality": pa.array([0], pa.int32()),
                                          "slots": pa.array([[9] * 50], pa.list_(pa.int32()))})

    (model,) = _learn(batches(), 10)
    weights = np.frombuffer(model.column("weights")[0].as_py(), dtype="<f4")
    assert weights[9] == 0 < weights[1] and weights[3] < 0


def test_quality_generalises(spark):
    from factlake.llm.common import table
    from factlake.llm.quality_nbsvm import score_quality

    sf = "/root/testdata/sf0.1"
    got = score_quality(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df().set_index("doc_id")["quality"]
    held = got.join(labels, how="inner").query("held_out")
    assert held.loc[held["quality"] == 1, "predicted"].mean() > 0.98
    assert held.loc[held["quality"] == 0, "predicted"].mean() < 0.1


def codes(rows, entries=64, rounds=2, parts=16):
    """The contract, component by component."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(order[0][1])
    at = [i * width // parts for i in range(parts + 1)]
    books = [[v[a:b] for _, v, _ in order] for a, b in zip(at, at[1:], strict=False)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                x = v[at[p]:at[p + 1]]
                held[p, nearest(p, x)[1]].append(x)
        for (p, n), xs in held.items():
            books[p][n] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, total = [], Counter()
    for i, v, label in kept:
        found = [nearest(p, v[at[p]:at[p + 1]]) for p in range(parts)]
        out.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
        total[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for i, label, c, e in out), key=str)


def coded(spark, rows, **more):
    from factlake.llm.grid_codes import code_digest, learn_codebooks, write_codes

    vectors = frame(spark, rows, VEC)
    books = learn_codebooks(vectors, **more)
    return code_digest(write_codes(vectors, books), books)


@pytest.mark.parametrize("width,n", [(16, 90), (32, 200), (40, 30)])
def test_codes(spark, width, n):
    rng = np.random.default_rng(width)
    rows = [(int(i), np.round(rng.normal(size=width) * (1 + 40 * (i == 3)), 3).tolist(), int(i) % 3 if i % 4 else None)
            for i in rng.permutation(n)]
    rows += [rows[0], (None, rows[1][1], 1), (5, rows[2][1], 9), (n + 1, None, 1), (n + 2, [], 2),
             (n + 3, [math.nan] * width, 1), (n + 4, [None, *rows[0][1][1:]], 2), (n + 5, [math.inf] * width, None)]
    got = coded(spark, rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes(rows)


def test_codes_of_odd_vectors(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.25] * 16, 1), (3, [1.0] * 7, 1), (4, [1e30] * 16, 1), (5, [-0.001] * 16, None)]
    got = {r.vec_id: r for r in coded(spark, rows).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[3].code is got[3].error is got[4].code is None
    assert {i: (got[i].code, got[i].error) for i in (1, 2, 5)} == \
        {i: (c, e) for i, c, e, *_ in codes([r for r in rows if r[0] in (1, 2, 5)])}
    assert got[3].label_error == got[1].label_error == got[1].error + got[2].error
    assert coded(spark, []).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-300, 300), st.integers(-300, 300)), min_size=1, max_size=20),
       st.lists(st.tuples(st.integers(-400, 400), st.integers(-400, 400)), min_size=1, max_size=40),
       st.sampled_from([1, 4, 32]))
def test_cells_hold_every_nearest_entry(entries, parts, cell):
    from factlake.llm.grid_codes import GridCells

    book = GridCells(np.array(entries, dtype=np.int64), cell)
    for _ in range(2):
        index, distance = book.nearest(np.array(parts, dtype=np.int64))
        want = [min(((x - a) ** 2 + (y - b) ** 2, i) for i, (a, b) in enumerate(entries)) for x, y in parts]
        assert list(zip(distance.tolist(), index.tolist(), strict=True)) == want


def test_few_entries_are_compared():
    from factlake.llm.grid_codes import GridCells

    rng = np.random.default_rng(2)
    book = GridCells(rng.integers(-80, 80, (64, 4)))
    parts = rng.integers(-80, 80, (20000, 4))
    book.nearest(parts)
    assert book.evaluated < 20000 * 64 / 2
