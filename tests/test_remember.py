"""Remember in rounds against remember in steps."""

import hashlib

import numpy as np
import pytest
from pool import clustered, fact, similarities, table

from factlake.operators import remember

AS_OF = "2025-02-01 00:00:00"
FACT = ("seq long, project_id string, created_by string, content string, tags array<string>, "
        "repo string, importance string, embedding array<float>")
AUTHORS = ["alice/coder", "bob/coder", "auto/ci"]


def derived(*parts):
    h = hashlib.md5("\u0001".join(str(p) for p in parts).encode()).hexdigest()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def step_by_step(stored, facts, threshold):
    """Rows by id, and (id, action) by project and seq, of one fact after the other."""
    rows = {f[0]: {"project": f[1], "content": f[2], "vec": f[3], "author": f[4], "tags": f[8], "repo": f[7],
                   "importance": f[9], "pinned": f[10], "archived": f[11], "written": None} for f in stored}
    report = {}
    for seq, project, author, content, tags, repo, importance, vec in sorted(facts, key=lambda f: f[0]):
        pool = [(i, r) for i, r in rows.items()
                if r["project"] == project and not r["archived"] and r["vec"] is not None and any(r["vec"])]
        hits = []
        if pool and vec is not None and any(vec):
            near = similarities([vec], [r["vec"] for _, r in pool])[0]
            hits = [(-s, r["author"] != author, r["written"] is None, -(r["written"] or 0), i)
                    for s, (i, r) in zip(near, pool, strict=True) if s > threshold]
        if hits and not min(hits)[1]:
            row = rows[min(hits)[-1]]
            row.update(content=content, vec=vec, written=seq)
            for name, value in (("tags", tags), ("repo", repo), ("importance", importance)):
                if value is not None:
                    row[name] = value
            report[project, seq] = (min(hits)[-1], "update")
            continue
        i = derived(project, author, seq, content, AS_OF)
        rows[i] = {"project": project, "content": content, "vec": vec, "author": author,
                   "tags": [*(tags or []), *(["corroborated"] if hits else [])], "repo": repo,
                   "importance": importance or "normal", "pinned": importance == "critical",
                   "archived": False, "written": seq}
        report[project, seq] = (i, "insert_corroborated" if hits else "insert")
    return rows, report


def check(spark, stored, facts, threshold):
    wanted, outcomes = step_by_step(stored, facts, threshold)
    after, report = remember.remember_batch(
        table(spark, stored), spark.createDataFrame(facts, FACT), AS_OF, threshold=threshold)
    project = {f[0]: f[1] for f in facts}
    assert {(project[r.seq], r.seq): (r.id, r.action) for r in report.collect()} == outcomes
    got = after.collect()
    assert len(got) == len(wanted)
    for r in got:
        w = wanted[r.id]
        assert (r.content, r.created_by, r.tags, r.repo, r.importance, r.pinned, r.project_id) == (
            w["content"], w["author"], w["tags"], w["repo"], w["importance"], w["pinned"], w["project"])
        assert (r.embedding is None) == (w["vec"] is None)
        if w["vec"] is not None:
            assert np.allclose(r.embedding, w["vec"])
        assert (str(r.updated_at) == AS_OF) == (w["written"] is not None)


def random_case(seed, size, stored, noise, copies, authors=AUTHORS, centres=6):
    rng = np.random.default_rng(seed)
    vectors = clustered(rng, size + stored, dims=4, centres=centres, noise=noise, copies=copies)
    pick = lambda options: options[rng.integers(len(options))]
    old = [fact(f"s{i:03}", vectors[i], author=pick(authors), archived=i % 9 == 0,
                project=["p", "q"][i % 2], tags=["old"]) for i in range(stored)]
    facts = [(int(i) * 3 - 7, pick(["p", "q"]), pick(authors), f"text {i}", pick([None, ["a"], []]),
              pick([None, "r1", "r2"]), pick([None, "high", "critical"]), [float(x) for x in vectors[stored + i]])
             for i in range(size)]
    return old, [facts[i] for i in rng.permutation(size)]


@pytest.mark.parametrize("seed, noise, copies, threshold", [
    (1, 0.3, 0.1, 0.95), (3, 0.8, 0.3, 0.8), (4, 0.2, 0.6, 0.97)])
def test_rounds_equal_steps(spark, seed, noise, copies, threshold):
    stored, facts = random_case(seed, 80, 24, noise, copies)
    check(spark, stored, facts, threshold)


def test_rounds_equal_steps_on_large_plan(spark, small_blocks):
    stored, facts = random_case(7, 60, 24, 0.5, 0.2)
    check(spark, stored, facts, 0.9)


def test_long_chain_of_refinements(spark):
    """Each fact is nearest to the one before: one row moves through all of them."""
    turn = lambda i: [float(np.cos(i / 40)), float(np.sin(i / 40))]
    stored = [fact("s", turn(-1), author="alice/coder", project="p")]
    facts = [(i, "p", "alice/coder", f"step {i}", None, None, None, turn(i)) for i in range(50)]
    check(spark, stored, facts, 0.999)


def test_many_copies(spark):
    """Copies by several authors, with and without a near variant that moves rows away."""
    at = lambda x: [1.0, x]
    facts = []
    for i in range(120):
        author = AUTHORS[i % 3]
        x = 0.05 if i % 40 == 20 and author == "bob/coder" else 0.0
        facts.append((i, "p", author, f"copy {i}", ["t"] if i % 10 == 0 else None, None, None, at(x)))
    check(spark, [fact("s", at(0.01), author="alice/coder", project="p")], facts, 0.99)


def test_more_items_than_are_kept(spark, monkeypatch):
    """With one nearest item kept, lost ones are searched for again."""
    monkeypatch.setattr(remember, "KEPT", 1)
    stored, facts = random_case(11, 60, 20, 0.5, 0.2, centres=2)
    check(spark, stored, facts, 0.85)


def test_odd_facts(spark):
    """No vector, no length, repeated rows, equal seqs in two projects, an empty batch, rejected texts."""
    same = (4, "p", "bob/coder", "b", None, None, None, [1.0, 0.0])
    facts = [(1, "p", "bob/coder", "no vector", None, None, None, [0.0, 0.0]),
             (2, "p", "bob/coder", "no vector", None, None, None, [0.0, 0.0]), same,
             (5, "q", "bob/coder", "b", None, None, None, [1.0, 0.0])]
    check(spark, [], facts, 0.9)
    _, report = remember.remember_batch(
        table(spark, []), spark.createDataFrame([same, same, (4, "q", *same[2:]), (9, "p", "x/y", " ", *same[4:])], FACT),
        AS_OF)
    assert sorted((r.seq, r.action) for r in report.collect()) == [(4, "insert"), (4, "insert"), (9, "reject")]
    after, report = remember.remember_batch(table(spark, [fact("s", [1, 0])]), spark.createDataFrame([], FACT), AS_OF)
    assert after.count() == 1 and report.count() == 0


@pytest.mark.parametrize("in_a_row, most", [(16_384, 2), (9, 6)])
def test_a_chain_of_waiting_facts_takes_few_rounds(spark, monkeypatch, in_a_row, most):
    """Rows of an author that move between near variants wait for each other, link by link."""
    rounds, plain = [], remember.materialize
    monkeypatch.setattr(remember, "_IN_A_ROW", in_a_row)
    monkeypatch.setattr(remember, "materialize", lambda df, name: (rounds.append(name), plain(df, name))[1])
    facts = [(i, "pq"[i % 2], AUTHORS[i % 3 % 2], f"turn {i}", None, None, None, [1.0, 0.01 * (i * i % 7)]) for i in range(60)]
    check(spark, [fact("s", [1.0, 0.02], author="alice/coder", project="p")], facts, 0.99)
    assert rounds.count("remember-round") <= most
