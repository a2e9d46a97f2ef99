"""Small tables of facts, and plain Python answers to compare with."""

import numpy as np

SCHEMA = """id string, project_id string, content string, embedding array<float>, created_by string,
engineer string, agent_type string, repo string, tags array<string>, importance string,
pinned boolean, archived boolean, created_at timestamp, updated_at timestamp,
last_accessed_at timestamp, access_count int"""


def fact(id, embedding=None, project="p", author="alice/coder", content=None, archived=False,
         pinned=False, tags=(), repo=None, accessed="2025-01-01 00:00:00", count=0,
         importance="normal", created="2025-01-01 00:00:00"):
    from datetime import datetime

    at = datetime.fromisoformat
    engineer, agent = author.split("/")
    return (id, project, content or f"content {id}",
            None if embedding is None else [float(x) for x in embedding], author,
            None if engineer == "auto" else engineer, agent, repo, list(tags), importance,
            pinned, archived, at(created), at(created), at(accessed), count)


def table(spark, facts):
    return spark.createDataFrame(facts, SCHEMA)


def unit(vectors):
    v = np.asarray(vectors, dtype=np.float32).astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def similarities(a, b):
    return np.round(unit(a) @ unit(b).T, 9)


def clustered(rng, size, dims=8, centres=12, noise=0.12, copies=0.3):
    """Vectors around a few centres; a share of them exact copies of one."""
    base = rng.normal(size=(centres, dims))
    vectors = base[rng.integers(0, centres, size)] + noise * rng.normal(size=(size, dims))
    vectors[rng.random(size) < copies] = vectors[0]
    return vectors.astype(np.float32)
