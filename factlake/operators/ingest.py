"""Writing facts in bulk: the decision table and import."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.embed import Embedder, embed_column
from factlake.functions.scalars import append_corroborated, parse_agent_id, pin_on_critical
from factlake.operators import filters
from factlake.operators.filters import content_reason, moment
from factlake.operators.search import similarity_rows
from factlake.operators.simjoin import best_hits
from factlake.schema import DEDUP_THRESHOLD, MAX_CONTENT_LENGTH
from factlake.session import materialize


def decide_action(candidates: DataFrame, matches: DataFrame, mode: str = "remember") -> DataFrame:
    """What to do with each candidate, judged by its nearest duplicate alone.

    By the same author: update it (``remember``) or skip the candidate
    (``import``).  By another author: insert with the corroboration mark.
    None: insert.  Candidates carry ``candidate_id, created_by``; matches are
    rows of :func:`factlake.operators.search.dedup_check`.
    """
    nearest = matches.filter("rank = 1").select(
        "candidate_id", F.col("id").alias("match_id"),
        F.col("created_by").alias("match_author"), F.col("similarity").alias("match_similarity"),
    )
    own = "update" if mode == "remember" else "skip"
    return candidates.join(nearest, "candidate_id", "left").withColumn(
        "action",
        F.when(F.col("match_id").isNull(), "insert")
        .when(F.col("match_author") == F.col("created_by"), own)
        .otherwise("insert_corroborated"),
    )


def derived_id(*parts: Column) -> Column:
    """A stable id in UUID form, so that a repeated job writes the same rows."""
    h = F.md5(F.concat_ws("\u0001", *parts))
    pieces = [F.substring(h, start, size) for start, size in
              ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)


def _as_type(df: DataFrame, column: str, kind: T.DataType) -> Column:
    """The column cast to ``kind``, left alone where only nullability differs."""
    same = df.schema[column].dataType.simpleString() == kind.simpleString()
    return F.col(column) if same else F.col(column).cast(kind).alias(column)


def append_memories(memory: DataFrame, rows: DataFrame, as_of) -> DataFrame:
    """Insert rows; missing or NULL fields take the column defaults."""
    now = moment(memory, as_of, "created_at")
    no_tags = F.array().cast("array<string>")
    defaults = {
        "tags": no_tags, "importance": F.lit("normal"), "pinned": F.lit(False),
        "archived": F.lit(False), "created_at": now, "updated_at": now,
        "last_accessed_at": now, "access_count": F.lit(0),
    }
    filled = rows.withColumns({
        name: F.coalesce(F.col(name), value) if name in rows.columns else value
        for name, value in defaults.items()
    })
    filled = filled.select(*[
        _as_type(filled, c, memory.schema[c].dataType) for c in memory.columns
        if c in filled.columns
    ])
    return memory.unionByName(filled, allowMissingColumns=True)


def new_facts(decided: DataFrame, as_of) -> DataFrame:
    """Table rows of the candidates that are to be inserted.

    The moment is part of the id: the same batch, imported again after its
    facts were archived or forgotten, gets other ids.
    """
    author = parse_agent_id(F.col("created_by"))
    corroborated = F.col("action") == "insert_corroborated"
    return decided.filter(F.startswith(F.col("action"), F.lit("insert"))).select(
        derived_id(
            F.col("project_id"), F.col("created_by"), F.col("candidate_id").cast("string"),
            F.col("content"), F.lit(str(as_of)),
        ).alias("id"),
        "project_id", "content", "embedding", "created_by",
        author["engineer"].alias("engineer"), author["agent_type"].alias("agent_type"),
        "repo",
        F.when(corroborated, append_corroborated(F.col("tags")))
        .otherwise(F.col("tags")).alias("tags"),
        F.coalesce("importance", F.lit("normal")).alias("importance"),
        pin_on_critical(F.col("importance")).alias("pinned"),
    )


# --- import -----------------------------------------------------------------------

def import_decisions(
    memory: DataFrame,
    batch: DataFrame,
    project_id: str,
    agent: str,
    threshold: float = DEDUP_THRESHOLD,
) -> DataFrame:
    """``ordinal, action`` as if the items were imported one after the other.

    Items (``ordinal, content, embedding``) have one author.  Against the
    stored facts one join gives the best match by the author and by others.
    Inside the batch an item is skipped once a similar earlier item, at least
    as near as the best match by others, was accepted, and accepted once all
    of those are skipped.  Each round asks every open item for just one open
    and one accepted such item, so rounds never list pairs.
    """
    stored = filters.active(filters.by_project(memory, project_id))
    # An item whose vector repeats an earlier one exactly is always skipped:
    # what decided the earlier one decides it too, or the earlier one itself.
    # Vectors without a length match nothing, so each of these stays for itself.
    fingerprint = F.when(
        F.exists("embedding", lambda x: x != 0), F.sha2(F.to_json("embedding"), 256)
    ).otherwise(F.concat(F.lit("item "), F.col("ordinal").cast("string")))
    first = materialize(
        batch.groupBy(fingerprint).agg(F.min("ordinal").alias("ordinal")).select("ordinal"),
        "import-first",
    )
    items = materialize(
        batch.filter(F.col("embedding").isNotNull()).join(first, "ordinal", "left_semi").select(
            F.col("ordinal").cast("string").alias("query_id"), "ordinal",
            F.lit(project_id).alias("part"), F.col("embedding").alias("vec"),
        ),
        "import-items",
    )
    own = F.when(F.col("created_by") == agent, "own").otherwise("other")
    probes = items.select(
        "query_id", "part", "vec",
        F.lit(float(threshold)).alias("threshold"), F.lit(1).alias("limit"),
    )
    stored_best = (
        best_hits(similarity_rows(stored, own.alias("label")), probes)
        .groupBy("query_id")
        .agg(
            F.max(F.when(F.col("label") == "own", F.col("similarity"))).alias("own"),
            F.max(F.when(F.col("label") == "other", F.col("similarity"))).alias("other"),
        )
    )
    known = items.join(stored_best, "query_id", "left")
    start = F.when(F.col("own") >= F.coalesce("other", F.lit(-1.0)), "skipped").otherwise("open")
    state = materialize(known.withColumn("status", start).drop("own"), "import-round")

    while state.filter("status = 'open'").limit(1).count():
        rows = state.filter("status <> 'skipped'").select(
            F.col("query_id").alias("id"), "part", "vec",
            F.col("status").alias("label"), F.col("ordinal").alias("ord"),
        )
        asking = state.filter("status = 'open'").select(
            "query_id", "part", "vec",
            F.lit(float(threshold)).alias("threshold"), F.lit(1).alias("limit"),
            F.coalesce("other", F.lit(-2.0)).alias("floor"),
            F.col("ordinal").alias("before"),
        )
        found = (
            best_hits(rows, asking, by_order=True)
            .groupBy("query_id")
            .agg(
                F.bool_or(F.col("label") == "accepted").alias("accepted"),
                F.bool_or(F.col("label") == "open").alias("waits"),
            )
        )
        decided = (
            F.when(F.col("status") != "open", F.col("status"))
            .when(F.col("accepted"), "skipped")
            .when(F.col("waits"), "open")
            .otherwise("accepted")
        )
        state = materialize(
            state.join(found, "query_id", "left")
            .withColumn("status", decided).drop("accepted", "waits"),
            "import-round",
        )

    action = (
        F.when(F.col("status") == "accepted",
               F.when(F.col("other").isNull(), "insert").otherwise("insert_corroborated"))
        .otherwise("skip")
    )
    chosen = state.select("ordinal", action.alias("action"))
    without = F.when(F.col("embedding").isNull(), "insert").otherwise("skip")
    return batch.select("ordinal", "embedding").join(chosen, "ordinal", "left").select(
        "ordinal", F.coalesce("action", without).alias("action")
    )


def import_batch(
    memory: DataFrame,
    entries: DataFrame,
    project_id: str,
    agent: str,
    as_of,
    embedder: Embedder | None = None,
    threshold: float = DEDUP_THRESHOLD,
    max_len: int | None = MAX_CONTENT_LENGTH,
    on_invalid: str = "fail",
):
    """(new memory, outcomes) of importing ``entries`` (IMPORT_SCHEMA) in order.

    ``on_invalid='fail'`` imports nothing if any content is empty or too long;
    ``'drop'`` leaves out just those; ``max_len=None`` takes any length.
    Outcomes: ``ordinal, outcome, error``.  Entries that bring an ``embedding``
    keep it; the others are embedded.
    """
    added, outcomes = imported_facts(
        memory, entries, project_id, agent, as_of, embedder, threshold, max_len, on_invalid
    )
    return (memory if added is None else append_memories(memory, added, as_of)), outcomes


def imported_facts(
    memory: DataFrame,
    entries: DataFrame,
    project_id: str,
    agent: str,
    as_of,
    embedder: Embedder | None = None,
    threshold: float = DEDUP_THRESHOLD,
    max_len: int | None = MAX_CONTENT_LENGTH,
    on_invalid: str = "fail",
):
    """(new facts, outcomes) of :func:`import_batch`; None in place of facts if nothing may be imported."""
    if on_invalid not in ("fail", "drop"):
        raise ValueError("on_invalid must be 'fail' or 'drop'")
    checked = entries.withColumn("reason", content_reason(F.col("content"), max_len))
    rejected = checked.filter(F.col("reason").isNotNull()).select(
        "ordinal", F.lit("error").alias("outcome"), F.col("reason").alias("error")
    )
    if on_invalid == "fail" and rejected.limit(1).count():
        return None, rejected
    valid = checked.filter(F.col("reason").isNull()).drop("reason")
    valid = materialize(with_vectors(valid, embedder), "import-batch")
    decided = import_decisions(memory, valid, project_id, agent, threshold)
    decided = materialize(decided, "import-decisions")
    rows = valid.join(decided, "ordinal").withColumns({
        "candidate_id": F.col("ordinal"),
        "project_id": F.lit(project_id),
        "created_by": F.lit(agent),
    })
    outcomes = decided.select(
        "ordinal",
        F.when(F.col("action") == "skip", "skipped").otherwise("imported").alias("outcome"),
        F.lit(None).cast("string").alias("error"),
    )
    return new_facts(rows, as_of), outcomes.unionByName(rejected)


def with_vectors(rows: DataFrame, embedder: Embedder | None) -> DataFrame:
    """``rows`` with a vector wherever none was given."""
    if "embedding" not in rows.columns:
        return embed_column(rows, "content", embedder)
    missing = embed_column(rows.filter(F.col("embedding").isNull()), "content", embedder)
    return rows.filter(F.col("embedding").isNotNull()).unionByName(missing)


def import_summary(outcomes: DataFrame) -> DataFrame:
    """One row: imported, skipped and the number of errors.

    The errors themselves are rows of the outcomes; :func:`import_errors` lists
    them in order.  A list in one row would grow with the batch.
    """
    return outcomes.agg(
        F.count_if(F.col("outcome") == "imported").alias("imported"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )


def import_errors(outcomes: DataFrame, max_len: int = MAX_CONTENT_LENGTH) -> DataFrame:
    """``ordinal, message`` of every rejected item."""
    return outcomes.filter("outcome = 'error'").select(
        "ordinal",
        F.concat(
            F.lit("Item "), F.col("ordinal").cast("string"),
            F.when(F.col("error") == "CONTENT_TOO_LONG",
                   f": content exceeds maximum length of {max_len} characters")
            .otherwise(": content must not be empty"),
        ).alias("message"),
    )
