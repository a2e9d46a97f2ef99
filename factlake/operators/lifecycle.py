"""Set-based changes of facts: ``(memory, changes, as_of) -> (new memory, report)``.

Nothing is changed in place.  Each function returns the next state of the table
as a plan over the old one plus a report on the ids asked for; a snapshot
writer (sources/tables.py) makes it durable.  A change set joins on the
unique id, so the fact side has no hot key; a small change set is broadcast by
the planner on its own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.embed import Embedder, embed_column
from factlake.operators import filters
from factlake.operators.filters import content_reason, moment
from factlake.schema import ARCHIVE_AFTER_DAYS, MAX_CONTENT_LENGTH


def _report_ids(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, status`` (found / missing) for every distinct id asked for."""
    known = memory.select("id", F.lit(True).alias("_known"))
    return ids.select("id").distinct().join(known, "id", "left").select(
        "id", F.when(F.col("_known"), "found").otherwise("missing").alias("status")
    )


def _update(memory: DataFrame, marks: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Apply ``changes`` to the rows that have a row in ``marks`` (unique ids)."""
    joined = memory.join(marks.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.select(*[
        F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in memory.columns
    ])


# --- access -------------------------------------------------------------------

def touch(memory: DataFrame, ids: DataFrame, as_of):
    """One access for each distinct known id.  The report has both numbers."""
    marks = ids.select("id").distinct()
    touched = _update(memory, marks, {
        "last_accessed_at": moment(memory, as_of),
        "access_count": (F.col("access_count") + 1).cast("int"),
    })
    known = memory.select("id", F.lit(True).alias("_known"))
    report = ids.select("id").join(known, "id", "left").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_distinct(F.when(F.col("_known"), F.col("id"))).alias("touched"),
    )
    return touched, report


def access_totals(touches: DataFrame) -> DataFrame:
    """Accesses and last access per id; an id twice in one call counts once."""
    per_call = touches.groupBy("id", "call_id").agg(F.max("ts").alias("ts"))
    return per_call.groupBy("id").agg(
        F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_ts")
    )


def fold_access_log(memory: DataFrame, touches: DataFrame):
    """All touches of a log in one pass."""
    totals = access_totals(touches)
    kind = memory.schema["last_accessed_at"].dataType
    joined = memory.join(totals, "id", "left")
    folded = joined.withColumns({
        "access_count": (F.col("access_count") + F.coalesce("hits", F.lit(0))).cast("int"),
        "last_accessed_at": F.greatest("last_accessed_at", F.col("last_ts").cast(kind)),
    }).select(*memory.columns)
    return folded, _report_ids(memory, touches)


# --- flags ----------------------------------------------------------------------

def _set_flag(memory: DataFrame, ids: DataFrame, as_of, extra: dict[str, Column]):
    marks = ids.select("id").distinct()
    changed = _update(memory, marks, {"updated_at": moment(memory, as_of), **extra})
    return changed, _report_ids(memory, ids)


def set_pinned(memory: DataFrame, ids: DataFrame, pinned: bool, as_of):
    return _set_flag(memory, ids, as_of, {"pinned": F.lit(pinned)})


def set_archived(memory: DataFrame, ids: DataFrame, archived: bool, as_of, reset_clock: bool = False):
    """Archive or restore by hand.

    A restored fact keeps its old access time, so the next sweep may archive
    it again; ``reset_clock`` counts the restore as an access time.
    """
    extra = {"archived": F.lit(archived)}
    if reset_clock:
        extra["last_accessed_at"] = moment(memory, as_of)
    return _set_flag(memory, ids, as_of, extra)


def promote(memory: DataFrame, ids: DataFrame, as_of):
    """Archived facts found by a search become active again; others stay as they are."""
    archived = memory.filter("archived").join(ids.select("id").distinct(), "id", "left_semi")
    return _set_flag(memory, archived.select("id"), as_of, {"archived": F.lit(False)})


def archive_stale(
    memory: DataFrame, as_of, days: int = ARCHIVE_AFTER_DAYS, project_id: str | None = None
):
    """The sweep over all projects (or one); the report has the affected count."""
    due = filters.archival_candidates(memory, as_of, days)
    stale = (
        ~F.col("pinned") & ~F.col("archived")
        & (F.col("last_accessed_at") < filters.days_before(moment(memory, as_of), days))
    )
    if project_id is not None:
        due = filters.by_project(due, project_id)
        stale = stale & (F.col("project_id") == project_id)
    swept = memory.withColumns({
        "archived": F.col("archived") | stale,
        "updated_at": F.when(stale, moment(memory, as_of)).otherwise(F.col("updated_at")),
    })
    return swept, due.agg(F.count(F.lit(1)).alias("affected"))


def forget(memory: DataFrame, ids: DataFrame):
    return memory.join(ids.select("id").distinct(), "id", "left_anti"), _report_ids(memory, ids)


# --- content ----------------------------------------------------------------------

def correct(
    memory: DataFrame,
    corrections: DataFrame,
    as_of,
    embedder: Embedder | None = None,
    max_len: int = MAX_CONTENT_LENGTH,
):
    """Replace contents (``id, new_content``); author and other fields stay.

    Only the corrected rows are embedded again.  Report: ``id, status,
    old_content, new_content``; an empty or too long content changes nothing.
    Of several corrections of an id the last by ``seq`` holds; without that
    column, the greatest text.
    """
    reason = content_reason(F.col("new_content"), max_len)
    turn = F.struct("seq", "new_content") if "seq" in corrections.columns else F.struct("new_content")
    checked = corrections.select("id", "new_content", turn.alias("turn"), reason.alias("reason"))
    known = memory.select("id", F.col("content").alias("old_content"))
    report = checked.join(known, "id", "left").select(
        "id",
        F.coalesce(
            "reason", F.when(F.col("old_content").isNull(), "MISSING").otherwise("CORRECTED")
        ).alias("status"),
        "old_content", "new_content",
    )
    valid = checked.filter(F.col("reason").isNull()).groupBy("id").agg(
        F.max("turn").getField("new_content").alias("new_content")
    )
    vectors = embed_column(valid, "new_content", embedder, output="_vector")
    changes = {
        "content": F.col("new_content"),
        "embedding": F.col("_vector"),
        "updated_at": moment(memory, as_of),
        **outdated_lexemes(memory),
    }
    return _update(memory, vectors, changes), report


def outdated_lexemes(memory: DataFrame) -> dict[str, Column]:
    """What a new content does to stored lexemes: none, until they are refreshed."""
    if "tsv" not in memory.columns:
        return {}
    return {"tsv": F.lit(None).cast(memory.schema["tsv"].dataType)}


def re_embed(memory: DataFrame, embedder: Embedder):
    """Move every fact to a new embedding model; facts already on it are kept."""
    if "embedding_model" not in memory.columns:
        memory = memory.withColumn("embedding_model", F.lit(None).cast("string"))
    on_model = F.coalesce(F.col("embedding_model") == embedder.name, F.lit(False))
    done, stale = memory.filter(on_model), memory.filter(~on_model)
    moved = embed_column(
        stale.withColumn("embedding_model", F.lit(embedder.name)), "content", embedder
    )
    return done.unionByName(moved.select(*memory.columns)), stale.agg(
        F.count(F.lit(1)).alias("re_embedded")
    )


def set_tags(memory: DataFrame, edits: DataFrame, as_of):
    """Add and remove tags (``id, add, remove``); removal wins.

    Several edits of an id apply in the order of ``seq``; without that column
    they count as one edit.
    """
    none = F.array().cast("array<string>")
    marks = _folded_edits(edits)
    # What was ever removed leaves its old place; what was added after that comes last.
    tags = F.array_union(
        F.array_except(F.coalesce("tags", none), F.coalesce("removed", none)), F.coalesce("added", none)
    )
    changed = _update(memory, marks, {"tags": tags, "updated_at": moment(memory, as_of)})
    return changed, _report_ids(memory, edits)


def _folded_edits(edits: DataFrame) -> DataFrame:
    """One row per id: tags ever removed, and tags added after their last removal, in order."""
    none = F.array().cast("array<string>")
    seq = F.col("seq").cast("long") if "seq" in edits.columns else F.lit(0).cast("long")
    numbered = edits.select(
        "id", seq.alias("seq"), F.coalesce("add", none).alias("add"), F.coalesce("remove", none).alias("remove")
    )
    steps = numbered.select("id", "seq", F.posexplode("add").alias("at", "tag")).withColumn("kept", F.lit(True)).union(
        numbered.select("id", "seq", F.posexplode("remove").alias("at", "tag")).withColumn("kept", F.lit(False))
    )
    last = steps.filter("not kept").groupBy("id", "tag").agg(F.max("seq").alias("gone"))
    added = (
        steps.filter("kept").join(last, ["id", "tag"], "left")
        .filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
        .groupBy("id", "tag").agg(F.min(F.struct("seq", "at")).alias("first"))
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "tag"))).getField("tag").alias("added"))
    )
    removed = last.groupBy("id").agg(F.collect_set("tag").alias("removed"))
    return numbered.select("id").distinct().join(added, "id", "left").join(removed, "id", "left")


# --- replay -----------------------------------------------------------------------

# Kinds of events that set a flag, and what they set it to.
_FLAG_EVENTS = {
    "pinned": {"pin": True, "unpin": False},
    "archived": {"archive": True, "restore": False, "promote": False},
}


def latest_state_per_id(events: DataFrame) -> DataFrame:
    """Per id the last value of every independent field, in one aggregation.

    Last writer wins per field by ``seq``, so a hot id costs no more than a
    partial aggregate.  A delete is final.
    """
    kind, seq = F.col("kind"), F.col("seq")

    def last_of(kinds, value):
        chosen = kind.isin(*kinds)
        return F.max_by(F.when(chosen, value), F.when(chosen, seq))

    flags = {
        flag: last_of(values, kind.isin(*[k for k, v in values.items() if v]))
        for flag, values in _FLAG_EVENTS.items()
    }
    updates = kind.isin("pin", "unpin", "archive", "restore", "promote", "correct")
    is_touch = kind == "touch"
    return events.groupBy("id").agg(
        flags["pinned"].alias("new_pinned"),
        flags["archived"].alias("new_archived"),
        last_of(["correct"], F.col("payload")).alias("new_content"),
        F.max(F.when(updates, F.col("ts"))).alias("new_updated"),
        F.max(F.when(is_touch, F.col("ts"))).alias("new_accessed"),
        F.count_if(is_touch).alias("touches"),
        F.bool_or(kind == "forget").alias("deleted"),
    )


def replay_events(memory: DataFrame, events: DataFrame, embedder: Embedder | None = None):
    """The table after an ordered log of pin, unpin, archive, restore, promote,
    touch, correct and forget events (``id, kind, seq, ts, payload``).

    A corrected content brings its vector, and its stored lexemes are dropped.
    """
    state = latest_state_per_id(events)
    renewed = embed_column(
        state.filter("new_content is not null").select("id", "new_content"), "new_content", embedder,
        output="new_vector",
    ).select("id", "new_vector")
    state = state.join(renewed, "id", "left")
    corrected = F.col("new_content").isNotNull()
    stamp = memory.schema["updated_at"].dataType
    joined = memory.join(state, "id", "left").filter(
        ~F.coalesce(F.col("deleted"), F.lit(False))
    )
    replayed = joined.withColumns({
        "pinned": F.coalesce("new_pinned", "pinned"),
        "archived": F.coalesce("new_archived", "archived"),
        "content": F.coalesce("new_content", "content"),
        "embedding": F.when(corrected, F.col("new_vector")).otherwise(F.col("embedding")),
        **{name: F.when(corrected, value).otherwise(F.col(name))
           for name, value in outdated_lexemes(memory).items()},
        "updated_at": F.coalesce(F.col("new_updated").cast(stamp), "updated_at"),
        # A log may be older than the table; an access never takes time back.
        "last_accessed_at": F.greatest("last_accessed_at", F.col("new_accessed").cast(stamp)),
        "access_count": (F.col("access_count") + F.coalesce("touches", F.lit(0))).cast("int"),
    }).select(*memory.columns)
    return replayed, _report_ids(memory, events)


