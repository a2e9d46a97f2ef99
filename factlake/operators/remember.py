"""Storing facts one after the other, as a batch.

A fact meets the project's active rows as all earlier facts of the batch left
them: the nearest row above the threshold decides.  If its author wrote it, the
row is updated in place and so *moves* to the fact's vector; otherwise the fact
becomes a row of its own.  Every fact thus places its vector in some row, and a
vector once placed (an *item*: a stored row, or a fact) is gone only when a later
fact by the same author is nearest to it.  That makes the order decidable in
rounds instead of steps: a fact is decided once the nearest item that may still
be there surely is, which holds as soon as no undecided earlier fact by the
item's author is near the item.  Facts that depend on nothing undecided, the mass
of a batch, are all decided in the first round; a chain of refinements too,
where each is nearest to the one before.

On equal similarity the author's own item is nearest, then the one written last,
then the smaller id.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.embed import Embedder
from factlake.functions.scalars import append_corroborated, parse_agent_id, pin_on_critical
from factlake.operators import filters
from factlake.operators.duplicates import connected_components
from factlake.operators.filters import content_reason, moment
from factlake.operators.ingest import append_memories, derived_id, with_vectors
from factlake.operators.lifecycle import outdated_lexemes
from factlake.operators.simjoin import best_hits, match_edges
from factlake.schema import DEDUP_THRESHOLD, MAX_CONTENT_LENGTH
from factlake.session import fresh_path, materialize

# Nearest items that a fact keeps between searches; more are searched for when they are gone.
KEPT = 4
# Facts of a component that one task decides in a row.
_IN_A_ROW = 16_384
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1
_DECIDED = "fact string, seq long, target string, action string, round int"


def _own_part() -> Column:
    return F.concat_ws("\u0001", "part", "created_by")


def fact_key(project: Column, seq: Column) -> Column:
    """Names a fact; the later of two facts sorts first, and every fact before every stored row."""
    back = F.lit(_LAST).cast("decimal(20,0)") - seq.cast("decimal(20,0)")
    return F.concat(F.lit("0"), F.lpad(back.cast("string"), 20, "0"), F.lit("\u0001"), F.coalesce(project, F.lit("")))


def _stored_items(memory: DataFrame) -> DataFrame:
    return filters.active(memory).filter(F.col("embedding").isNotNull()).select(
        F.concat(F.lit("1"), F.col("id")).alias("id"), F.col("project_id").alias("part"),
        "created_by", F.col("embedding").cast("array<double>").alias("vec"), F.lit(_FIRST).alias("ord"),
    )


def _fact_items(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("fact").alias("id"), "part", "created_by", "vec", F.col("seq").alias("ord"))


def _folded(facts: DataFrame, threshold: float) -> DataFrame:
    """``fact, first`` of the facts that repeat an earlier vector of their author's,
    where no other vector of that author in the batch is near.

    Nothing in the batch can move such a row, so each repeat finds the one before
    it there, and a mass of copies costs one search.
    """
    name = F.sha2(F.concat_ws("\u0001", "part", "created_by", F.to_json("vec")), 256)
    named = materialize(facts.select("fact", "seq", "part", "created_by", "vec", name.alias("name")), "remember-names")
    families = materialize(
        named.groupBy("name").agg(
            F.min_by("fact", "seq").alias("first"), F.min_by("part", "seq").alias("part"),
            F.min_by("created_by", "seq").alias("created_by"), F.min_by("vec", "seq").alias("vec"),
            F.count(F.lit(1)).alias("n"),
        ), "remember-families",
    )
    rows = families.select(F.col("name").alias("id"), _own_part().alias("part"), "vec")
    probes = families.filter("n > 1").select(
        F.col("name").alias("query_id"), _own_part().alias("part"), "vec",
        F.lit(float(threshold)).alias("threshold"), F.lit(1).alias("limit"),
    )
    mixed = best_hits(rows, probes, exclude_self=True).select(F.col("query_id").alias("name")).distinct()
    alone = materialize(
        families.filter("n > 1").join(mixed, "name", "left_anti").select("name", "first"), "remember-copies"
    )
    return named.select("fact", "name").join(alone, "name").filter(F.col("fact") != F.col("first")).select("fact", "first")


def _nearest_items(items: DataFrame, asking: DataFrame, threshold: float) -> DataFrame:
    """``fact, item, similarity, own, complete``: the nearest items of each asking fact.

    The listed items are the nearest ones without a gap; ``complete`` says that
    there are no others.  One search finds the nearest items by anyone and those
    by the author.
    """
    by = {"any": F.col("part"), "own": _own_part()}
    rows, probes = None, None
    for kind, part in by.items():
        prefix = F.lit(f"{kind}\u0002")
        r = items.select("id", F.concat(prefix, part).alias("part"), "vec", "ord", "until")
        p = asking.select(
            F.concat(prefix, F.col("fact")).alias("query_id"), F.concat(prefix, part).alias("part"), "vec",
            F.lit(float(threshold)).alias("threshold"), F.lit(KEPT).alias("limit"), F.col("seq").alias("before"),
        )
        rows, probes = (r, p) if rows is None else (rows.unionByName(r), probes.unionByName(p))
    hits = materialize(
        best_hits(rows, probes).select(
            F.substring_index("query_id", "\u0002", 1).alias("kind"),
            F.substring_index("query_id", "\u0002", -1).alias("fact"), F.col("id").alias("item"), "similarity",
        ), "remember-hits",
    )
    # Where a list is full, further items may stand behind its last one.
    place = F.struct(-F.col("similarity"), F.col("item"))
    last = hits.groupBy("fact").agg(*(
        F.when(F.count_if(F.col("kind") == kind) >= KEPT, F.max(F.when(F.col("kind") == kind, place))).alias(f"last_{kind}")
        for kind in by
    ))
    merged = hits.groupBy("fact", "item").agg(
        F.max("similarity").alias("similarity"), F.max(F.col("kind") == "own").alias("own")
    ).join(last, "fact")
    here = F.struct(-F.col("similarity"), F.col("item"))
    nearer = lambda end: -F.col("similarity") < F.col(end)["col1"]
    as_near = lambda end: -F.col("similarity") == F.col(end)["col1"]
    before_any = F.col("last_any").isNull() | nearer("last_any") | (
        as_near("last_any") & (F.col("own") | (here <= F.col("last_any"))))
    before_own = F.col("last_own").isNull() | nearer("last_own") | (
        as_near("last_own") & F.col("own") & (here <= F.col("last_own")))
    return merged.select(
        "fact", "item", "similarity", "own", (before_any & before_own).alias("known"),
        (F.col("last_any").isNull() & F.col("last_own").isNull()).alias("complete"),
    )


def _in_a_row(table: pa.Table) -> pa.Table:
    """The decisions of a component's next facts, up to one whose list has run out."""
    gone, decided = {}, []
    for row in sorted(table.to_pylist(), key=lambda r: r["seq"]):
        living = [
            (-item["similarity"], not item["own"], item["item"]) for item in row["items"] or ()
            if gone.get(item["item"], row["seq"]) >= row["seq"]
            and (item["until"] is None or item["until"] >= row["seq"])
        ]
        if not living and not row["complete"]:
            break
        far, other, item = min(living, default=(0.0, True, None))
        if not other:
            gone[item] = row["seq"]
        action = "insert" if item is None else "insert_corroborated" if other else "update"
        decided.append((row["fact"], row["seq"], None if other else item, action))
    columns = list(zip(*decided)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(
        ("fact", "seq", "target", "action"), columns, kinds)})


def _next_of_components(
    waiting: DataFrame, known: DataFrame, seen: DataFrame, gone: DataFrame, threshold: float
) -> DataFrame:
    """Decisions of waiting facts, each component of near facts and items by itself.

    Whatever may take an item of a fact's list is near the item, so it is in the
    fact's component, and the earlier ones of it come first.
    """
    own_lists = materialize(known.join(waiting.select("fact"), "fact", "left_semi"), "remember-lists")
    listed = seen.join(own_lists.select(F.col("item").alias("id")).distinct(), "id", "left_semi")
    nodes = materialize(
        waiting.select(F.col("fact").alias("id"), "part", "vec")
        .unionByName(listed.select("id", "part", "vec")).dropDuplicates(["id"]), "remember-nodes",
    )
    components = connected_components(match_edges(nodes, threshold))
    item = F.struct("item", "similarity", "own", "until")
    lists = own_lists.join(gone, "item", "left").groupBy("fact").agg(
        F.bool_and("complete").alias("complete"), F.collect_list(F.when(F.col("known"), item)).alias("items")
    )
    turn = F.row_number().over(Window.partitionBy("component").orderBy("seq"))
    following = (
        waiting.select("fact", "seq").join(components, F.col("fact") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "fact")).withColumn("turn", turn)
        .filter(F.col("turn") <= _IN_A_ROW).join(lists, "fact", "left")
        .select("component", "fact", "seq", F.coalesce("complete", F.lit(True)).alias("complete"), "items")
    )
    return following.groupBy("component").applyInArrow(
        _in_a_row, "fact string, seq long, target string, action string")


def remember_decisions(memory: DataFrame, facts: DataFrame, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """``fact, seq, target, action`` of each fact, in the order of ``seq`` within a project.

    ``facts`` carry ``fact, seq, part, created_by, vec``.  ``target`` is the item
    that an update moves: a fact's key, or ``1`` and the id of a stored row.
    Facts without a vector, or with one without a length, match nothing.
    """
    spark = facts.sparkSession
    path = fresh_path(spark, "remember-decided")
    usable = F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0) & F.col("part").isNotNull()
    placed = facts.withColumn("vec", F.col("vec").cast("array<double>")).filter(F.coalesce(usable, F.lit(False)))
    folded = materialize(_folded(placed, threshold), "remember-folded")
    placed = materialize(
        placed.select("fact", "seq", "part", "created_by", "vec").join(folded, "fact", "left_anti"), "remember-facts"
    )
    items = _stored_items(memory).unionByName(_fact_items(placed))

    def write(decided: DataFrame, number: int) -> None:
        decided.select("fact", "seq", "target", "action").write.parquet(f"{path}/round={number}")

    def decided_so_far() -> DataFrame:
        return spark.read.schema(_DECIDED).parquet(path)

    write(
        facts.select("fact", "seq").join(placed.select("fact"), "fact", "left_anti").join(folded, "fact", "left").select(
            "fact", "seq", F.col("first").alias("target"),
            F.when(F.col("first").isNull(), "insert").otherwise("update").alias("action"),
        ), 0,
    )
    gone = spark.createDataFrame([], "item string, until long")
    known = seen = None
    waiting, asking, number = placed, placed, 0
    while True:
        number += 1
        if asking is not None:
            # Where moved rows went is searched anew; all else is kept from the first search.
            living = items.join(gone.withColumnRenamed("item", "id"), "id", "left").withColumn(
                "until", F.coalesce("until", F.lit(_LAST)))
            found = materialize(_nearest_items(living, asking, threshold), "remember-nearest")
            old = [] if known is None else [known.join(asking.select("fact"), "fact", "left_anti")]
            known = materialize(found.unionByName(old[0]) if old else found, "remember-known")
            seen = materialize(
                items.join(known.select(F.col("item").alias("id")).distinct(), "id", "left_semi"), "remember-items"
            )
        best = (
            known.filter("known").join(gone, "item", "left")
            .join(waiting.select("fact", "seq"), "fact")
            .filter(F.col("until").isNull() | (F.col("until") >= F.col("seq")))
            .groupBy("fact").agg(F.min(F.struct(
                (-F.col("similarity")).alias("far"), (~F.col("own")).alias("other"), F.col("item").alias("item")
            )).alias("best"))
        )
        listed = known.groupBy("fact").agg(F.bool_and("complete").alias("complete"))
        judged = materialize(
            waiting.join(best, "fact", "left").join(listed, "fact", "left").select(
                *waiting.columns, F.col("best.item").alias("item"), (~F.col("best.other")).alias("own"),
                (F.col("best").isNull() & ~F.coalesce("complete", F.lit(True))).alias("asks"),
            ), "remember-judged",
        )
        # The first undecided fact that may yet take each item in question.
        in_question = seen.join(
            judged.filter(F.col("item").isNotNull()).select(F.col("item").alias("id")).distinct(), "id", "left_semi"
        ).select(
            F.col("id").alias("query_id"), _own_part().alias("part"), "vec",
            F.lit(float(threshold)).alias("threshold"), F.lit(1).alias("limit"), F.col("ord").alias("after"),
        )
        takers = waiting.select(F.col("fact").alias("id"), _own_part().alias("part"), "vec", F.col("seq").alias("ord"))
        taken = best_hits(takers, in_question, by_order=True).select(
            F.col("query_id").alias("item"), F.col("ord").alias("taker"))
        sure = (F.col("item").isNull() & ~F.col("asks")) | (
            F.col("item").isNotNull() & (F.col("taker").isNull() | (F.col("taker") >= F.col("seq"))))
        judged = materialize(judged.join(taken, "item", "left").withColumn("sure", sure), "remember-round")
        write(judged.filter("sure").select(
            "fact", "seq", F.when(F.col("own"), F.col("item")).alias("target"),
            F.when(F.col("item").isNull(), "insert").when(F.col("own"), "update")
            .otherwise("insert_corroborated").alias("action"),
        ), number)
        left = judged.agg(F.count_if(~F.col("sure")).alias("n"), F.count_if("asks").alias("asks")).first()
        if not left["n"]:
            return decided_so_far().drop("round")
        waiting = judged.filter("NOT sure").select(*placed.columns)
        # Folded copies keep their row, so only decisions of the rounds move one.
        moved = lambda: decided_so_far().filter((F.col("round") > 0) & (F.col("action") == "update")).select(
            F.col("target").alias("item"), F.col("seq").alias("until"))
        number += 1
        write(_next_of_components(waiting, known, seen, moved(), threshold), number)
        gone = moved()
        now = spark.read.schema(_DECIDED).parquet(f"{path}/round={number}").select("fact")
        waiting = materialize(waiting.join(now, "fact", "left_anti"), "remember-waiting")
        if waiting.isEmpty():
            return decided_so_far().drop("round")
        asks = judged.filter("asks").join(now, "fact", "left_anti").select(*placed.columns)
        asking = asks if left["asks"] else None


def _rows_of(decided: DataFrame, new_ids: DataFrame) -> DataFrame:
    """``fact, row``: the id of the row that each fact ends in.

    Updates point to the item they move; pointers are followed two at a time, so
    a chain of n updates takes the logarithm of n rounds.
    """
    state = materialize(
        decided.join(new_ids, "fact").select(
            "fact",
            F.when(F.col("action") != "update", F.col("new_id"))
            .when(F.startswith(F.col("target"), F.lit("1")), F.substring("target", 2, 1 << 30)).alias("row"),
            F.when((F.col("action") == "update") & F.startswith(F.col("target"), F.lit("0")), F.col("target")).alias("next"),
        ), "remember-rows",
    )
    while state.filter("row IS NULL").limit(1).count():
        ahead = state.select(F.col("fact").alias("next"), F.col("row").alias("_row"), F.col("next").alias("_next"))
        state = materialize(
            state.join(ahead, "next", "left").select(
                "fact", F.coalesce("row", "_row").alias("row"),
                F.when(F.col("row").isNull() & F.col("_row").isNull(), F.col("_next")).alias("next"),
            ), "remember-rows",
        )
    return state.select("fact", "row")


def remember_batch(
    memory: DataFrame,
    facts: DataFrame,
    as_of,
    embedder: Embedder | None = None,
    threshold: float = DEDUP_THRESHOLD,
    max_len: int = MAX_CONTENT_LENGTH,
):
    """(new memory, report) of storing facts of any authors and projects in order.

    Facts carry ``seq, project_id, created_by, content, tags, repo,
    importance`` (and ``embedding``, else they are embedded); ``seq`` names a
    fact of its project, and rows that repeat one are one fact.  Rows and report
    are those of storing each project's facts one by one in the order of ``seq``:
    an update replaces content and vector, and tags, repo and importance where
    given; a new row is pinned if it is critical, and tagged as corroborated if
    the nearest row was another author's.  Report: ``seq, id, action, reason``.
    """
    checked = facts.withColumn("seq", F.col("seq").cast("long")).withColumn(
        "reason", content_reason(F.col("content"), max_len))
    rejected = checked.filter(F.col("reason").isNotNull()).select(
        "seq", F.lit(None).cast("string").alias("id"), F.lit("reject").alias("action"), "reason"
    )
    valid = checked.filter(F.col("reason").isNull()).drop("reason")
    columns = ["project_id", "seq", "created_by", "content", "tags", "repo", "importance"]
    columns += ["embedding"] if "embedding" in valid.columns else []
    whole = F.struct(*columns)
    once = valid.groupBy("project_id", "seq").agg(
        F.min_by(whole, F.struct("created_by", "content", F.xxhash64(whole))).alias("one")
    ).select("one.*")
    batch = materialize(
        with_vectors(once, embedder).withColumn("fact", fact_key(F.col("project_id"), F.col("seq"))), "remember-batch"
    )
    decided = remember_decisions(
        memory,
        batch.select("fact", "seq", F.col("project_id").alias("part"), "created_by", F.col("embedding").alias("vec")),
        threshold,
    )
    new_ids = batch.select("fact", derived_id(
        F.col("project_id"), F.col("created_by"), F.col("seq").cast("string"), F.col("content"), F.lit(str(as_of)),
    ).alias("new_id"))
    rows = _rows_of(decided, new_ids)
    outcome = materialize(
        decided.select("fact", "action").join(rows, "fact").join(batch, "fact"), "remember-outcome"
    )
    new = F.col("action") != "update"
    corroborated = F.col("action") == "insert_corroborated"
    given = {
        "tags": F.when(corroborated, append_corroborated(F.col("tags")))
        .when(new, F.coalesce("tags", F.array().cast("array<string>"))).otherwise(F.col("tags")),
        "repo": F.col("repo"),
        "importance": F.when(new, F.coalesce("importance", F.lit("normal"))).otherwise(F.col("importance")),
    }
    # What each row holds in the end: the last text, and of the other fields the last given ones.
    state = materialize(
        outcome.withColumns(given).withColumn("born", F.when(new, F.col("seq"))).groupBy("row").agg(
            F.max_by("content", "seq").alias("new_content"), F.max_by("embedding", "seq").alias("new_embedding"),
            *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in given),
            F.max_by("project_id", "born").alias("new_project"), F.max_by("created_by", "born").alias("new_author"),
            F.max_by(F.col("importance"), "born").alias("first_importance"), F.max("born").alias("born"),
        ), "remember-state",
    )
    renewed = F.col("new_content").isNotNull()
    updated = memory.join(
        state.filter("born IS NULL").withColumnRenamed("row", "id"), "id", "left"
    ).withColumns({
        **{name: F.when(renewed, value).otherwise(F.col(name))
           for name, value in outdated_lexemes(memory).items()},
        **{c: F.coalesce(f"new_{c}", c) for c in ("content", "embedding", "tags", "repo", "importance")},
        "updated_at": F.when(renewed, moment(memory, as_of)).otherwise(F.col("updated_at")),
    }).select(*memory.columns)
    author = parse_agent_id(F.col("new_author"))
    inserted = state.filter("born IS NOT NULL").select(
        F.col("row").alias("id"), F.col("new_project").alias("project_id"), F.col("new_content").alias("content"),
        F.col("new_embedding").alias("embedding"), F.col("new_author").alias("created_by"),
        author["engineer"].alias("engineer"), author["agent_type"].alias("agent_type"),
        F.col("new_repo").alias("repo"), F.col("new_tags").alias("tags"),
        F.col("new_importance").alias("importance"), pin_on_critical(F.col("first_importance")).alias("pinned"),
    )
    report = outcome.select(
        "seq", F.col("row").alias("id"), "action", F.lit(None).cast("string").alias("reason")
    )
    return append_memories(updated, inserted, as_of), report.unionByName(rejected)
