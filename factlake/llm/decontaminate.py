"""Benchmark decontamination as a prefix-filtered set join on word windows.

Each benchmark item is cut in windows of ten words. A window can only occur
where its rarest word (counted over all documents) occurs, so the words of the
documents are joined with one necessary word per window; the word's place in
the window gives where the window would start, bounds on start and end drop
candidates that do not fit, and the candidates left are compared word by word
with the document. Only narrow rows are joined and shuffled until then.

The words of the benchmark are broadcast if their checked size is at most
MOST_BYTES; beyond that the joins shuffle.

Null texts have no words. Rows that repeat an id or text all keep their row.
A null ``doc_id`` keeps its row. Items with equal ids are one item; an item
with a null id hits words but is not listed. Empty tables give no hits.

Built-in functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import ascii_lower
from factlake.session import materialize

WINDOW = 10
# Words of the benchmark are broadcast up to this size.
MOST_BYTES = 32 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _pieces(lowered: Column) -> Column:
    """What lies between separators; the first and last may be empty."""
    return F.split(F.coalesce(lowered, F.lit("")), _BETWEEN, -1)


def _words(lowered: Column) -> Column:
    return F.filter(_pieces(lowered), lambda w: w != "")


def _sent(words: DataFrame) -> DataFrame:
    """Words to broadcast where their checked size allows; else the planner joins by shuffling."""
    size = words.agg(F.sum(F.octet_length("word") + 64).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(words) if size <= MOST_BYTES else words


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``window, words``, and ``window, item_id`` of their items."""
    words = benchmark.select(
        F.col("item_id").alias("item_id"), _words(ascii_lower(F.col("text").cast("string"))).alias("words")
    ).filter(F.size("words") > 0)
    cut = words.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))),
        lambda i: F.slice("words", i, F.lit(size)),
    )).alias("words"))
    named = cut.select(F.xxhash64("words").alias("window"), "words", "item_id")
    windows = materialize(named.select("window", "words").dropDuplicates(["window"]), "windows")
    items = materialize(named.select("window", "item_id").distinct(), "window-items")
    return windows, items


def row_key() -> Column:
    """What a row of documents is known by: equal rows have one key."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` in which no window of the benchmark occurs."""
    found = contamination(documents, benchmark, size, with_row=True)
    hit = materialize(found.filter("contaminated").select(F.col("row").alias("hit_row")).distinct(), "contaminated")
    return documents.join(hit, row_key() == hit["hit_row"], "left_anti")


def contamination(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, with_row: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document."""
    windows, items = benchmark_windows(benchmark, size)
    texts = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "row", row_key()
    )
    # A looser key than the exact lower-casing; what differs is found by the comparison. Each word is
    # lowered by itself, as those of windows are: a capital sigma's lower case depends on what is beside it.
    pieces = texts.select("row", F.split(F.coalesce("text", F.lit("")), _BETWEEN_ANY_CASE, -1).alias("pieces"))
    spots = windows.select("window", F.size("words").alias("size"), F.posexplode("words").alias("place", "word")).select(
        "window", "size", "place", F.lower("word").alias("word")
    )
    vocabulary = materialize(spots.select("word").distinct(), "benchmark-words")
    seen = materialize(
        pieces.select(F.explode("pieces").alias("word")).select(F.lower("word").alias("word"))
        .join(_sent(vocabulary), "word")
        .groupBy("word").agg(F.count(F.lit(1)).alias("seen")), "word-counts"
    )
    # Every word of a window that occurs was seen; a window with an unseen word has no candidates.
    rarest = spots.join(seen, "word", "left").groupBy("window", "size").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "place", "word")).alias("first")
    ).filter("first.seen > 0")
    prefix = materialize(
        rarest.join(windows, "window").select(
            "window", "size", F.col("first.place").alias("place"), F.col("first.word").alias("word"), "words"
        ), "window-prefixes"
    )
    starts_empty = F.when(F.element_at("pieces", 1) == "", 1).otherwise(0)
    ends_empty = F.when((F.element_at("pieces", -1) == "") & (F.size("pieces") > 1), 1).otherwise(0)
    counted = pieces.withColumn("lead", starts_empty).withColumn(
        "n", F.size("pieces") - F.col("lead") - ends_empty
    )
    # Only the words themselves meet all words of the documents; the windows join what is left.
    necessary = materialize(prefix.select("word").distinct(), "necessary-words")
    candidates = (
        counted.select("row", "lead", "n", F.posexplode("pieces").alias("at", "word"))
        .withColumn("word", F.lower("word")).join(_sent(necessary), "word", "left_semi")
        .join(prefix.select("window", "size", "place", "word"), "word")
        .withColumn("start", F.col("at") - F.col("lead") - F.col("place"))
        .filter("start >= 0 and start + size <= n")
        .select("row", "start", "window").distinct()
    )
    # Only as many candidates per document as it has words with a window's rarest one.
    per_row = materialize(
        candidates.join(prefix.select("window", "words"), "window")
        .groupBy("row").agg(F.collect_list(F.struct("start", "window", "words")).alias("candidates")),
        "candidates",
    )
    checked = texts.join(per_row, "row", "left").select(
        "doc_id", "row", "candidates", _pieces(ascii_lower(F.col("text"))).alias("pieces")
    ).withColumn("lead", starts_empty).withColumn("n_words", (F.size("pieces") - F.col("lead") - ends_empty))
    occurring = F.array_sort(F.filter("candidates", lambda c: F.slice(
        "pieces", c["start"] + F.col("lead") + 1, F.size(c["words"])
    ) == c["words"]))
    found = checked.select("doc_id", "row", "n_words", F.coalesce(F.transform(occurring, lambda c: F.struct(
        c["start"].alias("start"), (c["start"] + F.size(c["words"])).alias("end"), c["window"].alias("window")
    )), F.array().cast("array<struct<start:int,end:int,window:bigint>>")).alias("occurring"))
    found = materialize(found, "occurring")
    hit = F.aggregate(
        "occurring", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda done, o: F.struct(
            F.greatest(done["end"], o["end"]).alias("end"),
            (done["hit"] + F.greatest(o["end"] - F.greatest(o["start"], done["end"]), F.lit(0))).alias("hit"),
        ),
        lambda done: done["hit"].cast("long"),
    )
    listed = (
        found.filter(F.size("occurring") > 0)
        .select("row", F.explode(F.array_distinct("occurring.window")).alias("window")).distinct()
        .join(items, "window").groupBy("row")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return found.select("doc_id", "row", F.col("n_words").cast("long"), hit.alias("n_hit")).join(
        listed, "row", "left"
    ).select(
        *(["row"] if with_row else []), "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
