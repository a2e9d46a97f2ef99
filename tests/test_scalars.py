import pytest
from pyspark.sql import functions as F

from factlake.functions import scalars as S
from factlake.functions import vectors as V
from factlake.functions.embed import HashedWords, embed_column, split_blank
from factlake.functions.stemmer import stem
from factlake.functions.text import STOP_WORDS_ENGLISH, lexemes


def values(spark, rows, schema, column):
    frame = spark.createDataFrame(rows, schema)
    return [r[0] for r in frame.select(column).collect()]


@pytest.mark.parametrize("agent, expected", [
    ("alice/code-reviewer", ("alice/code-reviewer", "alice", "code-reviewer", None)),
    ("auto/ci-fixer", ("auto/ci-fixer", None, "ci-fixer", None)),
    ("  bob/debugger\n", ("bob/debugger", "bob", "debugger", None)),
    ("", (None, None, None, "EMPTY")),
    ("   ", (None, None, None, "EMPTY")),
    (None, (None, None, None, "EMPTY")),
    ("alice", (None, None, None, "NO_SEPARATOR")),
    ("/reviewer", (None, None, None, "EMPTY_PREFIX")),
    ("alice/", (None, None, None, "EMPTY_SUFFIX")),
    ("alice/team/reviewer", (None, None, None, "EXTRA_SEPARATOR")),
    ("alice//", (None, None, None, "EXTRA_SEPARATOR")),
])
def test_parse_agent_id(spark, agent, expected):
    frame = spark.createDataFrame([(agent,)], "a string")
    assert tuple(frame.select(S.parse_agent_id(F.col("a")).alias("p")).first().p) == expected


@pytest.mark.parametrize("seconds, ago, age", [
    (-5, "just now", "<1m"), (0, "just now", "<1m"), (59, "just now", "<1m"),
    (60, "1m ago", "1m"), (3599, "59m ago", "59m"), (3600, "1h ago", "1h"),
    (86399, "23h ago", "23h"), (86400, "1d ago", "1d"), (400 * 86400, "400d ago", "400d"),
])
def test_ages(spark, seconds, ago, age):
    now = F.lit("2025-06-01 12:00:00").cast("timestamp")
    then = (now.cast("long") - seconds).cast("timestamp")
    row = spark.range(1).select(S.relative_time(then, now).alias("r"), S.age(then, now).alias("a")).first()
    assert (row.r, row.a) == (ago, age)


def test_texts(spark):
    rows = [("short",), ("a\nb",), ("x" * 41,), ("y" * 40,)]
    assert values(spark, rows, "t string", S.truncate_text(F.col("t"), 40)) == [
        "short", "a b", "x" * 37 + "...", "y" * 40]
    assert values(spark, [("a\U0001F600b",), ("abc",), ("",)], "t string",
                  S.utf16_length(F.col("t"))) == [4, 3, 0]
    assert values(spark, [(0.125,), (0.874999,), (1.0,), (0.5,)], "t double",
                  S.format_score(F.col("t"))) == ["0.13", "0.87", "1.00", "0.50"]


def test_tags(spark):
    rows = [(" a, b ,,c ",), (" , ",), ("",), (None,)]
    assert values(spark, rows, "t string", S.parse_tags(F.col("t"))) == [["a", "b", "c"], None, None, None]
    rows = [(["arch", "security"],), ([],)]
    assert values(spark, rows, "t array<string>", S.format_tags(F.col("t"))) == ["[arch, security]", ""]
    rows = [(None,), (["corroborated"],)]
    assert values(spark, rows, "t array<string>", S.append_corroborated(F.col("t"))) == [
        ["corroborated"], ["corroborated", "corroborated"]]
    wanted = F.array(F.lit("a"), F.lit("b"))
    rows = [(["b", "c", "a"],), (["a"],), (None,)]
    kept = spark.createDataFrame(rows, "t array<string>").filter(S.contains_all(F.col("t"), wanted))
    assert kept.count() == 1


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in frame.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [
        1.0, 0.0, None, None]
    assert [r[0] for r in frame.select(V.l2_normalize(F.col("b"))).collect()][1] == [0.0, 1.0]
    assert values(spark, [("[0.5,2]",)], "t string", V.parse_vector(F.col("t"))) == [[0.5, 2.0]]


@pytest.mark.parametrize("word, expected", [
    ("consigned", "consign"), ("consistency", "consist"), ("running", "run"), ("hopping", "hop"),
    ("hoping", "hope"), ("skies", "sky"), ("dying", "die"), ("flies", "fli"), ("ties", "tie"),
    ("agreed", "agre"), ("relational", "relat"), ("national", "nation"), ("kindness", "kind"),
    ("happily", "happili"), ("generically", "generic"), ("cry", "cri"), ("say", "say"), ("by", "by"),
    ("databases", "databas"), ("caresses", "caress"), ("gas", "gas"), ("this", "this"),
    ("knightly", "knight"), ("succeeding", "succeed"), ("bed", "bed"), ("controlling", "control"),
    ("größe", "größe"), ("x1", "x1"),
])
def test_stem(word, expected):
    assert stem(word) == expected


def test_lexemes(spark):
    text = "The Services are running; the SERVICE ran, größer 42!"
    simple, english = (
        values(spark, [(text,)], "t string", lexemes(F.col("t"), config))[0]
        for config in ("simple", "english")
    )
    assert simple == ["the", "services", "are", "running", "service", "ran", "größer", "42"]
    assert english == ["servic", "run", "ran", "größer", "42"]
    assert len(STOP_WORDS_ENGLISH) == len(set(STOP_WORDS_ENGLISH)) == 127


def test_embedding(spark):
    frame = spark.createDataFrame([(i, f"fact number {i}") for i in range(250)], "id long, t string")
    vectors = {r.id: r.embedding for r in embed_column(frame, "t", HashedWords(16)).collect()}
    assert len(vectors) == 250
    one = HashedWords(16).embed(["fact number 77"])[0]
    assert vectors[77] == pytest.approx(list(one), abs=1e-6)
    blank = spark.createDataFrame([(1, " "), (2, "x")], "id long, t string")
    usable, refused = split_blank(blank, "t")
    assert [r.id for r in usable.collect()] == [2] and [r.id for r in refused.collect()] == [1]
    with pytest.raises(Exception, match="empty text"):
        embed_column(blank, "t").collect()
