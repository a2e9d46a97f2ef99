"""Text search through words, stems and tags against plain Python."""

import random
import re

import pytest
from pool import fact, table
from pyspark.sql import functions as F

from factlake.functions import dictionary as D
from factlake.functions.stemmer import stem
from factlake.functions.text import STOP_WORDS_ENGLISH
from factlake.operators import textindex

WORDS = ("run runs running runner connect connected connection connections the of and house houses "
         "housing generous general Étude 中文 x1 stopping stop").split()
ASKED = "query_id long, project_id string, question string, tags array<string>, include_archived boolean, agent string"


def plain(text, config):
    words = set(re.findall(r"[^\W_]+", text.lower()))
    return words if config == "simple" else {stem(w) for w in words - set(STOP_WORDS_ENGLISH)}


def cases(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    facts = [fact(f"f{i:03}", content=text(rng.randrange(1, 9)) if i % 30 else "...", project="pq"[i % 2],
                  archived=i % 7 == 0, tags=rng.sample(["a", "b", "the"], rng.randrange(3)),
                  author=["alice/coder", "bob/coder"][i % 3 == 0]) for i in range(160)]
    asked = [(i, "pq"[i % 2], text(rng.randrange(1, 4)) if i % 10 else ["", "the of", "unseen word", "connecting"][i // 10],
              [None, [], ["a"], ["a", "the"]][i % 4], i % 3 == 0, [None, "bob/coder"][i % 5 == 0]) for i in range(40)]
    return facts, asked


def wanted(facts, asked, config, tags=False, scope=False):
    out = set()
    for q, project, question, named, archived, agent in asked:
        terms = plain(question, config)
        for f in facts:
            if f[1] != project or not terms or not terms <= plain(f[2], config):
                continue
            if (tags or scope) and not set(named or ()) <= set(f[8]):
                continue
            if scope and ((f[11] and not archived) or (agent and f[4] != agent)):
                continue
            out.add((q, f[0]))
    return out


@pytest.mark.parametrize("config", ["simple", "english"])
@pytest.mark.parametrize("tags", [False, True])
def test_index(spark, tmp_path, config, tags):
    facts, asked = cases()
    textindex.write_text_index(table(spark, facts), str(tmp_path / "index"), block=8)
    index = textindex.read_text_index(spark, str(tmp_path / "index"))
    assert index[1].agg(F.max("n")).first()[0] <= 8
    assert index[1].filter("n <> size(ids) OR first_id <> ids[0] OR last_id <> ids[n - 1] OR ids <> sort_array(ids)").count() == 0
    got = textindex.text_search(index, spark.createDataFrame(asked, ASKED), config, tags=tags)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted(facts, asked, config, tags)


@pytest.mark.parametrize("config", ["simple", "english"])
@pytest.mark.parametrize("stored", [False, True])
def test_without_index(spark, config, stored):
    facts, asked = cases(2)
    memory = table(spark, facts)
    memory = textindex.refresh_tsv(memory, config) if stored else memory
    got = textindex.text_candidates(memory, spark.createDataFrame(asked, ASKED), config)
    assert {tuple(r) for r in got.collect()} == wanted(facts, asked, config, scope=True)
    assert textindex.text_candidates(memory.limit(0), spark.createDataFrame(asked, ASKED), config).count() == 0


def test_dictionary_grows_by_new_words_only(spark, tmp_path):
    path = str(tmp_path / "stems")
    first = spark.createDataFrame([(1, "Running the houses"), (2, None), (3, "")], "id long, text string")
    assert {tuple(r) for r in D.grow_dictionary(first, "text", path).collect()} == {("running", "run"), ("houses", "hous")}
    more = first.union(spark.createDataFrame([(4, "running runs")], first.schema))
    grown = D.grow_dictionary(more, "text", path)
    assert sorted(r.word for r in grown.collect()) == ["houses", "running", "runs"]
    assert D.grow_dictionary(more, "text", path).count() == 3
    found = {r.id: r.lexemes for r in D.stem_lexemes(more, "id", "text", grown).collect()}
    assert found == {1: ["hous", "run"], 2: None, 3: [], 4: ["run"]}


def test_stored_dictionary_serves_search(spark, tmp_path):
    facts, asked = cases(3)
    memory = table(spark, facts)
    stems = D.grow_dictionary(memory, "content", str(tmp_path / "stems"))
    got = textindex.text_candidates(memory, spark.createDataFrame(asked, ASKED), "english", stems)
    assert {tuple(r) for r in got.collect()} == wanted(facts, asked, "english", scope=True)
