"""Texts travel no more often than they must, and are stored small."""

import os

from pool import fact, table

from factlake.plans import facts
from factlake.sources import tables

SF = "/root/testdata/sf0.001"


def _shuffles_of(plan, name):
    """How many exchanges of a physical plan carry the column ``name``."""
    own = plan.nodeName().startswith("Exchange") and f"{name}#" in plan.output().mkString(",")
    children = plan.children()
    return int(own) + sum(_shuffles_of(children.apply(i), name) for i in range(children.size()))


def test_texts_of_facts_are_shuffled_once(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        plan = facts.memory(spark, SF)._jdf.queryExecution().executedPlan()
        assert _shuffles_of(plan, "text") == 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_stored_facts_are_compressed_with_zstd(spark, tmp_path):
    tables.write_snapshot(table(spark, [fact("a", [1, 0]), fact("b", None)]), str(tmp_path / "s"))
    files = [f for folder, _, found in os.walk(tmp_path) if "project_id=" in folder for f in found if f.startswith("part-")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
