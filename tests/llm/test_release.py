"""Heaps that earlier steps have filled are given back between the steps of the pipeline."""

import pytest

import corpus_pipeline
from marlstone.llm import common


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(beans.get(i).getCollectionCount() for i in range(beans.size()) if "Old" in beans.get(i).getName() or "MarkSweep" in beans.get(i).getName())


def test_each_task_collects(spark):
    before = full_collections(spark)
    n = common.collect_in_tasks(spark)
    assert n == spark.sparkContext.defaultParallelism and full_collections(spark) - before >= 1


@pytest.mark.parametrize(("master", "times"), [("local", 0), ("local[4]", 0), ("local-cluster[3,2,3000]", 1), ("spark://host:7077", 1), ("yarn", 1)])
def test_only_executors_of_their_own_collect(monkeypatch, master, times):
    class Session:
        class sparkContext:  # noqa: N801
            pass

    Session.sparkContext.master = master
    asked = []
    monkeypatch.setattr(common, "collect_in_tasks", asked.append)
    common.release_executors(Session)
    assert len(asked) == times


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_every_stage_begins_with_it(monkeypatch, k):
    class Begun(Exception):
        pass

    def begun(spark):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "release_executors", begun)
    with pytest.raises(Begun):
        corpus_pipeline.STAGES[k][1](None, None, "")
