"""Shared working storage: what is kept, what is deleted, and by whom."""

import os
import threading
from types import SimpleNamespace

import pytest

from tessera import catalog, storage
from tessera.operators import graph


def tables(spark):
    folder = storage.shared_dir(spark).removeprefix("file://")
    return sorted(x for x in os.listdir(folder) if x.startswith("tessera-"))


def test_scratch_deletes_all_but_what_is_kept(spark):
    storage.release(spark)
    with storage.scratch(spark):
        storage.materialize(spark.range(3), "one")
        kept = storage.materialize(spark.range(4), "two", keep=True)
        assert len(tables(spark)) == 2
    assert kept.count() == 4 and [x.split("-")[1] for x in tables(spark)] == ["two"]
    storage.release(spark)
    assert tables(spark) == []


def test_threads_do_not_delete_each_others_tables(spark):
    inside, done = threading.Event(), threading.Event()
    counts = []

    def other():
        with storage.scratch(spark):
            df = storage.materialize(spark.range(5), "other")
            inside.set()
            done.wait(60)
            counts.append(df.count())

    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with storage.scratch(spark):
        storage.materialize(spark.range(6), "mine")
    done.set()
    t.join()
    assert counts == [5]
    storage.release(spark)
    assert tables(spark) == []


def test_a_graph_operator_leaves_its_result_only(spark):
    storage.release(spark)
    nodes, edges = spark.range(4).toDF("id"), spark.createDataFrame([(0, 1, 1.0, 0.5), (1, 2, 1.0, 0.4), (0, 2, 1.0, 0.3)], "a long, b long, weight double, distance double")
    for operator in (graph.pagerank, graph.eigenvector, graph.components, graph.core_numbers, graph.spanning_forest):
        assert operator(nodes, edges).count() > 0
        assert len(tables(spark)) == 1, operator.__name__
        storage.release(spark)


@pytest.mark.parametrize("name", ["avg_pct_rank", "global_rank", "resume_pending"])
def test_nothing_is_left_after_a_query_is_released(spark, sf, name):
    catalog.QUERIES[name](spark, sf).collect()
    storage.release(spark)
    assert tables(spark) == []


def test_a_cluster_without_a_shared_folder_is_an_error():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
