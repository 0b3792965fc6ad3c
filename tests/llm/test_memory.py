"""What bounds the memory of executors and driver: sizes of Arrow batches, numbers of rounds and queries."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeloom.llm import graph, packing, store, toxicity

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


@pytest.fixture
def written(monkeypatch):
    """The tables that components() writes, one after the other."""
    names = []
    monkeypatch.setattr(graph, "kept", lambda df, name: names.append(name) or store.kept(df, name))
    return names


@pytest.mark.parametrize("step", [1 << 18, 50])
def test_components_of_any_graphs(spark, monkeypatch, step):
    monkeypatch.setattr(graph, "STEP_EDGES", step)
    rng = np.random.default_rng(8)
    names = rng.integers(-(2**63), 2**63 - 1, 400)
    edges = [(int(names[a]), int(names[b])) for a, b in rng.integers(0, 400, (260, 2))] + [(int(names[0]), int(names[k])) for k in range(300, 340)]
    found = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.label for r in found} == plain_components(edges)
    assert graph.components(spark.createDataFrame([(4, 4)], "u long, v long")).count() == 0


def test_forest():
    rng = np.random.default_rng(9)
    for n, m in ((1, 0), (2, 1), (30, 10), (200, 150), (100, 900)):
        edges = rng.integers(-n, n, (m, 2))
        u, v = graph.forest(edges[:, 0], edges[:, 1])
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == plain_components(edges.tolist())
        assert len(u) == len(set(u.tolist())) <= m


def test_long_chains_take_few_rounds(spark, written):
    n = 3000
    order = np.random.default_rng(10).permutation(n).tolist()
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "u long, v long")
    found = graph.components(edges)
    assert found.filter("label = 0").count() == n - 1
    assert len(written) <= 5  # the edges, and two tables a round


@pytest.mark.parametrize("stage", ["toxic", "pack"])
def test_stages_of_the_pipeline_get_batches_of_few_bytes(spark, monkeypatch, stage, tmp_path):
    """Spark's own batches would hold all 3,000 rows, 12 MB."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), 4000, " word").alias("text")).coalesce(1)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "bytes"]) for b in batches)
    measure = lambda docs, *_: docs.select("doc_id", "text").mapInArrow(sizes, "n long, bytes long")
    monkeypatch.setattr(toxicity, "keep_clean", measure)
    monkeypatch.setattr(packing, "pack_documents", measure)
    try:
        found = getattr(corpus_pipeline, stage)(spark, docs, str(tmp_path)).collect()
    finally:
        spark.conf.unset(SETTING)
    assert sum(r.n for r in found) == 3000
    assert max(r.bytes for r in found) <= 5 << 20


def test_own_setting_of_batches_stays(spark):
    try:
        spark.conf.set(SETTING, "123456")
        store.small_batches(spark)
        assert spark.conf.get(SETTING) in ("123456", "123456b")
    finally:
        spark.conf.unset(SETTING)
