"""Held-out recall of the toxicity model on the test tables, the forest's vote against its trees, clashing names of searches and pages."""

import os

import pytest
from pyspark.sql import functions as F

from treeloom.llm import html_text, queries, secrets, topk, toxicity


@pytest.mark.parametrize(("folder", "recall", "alarms"), [("sf0.01", 0.6, 0.04), ("sf0.1", 0.9, 0.03)])
def test_toxicity_recall_of_held_out_documents(spark, folder, recall, alarms):
    """sf0.01 has 37 toxic documents to learn from; in German and French their words share stems with as many clean ones (3 against 3), so five of 14 are missed."""
    path = f"/root/testdata/{folder}"
    if not os.path.isdir(path):
        pytest.skip("the test tables are not there")
    labels = spark.read.parquet(f"{path}/labels.parquet").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = queries.op2_toxicity(spark, path).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    share = {r.toxic: r.p for r in rows}
    print(folder, {r.toxic: (r.n, round(r.p, 3)) for r in rows})
    assert share[1] >= recall and share[0] <= alarms


def test_vote_is_what_the_trees_say(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = secrets.labelled_findings(spark, 1500)
    forest = secrets.train(found, trees=7, depth=6)
    rows = found.select("label", secrets.describe(F.col("value"), F.col("before"), F.col("after")).alias("f")).select("label", "f", secrets.vote(forest, F.col("f")).alias("vote"))
    got = rows.collect()

    def leaf(node, f):
        while not isinstance(node, int):
            k, at, low, high = node
            node = low if f[secrets.FEATURES[k]] <= at else high
        return node

    assert len(got) == 1500
    assert all(abs(r.vote - sum(leaf(t, r.f) for t in forest) / 7) < 1e-12 for r in got)
    flat = VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(found.coalesce(1).select(F.col("label").cast("double").alias("label"), secrets.describe(F.col("value"), F.col("before"), F.col("after")).alias("f")).select("label", "f.*"))
    model = RandomForestClassifier(numTrees=7, maxDepth=6, seed=11, maxBins=64).fit(flat.select("label", "features"))
    both = model.transform(flat).select("prediction", secrets.vote(forest, F.struct(*secrets.FEATURES)).alias("vote")).collect()
    assert sum((r.vote > 0.5) == (r.prediction > 0.5) for r in both) >= 0.98 * len(both)


def test_clashing_names_of_searches_and_pages(spark):
    rows = [(i, [float(i % 7), 1.0], "a", "b", "c", "d", 1) for i in range(40)] + [(None, [1.0, 1.0], "a", "b", "c", "d", 1), (0, [0.0, 1.0], "x", "b", "c", "d", 2), (50, None, "a", "b", "c", "d", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v string, query_id string, score string, _row int")
    found = topk.search(df, F.col("vec_id") % 20 == 0, 3)
    plain = topk.search(df.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() == 9  # id 0 is there twice
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0
    assert topk.search(df, F.lit(False), 3).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>a", "t", 3, "k"), (None, None, None, "t", 4, "k"), (1, "u", "<p>a", "t", 3, "k")], "page_id long, url string, html string, text string, n_chars int, tag string")
    assert sorted(map(tuple, html_text.extract(pages).select("url", "text", "n_chars").collect()), key=repr) == sorted([("u", "a", 1), ("u", "a", 1), (None, "", 0)], key=repr)
