"""The metric index against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import metric


def clustered(seed, clusters, size, dims):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, 10, (clusters, 1, dims)) + rng.normal(0, 0.5, (clusters, size, dims))).reshape(-1, dims).astype(np.float32)


def frame(spark, vectors, extra=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + list(extra), "vec_id long, embedding array<float>")


def expected(vectors, queries, n):
    out = {}
    for i in queries:
        d = np.sqrt(((vectors.astype(np.float64) - vectors[i].astype(np.float64)) ** 2).sum(axis=1))
        out[i] = [(int(j), round(float(d[j]), 6)) for j in np.lexsort((np.arange(len(d)), d))[:n]]
    return out


def rows(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["id"], round(r["distance"], 6)))
    return out


@pytest.mark.parametrize(("clusters", "size", "copies"), [(40, 50, 0), (1, 700, 0), (6, 60, 300)])
def test_same_as_all_distances(spark, clusters, size, copies):
    v = clustered(clusters, clusters, size, 8)
    v = np.concatenate([v, np.repeat(v[:1], copies, axis=0)])  # copies of one vector
    df = frame(spark, v, [(10**6, None)]).cache()
    asked = df.where("vec_id % 3 = 0 OR vec_id = 1000000")
    want = expected(v, range(0, len(v), 3), 5)
    assert rows(metric.nearest(df, asked, 5, most=0)) == want
    assert rows(metric.nearest(df, asked, 5, most=10**6)) == want


def test_few_distances_on_clusters(spark):
    v = clustered(7, 100, 60, 8)
    df = frame(spark, v).cache()
    index = metric.Index(df, "vec_id", "embedding", 5, 200, shell=16)
    asked = df.where("vec_id % 4 = 0")
    met, everything = index.candidates(asked, "vec_id", "embedding").count(), len(v) * asked.count()
    assert met < everything / 50


def test_no_rows(spark):
    df = frame(spark, clustered(1, 2, 5, 3))
    assert metric.nearest(df.limit(0), df, 3, most=0).collect() == []
    assert metric.nearest(df, df.limit(0), 3).collect() == []
    few = metric.nearest(df.where("vec_id < 2"), df, 3, most=0)
    assert few.groupBy("query").agg(F.count("*").alias("n")).where("n <> 2").count() == 0
