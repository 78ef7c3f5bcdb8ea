"""Streaming forms, kernels, and every catalogue query against its SQL on the smallest tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.operators import ml, states
from millrace.plans import catalogue
from millrace.streaming import live

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.7g}" if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio") else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_catalogue(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    at = [want.columns.index(c) for c in sorted(want.columns)]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams(spark, tmp_path):
    rows = [(1, 10, 1000, True, "idle"), (2, 10, 1500, False, None), (3, 10, 2000, True, "a"), (4, 10, 2000, True, "b"), (5, 10, 2500, False, None), (6, 20, 1, False, None)]
    schema = "id long, station_id long, ts long, is_state boolean, state string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = live.asof_stream(source, "station_id", "ts", "is_state", "state", "id")
    q = out.writeStream.format("memory").queryName("asof_out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.matched_state, r.matched_ts, r.join_ambiguous) for r in spark.sql("select * from asof_out").collect()} == {(2, "idle", 1000, False), (5, None, None, True), (6, None, None, False)}
    wide = spark.range(4).selectExpr("timestamp_seconds(id * 3) at", "10L station_id", "cast(id as double) w", *[f"id % 2 = 0 {b}" for b in states.BITS])
    assert live.windowed_power(wide, "at", "station_id", "w").count() == 2 and live.classified(wide).where("plc_state = 'processing'").count() == 2


def test_kernel(spark):
    x = np.random.default_rng(0).uniform(0, math.pi, (12, 3))
    state = ml.zz_state(x)
    assert np.allclose((np.abs(state) ** 2).sum(1), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, scaled array<double>")
    k = {(r.i, r.j): r.k for r in ml.fidelity_gram(df, "i").collect()}
    assert len(k) == 144 and all(abs(k[i, j] - abs(np.vdot(state[i], state[j])) ** 2) < 1e-9 for i, j in k)
    with pytest.raises(ValueError):
        ml.fidelity_gram(df, "i", most=5)


def test_kernel_kmeans_and_ridge():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(3, 0.1, (20, 2))])
    gram = np.exp(-((x[:, None] - x[None]) ** 2).sum(2))
    label = ml.kernel_kmeans(gram, 2)
    assert len(set(label[:20])) == len(set(label[20:])) == 1 and label[0] != label[20]
    y = x.sum(1)
    ridge, weights = ml.select_ridge(gram[::2, ::2], y[::2], gram[1::2, ::2], y[1::2])
    assert np.abs(gram[1::2, ::2] @ weights - y[1::2]).mean() < 0.3 and ridge > 0


def test_learners(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 10 >= 5).cast("double").alias("label"))
    x = ml.balanced_weights(ml.assembled(df, ["a", "b"]), "label").cache()
    for learner in ml.classifiers(1, trees=5).values():
        assert learner.fit(x).transform(x).where("prediction <> label").count() < 10
