"""Models of the idle-duration and state experiments: Spark's learners, and small kernels on bounded samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(rows: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="skip").transform(rows)


def balanced_weights(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights n / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    totals = counts.agg(F.sum("__n").alias("__t"), F.count("*").alias("__c"))
    return rows.join(F.broadcast(counts.crossJoin(totals)), label).withColumn(name, F.col("__t") / (F.col("__c") * F.col("__n"))).drop("__n", "__t", "__c")  # a row a class


def regressors(seed: int = 0, trees: int = 300) -> dict:
    return {
        "random_forest": RandomForestRegressor(numTrees=trees, maxDepth=8, seed=seed, labelCol="label"),
        "boosted_trees": GBTRegressor(maxIter=trees, maxDepth=5, stepSize=0.05, seed=seed, labelCol="label"),
    }


def classifiers(seed: int = 0, trees: int = 300) -> dict:
    return {
        "logistic": LogisticRegression(maxIter=200, weightCol="weight", labelCol="label"),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, weightCol="weight", labelCol="label"),
    }


def clusters(rows: DataFrame, features: list[str], k: int, seed: int = 0) -> DataFrame:
    """``cluster`` of each row: k-means over standardised features."""
    stages = [VectorAssembler(inputCols=features, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("__raw", "__x")


def scaled(train: DataFrame, rows: DataFrame, features: list[str], low: float = 0.0, high: float = math.pi) -> DataFrame:
    """``scaled``, an array: features between ``low`` and ``high`` as the training rows lie."""
    scaler = MinMaxScaler(min=low, max=high, inputCol="__raw", outputCol="__s").fit(assembled(train, features, "__raw"))
    return scaler.transform(assembled(rows, features, "__raw")).withColumn("scaled", vector_to_array("__s")).drop("__raw", "__s")


def zz_state(x: np.ndarray, repeats: int = 2) -> np.ndarray:
    """State vectors of the ZZ feature map with linear entanglement: rows of ``x``, one qubit a column (least significant first)."""
    m, q = x.shape
    bits = (np.arange(1 << q)[:, None] >> np.arange(q)) & 1
    state = np.zeros((m, 1 << q), np.complex128)
    state[:, 0] = 1
    phase = 2 * x @ bits.T.astype(float)
    for a in range(q - 1):
        phase += 2 * np.outer((np.pi - x[:, a]) * (np.pi - x[:, a + 1]), bits[:, a] ^ bits[:, a + 1])
    for _ in range(repeats):
        for a in range(q):
            s = state.reshape(m, 1 << (q - a - 1), 2, 1 << a)
            state = np.stack([s[:, :, 0] + s[:, :, 1], s[:, :, 0] - s[:, :, 1]], 2).reshape(m, -1) / np.sqrt(2)
        state = state * np.exp(1j * phase)
    return state


def fidelity_gram(sample: DataFrame, identity: str, column: str = "scaled", most: int = 2000) -> DataFrame:
    """(i, j, k): squared overlap of the encoded states of each pair of a sample of ``most`` rows at most."""
    rows = sample.select(F.col(identity).cast("long").alias("i"), F.col(column).alias("x")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a kernel is for samples of {most} rows at most")
    ids = np.array([r.i for r in rows], np.int64)
    states = zz_state(np.array([r.x for r in rows], float)) if rows else np.zeros((0, 1), complex)
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("k", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column("r").to_pylist():
                k = np.abs(states @ states[r].conj()) ** 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), ids[r])), pa.array(ids), pa.array(k)], schema=schema)

    return sample.sparkSession.range(len(ids)).select(F.col("id").alias("r")).mapInArrow(run, "i long, j long, k double")


def kernel_kmeans(gram: np.ndarray, k: int, seed: int = 0, starts: int = 10, most: int = 100) -> np.ndarray:
    """Labels of the best of several runs of k-means in the kernel's feature space; an emptied cluster takes the farthest point."""
    rng, n = np.random.default_rng(seed), len(gram)
    best, found = np.inf, np.zeros(n, int)
    for _ in range(starts):
        label = rng.integers(0, k, n)
        for _ in range(most):
            d = np.empty((n, k))
            for c in range(k):
                own = label == c
                d[:, c] = np.diag(gram) - 2 * gram[:, own].mean(1) + gram[np.ix_(own, own)].mean() if own.any() else np.inf
            new = d.argmin(1)
            for c in set(range(k)) - set(new.tolist()):
                new[d[np.arange(n), new].argmax()] = c
            if (new == label).all():
                break
            label = new
        cost = d[np.arange(n), label].sum()
        if cost < best:
            best, found = cost, label
    return found


def kernel_ridge(gram: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Dual weights of kernel ridge regression, our stand-in for a kernel support-vector regressor on small samples."""
    return np.linalg.solve(gram + ridge * np.eye(len(gram)), y)


def select_ridge(train: np.ndarray, y: np.ndarray, held: np.ndarray, y_held: np.ndarray, grid: tuple[float, ...] = (0.05, 0.1, 0.5, 1.0, 2.0)) -> tuple[float, np.ndarray]:
    """The ridge of least mean absolute error on validation rows (``held``: their kernel against training rows)."""
    fits = [(float(np.abs(held @ kernel_ridge(train, y, r) - y_held).mean()), r) for r in grid]
    r = min(fits)[1]
    return r, kernel_ridge(train, y, r)
