"""Operator 7: exact top-k by inner product over vector-approximation files.

Vectors become integers, floor(256 x).  A block holds up to ``block`` vectors: for each dimension 16 cells between the
block's least and greatest value.  The approximation file has a row for each block, with the cell numbers packed two to a byte;
the exact integers stand in a file of their own for each block.  A search scans the cells for lower and upper bounds of every
score (one product with the cells' corners, and the cells' widths weighted by the query's signs), keeps vectors whose upper bound reaches
the kth best lower bound, and reads exact vectors by falling upper bound until the kth exact score is above the next
bound; ties are read on.  A block's exact file is opened only if some query keeps one of its vectors.

Blocks of queries meet stripes of vector blocks, and only cells and ids travel there, a sixteenth of the vectors or less; each
meeting yields at most k rows a query, and a window over those ranks them.  Vectors that are null, empty, or hold null or non-finite
components take no part.  Only vectors of a query's own length are its candidates.  A row is a candidate of every query of another
vec_id, and exact repeats of a row each take a rank; rows that share the query's vec_id are not its candidates.  A query vec_id is
answered once: by the best scores of all its different vectors.  A null vec_id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, open_fs, partitions, scratch

CELLS = 16
_SAFE = float(1 << 53)


def _integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of a batch, for each length."""
    ids, column = batch.column("vec_id"), batch.column("embedding")
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lens) - lens
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lens[lens > 0]):
        rows = np.flatnonzero((lens == dim) & known)
        x = values[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1)
        x = np.floor(256 * x[good])
        if x.size and np.abs(x).max() >= 2.0**62:
            raise ValueError("a component is too large for integer scores")
        yield ids[rows[good]], x.astype(np.int64)


def build_block(ids: np.ndarray, x: np.ndarray) -> tuple[dict, bytes]:
    """The packed cells of a block of rows, and its exact vectors."""
    low, high = x.min(0), x.max(0)
    width = np.maximum(1, -(-(high - low + 1) // CELLS))
    cells = ((x - low) // width).astype(np.uint8)
    if cells.shape[1] % 2:
        cells = np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], 1)
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low.min() and high.max() <= np.iinfo(t).max)
    row = {"dim": x.shape[1], "ids": ids.astype(np.int64).tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": (cells[:, ::2] << 4 | cells[:, 1::2]).tobytes(), "kind": kind}
    return row, x.astype(kind).tobytes()


class Best:
    """The k best (score, id) of one query: highest scores, then smallest ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores, ids) -> None:
        self.rows = sorted([*self.rows, *zip((-s for s in scores), ids)])[: self.k]

    @property
    def bar(self) -> float:
        return -self.rows[-1][0] if len(self.rows) == self.k else -np.inf


def search_block(block: dict, exact_of, ids: np.ndarray, queries: np.ndarray, best: list[Best], k: int, tile: int = 64) -> int:
    """Offer a block's vectors to each query; ``exact_of()`` reads the exact vectors.  Returns how many were scored."""
    dim = block["dim"]
    own = np.frombuffer(block["ids"], np.int64)
    low, width = np.frombuffer(block["low"], np.int64), np.frombuffer(block["width"], np.int64)
    packed = np.frombuffer(block["cells"], np.uint8).reshape(len(own), -1)
    cells = np.stack([packed >> 4, packed & 15], 2).reshape(len(own), -1)[:, :dim].astype(np.int64)
    below = low + cells * width
    largest = max(np.abs(below).max(initial=0), np.abs(below + width).max(initial=0)).astype(float) * np.abs(queries).max(initial=0) * dim
    exact, read = None, 0
    if largest >= _SAFE:  # bounds in floats would not be exact
        exact = exact_of().astype(object)
        for q, x, b in zip(ids.tolist(), queries.astype(object), best):
            rows = np.flatnonzero(own != q)
            b.add((exact[rows] @ x).tolist(), own[rows].tolist())
            read += len(rows)
        return read
    corner, span = below.astype(float).T, (width - 1).astype(float)
    for a in range(0, len(ids), tile):
        q = queries[a : a + tile].astype(float)
        at_corner = q @ corner
        upper, lower = at_corner + (np.maximum(q, 0) @ span)[:, None], at_corner + (np.minimum(q, 0) @ span)[:, None]
        mine = own[None, :] == ids[a : a + tile, None]
        upper[mine] = lower[mine] = -np.inf
        floor = np.partition(lower, lower.shape[1] - k, 1)[:, -k] if lower.shape[1] >= k else np.full(len(q), -np.inf)
        for i, b in enumerate(best[a : a + tile]):
            left = np.flatnonzero((upper[i] >= max(floor[i], b.bar)) & ~mine[i])
            left = left[np.argsort(-upper[i, left], kind="stable")]
            for at in range(0, len(left), 4 * k):
                some = left[at : at + 4 * k]
                some = some[upper[i, some] >= b.bar]
                if not len(some):
                    break
                if exact is None:
                    exact = exact_of().astype(float)
                b.add((exact[some] @ q[i]).astype(np.int64).tolist(), own[some].tolist())
                read += len(some)
    return read


_FIELDS = (("block", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "low", "width", "cells")), ("kind", pa.string()), ("file", pa.string()))
_BLOCK = "block long, dim int, ids binary, low binary, width binary, cells binary, kind string, file string"


def va_file(vectors: DataFrame, folder: str, block: int = 4096) -> DataFrame:
    """The approximation file, a row for each block; writes the exact files into ``folder``, named by task attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        n = task.partitionId() << 24
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for ids, x in _integers(batch):
                for a in range(0, len(ids), block):
                    row, exact = build_block(ids[a : a + block], x[a : a + block])
                    name = f"exact-{n}-{task.taskAttemptId()}.bin"
                    with fs.open_output_stream(f"{root}/{name}") as out:
                        out.write(exact)
                    yield pa.RecordBatch.from_pylist([{"block": n, "file": name} | row], pa.schema(_FIELDS))
                    n += 1

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, _BLOCK)


def _read_exact(folder: str, row: dict) -> np.ndarray:
    fs, root = open_fs(folder)
    with fs.open_input_file(f"{root}/{row['file']}") as f:
        return np.frombuffer(f.read(), row["kind"]).reshape(-1, row["dim"])


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = 4096, queries_in_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for each vec_id of ``vectors`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    folder = scratch(spark, "va-exact")
    blocks = materialize(va_file(vectors, folder, block), "va")
    asked = vectors.where(is_query)
    groups, stripes = max(1, -(-asked.count() // queries_in_block)), partitions(spark)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(questions: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        stored = found.sort_by([("block", "ascending")]).to_pylist()
        for batch in questions.combine_chunks().to_batches():
            for ids, x in _integers(batch):
                x = np.unique(np.concatenate([ids[:, None], x], 1), axis=0)
                ids, x = x[:, 0], x[:, 1:]
                best = [Best(k) for _ in ids]
                for row in stored:
                    if row["dim"] == x.shape[1]:
                        search_block(row, lambda row=row: _read_exact(folder, row), ids, x, best, k)
                for q, b in zip(ids.tolist(), best):
                    for s, v in b.rows:
                        out["query_id"].append(q), out["vec_id"].append(v), out["score"].append(-s)
        return pa.table(out, schema)

    q = asked.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    v = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qb"), F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"))
    near = q.groupBy("qb", "stripe").cogroup(v.groupBy("qb", "stripe")).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
