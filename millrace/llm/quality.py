"""Operator 8: document quality by hierarchical empirical Bayes over hosts and paths.

A document classifier (boosted trees over surface features, isotonic calibration, fitted on at most ``most`` labelled
rows) gives each text a probability of good quality.  Probabilities of all documents are summed by host and by path in one
grouped aggregation.  A host's rate is shrunk to the global one, a path's to its host's, each with a weight that the
spread of the rates themselves gives (method of moments), so sparse sites stay near their parent.  A document's odds
are its own times the ratio of its path's odds to the global ones, its own evidence taken out of its site first.

Null and empty texts have all features 0.  A null host or path is a site of its own.  Repeated labels of a doc_id count once, as
good if any is; null labels are left out; without both classes among labels every document has the rate of the labels
(0.5 without any).  An empty table gives no rows.  Scoring keeps every row and every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boost import Boosted, Isotonic, calibrated
from .chunks import chunk_keys, mixed
from .shared import byte_list, materialize, steps, tidy
from .toxicity import FOLDS, _fold, training_rows

_KINDS = [b"*", b"&", b"$", b"%", b"#", b"|", b"!", b"?", b"@<>{}[]\\^~`=_+", b".,;:", b"\n", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"\"'()-/"]
_KIND = np.full(256, len(_KINDS) + 1, np.uint8)  # the last kind: what else there is below 0x80
_KIND[0x80:] = len(_KINDS)
for _k, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _k
FEATURES = len(_KINDS) + 2 + 10
#: Bytes whose kinds are counted at once.
_SLICE = 1 << 20
#: Sites up to this many are sent to all executors; more are joined by shuffle.
MOST_SITES = 200_000


def surface_features(texts: list[bytes]) -> np.ndarray:
    """Character kinds, word lengths, and repetition of words and lines, for each text."""
    m, kinds = len(texts), len(_KINDS) + 2
    out = np.zeros((m, FEATURES))
    buf = b"\n".join(texts)
    data = np.frombuffer(buf, np.uint8)
    if not len(data):
        return out
    lens = np.fromiter(map(len, texts), np.int64, m)
    begins = np.cumsum(lens + 1) - lens - 1
    counts = np.zeros(m * kinds, np.int64)
    for a in range(0, len(data), _SLICE):
        part = data[a : a + _SLICE]
        i, j = np.searchsorted(begins, (a, a + len(part) - 1), "right") - 1
        of = np.repeat(np.arange(i, j + 1), np.diff(np.append(np.maximum(begins[i : j + 1], a), a + len(part))))
        counts += np.bincount(of * kinds + _KIND[part], minlength=m * kinds)
    out[:, :kinds] = counts.reshape(m, kinds) / np.maximum(lens, 1)[:, None]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return out
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    of = np.searchsorted(begins, starts, "right") - 1
    n = np.bincount(of, minlength=m).astype(float)
    some = np.maximum(n, 1)
    size = (ends - starts).astype(float)
    h = mixed(*chunk_keys(data, starts, ends))
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])])
    order = np.lexsort((h, of))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])
    loud = _KIND[data[ends - 1]] <= 8  # ends in a sign that isn't a stop
    mean = np.bincount(of, size, m) / some
    k = kinds
    out[:, k] = np.log1p(n)
    out[:, k + 1] = mean
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(of, size**2, m) / some - mean**2, 0))
    out[:, k + 3] = np.bincount(of[order], new, m) / some
    out[:, k + 4] = np.bincount(of, same, m) / some
    out[:, k + 5] = np.bincount(of, loud, m) / some
    out[:, k + 6] = np.bincount(of, size == 1, m) / some
    np.maximum.at(out[:, k + 7], of, size)
    line_from = np.unique(np.concatenate([begins[lens > 0], np.flatnonzero(data[:-1] == 10) + 1]))
    line_to = np.append(line_from[1:], len(data))
    lh = mixed(*chunk_keys(data, line_from, line_to))
    line_of = np.searchsorted(begins, line_from, "right") - 1
    order = np.lexsort((lh, line_of))
    again = np.concatenate([[False], (lh[order][1:] == lh[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])])
    out[:, k + 8] = np.bincount(line_of[order], again * (line_to - line_from)[order], m) / np.maximum(lens, 1)
    shouted = (_KIND[data[starts]] == 12) & (size > 1) & (_KIND[data[np.minimum(starts + 1, len(data) - 1)]] == 12)
    out[:, k + 9] = np.bincount(of, shouted, m) / some
    return out


class Model:
    def __init__(self, rate: float, trees: Boosted | None = None, curve: Isotonic | None = None):
        self.rate, self.trees, self.curve = min(max(rate, 1e-3), 1 - 1e-3), trees, curve

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        return np.clip(self.curve.apply(self.trees.margin(surface_features(texts))), 1e-4, 1 - 1e-4)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", most: int = 20_000) -> Model:
    rows = training_rows(docs, labels, label, allowed, most)
    schema = pa.schema([("doc", pa.int64()), ("y", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_list(batch.column("text"))
            for a, b in steps(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("y").slice(a, b - a).cast(pa.int64()), pa.array(surface_features(texts[a:b]).tolist(), schema[2].type)], schema=schema)

    got = rows.select("doc_id", "y", "text").mapInArrow(tidy(run), "doc long, y long, x array<double>").toArrow()  # features of at most ``most`` rows
    if not got.num_rows:
        return Model(0.5)
    order = np.argsort(got.column("doc").to_numpy(), kind="stable")
    y = got.column("y").to_numpy()[order].astype(float)
    if y.min() == y.max():
        return Model(y.mean())
    folds = np.array([_fold(d) for d in got.column("doc").to_numpy()[order].tolist()]) % FOLDS
    return Model(y.mean(), *calibrated(Boosted, np.array(got.column("x").to_pylist())[order], y, folds))


def with_evidence(docs: DataFrame, model: Model, column: str = "evidence") -> DataFrame:
    """The documents with the classifier's probability, which replaces a column of its name; other columns are kept."""
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_list(batch.column("text"))
            found = [model.evidence(texts[a:b]) for a, b in steps(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))], names=[*batch.schema.names, column])

    return docs.mapInArrow(tidy(run), schema)


def _weight(rates: DataFrame, rate: str, n: str, parent) -> float:
    """Pseudo-documents of the parent's rate that a site's own count is set against: from the spread of rates beyond chance."""
    r = rates.agg(
        F.count("*").alias("sites"), F.avg((F.col(rate) - parent) ** 2).alias("spread"), F.avg(parent * (1 - parent) / F.col(n)).alias("chance"), F.avg(parent * (1 - parent)).alias("one")
    ).first()
    if not r.sites or r.one is None:
        return 10.0
    return min(max(r.one / max(r.spread - r.chance, 1e-6), 10.0), 10_000.0)


def sites(evidence: DataFrame, model: Model) -> DataFrame:
    """host, path, n and sum of a path's documents, and host_rate, the host's shrunken rate; from (host, path, evidence) rows."""
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("sum")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("sum").alias("host_sum"))
    total = paths.agg(F.sum("n"), F.sum("sum")).first()
    rate = total[1] / total[0] if total[0] else model.rate
    a = _weight(hosts.select((F.col("host_sum") / F.col("host_n")).alias("rate"), "host_n"), "rate", "host_n", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_sum") + a * rate) / (F.col("host_n") + a))
    hosts = hosts.withColumnRenamed("host", "of_host")
    known = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"), "sites")
    b = _weight(known.select((F.col("sum") / F.col("n")).alias("rate"), "n", "host_rate"), "rate", "n", F.col("host_rate"))
    return known.withColumns({"rate": F.lit(rate), "host_weight": F.lit(a), "path_weight": F.lit(b)})


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def with_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, allowed: Column | None = None, most: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """The documents with evidence, host_rate, path_rate and quality_score (0 to 1), which replace columns of these names; other columns are kept,
    or those of ``keep``.  Evidence is computed once and written with what is kept."""
    model = fit(docs, labels, F.lit(True) if allowed is None else allowed, most=most)
    names = [c for c in docs.columns if keep is None or c in keep]
    own = docs.withColumns({"__own_host": host.cast("string"), "__own_path": path.cast("string")})
    scored = materialize(with_evidence(own, model, "__evidence").select(*names, "__own_host", "__own_path", "__evidence"), "evidence")
    narrow = scored.select(F.col("__own_host").alias("host"), F.col("__own_path").alias("path"), F.col("__evidence").alias("evidence"))
    known = sites(narrow, model)
    known = known.select(*[F.col(c).alias(f"__{c}") for c in known.columns])  # no name of the documents' own columns
    if known.count() <= MOST_SITES:
        known = F.broadcast(known)
    e = F.col("__evidence")
    joined = scored.join(known, F.col("__own_host").eqNullSafe(F.col("__host")) & F.col("__own_path").eqNullSafe(F.col("__path")), "left")
    host_rate = (F.col("__host_sum") - e + F.col("__host_weight") * F.col("__rate")) / (F.col("__host_n") - 1 + F.col("__host_weight"))
    path_rate = (F.col("__sum") - e + F.col("__path_weight") * host_rate) / (F.col("__n") - 1 + F.col("__path_weight"))
    odds = _logit(e) + _logit(path_rate) - _logit(F.col("__rate"))
    new = {"evidence": e, "host_rate": host_rate, "path_rate": path_rate, "quality_score": 1 / (1 + F.exp(-odds))}
    return joined.select(*[F.col(c) for c in names if c not in new], *[v.alias(k) for k, v in new.items()])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, quality_score, keep.  Host: source; path: source and language."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    scored = with_quality(own, labels, F.col("source"), F.col("lang"), most=most, keep=["doc_id"])
    return scored.select("doc_id", "evidence", "host_rate", "path_rate", "quality_score", (F.col("quality_score") >= threshold).cast("int").alias("keep"))
