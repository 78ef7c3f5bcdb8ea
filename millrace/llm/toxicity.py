"""Operator 3: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed list of insults (plain, and after undoing common disguises), densities of a
learned lexicon (words and word beginnings that training rows show to be typical of the label), nearness of a
second-person word to a hit, rates of capitals, punctuation, exclamation, digits and disguised words.  Features of
distinct words are computed once a worker (a bounded table) and joined back by position.

Learning sees only labelled rows that the caller marks as training rows, at most ``most`` of them (a documented bound:
those with the smallest hash of doc_id), in three folds: a row's lexicon features come from the other folds' lexicon, so the trees
see them as they are on new texts.  The lexicon has at most ``entries`` items.  Only counts, features and the
model reach the driver.  labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have all features 0 and a score like others.  Repeated labels of a doc_id count once, as toxic if
any is; null labels and labels without a document are left out.  Without both classes among training rows the score
is that of the fixed list alone.  Scoring keeps every row and every column.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boost import Boosted, Isotonic, calibrated
from .chunks import ChunkTable
from .shared import byte_list, kept_by, materialize, steps, tidy

#: Common insults.
INSULTS = frozenset("asshole bastard bitch clown coward creep cretin dimwit disgusting dumb dumbass dummy filth fool freak garbage idiot idiotic imbecile jerk loser lunatic maggot moron moronic nitwit parasite pathetic pig scum shithead slob slut stupid swine trash ugly useless vermin whore worthless".split())
#: Second-person words of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch ihr tu toi te ton ta tes vous votre vos ti tú usted ustedes vosotros tus".split())
#: Characters that stand in for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
FOLDS = 3
STARTS = (4, 5, 6, 7)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_REPEAT = re.compile(r"(.)\1{2,}")


def bare(word: str) -> str:
    return _EDGE.sub("", word).lower()


def undisguised(word: str) -> str:
    """The word with stand-in characters, inner marks and stretched letters undone."""
    return _REPEAT.sub(r"\1", _INNER.sub("", word.translate(DISGUISE))).lower()


def items(word: str) -> list[str]:
    """What the lexicon counts of a bare word: itself and its beginnings."""
    return ["=" + word, *(word[:k] for k in STARTS if len(word) > k)] if word else []


#: Columns of a word's features.
INSULT, HIDDEN, WORD, START, YOU, CAPS, UPPER, LETTERS, MARKS, CRIES, ASKS, MASKED, DIGITS, LENGTH = range(14)
WIDE = 14


def word_features(word: str, lexicon: dict[str, float]) -> tuple[float, ...]:
    """Features of a word, which isn't empty. Most words are letters between marks, and are told from that without a look at each character."""
    inner = word if word[0].isalnum() and word[-1].isalnum() else _EDGE.sub("", word)
    low = inner.lower()
    insult = low in INSULTS
    if inner.isalpha():
        letters, digits, masked = len(inner), 0, _REPEAT.search(low) is not None
    else:
        letters, digits = sum(map(str.isalpha, word)), sum(map(str.isdigit, word))
        masked = letters > 0 and (len(inner) != sum(map(str.isalpha, inner)) or _REPEAT.search(low) is not None)
    upper = 0 if word.islower() else sum(map(str.isupper, word))
    if insult:
        hidden = False
    elif inner is word and letters == len(word):  # nothing to undo but stretched letters
        hidden = masked and undisguised(word) in INSULTS
    else:
        hidden = undisguised(word) in INSULTS
    start = 0.0
    for k in STARTS:
        if len(low) <= k:
            break
        start = max(start, lexicon.get(low[:k], 0.0))
    marks = len(word) - letters - digits
    return (
        insult, hidden, lexicon.get("=" + low, 0.0), start, low in SECOND,
        letters > 1 and upper == letters, upper, letters, marks, word.count("!") if marks else 0, word.count("?") if marks else 0, masked, digits, len(word),
    )


def _table(lexicon: dict[str, float]) -> ChunkTable:
    def encode(chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = [word_features(c.decode("utf-8"), lexicon) for c in chunks]
        return [(np.array(rows, np.float32).ravel(), np.full(len(rows), WIDE, np.int64))]

    return ChunkTable(encode, (np.float32,), max_entries=200_000)


_KEPT: dict[str, ChunkTable] = {}


def _table_of(lexicon: dict[str, float]) -> ChunkTable:
    """The worker's table for a lexicon; one is kept, over tasks."""
    name = hashlib.sha256(repr(sorted(lexicon.items())).encode()).hexdigest()
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = _table(lexicon)
    return _KEPT[name]


kept_by("toxicity", _KEPT.clear)
FEATURES = 21


def text_features(texts: list[bytes], table: ChunkTable) -> np.ndarray:
    """A row of dense features for each text."""
    out = np.zeros((len(texts), FEATURES))
    buf = b"\n".join(texts)
    data = np.frombuffer(buf, np.uint8)
    if not len(data):
        return out
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return out
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    rows = table.rows_of(buf, starts, ends)
    w = table.values[0][: table.n * WIDE].reshape(-1, WIDE)[rows]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lens + 1) - lens - 1
    of = np.searchsorted(begins, starts, "right") - 1
    n = np.bincount(of, minlength=len(texts)).astype(float)
    total = np.stack([np.bincount(of, w[:, k], len(texts)) for k in range(WIDE)], 1)
    some = np.maximum(n, 1)
    chars = np.maximum(total[:, LENGTH], 1)
    hit = (w[:, INSULT] + w[:, HIDDEN] > 0) | (np.maximum(w[:, WORD], w[:, START]) > 2)
    top = np.zeros((len(texts), 2))
    for k, c in enumerate((WORD, START)):
        np.maximum.at(top[:, k], of, w[:, c])
    near = np.zeros(len(texts))
    hits, you = np.flatnonzero(hit), np.flatnonzero(w[:, YOU] > 0)
    if len(hits) and len(you):
        i = np.searchsorted(you, hits)
        for side in (np.maximum(i - 1, 0), np.minimum(i, len(you) - 1)):
            gap = np.abs(you[side] - hits)
            ok = (of[you[side]] == of[hits]) & (gap <= 8)
            np.maximum.at(near, of[hits[ok]], 1 / (1 + gap[ok]))
    out[:, 0:7] = total[:, [INSULT, HIDDEN, WORD, START, YOU, CAPS, MASKED]] / some[:, None]
    out[:, 7:12] = total[:, [UPPER, MARKS, CRIES, ASKS, DIGITS]] / chars[:, None]
    out[:, 12:14] = top
    out[:, 14] = near
    out[:, 15:17] = total[:, [INSULT, HIDDEN]]
    out[:, 17] = np.bincount(of, w[:, WORD] > 1, len(texts))
    out[:, 18] = np.bincount(of, w[:, START] > 1, len(texts))
    out[:, 19] = np.log1p(n)
    out[:, 20] = out[:, 17:19].sum(1) / some
    return out


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, curve: Isotonic | None):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return 1 - np.exp(-100 * (x[:, 0] + x[:, 1]))
        return np.clip(self.curve.apply(self.trees.margin(x)), 0, 1)


def _fold(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 >> 7) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """doc_id, y, text of at most ``most`` labelled rows, written to the shared folder."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.where(allowed).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(own.join(F.broadcast(chosen), "doc_id"), "labelled")  # at most ``most`` narrow rows


def _lexicons(rows: DataFrame, entries: int) -> list[dict[str, float]]:
    """For each fold the lexicon of the others, then that of all: items typical of label 1 with their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        docs = [0] * (2 * FOLDS)
        for batch in batches:
            for doc, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                at = 2 * _fold(doc) + (1 if y else 0)
                docs[at] += 1
                for item in {i for w in set(text.split()) for i in items(bare(w))}:
                    found.setdefault(item, [0] * (2 * FOLDS))[at] += 1
            if len(found) > 60_000:
                yield pa.RecordBatch.from_pydict({"item": list(found), "n": list(found.values())}, schema)
                found = {}
        found[""] = docs
        yield pa.RecordBatch.from_pydict({"item": list(found), "n": list(found.values())}, schema)

    schema = pa.schema([("item", pa.string()), ("n", pa.list_(pa.int64()))])
    sums = [F.sum(F.element_at("n", k + 1)).alias(f"n{k}") for k in range(2 * FOLDS)]
    counts = rows.select("doc_id", "y", "text").mapInArrow(tidy(count), "item string, n array<long>").groupBy("item").agg(*sums)
    ones, zeros = (sum((F.col(f"n{2 * k + c}") for k in range(FOLDS)), F.lit(0)) for c in (1, 0))
    typical = counts.withColumn("ones", ones).withColumn("zeros", zeros)
    total = typical.where("item = ''").first()
    if total is None or not total.ones or not total.zeros:
        return []
    ratio = F.log((F.col("ones") + 0.5) / (total.ones + 1)) - F.log((F.col("zeros") + 0.5) / (total.zeros + 1))
    top = typical.where((F.col("item") != "") & (F.col("ones") >= 2) & (ratio > 1)).orderBy(F.desc(ratio * F.sqrt("ones")), "item").limit(entries).collect()
    out = []
    for left in [*range(FOLDS), None]:
        use = [k for k in range(FOLDS) if k != left]
        n1, n0 = (sum(total[f"n{2 * k + c}"] for k in use) for c in (1, 0))
        lexicon = {}
        for r in top:
            a, b = (sum(r[f"n{2 * k + c}"] for k in use) for c in (1, 0))
            odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
            if a >= 2 and odds > 1:
                lexicon[r["item"]] = odds
        out.append(lexicon)
    return out


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", most: int = 20_000, entries: int = 8_000) -> Model:
    rows = training_rows(docs, labels, label, allowed, most)
    lexicons = _lexicons(rows, entries)
    if not lexicons:
        return Model({}, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_table(x) for x in lexicons[:FOLDS]]
        for batch in batches:
            doc, y, texts = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), byte_list(batch.column("text"))
            for k in range(FOLDS):
                own = [i for i, d in enumerate(doc) if _fold(d) == k]
                for a, b in steps([texts[i] for i in own]):
                    x = text_features([texts[i] for i in own[a:b]], tables[k])
                    yield pa.RecordBatch.from_pydict({"k": [k] * len(x), "y": [y[i] for i in own[a:b]], "doc": [doc[i] for i in own[a:b]], "x": x.tolist()}, schema)

    schema = pa.schema([("k", pa.int64()), ("y", pa.int64()), ("doc", pa.int64()), ("x", pa.list_(pa.float64()))])
    got = rows.mapInArrow(tidy(run), "k long, y long, doc long, x array<double>").toArrow()  # features of at most ``most`` rows
    if not got.num_rows:
        return Model({}, None, None)
    order = np.argsort(got.column("doc").to_numpy(), kind="stable")
    x = np.array(got.column("x").to_pylist())[order]
    y, k = got.column("y").to_numpy()[order].astype(float), got.column("k").to_numpy()[order]
    if y.min() == y.max():
        return Model({}, None, None)
    return Model(lexicons[-1], *calibrated(Boosted, x, y, k))


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with their score, which replaces a column of its name; other columns are kept."""
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table_of(model.lexicon)
        for batch in batches:
            texts = byte_list(batch.column("text"))
            scores = [model.score(text_features(texts[a:b], table)) for a, b in steps(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*batch.schema.names, column])

    return docs.mapInArrow(tidy(run, "toxicity"), schema)


def training_split() -> Column:
    """Rows to learn from: crc32 of the id as text isn't 1 modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, training_split())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(own, model).select("doc_id", F.coalesce(~training_split(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
