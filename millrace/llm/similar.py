"""Near copies by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and all that such links join.

Links are sought by SimHash first, as in operator 5: its fingerprints of three-word shingles, filed in five parts of 12 or 13 bits, each
asked in a ball of radius one, the whole distance held to 9 bits, so that no two fingerprints within it are missed; buckets give
forests, and each node's nearest edge of these is verified on the exact sets.  But a fingerprint only estimates: two texts at 0.8 may differ in
more bits (10, give or take 3, in the worst case), and the edges verified are not all pairs.

So min-hashes, 40 bands of 5, join what SimHash leaves apart.  Two texts at 0.8 share fewer than two bands with
probability 3e-6 (less above 0.8); that is the only loss.  Every link is verified on the exact sets.

Equal texts are one node.  With the edges of SimHash each node is held against its best of the bands' hubs; from then on only keys are
looked at in which components still meet.  A node of which too many shingles occur in
no other node that may still have links can't reach the similarity with any, so it is left out, exactly; this and a second look at
hubs, now the nodes that share most with others, go before the last step.  There nodes are filed again in 357 bands of 15, and pairs that share one, lie in
different components and can be alike by these counts are verified.  So a large group of near copies is joined by few pairs, not by all, and
its far members are ruled out without pairs.

Texts: as in simhash, A-Z lower-cased, words between bytes 0x20 and 0x09 to 0x0D; fewer than five words are one shingle; null and
wordless texts have the empty set and are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import byte_list, materialize, partitions, tidy
from .simhash import fingerprint
from .simhash import links as print_links

SHINGLE, BANDS, ROWS = 5, 40, 5
#: Differing bits of two fingerprints that SimHash may link, and the parts in which these are filed.
PRINT_RADIUS, PRINT_PARTS = 9, 5
#: Rounds in which nodes that may still have links are held against the middle of their bands.
ROUNDS = 1
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Longer bands for nodes that are left after the rounds: a pair at 0.8 shares none of them with probability 3e-6.
LONG_BANDS, LONG_ROWS = 357, 15


def _draws(seed: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    draw = np.random.default_rng(seed)
    times = draw.integers(0, 1 << 63, bands * rows, np.uint64) << np.uint64(1) | np.uint64(1)
    return times, draw.integers(0, 1 << 63, bands * rows, np.uint64), rows


_SHORT, _LONG = _draws(42, BANDS, ROWS), _draws(43, LONG_BANDS, LONG_ROWS)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digests = b"".join([xxh64_digest(joined[x:y]) for x, y in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())])
    return np.unique(np.frombuffer(digests, np.uint64))


def band_keys(shingles: np.ndarray, draws: tuple[np.ndarray, np.ndarray, int] = _SHORT) -> np.ndarray:
    times, plus, rows = draws
    low = np.full(len(times), (1 << 64) - 1, np.uint64)
    step = 51_200 // len(times) + 1
    for i in range(0, len(shingles), step):
        np.minimum(low, (shingles[i : i + step, None] * times + plus).min(0), out=low)
    key = np.arange(1, len(times) // rows + 1, dtype=np.uint64)
    for row in low.reshape(-1, rows).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, sorted, have the least similarity."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return LEAST[1] * shared >= LEAST[0] * (len(both) - shared)


def _signed(texts: DataFrame) -> DataFrame:
    """``texts`` (node, text).  For each node its number of shingles, fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in byte_list(batch.column("text")):
                found = shingle_set(text)
                sizes.append(len(found))
                prints.append(fingerprint(text))
                keys.append(band_keys(found))
            flat = np.concatenate([*keys, np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], names=["node", "n", "fp", "bands"])

    return texts.mapInArrow(tidy(run), "node long, n long, fp long, bands array<long>").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", "bands")))


def _by_print(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by SimHash: of forests over all fingerprints within the radius each node's nearest; equal fingerprints meet their least node."""
    classes = materialize(signed.groupBy("fp").agg(F.min("node").alias("node")), "classes")
    equal = signed.select("node", "fp").join(classes.select("fp", F.col("node").alias("b")), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    near = print_links(classes, radius=PRINT_RADIUS, parts=PRINT_PARTS)
    either = near.select(F.explode(F.array(F.struct("a", "b", "apart"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))).alias("e")).select("e.*")
    nearest = either.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("h"))
    return equal.unionByName(nearest.select("a", F.col("h.b").alias("b")))


def _best(met: DataFrame, most: int) -> DataFrame:
    """Of the pairs (a, b) of each ``a`` those that met most often."""
    return met.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("m"), "b"))).where(F.col("k") <= most).select("a", "b")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t).tobytes() for t in byte_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(tidy(run), "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("of_a", "of_b"))
            keep = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(tidy(run), "a long, b long")


def _near_size(x: str, y: str) -> F.Column:
    return LEAST[1] * F.least(x, y) >= LEAST[0] * F.greatest(x, y)


def _rooted(filed: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (key, node, n) with the root of the node's component."""
    return filed.select("key", "node", "n").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(filed: DataFrame) -> DataFrame:
    """Rows (key, root, ...) of keys in which components still meet."""
    mixed = filed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return filed.join(mixed, "key", "left_semi")


def _held(left: DataFrame, sets: DataFrame, apart: bool) -> DataFrame:
    """For each node of ``left`` its number of shingles that another node (``apart``: of another component) of ``left`` has too: no new link can share more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), lists.cast(pa.list_(pa.int64()))], names=["node", "root", "shingles"])

    nodes = left.select("node", "n", "root").distinct()
    each = nodes.join(sets, "node").select("node", "root", "shingles").mapInArrow(tidy(run), "node long, root long, shingles array<long>").select("node", "root", F.explode("shingles").alias("shingle"))
    if not apart:
        alone = each.groupBy("shingle").agg(F.count("*").alias("m"), F.min("node").alias("node")).where("m = 1").select("node")
    else:
        inner = each.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x = y").select("shingle")
        alone = each.join(inner, "shingle", "left_semi").select("node")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    return nodes.join(alone, "node", "left").select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("held"))


def _can_link(n_a: str, held_a: str, n_b: str, held_b: str) -> F.Column:
    """Whether sets of these sizes can be alike if they share at most the lesser of what they hold in common with others."""
    up, down = LEAST
    return (up + down) * F.least(held_a, held_b) >= up * (F.col(n_a) + F.col(n_b))


def _possible(left: DataFrame) -> DataFrame:
    """Rows of ``left`` whose node can be alike with the smallest set of its key; others have no link there."""
    least = left.groupBy("key").agg(F.min("n").alias("least_n"))
    return left.join(least, "key").where((LEAST[0] + LEAST[1]) * F.col("held") >= LEAST[0] * (F.col("n") + F.col("least_n"))).drop("least_n")


def _filed_again(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of ``left`` under keys of the long bands, which sets of a similarity well under 0.8 seldom share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(x, np.uint64), _LONG) for x in batch.column("shingles").to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * LONG_BANDS), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.select(["node", "n", "held", "root"]).columns, lists], names=["node", "n", "held", "root", "keys"])

    nodes = left.select("node", "n", "held", "root").distinct().join(sets, "node").repartition(max(1, partitions(left.sparkSession) // 8))
    keyed = materialize(nodes.mapInArrow(tidy(run), "node long, n long, held long, root long, keys array<long>"), "keyed")
    return keyed.select("node", "n", "held", "root", F.explode("keys").alias("key"))


def roots(texts: DataFrame, hubs: int = 3) -> DataFrame:
    """``texts`` (node, text), rows of a node with equal texts.  Returns (node, root) for the nodes that have a link."""
    signed = materialize(_signed(texts), "signed")
    by_print = materialize(_by_print(signed), "by-print")
    filed = signed.select("node", "n", F.explode("bands").alias("key"))
    groups = filed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("r"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"), F.count("*").alias("m")).where("m > 1").select("key", "h.hub", "h.hub_n")
    shared = materialize(filed.join(groups, "key"), "shared")
    ends = by_print.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = texts.join(shared.select("node").unionByName(ends).distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(_sets(wanted), "sets")

    met = shared.where("node <> hub").where(_near_size("n", "hub_n")).groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("m"))
    pairs = by_print.unionByName(_best(met, hubs)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(_verified(pairs, sets), "first-links")

    left = shared
    for k in range(ROUNDS + 1):
        left = materialize(_open(_rooted(left, links)), "open")
        left = materialize(_open(_possible(left.join(_held(left, sets, k > 0), "node"))), "possible")
        if k == ROUNDS:
            break
        middle = left.groupBy("key").agg(F.max(F.struct((F.col("held") / F.col("n")).alias("part"), "node", "n", "held", "root")).alias("h"))
        met = left.join(middle, "key").where("root <> h.root").where(_can_link("n", "held", "h.n", "h.held")).groupBy(F.col("node").alias("a"), F.col("h.node").alias("b")).agg(F.count("*").alias("m"))
        links = materialize(links.unionByName(_verified(_best(met, hubs), sets)), "links")

    again = _filed_again(left, sets)
    x, y = (again.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "held", "root"))) for s in "ab")
    pairs = x.join(y, "key").where("root_a < root_b").where(_can_link("n_a", "held_a", "n_b", "held_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    last = materialize(_verified(pairs, sets), "last-links")
    return components(links.unionByName(last))


def near_texts(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), first (smallest doc_id and node of the group): one row for each doc_id and text; rows without doc_id are left out."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text"))
    of = texts.select("doc_id", "node").distinct().join(roots(texts.select("node", "text")), "node", "left")
    of = materialize(of.select("doc_id", "node", F.coalesce("root", "node").alias("root")), "groups")
    return of.join(of.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")), "root").select("doc_id", "node", "first")
