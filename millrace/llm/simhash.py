"""Operator 5: SimHash near-dedup by multi-index hashing.

A fingerprint has one bit for each bit of a 64-bit shingle hash: 1 if set in over half of the text's shingles.  Two
fingerprints link at 3 or fewer differing bits.  Of the two 32-bit halves one then differs by at most one bit, so a
fingerprint is filed under each half (the tables) and asks the tables for the ball of radius one around each half;
of two halves that differ in one bit, the one with that bit clear asks.  Matches are held against the whole distance.
Other radii go the same way with more, shorter parts: at a radius under twice their number one part differs by at most one bit.

Equal fingerprints are one class first, so copies never meet each other.  Table and query entries travel as packed
arrays, a row for each bucket and batch.  A bucket links its fingerprints by a spanning forest, not by all pairs; the
forests' edges go through distributed components.  Nothing is gathered on the driver.

Texts: A-Z lower-cased, words are runs other than bytes 0x20 and 0x09 to 0x0D; null and wordless texts have
fingerprint zero, which links like any other; with fewer words than a shingle the whole sequence is one shingle.
Rows with equal doc_id stay separate rows of one node: a document with several texts links their fingerprints; a row without doc_id gets its fingerprint and, unless rows with
ids share it, a null component.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import byte_list, materialize, partitions, tidy, with_text

RADIUS, PARTS = 3, 2


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(a), 1 << 15):
        digests = b"".join([xxh64_digest(joined[x:y], seed) for x, y in zip(a[i : i + (1 << 15)], b[i : i + (1 << 15)])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in byte_list(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return with_text(docs).mapInArrow(tidy(run), "doc_id long, fp long")


def _entries(fp: np.ndarray, node: np.ndarray, parts: int = PARTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys (part's number above its bits, at most 32), fingerprints, nodes, and whether the entry asks."""
    ends = [64 * k // parts for k in range(parts + 1)]
    for part, (low, high) in enumerate(zip(ends, ends[1:])):
        own = (fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        top = np.uint64(part << 32)
        yield own | top, fp, node, np.zeros(len(fp), np.uint8)
        for j in range(high - low):
            bit = np.uint64(1 << j)
            asks = (own & bit) == 0
            yield own[asks] | bit | top, fp[asks], node[asks], np.ones(int(asks.sum()), np.uint8)


def _mix(key: np.ndarray) -> np.ndarray:
    key = key * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(32))) * np.uint64(0xD1342543DE82EF95) >> np.uint64(33)


def links_in_bucket(key: np.ndarray, fp: np.ndarray, node: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (nodes) that connect all fingerprints of a bucket that share a key and lie within the radius."""
    order = np.lexsort((asks, key))
    key, fp, node, asks = key[order], fp[order], node[order], asks[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    filed = np.bincount(group, asks == 0)
    keep = (size[group] > 1) & (filed[group] > 0)
    key, fp, node, asks = key[keep], fp[keep], node[keep], asks[keep]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(key):
        ids, who = np.unique(node, return_inverse=True)
        parent = np.arange(len(ids))
        left = np.arange(len(key))
        d = 1
        while len(left := left[left + d < len(key)]) and len(left := left[key[left] == key[left + d]]):
            i = left[asks[left] == 0]  # table entries stand first in a group
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            a, b = who[i], who[i + d]
            while len(a):
                ra, rb = parent[a], parent[b]
                differ = ra != rb
                a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
                if not len(a):
                    break
                hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
                hook, at = np.unique(hi, return_index=True)  # each root is hooked once: by the edge that did it
                found.append((ids[a[at]], ids[b[at]]))
                parent[hook] = lo[at]
                while (parent != (up := parent[parent])).any():
                    parent = up
            d += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def links(classes: DataFrame, buckets: int | None = None, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """``classes`` (fp, node), distinct.  Edges (a, b, apart: differing bits) of a graph with the same components as all links."""
    if not 2 <= parts <= 64 or radius >= 2 * parts:
        raise ValueError("the radius must be under twice the number of parts")
    n = buckets or partitions(classes.sparkSession)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, node, asks = (np.concatenate(x) for x in zip(*_entries(batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy(), parts)))
            bucket = (_mix(key) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(n + 1))
            packed = [x[order] for x in (key, fp, node, asks)]
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), *(pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()) for x in packed)], names=["bucket", "key", "fp", "nodes", "asks"]
            )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["bucket"], []).append([np.frombuffer(row[c], t) for c, t in (("key", np.uint64), ("fp", np.uint64), ("nodes", np.int64), ("asks", np.uint8))])
        for found in held.values():
            key, fp, node, asks = (np.concatenate(x) for x in zip(*found))
            a, b = links_in_bucket(key, fp, node, asks, radius)
            if len(a):
                ids, at = np.unique(node, return_index=True)
                apart = np.bitwise_count(fp[at[np.searchsorted(ids, a)]] ^ fp[at[np.searchsorted(ids, b)]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart)], names=["a", "b", "apart"])

    filed = classes.mapInArrow(tidy(file), "bucket long, key binary, fp binary, nodes binary, asks binary")
    return filed.repartition(n, "bucket").mapInArrow(tidy(look), "a long, b long, apart long")


def near_copies(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links)."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    known = prints.where("doc_id is not null")
    classes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    several = known.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    shared = known.join(several, "doc_id", "left_semi").distinct().join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(links(classes).select("a", "b").unionByName(shared))
    of = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
