"""Operator 9: best-fit packing by a grouping genetic algorithm on islands.

A document is its ids and an end id; only documents longer than a sequence are cut, into full pieces and a rest.  Full
pieces are sequences of their own.  The rest is a bin-packing problem, dealt by hash into problems of bounded size.
Each problem is solved by several islands, tasks of their own: a population of packings, grouped by bins; crossover puts
well-filled bins of one parent into a copy of the other, takes out bins that hold the same pieces twice, swaps displaced
pieces into bins that they fill better, and best-fits the rest.  Between epochs every island's best packing migrates to the next island of its problem.  Then the
best island of each problem wins, its bins below ``full`` are opened, and their pieces are dealt and packed again.

Only narrow piece rows are shuffled, never texts; a problem's size doesn't grow with the corpus.  Null and empty texts are the end
id alone.  Rows with equal doc_id stay separate documents; null doc_ids are kept; an empty table gives no rows; other columns
aren't read.  Seeds are fixed, so equal rows in equal partitions give equal sequences.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import encode_words
from .shared import byte_list, materialize, partitions, steps, tidy, with_text

CAPACITY = 4096


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            texts, docs = byte_list(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in steps(texts):
                ids, n = encode_words(texts[a:b], tokenizer)
                ids, at = ids.astype("<u4"), np.concatenate([[0], np.cumsum(n)]).tolist()
                rows = []
                for doc, i, j in zip(docs[a:b], at, at[1:]):
                    own = np.concatenate([ids[i:j], end])
                    for k in range(0, len(own), capacity):
                        part = own[k : k + capacity]
                        rows.append((doc, k // capacity, k, len(part), zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return with_text(docs).mapInArrow(tidy(run, "words"), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.fill = [sum(map(sizes.__getitem__, b)) for b in self.bins]

    def best_fit(self, items: list[int]) -> Packing:
        """Put each item, in order, into the fullest bin that still takes it."""
        room = sorted((self.capacity - f, k) for k, f in enumerate(self.fill))
        for i in items:
            size = self.sizes[i]
            at = bisect.bisect_left(room, (size, -1))
            if at == len(room):
                self.bins.append([i])
                self.fill.append(size)
                left, k = self.capacity - size, len(self.bins) - 1
            else:
                left, k = room.pop(at)
                self.bins[k].append(i)
                self.fill[k] += size
                left -= size
            if left:
                bisect.insort(room, (left, k))
        return self

    def exchange(self, loose: list[int]) -> list[int]:
        """Swap an item of a bin with room for one or two loose ones that fill it better; returns what is loose then."""
        free = sorted((self.sizes[i], i) for i in loose)
        for k, b in enumerate(self.bins):
            room = self.capacity - self.fill[k]
            if not room or not free:
                continue
            best: tuple[int, int, tuple] = (0, -1, ())
            for at, i in enumerate(b):
                least, most = self.sizes[i], self.sizes[i] + room
                one = bisect.bisect_right(free, (most, len(self.sizes))) - 1
                if one >= 0 and free[one][0] - least > best[0]:
                    best = (free[one][0] - least, at, (one,))
                for x in range(max(0, one - 63), one + 1):  # pairs with one of the largest that fit
                    y = min(bisect.bisect_right(free, (most - free[x][0], len(self.sizes))) - 1, x - 1)
                    if y >= 0 and free[x][0] + free[y][0] - least > best[0]:
                        best = (free[x][0] + free[y][0] - least, at, (x, y))
                if best[0] == room:
                    break
            if best[2]:
                out = b.pop(best[1])
                b += [free[x][1] for x in best[2]]
                for x in best[2]:
                    free.pop(x)
                bisect.insort(free, (self.sizes[out], out))
                self.fill[k] += best[0]
        return [i for _, i in reversed(free)]

    @property
    def merit(self) -> tuple[int, float]:
        """Fewer bins, then fuller full bins."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fill)

    def crossed(self, other: Packing, rng: random.Random) -> Packing:
        """Inject some of the other's well-filled bins; drop own bins that share their items; best-fit what is displaced."""
        ranked = sorted(range(len(other.bins)), key=lambda k: -other.fill[k])
        ranked = ranked[: max(1, len(ranked) // 2)]
        injected = [other.bins[k] for k in rng.sample(ranked, max(1, int(len(ranked) * rng.uniform(0.2, 0.8))))]
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in self.bins:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        child = Packing(self.sizes, self.capacity, [list(b) for b in injected] + kept)
        return child.best_fit(child.exchange(displaced))

    def mutated(self, rng: random.Random) -> Packing:
        """Open the emptiest bins and a few others, and best-fit their items."""
        ranked = sorted(range(len(self.bins)), key=self.fill.__getitem__)
        opened = {*ranked[: 1 + len(ranked) // 50], *rng.sample(ranked, min(len(ranked), 1 + len(ranked) // 20))}
        loose = [i for k in opened for i in self.bins[k]]
        child = Packing(self.sizes, self.capacity, [list(b) for k, b in enumerate(self.bins) if k not in opened])
        return child.best_fit(child.exchange(loose))


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int, population: int = 4) -> Packing:
    """The best packing after some generations of one island."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [Packing(sizes, capacity, [list(b) for b in e]) for e in elites]
    if not people:
        people.append(Packing(sizes, capacity).best_fit(order))
    while len(people) < population and len(people[0].bins) > least:
        people.append(Packing(sizes, capacity).best_fit(sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.3))))
    people.sort(key=lambda p: p.merit, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least or len(people) < 2:
            break
        a, b = rng.sample(people, 2)
        people.append(a.crossed(b, rng))
        people.append(people[0].mutated(rng))
        people.sort(key=lambda p: p.merit, reverse=True)
        del people[population:]
    return people[0]


_PROBLEM = pa.schema([("g", pa.int64()), ("items", pa.binary()), ("sizes", pa.binary())])
_ISLAND = pa.schema([*_PROBLEM, ("island", pa.int32()), ("bins", pa.binary()), ("count", pa.int64()), ("merit", pa.float64())])
_ISLAND_DDL = "g long, items binary, sizes binary, island int, bins binary, count long, merit double"


def _gather(table: pa.Table) -> pa.Table:
    t = table.sort_by([("item", "ascending")])
    return pa.table([[t.column("g")[0].as_py()], [t.column("item").to_numpy().tobytes()], [t.column("size").to_numpy().tobytes()]], schema=_PROBLEM)


def _to_bins(numbers: bytes) -> list[list[int]]:
    of = np.frombuffer(numbers, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _island(capacity: int, epoch: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault((row["g"], row["island"]), []).append(row)
        for (g, island), rows in held.items():
            sizes = np.frombuffer(rows[0]["sizes"], np.int64).tolist()
            elites = [_to_bins(r["bins"]) for r in sorted(rows, key=lambda r: (-r["count"], r["merit"]), reverse=True) if r["bins"]]
            best = evolve(sizes, capacity, 7919 * g + 31 * island + epoch, elites, generations)
            of = np.zeros(len(sizes), np.int32)
            for k, b in enumerate(best.bins):
                of[b] = k
            yield pa.RecordBatch.from_pylist([{"g": g, "items": rows[0]["items"], "sizes": rows[0]["sizes"], "island": island, "bins": of.tobytes(), "count": len(best.bins), "merit": best.merit[1]}], _ISLAND)

    return run


def solve(items: DataFrame, problems: int, capacity: int = CAPACITY, islands: int = 3, epochs: int = 2, generations: int = 10) -> DataFrame:
    """``items`` (item, size).  g, item, size, bin, fill: a packing of each problem."""
    n = partitions(items.sparkSession)
    dealt = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(problems)), F.lit(problems)))
    problem = dealt.groupBy("g").applyInArrow(_gather, "g long, items binary, sizes binary")
    now = problem.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("binary").alias("bins"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("merit"))
    for epoch in range(epochs):
        now = now.repartition(max(n, min(problems * islands, 4 * n)), "g", "island").mapInArrow(tidy(_island(capacity, epoch, generations)), _ISLAND_DDL)
        if epoch + 1 < epochs:  # the best of each island stays and goes to the next
            now = now.withColumn("to", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands))))).withColumn("island", F.col("to")).drop("to")

    def choose(table: pa.Table) -> pa.Table:
        rows = table.select(["island", "count", "merit"]).to_pylist()
        k = min(range(len(rows)), key=lambda i: (rows[i]["count"], -rows[i]["merit"], rows[i]["island"]))
        row = table.slice(k, 1).to_pylist()[0]
        size, of = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bins"], np.int32)
        return pa.table({"g": np.full(len(of), row["g"]), "item": np.frombuffer(row["items"], np.int64), "size": size, "bin": of.astype(np.int64), "fill": np.bincount(of, size).astype(np.int64)[of]})

    return now.groupBy("g").applyInArrow(choose, "g long, item long, size long, bin long, fill long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, in_problem: int = 3000, full: float = 0.999) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    all_pieces = materialize(pieces(docs, tokenizer, end_id, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    rest = all_pieces.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
    count = rest.count()
    whole = all_pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("item") + F.lit(1 << 61), "offset": F.lit(0).cast("long")})
    if not count:
        return whole.drop("item")
    first = materialize(solve(rest, max(1, count // in_problem), capacity), "packing")
    good = F.col("fill") >= int(full * capacity)
    again = first.where(~good).select("item", "size")
    left = again.count()
    found = first.where(good).select("item", "size", (F.col("g") * (1 << 24) + F.col("bin")).alias("sequence_id"))
    if left:
        second = solve(again, max(1, left // in_problem), capacity)
        found = found.unionByName(second.select("item", "size", (F.col("g") * (1 << 24) + F.col("bin") + F.lit(1 << 60)).alias("sequence_id")))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("item", pa.int64()), ("size", pa.int64()), ("sequence_id", pa.int64())]))
        s, item, size = (table.column(c).to_numpy() for c in ("sequence_id", "item", "size"))
        order = np.lexsort((item, s))
        s, item, size = s[order], item[order], size[order]
        before = np.cumsum(size) - size
        first = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
        start = before[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))] if len(s) else before
        yield pa.RecordBatch.from_pydict({"item": item, "sequence_id": s, "offset": before - start})

    n = partitions(docs.sparkSession)
    placed = found.repartition(n, "sequence_id").mapInArrow(tidy(offsets), "item long, sequence_id long, offset long")
    return all_pieces.join(placed, "item").drop("item").unionByName(whole.drop("item"))
