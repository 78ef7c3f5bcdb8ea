"""Operator 1: removal of long repeats by a run-length index.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a document with a smaller doc_id; matches
don't cross documents and are judged on the input.  An index of the whole corpus would have to stand in one place, so
strings are dealt out by content.  Every 50-byte string has an anchor, the least hash of its 20-byte substrings; equal
strings have equal anchors.

1. Documents are dealt into groups of bounded bytes.  Equal texts of a group are one text, known by its least doc_id.  A group
   sends the anchors of its strings, 6 bytes each and once a group, to buckets by anchor; a bucket tells each group which
   of its anchors other documents have too.
2. Runs of strings with such an anchor become segments, so that each string stands in exactly one.  As in prefix-free parsing a
   bucket's texts are then a dictionary of distinct segments (by two hashes of 64 bits) and their occurrences; a group sends a
   segment once, under its smallest doc_id, with all places where its texts have it.  Segments of very common anchors
   are cut into single strings, dealt by their own content.
3. A bucket builds run-compressed Burrows-Wheeler transforms of its dictionary, with samples at run ends and the least document of each
   50-byte interval.  A segment that only the last document of its anchor has can't be a source and isn't put in.  All segments
   are streamed through the index as patterns; their matching statistics give the strings of 50 bytes that the index has,
   and from whom.  Nothing else marks a byte: whole copies and equal segments go through the index like all others.
4. Marks return to the texts, whose bytes are cut.

Every exchange is of packed arrays, by hash; groups, buckets and tasks follow the input's bytes, so none grows with the
corpus; long texts are worked on in overlapping windows.  A group of copies sends each segment once a group, a common anchor is
split.  Anchors are told apart by 48 bits, which can only add candidates.

Null text is empty; texts under 50 bytes lose nothing; documents with equal doc_id don't remove from each other and
keep their rows; a null doc_id counts as larger than all others; extra columns pass through :func:`cut_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .run_length_index import RunLengthIndex
from .shared import byte_list, in_batches, partitions, ragged, tidy, tidy_group, tidy_pair

LENGTH = 50
GRAM = 20
#: Documents (at most 255 counted in a group) from which an anchor's strings are dealt one by one.
COMMON = 1000
#: Strings in a segment at most.
RUN = 64
#: Bytes of text in a group, about; a text is never cut between groups.
GROUP_BYTES = 4 << 20
#: Strings of a text worked on at once.
WINDOW = 1 << 17
#: Bytes of segments in an index, about; segments that share a string always meet.
INDEX_BYTES = 1 << 20
_LAST = (1 << 63) - 1
_MASK = np.uint64((1 << 48) - 1)
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[2]
    x = (x ^ (x >> np.uint64(29))) * _M[3]
    return x ^ (x >> np.uint64(32))


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (_mix(x + np.uint64(0x51ED270B)) % np.uint64(n)).astype(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (fewer places than bytes), as an aligned array."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data).data, strides=(1,)).copy()


def anchors(data: np.ndarray, lens: np.ndarray, words: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and text of each string of ``length`` bytes within a text, and its anchor (48 bits)."""
    n, ends = len(data), np.cumsum(lens)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = n - GRAM + 1
    h = words[:k] * _M[0]
    h ^= h >> np.uint64(32)
    h += words[8 : 8 + k] * _M[1]
    h ^= h >> np.uint64(29)
    h += words[12 : 12 + k]
    h *= _M[2]
    h ^= h >> np.uint64(32)
    h *= _M[3]
    h >>= np.uint64(16)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    counts = np.maximum(lens - length + 1, 0)
    doc = np.repeat(np.arange(len(lens)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + (ends - lens)[doc]
    return start, doc, h[start]


def _runs(start: np.ndarray, doc: np.ndarray, anchor: np.ndarray, most: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """First string of each run of strings with one anchor in one text, of ``most`` strings at most; and the run's strings."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    size = np.diff(at, append=len(start))
    parts = -(-size // most)
    if (parts == 1).all():
        return at, size
    first = np.repeat(at, parts) + most * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    return first, np.diff(first, append=len(start))


def _segment_hashes(words: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each segment of 8 bytes or more: its words one after another, the last one flush with its end."""
    a, b = lens.astype(np.uint64) * _M[0], lens.astype(np.uint64) * _M[1] + np.uint64(1)
    left = np.arange(len(starts))
    for d in range(0, int(lens.max(initial=0)), 8):
        left = left[lens[left] > d]
        w = words[starts[left] + np.minimum(d, lens[left] - 8)]
        x = (a[left] ^ w) * _M[2]
        a[left] = x ^ (x >> np.uint64(29))
        y = (b[left] + w) * _M[3]
        b[left] = y ^ (y >> np.uint64(31))
    return _mix(a), _mix(b)


def _distinct(h1: np.ndarray, h2: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's class of equal hashes, and of each class the row that is least by ``then``."""
    by = np.lexsort((then, h2, h1))
    new = np.concatenate([[True], (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])])[: len(by)]
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    return of, by[new]


class _Group:
    """A group's rows and its distinct texts, ordered by their least doc_id (null: larger than all) and bytes."""

    def __init__(self, table: pa.Table):
        self.table = table
        texts = [t for chunk in table.column("text").chunks for t in byte_list(chunk)]
        ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        held: dict[bytes, set[int]] = {}
        for t, d in zip(texts, ids.tolist()):
            held.setdefault(t, set()).add(d)
        self.texts = sorted(held, key=lambda t: (min(held[t]), t))
        self.least = np.fromiter((min(held[t]) for t in self.texts), np.int64, len(self.texts))
        self.docs = np.fromiter((len(held[t]) for t in self.texts), np.int64, len(self.texts))
        number = {t: k for k, t in enumerate(self.texts)}
        self.text_of = [number[t] for t in texts]
        self.later = ids > self.least[self.text_of] if texts else np.zeros(0, bool)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, lengths, text numbers and offsets of windows of texts, so that each string of ``LENGTH`` bytes is in one."""
        parts: list[tuple[bytes, int, int]] = []
        size = 0
        for k, t in enumerate(self.texts):
            for a in range(0, max(len(t) - LENGTH + 1, 0), WINDOW):
                part = t if len(t) <= WINDOW else t[a : a + WINDOW + LENGTH - 1]
                parts.append((part, k, a))
                size += len(part)
                if size >= WINDOW:
                    yield self._joined(parts)
                    parts, size = [], 0
        if parts:
            yield self._joined(parts)

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lens, number, offset = (np.fromiter(x, np.int64, len(parts)) for x in ((len(p[0]) for p in parts), (p[1] for p in parts), (p[2] for p in parts)))
        return np.frombuffer(b"".join(p[0] for p in parts), np.uint8), lens, number, offset


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("anchors", pa.binary()), ("counts", pa.binary())])
_SHARED = pa.schema([("g", pa.int64()), ("anchors", pa.binary()), ("common", pa.binary())])
_SEGMENTS = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("key", pa.binary()), ("docs", pa.binary()), ("lens", pa.binary()), ("text", pa.binary()), ("size", pa.int64()), ("of", pa.binary()), ("rows", pa.binary()), ("at", pa.binary())])
_MARKS = pa.schema([("g", pa.int64()), ("marks", pa.binary()), ("size", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _send_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        group = _Group(table)
        seen = []
        for data, lens, number, _ in group.windows():
            start, doc, anchor = anchors(data, lens, _words(data))
            first, _ = _runs(start, doc, anchor, _LAST)
            x, d = anchor[first], number[doc[first]]
            by = np.lexsort((d, x))
            x, d = x[by], d[by]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])
            seen.append((x[new], d[new]))
        if not seen:
            return _batch(_ANCHORS, [])
        x, d = (np.concatenate(c) for c in zip(*seen))
        by = np.lexsort((d, x))
        x, d = x[by], d[by]
        other = np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])  # a long text's windows may repeat an anchor
        new = np.concatenate([[True], x[1:] != x[:-1]])
        own, count = x[new], np.minimum(np.add.reduceat(np.where(other, group.docs[d], 0), np.flatnonzero(new)), 255).astype(np.uint8)
        bucket = _bucket(own, buckets)
        by = np.argsort(bucket, kind="stable")
        full, at = np.unique(bucket[by], return_index=True)
        own, count, g = own[by], count[by], table.column("__g")[0].as_py()
        return _batch(_ANCHORS, [(k, g, _six(own[i:j]), count[i:j].tobytes()) for k, i, j in zip(full.tolist(), at, np.append(at[1:], len(own)))])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["bucket"], []).append(row)
    while held:
        yield held.popitem()


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for _, rows in _by_bucket(batches):
        lists = [_of_six(r["anchors"]) for r in rows]
        count = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows]).astype(np.int64)
        u, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, count, len(u))[inverse]
        at = 0
        for r, own in zip(rows, lists):
            n = total[at : at + len(own)]
            at += len(own)
            kept = n > 1
            if kept.any():
                told.setdefault(r["g"], []).append((own[kept], (n[kept] > COMMON).astype(np.uint8)))
    for g, parts in told.items():
        yield from _batch(_SHARED, [(g, b"".join(_six(x) for x, _ in parts), b"".join(y.tobytes() for _, y in parts))]).to_batches()


def _send_segments(buckets: int):
    """Occurrences go as (row, later) in ``rows`` and the place in ``at``.  Row 2k is text k in its least document, row 2k + 1 in
    larger ones; ``later`` says that the document is larger than the one that the segment is sent under."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return _batch(_SEGMENTS, [])
        group, g = _Group(table), table.column("__g")[0].as_py()
        told = _of_six(b"".join(shared.column("anchors").to_pylist()))
        common = np.frombuffer(b"".join(shared.column("common").to_pylist()), np.uint8)
        by = np.argsort(told)
        told, common = told[by], common[by].astype(bool)
        parts: list[tuple] = []
        for data, lens, number, offset in group.windows():
            words = _words(data)
            start, doc, anchor = anchors(data, lens, words)
            first, size = _runs(start, doc, anchor)
            i = np.minimum(np.searchsorted(told, anchor[first]), len(told) - 1)
            hit = told[i] == anchor[first]
            first, size, single = first[hit], size[hit], common[i[hit]]
            alone = ragged(np.arange(len(start)), first[single], size[single])  # strings of common anchors
            at = np.concatenate([first[~single], alone])
            if not len(at):
                continue
            n = np.concatenate([size[~single], np.ones(len(alone), np.int64)]) + LENGTH - 1
            s = start[at]
            h1, h2 = _segment_hashes(words, s, n)
            key = np.where(np.arange(len(at)) < len(at) - len(alone), _mix(anchor[at]), h1)
            of, kept = _distinct(h1, h2, np.arange(len(at)))  # one text for each distinct segment of a window
            body = np.zeros(len(at), bool)
            body[kept] = True
            kept = np.flatnonzero(body)
            parts.append((h1, h2, key, number[doc[at]], s - (np.cumsum(lens) - lens)[doc[at]] + offset[doc[at]], n, body, ragged(data, s[kept], n[kept])))
        if not parts:
            return _batch(_SEGMENTS, [])
        h1, h2, key, text, pos, n, body, bytes_ = (np.concatenate(x) for x in zip(*parts))
        del parts
        begin = np.cumsum(np.where(body, n, 0)) - np.where(body, n, 0)
        segment, head = _distinct(h1, h2, ~body)  # heads have bytes
        del h1, h2
        least = np.full(len(head), len(group.texts), np.int64)
        np.minimum.at(least, segment, text)
        owner = group.least[least]
        later = group.least[text] > owner[segment]
        twice = np.flatnonzero(group.docs[text] > 1)  # texts of several documents: the larger ones' own rows
        segment, pos = np.concatenate([segment, segment[twice]]), np.concatenate([pos, pos[twice]])
        row = np.concatenate([4 * text + later, 4 * text[twice] + 3]).astype(np.uint32)
        bucket = _bucket(key[head], buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(head), np.int64)
        rank[order] = np.arange(len(head))
        by = np.argsort(rank[segment], kind="stable")
        row, pos, seen = row[by], pos[by].astype(np.uint32), rank[segment[by]]
        full, at = np.unique(bucket[order], return_index=True)
        count = np.bincount(seen, minlength=len(head)).astype(np.uint32)
        out = []
        for k, i, j in zip(full.tolist(), at, np.append(at[1:], len(order))):
            some = order[i:j]
            x, y = np.searchsorted(seen, (i, j))
            joined = ragged(bytes_, begin[head[some]], n[head[some]]).tobytes()
            out.append((k, g, key[head[some]].astype(np.uint32).tobytes(), owner[some].tobytes(), n[head[some]].astype(np.uint8).tobytes(), pa.compress(joined, "zstd", asbytes=True), len(joined), count[i:j].tobytes(), row[x:y].tobytes(), pos[x:y].tobytes()))
        return _batch(_SEGMENTS, out)

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[np.ndarray]] = {}
    for _, rows in _by_bucket(batches):
        docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
        lens = np.concatenate([np.frombuffer(r["lens"], np.uint8) for r in rows]).astype(np.int64)
        key = np.concatenate([np.frombuffer(r["key"], np.uint32) for r in rows])
        data = np.frombuffer(b"".join(pa.decompress(r["text"], r["size"], "zstd", asbytes=True) for r in rows), np.uint8)
        of = np.repeat(np.arange(len(docs)), np.concatenate([np.frombuffer(r["of"], np.uint32) for r in rows]))
        row, at = (np.concatenate([np.frombuffer(r[c], np.uint32) for r in rows]) for c in ("rows", "at"))
        sender = np.repeat(np.array([r["g"] for r in rows]), [len(r["rows"]) // 4 for r in rows])
        del rows
        starts = np.cumsum(lens) - lens
        parts = -(-len(data) // INDEX_BYTES)
        part = (_mix(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        for k in range(parts):
            own = part == k
            if not own.any():
                continue
            occ = np.flatnonzero(own[of])
            marks, whose = _marks_of(ragged(data, starts[own], lens[own]), lens[own], docs[own], key[own], (np.cumsum(own) - 1)[of[occ]], (row[occ] & 1).astype(bool))
            whose = occ[whose]
            marks = np.stack([row[whose] >> np.uint32(1), at[whose] + marks[0], marks[1]]).astype(np.uint32)
            g = sender[whose]
            by = np.lexsort((marks[0], g))
            full, cut = np.unique(g[by], return_index=True)
            for x, i, j in zip(full.tolist(), cut, np.append(cut[1:], len(by))):
                found.setdefault(x, []).append(marks[:, by[i:j]])
    for g, marks in found.items():
        joined = np.concatenate(marks, 1).tobytes()
        yield from _batch(_MARKS, [(g, pa.compress(joined, "zstd", asbytes=True), len(joined))]).to_batches()


def _runs_of(text: np.ndarray, start: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts in a text: first, size, and for each text where its runs begin (one more than texts)."""
    by = np.lexsort((start, text))
    text, start = text[by], start[by]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)])) if len(text) else np.zeros(0, np.int64)
    return start[new], np.diff(new, append=len(text)), np.searchsorted(text[new], np.arange(texts + 1))


def _marks_of(data: np.ndarray, lens: np.ndarray, docs: np.ndarray, key: np.ndarray, of: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks (start, size) in segments' occurrences, and the occurrence that each is of.

    ``data``, ``lens``, ``docs``, ``key``: segments as sent, the smallest document that the sender has them in, and 32 bits that their anchor
    gives; ``of``: the segment of each occurrence; ``later``: whether it is in a larger document than that.
    """
    starts = np.cumsum(lens) - lens
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    distinct, head = _distinct(*_segment_hashes(_words(padded), starts, lens), docs)
    own, size = docs[head], lens[head]
    beyond = later | (docs[of] > own[distinct[of]])  # the occurrence is in a larger document than the segment's first
    source = np.zeros(len(head), bool)
    source[distinct[of[beyond]]] = True
    by = np.lexsort((own, key[head]))
    k, o = key[head][by], own[by]
    last = np.append(np.flatnonzero(k[1:] != k[:-1]), len(k) - 1)
    source[by] |= o < o[last[np.searchsorted(last, np.arange(len(k)))]]
    kept = np.flatnonzero(source)
    index = RunLengthIndex(ragged(data, starts[head[kept]], size[kept]), size[kept], own[kept], LENGTH)
    text, start, owner = index.matches(ragged(data, starts[head], size), size)
    before = owner < own[text]
    known = owner <= own[text]
    marks, whose = [], []
    for chosen, some in ((before, np.flatnonzero(~beyond)), (known, np.flatnonzero(beyond))):
        first, count, begins = _runs_of(text[chosen], start[chosen], len(head))
        d = distinct[of[some]]
        runs = begins[d + 1] - begins[d]
        each = ragged(np.arange(len(first)), begins[d], runs)
        marks.append(np.stack([first[each], count[each] + LENGTH - 1]))
        whose.append(np.repeat(some, runs))
    return np.concatenate(marks, 1), np.concatenate(whose)


def removed_bytes(size: int, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(starts + lens, minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def _cut(each):
    """``each``: text and mask of removed bytes (None: nothing) -> a row's added values."""

    def run(table: pa.Table, marks: pa.Table) -> tuple[pa.Table, list[tuple]]:
        group = _Group(table)
        packed = zip(marks.column("marks").to_pylist(), marks.column("size").to_pylist())
        row, start, size = np.concatenate([np.zeros((3, 0), np.uint32), *(np.frombuffer(pa.decompress(m, n, "zstd", asbytes=True), np.uint32).reshape(3, -1) for m, n in packed)], 1).astype(np.int64)
        by = np.argsort(row, kind="stable")
        row, start, size = row[by], start[by], size[by]
        at = np.searchsorted(row, np.arange(2 * len(group.texts) + 1)).tolist()
        done: dict[int, tuple] = {}
        for r in {2 * t + bool(x) for t, x in zip(group.text_of, group.later)}:
            text, i, j = group.texts[r // 2], at[r], at[r + 1]
            done[r] = each(text, removed_bytes(len(text), start[i:j], size[i:j]) if i < j else None)
        return table.drop_columns(["__g"]), [done[2 * t + bool(x)] for t, x in zip(group.text_of, group.later)]

    return run


def _marked(docs: DataFrame, finish, schema: T.StructType) -> DataFrame:
    """Group the documents, find the marks, and hand both to ``finish``."""
    in_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(docs.sparkSession)
    tasks = max(n, -(-size // (2 * GROUP_BYTES)))
    spread = F.xxhash64("doc_id", "text", F.pmod(F.monotonically_increasing_id(), F.lit(16)))  # rows with one id, or without, aren't one group
    grouped = docs.withColumn("__g", F.pmod(spread, F.lit(2 * tasks))).repartition(tasks, "__g")
    sent = grouped.groupBy("__g").applyInArrow(tidy_group(_send_anchors(tasks)), _ddl(_ANCHORS))
    shared = sent.repartition(tasks, "bucket").mapInArrow(tidy(_share), _ddl(_SHARED))
    segments = grouped.groupBy("__g").cogroup(shared.groupBy("g")).applyInArrow(tidy_pair(_send_segments(tasks)), _ddl(_SEGMENTS))
    marks = segments.repartition(tasks, "bucket").mapInArrow(tidy(_mark), _ddl(_MARKS))
    return grouped.groupBy("__g").cogroup(marks.groupBy("g")).applyInArrow(tidy_pair(finish), schema)


def _typed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def each(text: bytes, gone: np.ndarray | None) -> tuple:
        if gone is None:
            return (len(text), 0, 0, hashlib.sha256(text).hexdigest())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return (len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())

    cut = _cut(each)
    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        own, rows = cut(table, marks)
        return pa.table({"doc_id": own.column("doc_id"), **{k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(types.items())}})

    return _marked(_typed(docs).select("doc_id", "text"), finish, T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def cut_repeats(docs: DataFrame, length_column: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, with repeats cut from their texts; a character goes if all its bytes do.  Null stays null."""

    def each(text: bytes, gone: np.ndarray | None) -> tuple:
        if gone is None:
            return (None,)
        data = np.frombuffer(text, np.uint8)
        first = (data & 0xC0) != 0x80
        gone = np.logical_and.reduceat(gone, np.flatnonzero(first))[np.cumsum(first) - 1]
        return (data[~gone].tobytes().decode("utf-8"),)

    cut = _cut(each)

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        own, rows = cut(table, marks)
        text = own.column("text").combine_chunks()
        new = pa.array([t if c is None else c for t, (c,) in zip(text.to_pylist(), rows)], pa.string())
        return own.set_column(own.column_names.index("text"), "text", new).select(own.column_names)

    typed = _typed(docs)
    out = _marked(typed, finish, typed.schema).select(*docs.columns)
    if length_column in docs.columns:
        out = out.withColumn(length_column, F.coalesce(F.length("text"), F.col(length_column)).cast(docs.schema[length_column].dataType))
    return out
